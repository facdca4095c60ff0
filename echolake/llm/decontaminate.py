"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into features, weighted by how few passages of the whole corpus hold them. A randomised singular value
decomposition gives the latent space of the benchmark, which is what is searched for: rows are all passages of all items, weighted by the counts
of the whole corpus; products of the rows with a thin matrix are summed by feature in Spark, and only features x rank numbers reach the driver.
Overlapping windows of every document are then compared with all benchmark passages by cosine, one block of items per pass: both the cosine in the latent space and that with
the window's length before projection must reach a bound, so windows with little in that space are left early. The space has a fixed
rank however many items there are, so what it leaves is looked up in the full space as well: stretches that hold enough of an item's
rarest words (`Settings.rare` of its weight) for the check below to succeed, which no copy can lack. A candidate is checked in the words around it: the
longest common subsequence with the item, weighted like the features, must reach `Settings.same`, or `Settings.alike` where the
item's answer (its last sentence, or what follows its last question mark) is there as well.

The cosine of a leak is that in the latent space, or in the full space where only the rare words led to it.

Null and empty texts and items without words match nothing; repeated items count one by one.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, lists_of, stored, worker_cache

EDGES = b".,;:!?\"'()[]{}*#$%&|-_<>/\\~`^+="


@dataclass(frozen=True)
class Settings:
    features: int = 1 << 15
    rank: int = 96
    extra: int = 8
    window: int = 32
    step: int = 8
    cosine: float = 0.6
    share: float = 0.25
    same: float = 0.8
    alike: float = 0.6
    rare: float = 0.7
    items: int = 4096
    seed: int = 3


#: Items of fewer words than LEAST are found only where they are a whole text, others of fewer than SHORT only as they stand.
LEAST, SHORT = 5, 8


def _verbatim(item: list[bytes], region: list[bytes], alone: bool) -> bool:
    """Whether the words follow each other in the region (or are all of it)."""
    return item == region if alone else b" " + b" ".join(item) + b" " in b" " + b" ".join(region) + b" "


def words(text: str) -> list[bytes]:
    return [c for w in text.encode().lower().split() if (c := w.strip(EDGES))]


#: An odd factor of the word hash and its inverse modulo 2^64, so that words are cut out of one running sum.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
MIX = 0xFF51AFD7ED558CCD
PIECE = 1 << 20
_KIND = np.full(256, 2, np.uint8)
_KIND[list(EDGES)] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def feature_of(word: bytes, features: int) -> int:
    """The feature of a word without edge punctuation."""
    total, power = 0, 1
    for c in word:
        total += (c + 1) * power
        power = power * FACTOR % (1 << 64)
    total %= 1 << 64
    total = (total ^ total >> 33) * MIX % (1 << 64)
    return (total >> 32) % features


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache("powers")
    if len(kept.get("up", ())) < n:
        size = max(n, 1 << 14)
        for name, factor in (("up", FACTOR), ("down", INVERSE)):
            kept[name] = np.cumprod(np.append(np.uint64(1), np.full(size - 1, np.uint64(factor))), dtype=np.uint64)
    return kept["up"][:n], kept["down"]


def _piece_ids(data: bytes, features: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    core = np.flatnonzero(kind == 2)
    if not len(core):
        return np.zeros(0, np.int64)
    word = np.cumsum(kind == 0, dtype=np.int32)[core]
    new = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = core[np.append(0, new + 1)], core[np.append(new, len(core) - 1)]
    up, down = _powers(len(b))
    sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = (sums[ends] - before) * down[starts]
    h = (h ^ h >> np.uint64(33)) * np.uint64(MIX)
    return ((h >> np.uint64(32)) % np.uint64(features)).astype(np.int64)


def feature_ids(text: str, features: int) -> np.ndarray:
    """Features of the words of a text, as `feature_of` gives them, from array operations over its bytes."""
    data = text.encode().lower()
    if len(data) <= PIECE:
        return _piece_ids(data, features)
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and _KIND[data[end]]:
            end += 1
        parts.append(_piece_ids(data[at:end], features))
        at = end
    return np.concatenate(parts)


def passage_counts(df: DataFrame, s: Settings, text: str = "text") -> tuple[np.ndarray, int]:
    """How many passages (runs of `window` words) of the corpus hold each feature, and how many passages there are."""
    features, window = s.features, s.window
    schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        seen, total, held, size = np.zeros(features, np.int64), 0, [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = feature_ids(t or "", features)
                total += -(-len(ids) // window)
                key = np.sort(np.arange(len(ids)) // window * features + ids)
                held.append(key[np.append(True, key[1:] != key[:-1])] % features if len(key) else key)
                size += len(key)
                if size > 1 << 20:
                    seen += np.bincount(np.concatenate(held), minlength=features)
                    held, size = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=features)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], total))], names=["feature", "n"])

    rows = df.select(text).mapInArrow(count, schema).groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most features + 1 rows
    at, n = (rows.column(c).to_numpy() for c in ("feature", "n"))
    out = np.zeros(features, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def passages(ids: np.ndarray, window: int, step: int) -> list[np.ndarray]:
    return [ids[a : a + window] for a in range(0, max(len(ids) - window + step, 1), step)] if len(ids) else []


def latent(items: DataFrame, weights: np.ndarray, s: Settings, item_text: str) -> np.ndarray:
    """features x rank: the leading right singular vectors of the weighted passages of the whole benchmark."""
    features, window, k = s.features, s.window, s.rank + s.extra
    rows = items.select(F.col(item_text).alias("t"))

    def cut(texts):
        lists, sizes = [], []
        for t in texts:
            parts = passages(feature_ids(t, features), window, window // 2)
            lists.append(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int32))
            sizes.append([len(p) for p in parts])
        return [lists_of(np.concatenate(lists), [len(x) for x in lists]), pa.array(sizes, pa.list_(pa.int32()))]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
    cut_rows = stored(add_columns(rows, "t", fields, cut).select("ids", "sizes"), "passages")
    idf = weights.astype(np.float32)
    rng = np.random.default_rng(s.seed)
    basis = rng.standard_normal((features, k), np.float32)
    schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("v", T.ArrayType(T.FloatType()))])
    for last in (False, True):
        shared = items.sparkSession.sparkContext.broadcast(basis)  # features x k, whatever the data

        def product(batches, shared=shared):
            q = shared.value
            out = np.zeros_like(q)
            for batch in batches:
                for ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                    at = 0
                    for n in sizes:
                        own, times = np.unique(ids[at : at + n], return_counts=True)
                        at += n
                        w = idf[own] * times
                        norm = np.linalg.norm(w)
                        if norm:
                            w = (w / norm).astype(np.float32)
                            out[own] += w[:, None] * (w @ q[own])
            held = np.flatnonzero(out.any(1)).astype(np.int32)
            for a in range(0, len(held), 4096):
                part = held[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part), lists_of(out[part].ravel(), [k] * len(part))], names=["feature", "v"])

        sums = cut_rows.mapInArrow(product, schema).groupBy("feature").agg(F.array(*[F.sum(F.col("v")[i]).cast("float") for i in range(k)]).alias("v"))
        got = sums.toArrow()
        image = np.zeros((features, k), np.float32)
        for b in got.to_batches():
            image[b.column("feature").to_numpy()] = b.column("v").flatten().to_numpy().reshape(-1, k)
        del got
        if last:
            values, turn = np.linalg.eigh(basis.T @ image)
            return (basis @ turn[:, np.argsort(-values)[: s.rank]]).astype(np.float32)
        basis = np.linalg.qr(image + 1e-12 * rng.standard_normal(image.shape, np.float32))[0]


def common_subsequence(a: list, b: list, weight) -> tuple[float, int]:
    """Weight and length of a longest common subsequence by weight: one row of the table at a time."""
    if not a or not b:
        return 0.0, 0
    w = np.asarray([weight(x) for x in a])
    codes = {x: i for i, x in enumerate(dict.fromkeys(a))}
    mine = np.asarray([codes[x] for x in a])
    row, count = np.zeros(len(a) + 1), np.zeros(len(a) + 1, np.int64)
    for x in b:
        code = codes.get(x)
        if code is None:
            continue
        take = np.where(mine == code, row[:-1] + w, 0)
        better = take > row[1:]
        row[1:] = np.maximum(row[1:], take)
        count[1:] = np.where(better, count[:-1] + 1, count[1:])
        best = np.maximum.accumulate(row)
        last = np.maximum.accumulate(np.where(row >= best, np.arange(len(row)), 0))
        row, count = best, count[last]
    return float(row[-1]), int(count[-1])


class Sequence:
    """Words with their weights and places, for common subsequences with many others."""

    def __init__(self, words_: list[bytes], weight):
        self.weights = [weight(x) for x in words_]
        self.whole = sum(self.weights)
        self.places: dict[bytes, list[int]] = {}
        for p in range(len(words_) - 1, -1, -1):
            self.places.setdefault(words_[p], []).append(p)

    def shared(self, b: list[bytes]) -> float:
        """What `common_subsequence` gives as weight: its row never falls, so a match that is no gain changes nothing."""
        row = np.zeros(len(self.weights) + 1)
        for places in filter(None, map(self.places.get, b)):
            for p in places:  # from the last place on, so that each still meets the row of the word before
                total = row[p] + self.weights[p]
                if total > row[p + 1]:
                    np.maximum(row[p + 1 :], total, out=row[p + 1 :])
        return float(row[-1])


def answer(text: str) -> list[bytes]:
    """Words after the last question mark, else of the last sentence."""
    tail = text.rsplit("?", 1)[1] if "?" in text else ""
    if not words(tail):
        parts = [p for p in re.split(r"[.!?]\s|\n", text) if words(p)]
        tail = parts[-1] if parts else ""
    return words(tail)


class Items:
    """One block of benchmark items: their passages in the latent space, words and answers."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, space: np.ndarray, s: Settings):
        self.s, self.weights = s, weights
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1] or "") for r in rows]
        self.answers = [answer(r[1] or "") for r in rows]
        self.sequences, self.answer_sequences = ([Sequence(x, self.weight) for x in y] for y in (self.words, self.answers))
        self.table = np.vstack([(space * weights[:, None]).astype(np.float32), np.zeros((1, space.shape[1]), np.float32)])
        self.squares = np.append(weights, 0).astype(np.float32) ** 2
        owner, vectors = [], []
        for i, (_, text) in enumerate(rows):
            for part in passages(feature_ids(text or "", s.features), s.window, s.window // 2):
                owner.append(i)
                vectors.append(self.table[part].sum(0))
        self.owner = np.asarray(owner, np.int64)
        self.vectors = _unit(np.asarray(vectors, np.float32).reshape(len(owner), -1))
        self._index()

    def _index(self) -> None:
        """By feature, the items that have it among their rarest words; by item, the weight of those that the least share leaves."""
        s, n = self.s, len(self.words)
        weights = self.weights.astype(np.float64) + 1e-3
        pairs, self.need, self.reach = [], np.zeros(n), np.asarray([len(w) + s.window for w in self.words], np.int64)
        for i, mine in enumerate(self.words):
            own, times = np.unique([feature_of(w, s.features) for w in mine], return_counts=True) if mine else (np.zeros(0, np.int64),) * 2
            order = np.argsort(-weights[own], kind="stable")
            sums = np.cumsum((weights[own] * times)[order])
            if not len(sums):
                continue
            last = min(int(np.searchsorted(sums, s.rare * sums[-1])), len(sums) - 1)
            least = s.alike if len(mine) >= 8 else s.same
            self.need[i] = sums[last] - (1 - least + 1e-4) * sums[-1]
            pairs += [(f, i) for f in own[order][: last + 1].tolist()]
        pairs = np.asarray(sorted(pairs), np.int64).reshape(-1, 2)
        self.post_at = np.searchsorted(pairs[:, 0], np.arange(s.features + 1))
        self.post_item = pairs[:, 1]

    def stretches(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a word, item) where the words from there on hold enough of the item's rarest ones; `at` are ascending positions."""
        none = np.zeros(0, np.int64)
        if not len(ids) or not len(self.post_item):
            return none, none
        size = self.post_at[ids + 1] - self.post_at[ids]
        held = np.flatnonzero(size)
        ids, at, size = ids[held], at[held], size[held]
        sums, most, out, a = np.cumsum(size), int(self.reach.max()), [(none, none)], 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + (1 << 20), "right")))
            c = int(np.searchsorted(at, at[b - 1] + most, "right"))
            n, first = size[a:c], self.post_at[ids[a:c]]
            word = np.repeat(np.arange(a, c), n)
            item = self.post_item[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(word))]
            order = np.argsort(item, kind="stable")
            word, item = word[order], item[order]
            key = item * (at[c - 1] - at[a] + most + 1) + at[word] - at[a]
            total = np.append(0, np.cumsum(self.weights[ids[word]].astype(np.float64) + 1e-3))
            end = np.searchsorted(key, key + self.reach[item], "right")
            good = total[end] - total[:-1] >= self.need[item]
            out.append((held[word[good]], item[good]))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out))

    def full_cosine(self, ids: np.ndarray, i: int, starts: list[int]) -> float:
        """The highest cosine in the full space of a passage of the item with a window around the given ones."""
        s, best = self.s, 0.0
        mine = np.asarray([feature_of(w, s.features) for w in self.words[i]], np.int64)
        parts = [np.unique(p, return_counts=True) for p in passages(mine, s.window, s.window // 2)]
        for start in starts:
            for a in range(max(0, start - len(mine) // s.step * s.step - s.step), start + s.window, s.step):
                own, times = np.unique(ids[a : a + s.window], return_counts=True)
                w = self.weights[own] * times
                for f, n in parts:
                    v = self.weights[f] * n
                    _, x, y = np.intersect1d(own, f, assume_unique=True, return_indices=True)
                    best = max(best, float(w[x] @ v[y]) / max(float(np.linalg.norm(w) * np.linalg.norm(v)), 1e-9))
        return best

    def close_share(self, mine: Sequence, region: list[bytes]) -> float:
        """The largest share of an item in a stretch of half again its length: words strewn over more text are no copy."""
        size = len(mine.weights)
        width = size + size // 2 + 2
        starts = range(0, max(len(region) - width, 0) + size // 4, max(size // 4, 1))
        return max(mine.shared(region[a : a + width]) for a in starts) / mine.whole

    def weight(self, word: bytes) -> float:
        return float(self.weights[feature_of(word, self.s.features)]) + 1e-3

    def candidates(self, ids: np.ndarray) -> dict[int, dict[int, float]]:
        """By item, the first words of the windows near it with their cosine."""
        s = self.s
        out: dict[int, dict[int, float]] = {}
        if not len(ids) or not len(self.owner):
            return out
        span = s.window // s.step
        n = max(-(-len(ids) // s.step), span)
        for first in range(0, n - span + 1, 4096):
            last = min(first + 4096, n - span + 1)
            part = ids[first * s.step : (last + span - 1) * s.step]
            padded = np.full((last + span - 1 - first) * s.step, len(self.table) - 1)
            padded[: len(part)] = part
            blocks = self.table[padded].reshape(-1, s.step, self.table.shape[1]).sum(1)
            sums = blocks[: last - first].copy()
            for k in range(1, span):
                sums += blocks[k : k + last - first]
            size = np.linalg.norm(sums, axis=1)
            square = self.squares[padded].reshape(-1, s.step).sum(1)
            whole = np.sqrt(sum(square[k : k + last - first] for k in range(span)))
            part = size / np.maximum(np.maximum(whole, size), 1e-9)
            live = np.flatnonzero(part >= s.share)
            near = (sums[live] / np.maximum(size[live], 1e-9)[:, None]) @ self.vectors.T
            for r, c in zip(*np.nonzero((near >= s.cosine) & (near * part[live][:, None] >= s.share))):
                own = out.setdefault(int(self.owner[c]), {})
                at = (first + int(live[r])) * s.step
                own[at] = max(own.get(at, 0.0), float(near[r, c]))
        return out

    def check_all(self, texts: list[str]) -> list[list[tuple[int, float, float, bool, str]]]:
        """What `check` finds in each text."""
        ids = [feature_ids(t, self.s.features) for t in texts]
        ends = np.cumsum([len(x) for x in ids])
        gap = int(self.reach.max(initial=0)) + 1  # no stretch goes on in the next text
        own = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        word, item = self.stretches(np.concatenate([*ids, np.zeros(0, np.int64)]), np.arange(len(own)) + own * gap)
        more: dict[int, list] = {}
        for w, i in zip(word.tolist(), item.tolist()):
            more.setdefault(int(own[w]), []).append((i, w - int(ends[own[w]]) + len(ids[own[w]])))
        return [self.check(t, x, more.get(k, [])) for k, (t, x) in enumerate(zip(texts, ids))]

    def check(self, text: str, ids: np.ndarray, more: list[tuple[int, int]]) -> list[tuple[int, float, float, bool, str]]:
        """(item, cosine, share of the item in the text, answer found, verdict) of the items in a text; `more` are (item, word)."""
        near = self.candidates(ids)
        for i, at in more:
            near.setdefault(i, {}).setdefault(at // self.s.step * self.s.step, -1.0)
        if not near:
            return []
        tokens, out, s_alike = words(text), [], self.s.alike
        for i, at in near.items():
            mine, wanted = self.words[i], self.answers[i]
            sequence, wanted_sequence = self.sequences[i], self.answer_sequences[i]
            whole, part = sequence.whole, wanted_sequence.whole
            best, reach, done = (0.0, False), len(mine) + self.s.step, -1
            for start in sorted(at):
                a, b = max(0, start - reach), start + self.s.window + reach
                if b <= done:
                    continue
                done = b + len(mine) // 2
                region = tokens[a : done]
                present = set(region)
                if sum(w for x, w in zip(mine, sequence.weights) if x in present) < s_alike * whole:  # no subsequence can weigh more
                    continue
                if len(mine) < SHORT:
                    share = float(_verbatim(mine, tokens if len(mine) < LEAST else region, len(mine) < LEAST))
                else:
                    share = sequence.shared(region) / whole
                    if share >= self.s.same:
                        near_share = self.close_share(sequence, region)
                        share = near_share if near_share >= self.s.same else min(share, np.nextafter(self.s.same, 0))
                if share < s_alike:
                    continue
                found = bool(wanted) and wanted_sequence.shared(region) >= self.s.same * part
                best = max(best, (share, found))
            share, found = best
            if share >= self.s.same or share >= self.s.alike and found and len(mine) >= 8:
                cosine = max(at.values())
                cosine = cosine if cosine >= 0 else self.full_cosine(ids, i, sorted(at))
                out.append((self.ids[i], cosine, share, found, "copy" if share >= self.s.same else "paraphrase"))
        return sorted(out, key=str)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType()),
    T.StructField("answer_found", T.BooleanType()), T.StructField("verdict", T.StringType())]))


def prepare(docs: DataFrame, items: DataFrame, s: Settings = Settings(), text: str = "text", item_text: str = "text",
            item_id: str = "item_id") -> list[tuple]:
    """Statistics, latent space and the blocks of items for `mark`."""
    counts, total = passage_counts(docs, s, text)
    weights = np.log((total + 1) / (counts + 1)).astype(np.float32)
    space = latent(items, weights, s, item_text)
    blocks = []
    n = items.count()
    parts = -(-n // s.items)
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(parts)) == p) if parts > 1 else items
        blocks.append((sorted(((r[0], r[1]) for r in own.select(item_id, item_text).collect()), key=str), weights, space, s))
    return blocks


def mark(df: DataFrame, block: tuple, text: str = "text") -> DataFrame:
    """Add `found`: the items of the block in each row's text."""
    *plain, settings = block
    # Plain values only: broadcasts travel by reference to their classes, which executors need not have.
    shared, token = df.sparkSession.sparkContext.broadcast((*plain, asdict(settings))), uuid.uuid4().hex

    def run(texts):
        kept = worker_cache("items")
        if kept.get("key") != token:
            *values, numbers = shared.value
            kept.update(key=token, items=Items(*values, Settings(**numbers)))
        return [pa.array([[dict(zip(("item_id", "cosine", "share", "answer_found", "verdict"), x)) for x in found] for found in kept["items"].check_all(texts)],
                         _found_type())]

    return add_columns(df, text, [T.StructField("found", FOUND)], run)


def _found_type():
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(FOUND)


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row and item found in it: `doc_id`, `item_id`, `cosine`, `share`, `answer_found`, `verdict`."""
    docs = docs.select(doc_id, text)
    out = docs.sparkSession.createDataFrame([], f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, item_id long, cosine double, share double, answer_found boolean, verdict string")
    for block in prepare(docs, items, s, text):
        found = mark(docs, block, text).where(F.size("found") > 0).select(doc_id, F.explode("found").alias("f")).select(doc_id, "f.*")
        out = out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows that hold no item."""
    columns, out = docs.columns, docs
    kept = free_name(docs, "found_") if "found" in columns else None
    for block in prepare(docs, items, s, text):
        out = out.withColumnRenamed("found", kept) if kept else out
        out = mark(out, block, text).where(F.size("found") == 0).drop("found")
        out = out.withColumnRenamed(kept, "found") if kept else out
    return out.select(*columns)
