"""Language-model scores of texts.

Two models learn from the same rows. The base is a smoothed word frequency: words in ASCII lower case and an end for each text. The
other is a causal self-attention model on subword ids: the ids of a text's words (and its end) are predicted one by one from the
ids before. It first predicts a class of ids, from one attention head over a window and the id before, then the id within
its class by frequency. Word counts, ids per class and their frequencies come from all learning rows, and so do the attention weights: a text
is cut into windows that overlap by half, so that each id is predicted once, in the second half of its window. The windows of all learning
rows are dealt to `Settings.rounds` rounds, each window to one (`Settings.every` above 1 would leave all but one in so many out). In a round the weights
are trained in numpy in each part of the data, `BLOCK` windows in memory at a time, and averaged by the number of windows; every id has an input row of its own, averaged
by how often a part met it, so that rare ids are not drawn back by parts that lack them. So weights depend on how the rows lie
in files and parts. Scoring takes the same windows, many at a time under a causal mask.

Texts are spelt once: one pass stores the ids of every text, the counts of words and of ids; learning and scoring read these ids. A second pass over the texts
sums the common words, whose counts it holds in a table of at most `TOP_WORDS` words of at most `TOP_BYTES` bytes; only the others, each
once per text, meet their counts in a join by word. Null is read as empty, a text without words has its end alone. Without learning rows all counts are zero
and both scores are those of a uniform guess.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass, replace
from itertools import chain, count, islice, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin_pass, give_back, lists_of, slices, stored, worker_cache
from .pieces import load

TOP_WORDS = 300_000
TOP_BYTES = 64
END = ""  # no word is empty, so an empty one can stand for the end of a text


@dataclass(frozen=True)
class Settings:
    half: int = 16
    size: int = 16
    classes: int = 64
    single: int = 48
    inputs: int = 32_001  # a row for every piece and one for what stands before a text; `learnt` sets it by the pieces
    every: int = 1
    rounds: int = 2
    rate: float = 0.05
    batch: int = 128
    seed: int = 5


CACHE_WORDS = 1_000_000
BLOCK = 8192  # windows held at a time
TALL = 256  # rows of tall products taken at a time
SAFE = 30  # exponentials of numbers below it, and their sums, can't overflow


def lowered(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per word, and one with an empty word for the end of each text; other columns stay."""
    others = [c for c in rows.columns if c != text]
    words = F.split(lowered(F.col(text)), r"[\x20\x09-\x0D]+")
    return rows.select(*others, F.explode(F.array_append(F.array_remove(words, ""), F.lit(END))).alias("word"))


def word_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """`word`, `n`; partial sums first, so a common word reaches its task once per part."""
    return tokens(rows.select(text), text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, most: int = TOP_WORDS) -> dict[bytes, int]:
    """The counts of the most frequent words: `most` of TOP_BYTES bytes at most, all of one count or none."""
    known = counts.where((F.octet_length("word") <= TOP_BYTES) & (F.col("word") != END))
    sizes = known.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])  # a row per different count
    fits = np.flatnonzero(np.cumsum(sizes.column("words").to_numpy()) <= most)
    if not len(fits):
        return {}
    top = known.where(F.col("n") >= sizes.column("n")[int(fits[-1])].as_py()).toArrow()
    return {w.encode(): n for w, n in zip(top.column("word").to_pylist(), top.column("n").to_pylist())}


class Speller:
    """Words by number, and the subword ids of each; number 0 is the end of a text."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.clear()

    def clear(self) -> None:
        self.index = defaultdict(count().__next__)  # numbers in the order in which words are met
        self.index[END.encode()]
        self.flat, self.start, self.size = np.asarray([self.library.eos_id()], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words; those met for the first time are spelt by the public library."""
        old = len(self.index)
        got = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > old:
            lists = self.library.encode([w.decode() for w in islice(self.index, old, None)], num_threads=1)
            self.size = np.concatenate([self.size, np.fromiter(map(len, lists), np.int64, len(lists))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32)])
            self.start = np.cumsum(self.size) - self.size
        return got

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words and ends of some texts and how many each has; their subword ids and how many each has."""
        words, sizes = lower_words(texts, END.encode())
        numbers = self.numbers(words)
        each = self.size.take(numbers)
        ends = np.cumsum(each)
        ids = self.flat.take(np.repeat(self.start.take(numbers) - ends + each, each) + np.arange(each.sum()))
        return numbers, sizes, ids, np.diff(ends.take(np.cumsum(sizes) - 1), prepend=0)


def lower_words(texts: list[str], *last: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of some texts in a row, `last` after those of each, and how many each text has."""
    lists = [t.encode().lower().split() for t in texts]
    for own in lists:
        own.extend(last)
    return list(chain.from_iterable(lists)), np.fromiter(map(len, lists), np.int64, len(lists))


def speller(model: bytes) -> Speller:
    """The speller of this worker, cleared once it holds more than `CACHE_WORDS` words."""
    kept = worker_cache("word-ids")
    if kept.get("model") != model:
        kept.update(model=model, speller=Speller(model))
    if len(kept["speller"].index) > CACHE_WORDS:
        kept["speller"].clear()
    return kept["speller"]


def word_ids(texts: list[str], model: bytes) -> list[np.ndarray]:
    """Subword ids of the words of each text, and the end id."""
    _, _, ids, sizes = speller(model).texts(texts)
    return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []


def id_type(pieces: int) -> np.dtype:
    """The type of stored ids."""
    return np.dtype(np.uint16 if pieces <= 1 << 16 else np.int32)


def packed(ids: np.ndarray, sizes: np.ndarray, pieces: int) -> pa.Array:
    """A binary value for the ids of each text."""
    kind = id_type(pieces)
    offsets = np.append(0, np.cumsum(sizes) * kind.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())


def unpacked(column: pa.Array, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of lists or of `packed` values, and where each row begins and the last ends."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(column.offsets.to_numpy())))
    kind, column = id_type(pieces), column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind)
    return flat, (at - at[0]) // kind.itemsize


def spelt(rows: DataFrame, pieces: bytes, text: str = "t") -> DataFrame:
    """One pass over texts, stored: a row per text with its `ids` and the other columns; rows of `word` and of `id` with partial counts `n` of the rows where `learn` holds."""
    size = len(load(pieces).raw)
    own = [f for f in rows.schema.fields if f.name != text]
    new = [T.StructField("ids", T.BinaryType()), T.StructField("word", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in own], *new])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def made(size, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def run(batches):
        begin_pass(__name__)
        kept, words, of_ids = speller(pieces), np.zeros(0, np.int64), np.zeros(size, np.int64)

        def counted():
            at, names = np.flatnonzero(words), list(kept.index)
            return made(len(at), word=pa.array([names[i] for i in at], pa.binary()).cast(pa.string()), n=pa.array(words[at]))

        for batch in batches:
            for part in slices(batch, text):
                if len(kept.index) > CACHE_WORDS:
                    yield counted()
                    kept.clear()
                    words = np.zeros(0, np.int64)
                numbers, sizes, ids, lengths = kept.texts(part.column(text).to_pylist())
                learn = part.column("learn").to_numpy(zero_copy_only=False).astype(bool)
                more = np.bincount(numbers[np.repeat(learn, sizes)], minlength=len(kept.index))
                more[: len(words)] += words
                words = more
                of_ids += np.bincount(ids[np.repeat(learn, lengths)], minlength=size)
                yield made(len(part), ids=packed(ids, lengths, size), **{f.name: part.column(f.name) for f in own})
        yield counted()
        at = np.flatnonzero(of_ids)
        yield made(len(at), id=pa.array(at.astype(np.int32)), n=pa.array(of_ids[at]))
        give_back()

    return stored(rows.mapInArrow(run, schema), "spelt")


class Classes:
    """Classes of ids by frequency: the most frequent alone, the others, split by whether they start a word, in bands of equal weight."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, s: Settings):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.of = np.zeros(n, np.int32)
        self.of[order[: s.single]] = np.arange(min(s.single, n))
        rest, bands = order[s.single :], (s.classes - s.single) // 2
        for k, own in enumerate((rest[starts[rest]], rest[~starts[rest]])):
            weight = np.cumsum(counts[own] + 0.5)
            if len(own):
                self.of[own] = s.single + k * bands + np.minimum((weight / weight[-1] * bands).astype(int), bands - 1)
        whole = np.bincount(self.of, counts + 0.5, s.classes)
        self.inside = np.log((counts + 0.5) / whole[self.of]).astype(np.float32)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.input = (rank + 1).astype(np.int32)  # 0 is what stands before a text
        self.base = np.log(np.maximum(whole, 0.5) / whole.sum()).astype(np.float32)


class Attention:
    """Weights and sums of the model; everything but training is in `forward`."""

    names = ("embed", "query", "key", "value", "near", "out", "skip", "bias")

    def __init__(self, s: Settings, base: np.ndarray):
        rng = np.random.default_rng(s.seed)
        d, c = s.size, s.classes
        make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.s = s
        self.w = {"embed": make(s.inputs, d), "query": make(d, d), "key": make(d, d), "value": make(d, d), "near": np.zeros(2 * s.half, np.float32),
                  "out": np.zeros((d, c), np.float32), "skip": np.zeros((d, c), np.float32), "bias": base.copy()}
        i, j = np.arange(s.half)[:, None] + s.half, np.arange(2 * s.half)[None]
        self.mask = np.where(j <= i, 0, -1e9).astype(np.float32)
        self.distance = np.clip(i - j, 0, 2 * s.half - 1)
        self.past = {n: np.full(p.shape, 1e-6, np.float32) for n, p in self.w.items()}

    def forward(self, x: np.ndarray, valid: np.ndarray):
        """Log-probabilities of the classes in the second half of windows of inputs, and the attention; `valid` marks places that belong to the text.

        The plain form: `target` and `slim_gradient` give the same with fewer products.
        """
        w, h = self.w, self.s.half
        e = w["embed"][x]
        q, k, v = e[:, h:] @ w["query"], e @ w["key"], e @ w["value"]
        a = q @ k.transpose(0, 2, 1) * self.s.size**-0.5 + self.mask + w["near"][self.distance] + np.where(valid, 0, -1e9)[:, None, :]
        a = np.exp(a - a.max(2, keepdims=True))
        a /= a.sum(2, keepdims=True)
        z = a @ v @ w["out"] + e[:, h:] @ w["skip"] + w["bias"]
        z -= z.max(2, keepdims=True)
        return z - np.log(np.exp(z).sum(2, keepdims=True)), a

    def attend(self, e: np.ndarray, near: np.ndarray, valid: np.ndarray):
        """Attention before it is divided by its sums, the inverse of these, and `e` with windows transposed; `near` are queries times keys but for `e`."""
        n, h = len(e), self.s.half
        turned = np.ascontiguousarray(e.transpose(0, 2, 1))
        u = near @ turned
        place = self.w["near"][self.distance] + self.mask
        if max(u.max(), -u.min()) + np.abs(self.w["near"]).max() < SAFE:
            np.exp(u, out=u)
            u *= np.exp(place)
            part = np.flatnonzero(~valid.all(1))  # windows at an end of their text
            u[part] *= valid[part][:, None, :]
        else:
            u += place
            u += np.where(valid, 0, u.dtype.type(-1e9))[:, None, :]
            u -= u.max(2, keepdims=True)
            np.exp(u, out=u)
        return u, 1 / (u.reshape(n * h, 2 * h) @ np.ones(2 * h, u.dtype)), turned

    def joint(self):
        """Query and key as one product, and what follows the attention (value and out, skip) as another."""
        w = self.w
        return w["query"] @ w["key"].T * w["embed"].dtype.type(self.s.size**-0.5), np.concatenate([w["value"] @ w["out"], w["skip"]])

    def classed(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logits `z` and by what their exponentials are multiplied: the bias's, or where these could overflow all is in the logits, each row less its largest."""
        bias = self.w["bias"]
        if max(z.max(), -z.min(), np.abs(bias).max()) < SAFE:
            return z, np.exp(bias)
        z += bias
        z -= z.max(1, keepdims=True)
        return z, np.ones_like(bias)

    def prepare(self) -> None:
        """Queries times keys of every input, so that scoring looks them up."""
        both, self.last = self.joint()
        self.near = self.w["embed"] @ both

    def target(self, x: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the target classes; needs `prepare`."""
        n, h, d = len(x), self.s.half, self.s.size
        e = self.w["embed"].take(x, 0)
        u, r, _ = self.attend(e, self.near.take(x[:, h:], 0), valid)
        both = np.empty((n, h, 2 * d), e.dtype)
        np.multiply(u @ e, r.reshape(n, h, 1), out=both[:, :, :d])
        both[:, :, d:] = e[:, h:]
        z, times = self.classed(both.reshape(n * h, 2 * d) @ self.last)
        at = z[np.arange(len(z)), target.ravel()] + np.log(times)[target.ravel()]
        np.exp(z, out=z)
        return (at - np.log(z @ times)).reshape(target.shape)

    def gradient(self, x, valid, target, counts):
        """The gradient of the mean loss by weight."""
        g, whole = self.slim_gradient(x, valid, target, counts), np.zeros_like(self.w["embed"])
        rows, values = g["embed"]
        whole[rows] = values
        return {**g, "embed": whole}

    def slim_gradient(self, x, valid, target, counts):
        """The gradient, that of `embed` as (rows, values): the other rows have none."""
        w, h, s = self.w, self.s.half, self.s
        e = w["embed"].take(x, 0)
        n, d, kind = len(x), e.shape[2], e.dtype
        near, last = self.joint()
        both = np.empty((n, h, 2 * d), kind)  # what is attended to, and the id before
        both[:, :, d:] = e[:, h:]
        own = both.reshape(n * h, 2 * d)[:, d:]
        q = (own @ near).reshape(n, h, d)
        u, r, turned = self.attend(e, q, valid)
        m = np.multiply(u @ e, r.reshape(n, h, 1), out=both[:, :, :d])
        both = both.reshape(n * h, 2 * d)
        z, times = self.classed(both @ last)
        np.exp(z, out=z)
        weight = (counts.ravel() / max(counts.sum(), 1)).astype(kind)
        z *= (weight / (z @ times))[:, None]
        z[np.arange(n * h), target.ravel()] -= weight / times[target.ravel()]  # the gradient by logits, but for `times`
        g_last = crossed(both, z) * times
        g = {"bias": (np.ones(n * h, kind) @ z) * times, "out": w["value"].T @ g_last[:d], "value": g_last[:d] @ w["out"].T, "skip": g_last[d:]}
        d_both = z @ (last * times).T
        dm = (d_both[:, :d] * r[:, None]).reshape(n, h, d)
        ds = dm @ turned
        ds -= ((dm * m).reshape(n * h, d) @ np.ones(d, kind)).reshape(n, h, 1)  # its mean by the attention
        ds *= u
        g["near"] = np.bincount(self.distance.ravel(), ds.sum(0).ravel(), 2 * h).astype(w["near"].dtype)
        dq = (ds @ e).reshape(n * h, d)
        g_near = crossed(own, dq) * kind.type(s.size**-0.5)
        g["query"], g["key"] = g_near @ w["key"], g_near.T @ w["query"]
        de = u.transpose(0, 2, 1) @ dm
        de += ds.transpose(0, 2, 1) @ q
        d_own = dq @ near.T
        d_own += d_both[:, d:]
        de[:, h:] += d_own.reshape(n, h, d)
        at = x.ravel().astype(np.uint16 if s.inputs <= 1 << 16 else x.dtype)  # short integers are sorted by radix
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g["embed"] = at[first].astype(np.int64), np.add.reduceat(de.reshape(-1, d).take(order, 0), first)
        return g

    def train(self, x, valid, target, counts, rng) -> None:
        """One pass over windows; what is known of the size of past steps stays for the next call."""
        s, past = self.s, self.past
        order = rng.permutation(len(x))
        x, valid, target, counts = (c.take(order, 0) for c in (x, valid, target, counts))
        for start in range(0, len(order), s.batch):
            own = slice(start, start + s.batch)
            for n, g in self.slim_gradient(x[own], valid[own], target[own], counts[own]).items():
                rows, g = g if n == "embed" else (slice(None), g)
                step = g * g
                step += past[n][rows]
                past[n][rows] = step
                np.divide(g, np.sqrt(step, out=step), out=step)
                step *= s.rate
                self.w[n][rows] -= step

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.names]).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.names:
            size = self.w[n].size
            self.w[n] = flat[at : at + size].reshape(self.w[n].shape).astype(np.float32)
            at += size


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of tall arrays, in blocks that stay in the processor's cache."""
    n = len(a) // TALL * TALL
    got = a[n:].T @ b[n:]
    if n:
        got += (a[:n].reshape(-1, TALL, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, TALL, b.shape[1])).sum(0)
    return got


class Texts:
    """Texts of ids, one after the other from the places `at`, as inputs and classes of the model."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, s: Settings, classes: Classes):
        self.half, self.at, self.size = s.half, at, np.diff(at)
        self.input, self.of = classes.input.take(flat), classes.of.take(flat)
        self.count = -(-self.size // s.half)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The text and the number within it of every window."""
        text = np.repeat(np.arange(len(self.size)), self.count)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(self.count) - self.count, self.count)

    def windows(self, text: np.ndarray, which: np.ndarray):
        """Inputs, their validity, target classes and which targets count, for some windows."""
        h = self.half
        place = (which * h - h)[:, None] + np.arange(2 * h)
        valid = (place >= 0) & (place < self.size[text][:, None])
        place += self.at[text][:, None]
        target = self.of.take(place[:, h:], mode="clip")
        counted = valid[:, h:].copy()
        target *= counted
        place -= 1
        inputs = self.input.take(place, mode="clip")
        inputs *= valid
        inputs[which == 1, 0] = 0  # before the first id
        inputs[which == 0, h] = 0
        valid[:, h] = True  # a padded row attends somewhere
        return inputs, valid, target, counted


def windows(ids: np.ndarray, s: Settings, classes: Classes, pick: np.ndarray | None = None):
    """All windows of a text or some, as `Texts.windows` gives them."""
    texts = Texts(ids, np.asarray([0, len(ids)]), s, classes)
    which = texts.all()[1] if pick is None else pick
    return texts.windows(np.zeros(len(which), np.int64), which)


def cuts(batches, s: Settings, classes: Classes, round_: int):
    """The windows that a round learns from: over all rounds every window once (of each `Settings.every` one, and one of a shorter text)."""
    most = BLOCK // 4
    for batch in batches:
        texts = Texts(*unpacked(batch.column("ids"), len(classes.of)), s, classes)
        text, which = texts.all()
        first = (texts.size % np.minimum(s.every, texts.count))[text]
        own = np.flatnonzero((which >= first) & ((which - first) % s.every == 0) & ((which // s.every + texts.size[text]) % s.rounds == round_))
        for a in range(0, len(own), most):
            pick = own[a : a + most]
            yield texts.windows(text[pick], which[pick])


def blocks(parts):
    """Windows gathered up to `BLOCK` at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= BLOCK:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def in_parts(flat: np.ndarray, step: int) -> np.ndarray:
    """A row for each `step` weights, the last one filled up with zeros."""
    return np.pad(flat, (0, -len(flat) % step)).reshape(-1, step)


@dataclass
class Model:
    settings: Settings
    classes: Classes
    weights: np.ndarray
    pieces: bytes

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each text."""
        if not texts:
            return np.zeros(0)
        _, _, ids, sizes = speller(self.pieces).texts(texts)
        return self.score_ids(ids, np.append(0, np.cumsum(sizes)))

    def score_ids(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text of ids; texts lie one after the other from the places `at`."""
        kept = worker_cache("language")
        key = self.weights.tobytes()
        if kept.get("key") != key:
            net = Attention(self.settings, self.classes.base)
            net.load(self.weights)
            net.prepare()
            kept.update(key=key, net=net)
        net, texts = kept["net"], Texts(flat, at, self.settings, self.classes)
        out = np.add.reduceat(self.classes.inside.take(flat), at[:-1], dtype=np.float64)
        text, which = texts.all()
        sums = np.zeros(len(text))
        for a in range(0, len(text), BLOCK):
            x, ok, target, counted = texts.windows(text[a : a + BLOCK], which[a : a + BLOCK])
            for b in range(0, len(x), 128):
                own = slice(b, b + 128)
                sums[a + b : a + b + 128] = (net.target(x[own], ok[own], target[own]) * counted[own]).sum(1, dtype=np.float64)
        return (out + np.bincount(text, sums, len(out))) / np.log(10)


def train(rows: DataFrame, counts: DataFrame, pieces: bytes, s: Settings = Settings(), text: str = "text") -> Model:
    """A model from learning rows and their word counts."""
    size = len(load(pieces).raw)

    def spell(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            for a in range(0, len(words), 20_000):
                ids = word_ids(words[a : a + 20_000], pieces)
                size_ = np.asarray([len(x) for x in ids])
                weight = np.repeat(n[a : a + 20_000].astype(np.float64), size_)
                last = np.cumsum(size_) - 1
                weight[last[size_ > 1]] = 0  # only the end of a text, spelt as an empty word, ends here
                total += np.rint(np.bincount(np.concatenate(ids), weight, size)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    own = spelt(rows.select(F.lit(False).alias("learn"), F.coalesce(F.col(text), F.lit("")).alias("t")), pieces)
    return learnt(own.where("ids IS NOT NULL").select("ids"), counts.mapInArrow(spell, "id int, n long"), pieces, s)


def learnt(texts: DataFrame, frequencies: DataFrame, pieces: bytes, s: Settings = Settings()) -> Model:
    """A model from the `ids` of learning rows, as `spelt` stores them, and partial counts `n` of each `id`."""
    raw = load(pieces).raw
    found = frequencies.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per piece at most
    frequency = np.zeros(len(raw), np.int64)
    frequency[found.column("id").to_numpy()] = found.column("n").to_numpy()
    s = replace(s, inputs=len(raw) + 1)
    classes = Classes(frequency, np.asarray([r[:1] == b" " for r in raw]), s)
    net = Attention(s, classes.base)
    weights, step = net.flat(), s.size  # a part of `step` weights is an input row, or some of the other weights
    for round_ in range(s.rounds):

        def fit(batches, weights=weights, round_=round_):
            begin_pass(__name__)
            own, rng, total, met = Attention(s, classes.base), np.random.default_rng([s.seed, round_]), 0, np.zeros(s.inputs, np.int64)
            own.load(weights)
            for made in blocks(cuts((part for batch in batches for part in slices(batch, "ids")), s, classes, round_)):
                own.train(*made, rng)
                total += len(made[0])
                met += np.bincount(made[0].ravel(), minlength=s.inputs)
            if total:
                flat = in_parts(own.flat(), step)
                n = np.append(met, np.full(len(flat) - len(met), total))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), lists_of(flat[at].ravel(), [step] * len(at))], names=["part", "n", "v"])
            give_back()

        mean = texts.mapInArrow(fit, "part int, n long, v array<float>").groupBy("part").agg(
            F.array(*[(F.sum(F.col("n") * F.col("v")[i]) / F.sum("n")) for i in range(step)]).alias("v")).toArrow()  # the weights, whatever the data
        if mean.num_rows:
            whole = in_parts(weights, step)
            whole[mean.column("part").to_numpy()] = mean.column("v").combine_chunks().flatten().to_numpy().reshape(-1, step)
            weights = whole.ravel()[: len(weights)]
    return Model(s, classes, weights, pieces)


def score(texts: DataFrame, model: Model) -> DataFrame:
    """`score` in place of the `ids` of texts, as `spelt` stores them."""
    # Plain values only: broadcasts travel by reference to their classes, which executors need not have.
    shared, token = texts.sparkSession.sparkContext.broadcast((asdict(model.settings), vars(model.classes), model.weights, model.pieces)), uuid.uuid4().hex
    keep = [f for f in texts.schema.fields if f.name != "ids"]

    def run(batches):
        begin_pass(__name__)
        kept = worker_cache("language-model")
        if kept.get("token") != token:
            settings, numbers, weights, pieces = shared.value
            classes = Classes.__new__(Classes)
            vars(classes).update(numbers)
            kept.update(token=token, model=Model(Settings(**settings), classes, weights, pieces))
        model = kept["model"]
        for batch in batches:
            for part in slices(batch, "ids"):
                got = model.score_ids(*unpacked(part.column("ids"), len(model.classes.of)))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], pa.array(got, pa.float64())], names=[*[f.name for f in keep], "score"])
        give_back()

    return texts.mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def base_sums(rows: DataFrame, counts: DataFrame, keys: list[str], text: str = "t") -> DataFrame:
    """For each value of `keys`: `words`, how many of them are `known`, and their sum `logs` of log10(count + 0.5).

    Rows of equal keys have equal texts; they are summed together and divided by their number.
    """
    top = {w: float(np.log10(n + 0.5)) for w, n in top_words(counts).items()}
    shared = rows.sparkSession.sparkContext.broadcast(top)
    fields = [rows.schema[k] for k in keys]
    rare = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("m", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("words", T.LongType()), T.StructField("top_words", T.LongType()), T.StructField("top_sum", T.DoubleType()), T.StructField("rare", rare)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        begin_pass(__name__)
        value = shared.value
        for batch in batches:
            for part in slices(batch, text):
                words, sizes = lower_words(part.column(text).to_pylist())
                logs = np.fromiter(map(value.get, words, repeat(np.nan)), np.float64, len(words))
                owner, other = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(np.isnan(logs))
                met = {}  # each word once per text
                for pair in zip(owner[other].tolist(), map(words.__getitem__, other.tolist())):
                    met[pair] = met.get(pair, 0) + 1
                n = np.bincount(owner[other], minlength=len(sizes))
                each = np.bincount(np.fromiter((i for i, _ in met), np.int64, len(met)), minlength=len(sizes))
                pairs = pa.StructArray.from_arrays([pa.array([w for _, w in met], pa.binary()).cast(pa.string()), pa.array(list(met.values()), pa.int64())], names=["word", "m"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)).astype(np.int32)), pairs)
                columns = [*[part.column(k) for k in keys], pa.array(sizes), pa.array(sizes - n), pa.array(np.bincount(owner, np.nan_to_num(logs), len(sizes))), lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        give_back()

    own = stored(rows.select(*keys, text).mapInArrow(run, schema), "base")
    c = F.coalesce("c", F.lit(0))
    each = own.select(*keys, F.explode("rare").alias("r")).select(*keys, "r.word", "r.m").join(counts.withColumnRenamed("n", "c"), "word", "left")
    each = each.select(*keys, F.when(c > 0, F.col("m")).otherwise(0).alias("known"), (F.col("m") * F.log10(c + 0.5)).alias("logs"))
    whole = own.select(*keys, F.col("top_words").alias("known"), F.col("top_sum").alias("logs"), "words")
    sums = each.unionByName(whole, allowMissingColumns=True).groupBy(*keys).agg(F.sum("known").alias("known"), F.sum("logs").alias("logs"), F.sum("words").alias("words"), F.count("words").alias("same"))
    return sums.select(*keys, *[(F.col(x) / F.col("same")).alias(x) for x in ("words", "known", "logs")])


def scores(df: DataFrame, learn, pieces: bytes, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` per row, learning from the rows where `learn` holds."""
    rows = df.select(F.col(doc_id).alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(learn, F.lit(False)).alias("learn")).withColumn("h", F.xxhash64("t"))
    read = spelt(rows, pieces)
    counts = stored(read.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == END, F.col("n"))).alias("e")).first()
    total, distinct, ends = int(whole.n or 0), int(whole.v), int(whole.e or 0)
    texts = read.where("ids IS NOT NULL")
    model = learnt(texts.where("learn").select("ids"), read.where("id IS NOT NULL").select("id", "n"), pieces, s)
    base = base_sums(rows, counts, ["k", "h"])
    own = score(texts.select("k", "h", "ids"), model)
    joined = own.join(base, own["k"].eqNullSafe(base["k"]) & (own["h"] == base["h"]))
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    tokens_ = F.round("words").cast("long") + 1
    return joined.select(
        own["k"].alias(doc_id), tokens_.alias("n_tokens"), (F.round("known").cast("long") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 0.5)) - tokens_ * scale).alias("base_score"), "score")
