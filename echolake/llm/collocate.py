"""Phrase collocations by weighted acyclic automata.

A count transducer is an acyclic automaton over word labels whose outputs add up, along a path, to the count of its phrase. Outputs are pushed
towards the start (each state's smallest output moves to the arcs that lead to it), which makes equal continuations equal states; sorted
n-grams are added in blocks, and the states that no later n-gram can reach are looked up in a register, so the automaton is minimal as it grows.

1. Words are counted per language, and words of equal label (a 64-bit hash) are found out.
2. Each task builds a transducer of the n-grams of its shard: first of word pairs whose words are frequent, then of runs of three and more whose
   pairs all are (a phrase occurs no more often than any of its parts, so nothing frequent is lost). What is frequent is told by a Bloom filter of bounded
   size; what it lets through too much only costs room, since all counts are exact.
3. Transducers are cut by prefix range (language and first word by hash, a frequent first word also by the second) and meet by range, where weights
   of equal phrases are summed. One union automaton per range keeps what is frequent.
4. Parts of candidates are looked up by composing their sorted list with the union automaton of their range.

Null texts are empty, null languages are `unknown`. Long texts are read whole; a shard may end within a text's row only after it. Repeated rows
count each time. Ties in score and count are in the byte order of phrases. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, stored

LEAST = 30
LONGEST = 4
MOST = 2_000
#: Words of a shard, words whose phrases one range holds about, ranges at most, bits of a filter at most.
SHARD_WORDS = 1_000_000
RANGE_WORDS = 500_000
RANGES = 1 << 14
FILTER_BITS = 1 << 28
#: Bytes of automata in one Arrow batch that a shard sends.
BLOB_BYTES = 8_000_000

#: A-Z lower-cased, piece ends to line feeds, tabs to spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_END = b"\n"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def label(word: bytes) -> int:
    """The label of a word or language: never zero, which ends a phrase."""
    return xxhash.xxh3_64_intdigest(word) or 1


def mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of labels."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c) + _M1
        out = (out ^ (out >> np.uint64(30))) * _M2
        out = (out ^ (out >> np.uint64(27))) * _M3
        out ^= out >> np.uint64(31)
    return out


# Automata ------------------------------------------------------------------------------------------------------------------


class Transducer:
    """Arcs by state: arcs `first[s]` to `first[s + 1]` (sorted by label) leave state s, with an output and a target; `final[s]` is the weight of
    stopping there, or -1. State 0 is the end of the longest phrases, the last state is the start."""

    def __init__(self, first, final, labels, outputs, targets, start_output: int = 0):
        self.first, self.final, self.labels, self.outputs, self.targets, self.start_output = first, final, labels, outputs, targets, start_output

    def __len__(self) -> int:
        return len(self.final)

    def to_bytes(self) -> bytes:
        """Counts, then labels once each with arcs as places among them; numbers take no more bytes than the largest needs."""
        distinct, place = np.unique(self.labels, return_inverse=True)
        arrays = [np.diff(self.first), self.final + 1, distinct, place, self.outputs, self.targets]
        out = [struct.pack("<q", self.start_output)]
        for a in arrays:
            kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) < 1 << 8 * int(k[2]))
            out.append(struct.pack("<cQ", kind[2].encode(), len(a)) + a.astype(kind).tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        at, got = 8, []
        for _ in range(6):
            width, n = struct.unpack_from("<cQ", data, at)
            at += struct.calcsize("<cQ")
            size = int(width)
            got.append(np.frombuffer(data, f"<u{size}", n, at))
            at += n * size
        degree, final, distinct, place, outputs, targets = got
        first = np.concatenate([[0], np.cumsum(degree.astype(np.int64))])
        return cls(first, final.astype(np.int64) - 1, distinct.astype(np.uint64)[place], outputs.astype(np.int64), targets.astype(np.int64),
                   struct.unpack_from("<q", data)[0])

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases in order of their labels (rows of labels, zeros behind), and their counts."""
        state, weight, path = np.asarray([len(self) - 1]), np.asarray([self.start_output]), np.zeros((1, 0), np.uint64)
        rows, counts = [], []
        while len(state):
            done = self.final[state] >= 0
            if path.shape[1] and done.any():
                rows.append(path[done])
                counts.append(weight[done] + self.final[state[done]])
            degree = self.first[state + 1] - self.first[state]
            own = np.repeat(np.arange(len(state)), degree)
            arc = np.arange(len(own)) - np.repeat(np.cumsum(degree) - degree, degree) + self.first[state[own]]
            path = np.column_stack([path[own], self.labels[arc]])
            weight, state = weight[own] + self.outputs[arc], self.targets[arc]
        if not rows:
            return np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        width = max(r.shape[1] for r in rows)
        keys = np.vstack([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])
        counts = np.concatenate(counts)
        order = in_order(keys)
        return keys[order], counts[order]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Composition with a list of phrases: the count of each row, 0 where there is no path."""
        state = np.full(len(rows), len(self) - 1)
        weight = np.full(len(rows), self.start_output)
        alive, out = np.ones(len(rows), bool), np.zeros(len(rows), np.int64)
        for depth in range(rows.shape[1] + 1):
            column = rows[:, depth] if depth < rows.shape[1] else np.zeros(len(rows), np.uint64)
            ends = np.flatnonzero(alive & (column == 0))
            good = ends[self.final[state[ends]] >= 0]
            out[good] = weight[good] + self.final[state[good]]
            alive[ends] = False
            go = np.flatnonzero(alive)
            if not len(go):
                break
            low, high, want = self.first[state[go]].copy(), self.first[state[go] + 1].copy(), column[go]
            top = high.copy()
            while (open_ := low < high).any():  # all binary searches at once
                middle = (low + high) // 2
                less = np.zeros(len(go), bool)
                less[open_] = self.labels[middle[open_]] < want[open_]
                low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
            hit = low < top
            hit[hit] = self.labels[low[hit]] == want[hit]
            alive[go[~hit]] = False
            go, arc = go[hit], low[hit]
            weight[go] += self.outputs[arc]
            state[go] = self.targets[arc]
        return out


class Builder:
    """Adds blocks of sorted n-grams; no first label may appear in two blocks."""

    def __init__(self):
        self.register: dict[bytes, int] = {}
        self.degree, self.final, self.labels, self.outputs, self.targets = [], [], [], [], []
        self.top: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.end = self._state(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _state(self, final: int, labels, outputs, targets) -> int:
        """The registered state with these arcs; children come before it."""
        mark = struct.pack("<q", final) + labels.tobytes() + outputs.tobytes() + targets.tobytes()
        known = self.register.get(mark)
        if known is None:
            known = self.register[mark] = len(self.final)
            self.degree.append(len(labels))
            self.final.append(final)
            self.labels.append(labels)
            self.outputs.append(outputs)
            self.targets.append(targets)
        return known

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Phrases as rows of labels, sorted and distinct, zeros behind."""
        if not len(rows):
            return
        width = rows.shape[1]
        # from the deepest labels up: `key` are the distinct prefixes of the present depth with the state behind and the output that goes to their arc
        key, state, out = rows[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for depth in range(width, 0, -1):
            ends = rows[:, depth - 1] != 0
            if depth < width:
                ends &= rows[:, depth] == 0
            stop_key, stop = rows[ends, :depth], counts[ends]
            if depth == width:
                key, state, out = stop_key, np.full(len(stop), self.end), stop
            else:
                key, state, out = self._freeze(key, state, out, stop_key, stop)
        self.top.append((key[:, 0], out, state))

    def _freeze(self, key, state, out, stop_key, stop):
        """One state per distinct prefix: its arcs are the rows of `key` with that prefix, its weight of stopping comes from `stop`."""
        depth = key.shape[1] - 1
        heads = np.concatenate([key[:, :depth], stop_key])
        order = in_order(heads)
        heads = heads[order]
        new = np.ones(len(heads), bool)
        new[1:] = (heads[1:] != heads[:-1]).any(1)
        prefix = heads[new]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        arcs, stops = group[: len(key)], group[len(key) :]
        final = np.full(len(prefix), -1, np.int64)
        final[stops] = stop
        big = np.iinfo(np.int64).max
        least = np.where(final >= 0, final, big)
        np.minimum.at(least, arcs, out)
        final = np.where(final >= 0, final - least, -1)
        out = out - least[arcs]
        begin = np.searchsorted(arcs, np.arange(len(prefix)))
        end = np.append(begin[1:], len(arcs))
        labels = np.ascontiguousarray(key[:, depth])
        plain = np.flatnonzero((begin == end) & (final == 0))  # nothing follows: the common end
        made = np.full(len(prefix), self.end, np.int64)
        is_plain = np.zeros(len(prefix), bool)
        is_plain[plain] = True
        for g in np.flatnonzero(~is_plain).tolist():
            a, b = begin[g], end[g]
            made[g] = self._state(int(final[g]), labels[a:b], out[a:b], state[a:b])
        return prefix, made, least

    def build(self) -> Transducer:
        if self.top:
            labels, outputs, targets = (np.concatenate(c) for c in zip(*self.top))
            order = np.argsort(labels, kind="stable")
            labels, outputs, targets = labels[order], outputs[order], targets[order]
        else:
            labels, outputs, targets = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        degree = np.asarray([*self.degree, len(labels)], np.int64)
        return Transducer(np.concatenate([[0], np.cumsum(degree)]), np.asarray([*self.final, -1], np.int64), np.concatenate([*self.labels, labels]),
                          np.concatenate([*self.outputs, outputs]), np.concatenate([*self.targets, targets]))


def in_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of labels."""
    return np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))


def transducer(rows: np.ndarray, counts: np.ndarray) -> Transducer:
    """From sorted distinct phrases."""
    made = Builder()
    made.add(rows, counts)
    return made.build()


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct phrases with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = in_order(rows)
    return summed_in_order(rows[order], counts[order])


def summed_in_order(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for column in rows.T:
        new[1:] |= column[1:] != column[:-1]
    return rows[new], np.add.reduceat(counts, np.flatnonzero(new))


class Union:
    """Sums transducers of one range; holds little more than its distinct phrases."""

    def __init__(self, width: int):
        self.width, self.rows, self.counts, self.held, self.base = width, [], [], 0, 0

    def add(self, other: Transducer) -> None:
        rows, counts = other.phrases()
        if len(rows):
            self.rows.append(np.pad(rows, ((0, 0), (0, self.width - rows.shape[1]))))
            self.counts.append(counts)
            self.held += len(rows)
            if self.held > 2 * self.base + 50_000:
                self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros((0, self.width), np.uint64), np.zeros(0, np.int64)
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        self.rows, self.counts = [], []
        order = in_order(rows)
        rows, counts = rows[order], counts[order]  # the unsorted copy is freed here, before the sums are made
        rows, counts = summed_in_order(rows, counts)
        self.rows, self.counts, self.held, self.base = [rows], [counts], len(rows), len(rows)
        return rows, counts


# Shards ----------------------------------------------------------------------------------------------------------------------


class _Ids(dict):
    """Numbers of a shard's words; 0 ends a piece."""

    def __init__(self):
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Shard:
    """The words of some texts, by language."""

    def __init__(self):
        self.texts: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        self.n = 0

    def add(self, lang: str, text: str) -> None:
        ids, runs = self.texts.setdefault(lang, (_Ids(), []))
        pieces = text.encode().translate(_PLAIN)
        words = [w for w in pieces.replace(b"\n", b" \n ").split(b" ") if w]
        runs.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        runs.append(np.zeros(1, np.int32))
        self.n += len(words)

    def words(self):
        """(lang, words, counts) of each language."""
        for lang, (ids, runs) in self.texts.items():
            counts = np.bincount(np.concatenate(runs), minlength=len(ids))
            yield lang, list(ids)[1:], counts[1:]

    def ngrams(self, longest: int, words: Filter | None, pairs: Filter | None):
        """(lang label, rows of labels, counts) of each language: pairs of frequent words, or (given `pairs`) the longer runs of frequent pairs."""
        for lang, (ids, runs) in self.texts.items():
            flat = np.concatenate(runs).astype(np.int64)
            labels = np.fromiter(map(label, ids), np.uint64, len(ids))
            own = np.full(len(labels), label(lang.encode()), np.uint64)
            known = words.has(mix(own, labels))
            known[0] = False
            ok = known[flat]
            at = np.flatnonzero(ok[:-1] & ok[1:])
            size = len(ids)
            code, pair, n = np.unique(flat[at] * size + flat[at + 1], return_inverse=True, return_counts=True)
            rows = labels[np.column_stack([code // size, code % size])]
            if pairs is None:
                yield int(own[0]), rows, n
                continue
            good = pairs.has(mix(own[:1].repeat(len(rows)), rows[:, 0], rows[:, 1]))[pair]
            at, head = at[good], pair[good]
            is_pair = np.zeros(len(flat) + 1, bool)
            is_pair[at] = True
            found, counts = [], []
            for length in range(3, longest + 1):
                go = is_pair[at + length - 2]
                at, head = at[go], head[go]
                code, head, n = np.unique(head * size + flat[at + length - 1], return_inverse=True, return_counts=True)
                rows = np.column_stack([rows[code // size], labels[code % size]])
                found.append(np.pad(rows, ((0, 0), (0, longest - length))))
                counts.append(n)
            yield int(own[0]), np.concatenate(found), np.concatenate(counts)


class Filter:
    """A Bloom filter with two bits per key."""

    def __init__(self, data: bytes, bits: int):
        self.bytes, self.bits = np.frombuffer(data, np.uint8), bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in places(keys, self.bits):
            out &= self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return out


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (0, 17)]


def bloom(keys: DataFrame, n: int, segment: int = 1 << 20) -> tuple[bytes, int]:
    """Two bits for each value of the column `key` (a signed 64-bit hash), made in tasks by segment; 16 bits a key, FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))

    def spread(batches):
        for batch in batches:
            k = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(k, bits)))], names=["at"])

    def fill(batches):
        now, held = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            seg, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "at"))
            for s in np.unique(seg):
                if s != now:
                    if now is not None:
                        yield row()
                    now, held = int(s), np.zeros(segment, bool)
                held[at[seg == s] % segment] = True
        if now is not None:
            yield row()

    at = keys.select("key").mapInArrow(spread, "at long").distinct().withColumn("segment", F.expr(f"at div {segment}"))
    rows = at.repartition("segment").sortWithinPartitions("segment").mapInArrow(fill, "segment long, bits binary").collect()  # FILTER_BITS / 8 bytes at most
    out = bytearray(max(bits, segment) // 8)
    for r in rows:
        out[r.segment * segment // 8 : (r.segment + 1) * segment // 8] = r.bits
    return bytes(out), bits


# Ranges --------------------------------------------------------------------------------------------------------------------


class Ranges:
    """Prefix ranges: a language's first word by hash; a frequent first word has ranges of its own, by the hash of the second word."""

    def __init__(self, n: int, heavy: dict[int, tuple[int, int]]):
        """`heavy`: (first range, ranges) by the hash of language and word."""
        self.n = n
        self.keys = np.asarray(sorted(heavy), np.uint64)
        self.at = np.asarray([heavy[k][0] for k in sorted(heavy)], np.int64)
        self.many = np.asarray([heavy[k][1] for k in sorted(heavy)], np.int64)

    def of(self, lang: np.ndarray, rows: np.ndarray) -> np.ndarray:
        head = mix(lang, rows[:, 0])
        out = (head >> np.uint64(32)).astype(np.int64) * self.n >> 32
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, head), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == head)
            place = place[hit]
            second = rows[hit, 1] if rows.shape[1] > 1 else np.zeros(len(hit), np.uint64)
            out[hit] = self.at[place] + ((mix(second) >> np.uint64(32)).astype(np.int64) * self.many[place] >> 32) * (second != 0)
        return out


BLOBS = T.StructType([T.StructField("range", T.LongType()), T.StructField("automaton", T.BinaryType())])


def _shards(batches, unknown: str, most: int):
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            shard.add(lang.as_py() if lang.is_valid else unknown, text.as_py() or "")
            if shard.n >= most:
                yield shard
                shard = Shard()
                give_back()
    if shard.n:
        yield shard
        del shard
        give_back()


def _blobs(found: list[tuple[int, int, bytes]]):
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=BLOBS.names)


def _cut(rows: np.ndarray, counts: np.ndarray, ranges: Ranges):
    """(range, automaton) of sorted phrases that begin with the language."""
    number = ranges.of(rows[:, 0], rows[:, 1:])
    order = np.argsort(number, kind="stable")
    number, rows, counts = number[order], rows[order], counts[order]
    begin = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(begin, np.append(begin[1:], len(number))):
        yield int(number[a]), transducer(rows[a:b], counts[a:b]).to_bytes()


def _counted(texts: DataFrame, unknown: str, longest: int, words: tuple, pairs: tuple | None, ranges: tuple, most: int) -> DataFrame:
    """The transducers of all shards, cut by range."""
    def run(batches):
        allowed, two, places_ = Filter(*words), Filter(*pairs) if pairs else None, Ranges(*ranges)
        for shard in _shards(batches, unknown, most):
            found = []
            for own, rows, counts in shard.ngrams(longest, allowed, two):
                if len(rows):
                    order = in_order(rows)
                    found.append((own, np.column_stack([np.full(len(rows), own, np.uint64), rows[order]]), counts[order]))
            if not found:
                continue
            found.sort(key=lambda f: f[0])  # one automaton per range holds all languages of the shard
            found_rows, found_counts = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
            del found, rows, counts
            made, size = [], 0
            for piece in _cut(found_rows, found_counts, places_):
                made.append(piece)
                size += len(piece[1])
                if size > BLOB_BYTES:
                    yield _blobs(made)
                    made, size = [], 0
            if made:
                yield _blobs(made)
            del found_rows, found_counts, made, shard

    return texts.mapInArrow(run, BLOBS)


def _united(blobs: DataFrame, width: int, least: int) -> DataFrame:
    """One automaton per range with the phrases of `least` occurrences or more."""
    def run(batches):
        now, union = None, None

        def made():
            rows, counts = union.sums()
            keep = counts >= least
            return _blobs([(now, transducer(rows[keep], counts[keep]).to_bytes())]) if keep.any() else None

        for batch in batches:
            for number, blob in zip(batch.column("range").to_pylist(), batch.column("automaton")):
                if number != now:
                    if now is not None and (row := made()) is not None:
                        yield row
                    now, union = number, Union(width)
                    give_back()
                union.add(Transducer.from_bytes(blob.as_buffer().to_pybytes()))
        if now is not None and (row := made()) is not None:
            yield row
        union = None
        give_back()

    return blobs.repartition("range").sortWithinPartitions("range").mapInArrow(run, BLOBS)


def _listed(automata: DataFrame, longest: int) -> DataFrame:
    """`lang`, `w` (labels), `a` of all phrases of automata."""
    def run(batches):
        for batch in batches:
            for blob in batch.column("automaton"):
                rows, counts = Transducer.from_bytes(blob.as_buffer().to_pybytes()).phrases()
                sizes = (rows[:, 1:] != 0).sum(1)
                for n in np.unique(sizes):
                    own = sizes == n
                    flat = pa.array(np.ascontiguousarray(rows[own, 1 : n + 1]).view(np.int64).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(own.sum() + 1, dtype=np.int32) * int(n)), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[own, 0].view(np.int64)), lists, pa.array(counts[own])], names=["lang", "w", "a"])

    return automata.mapInArrow(run, "lang long, w array<bigint>, a long")


def _composed(parts: DataFrame, automata: DataFrame, ranges: tuple, longest: int) -> DataFrame:
    """`lang`, `w`, `f` of distinct parts: each is sent to the automaton of its range and composed with it."""
    def route(batches):
        where = Ranges(*ranges)
        for batch in batches:
            rows = _matrix(batch.column("lang"), batch.column("w"), longest)
            number = where.of(rows[:, 0], rows[:, 1:])
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column("lang"), batch.column("w")], names=["range", "lang", "w"])

    asked = parts.mapInArrow(route, "range long, lang long, w array<bigint>").withColumn("automaton", F.lit(None).cast("binary"))
    held = automata.select("range", F.lit(None).cast("long").alias("lang"), F.lit(None).cast("array<bigint>").alias("w"), "automaton")

    def look(batches):
        now, machine = None, None
        for batch in batches:
            number = batch.column("range").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.diff(number, prepend=number[:1] - 1)) if len(number) else []
            for a, b in zip(begin, np.append(begin[1:], len(number))):
                some = batch.slice(a, b - a)
                if number[a] != now:
                    now, machine = number[a], None
                if some.column("automaton")[0].is_valid:
                    machine, some = Transducer.from_bytes(some.column("automaton")[0].as_buffer().to_pybytes()), some.slice(1)
                if some.num_rows and machine is not None:
                    got = machine.counts(_matrix(some.column("lang"), some.column("w"), longest))
                    yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("w"), pa.array(got)], names=["lang", "w", "f"])

    both = held.unionByName(asked.select("range", "lang", "w", "automaton"))
    return both.repartition("range").sortWithinPartitions("range", F.col("automaton").isNull()).mapInArrow(look, "lang long, w array<bigint>, f long")


def _matrix(lang: pa.Array, lists: pa.Array, longest: int) -> np.ndarray:
    """Rows of labels that begin with the language, zeros behind."""
    out = np.zeros((len(lang), longest + 1), np.uint64)
    out[:, 0] = lang.to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = flat
    return out


# The operator --------------------------------------------------------------------------------------------------------------


def _counts_of(lang: str, own: int, labels: np.ndarray, words: list, counts: np.ndarray) -> pa.RecordBatch:
    n = len(labels)
    columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, own)), pa.array(labels), pa.array(words, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "code", "label", "word", "f"])


def word_counts(texts: DataFrame, unknown: str, shard_words: int) -> DataFrame:
    """`lang`, `code` (of the language), `label`, `word`, `f`, and how many words have the label (`words`) with how many occurrences (`of_label`).

    `word` is null and `label` 0 in the row of a language's sum. Shards count before the shuffle.
    """
    def run(batches):
        for shard in _shards(batches, unknown, shard_words):
            for lang, words, counts in shard.words():
                met = np.flatnonzero(counts)
                labels = np.fromiter((label(words[i]) for i in met), np.uint64, len(met)).view(np.int64)
                own = np.uint64(label(lang.encode())).view(np.int64)
                for i in range(0, len(met) + 1, 50_000):
                    some = met[i : i + 50_000]
                    yield _counts_of(lang, own, labels[i : i + 50_000], [words[k].decode() for k in some], counts[some])
                yield _counts_of(lang, own, np.zeros(1, np.int64), [None], counts.sum(keepdims=True))

    made = texts.mapInArrow(run, "lang string, code long, label long, word string, f long")
    # Numbers alone are summed up, so no string is sorted; words of one label lie in one task and tell of each other.
    sums = made.repartition("code", "label").groupBy("code", "label", "lang", "word").agg(F.sum("f").alias("f"))
    same = Window.partitionBy("code", "label")
    return sums.select("*", F.count(F.lit(1)).over(same).alias("words"), F.sum("f").over(same).alias("of_label"))


def phrases(df: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", unknown: str = "und",
            shard_words: int = SHARD_WORDS, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All candidates and what belongs to them.

    `lang` (code), `w` (labels), `a`, `l`, `r`, `score` per candidate that stays; `label`, `word` of frequent words; `code`, `lang`, `n` of languages.
    """
    texts = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = stored(word_counts(texts, unknown, shard_words).where((F.col("of_label") >= least) | (F.col("label") == 0)), "words")
    langs, words = counted.where("label = 0"), counted.where("label <> 0")
    if counted.where("words > 1").limit(1).count():
        raise ValueError("two words or languages have the same 64-bit label; change the hash")
    n_words, total = words.count(), langs.agg(F.sum("f")).first()[0] or 0

    n = max(1, min(RANGES, -(-total // range_words)))
    heavy, at = {}, n
    share = max(1, total // n)
    for r in words.where(F.col("f") >= share).select("code", "label", "f").collect():  # RANGES words at most
        key = int(mix(np.asarray([r.code], np.int64).view(np.uint64), np.asarray([r.label], np.int64).view(np.uint64))[0])
        heavy[key] = (at, many := -(-r.f // share))
        at += many
    ranges = (n, heavy)

    def key_of(batches):
        for batch in batches:
            rows = _matrix(batch.column("lang"), batch.column("w"), longest)
            yield pa.RecordBatch.from_arrays([pa.array(mix(*rows[:, : len(batch.column("w")[0]) + 1].T).view(np.int64))], names=["key"])

    def filtered(found: DataFrame, count: int):
        return bloom(found.mapInArrow(key_of, "key long"), count)

    singles = words.select(F.col("code").alias("lang"), F.array("label").alias("w"), F.col("f").alias("a"))
    one = filtered(singles, n_words)
    two = stored(_united(_counted(texts, unknown, longest, one, None, ranges, shard_words), longest + 1, least), "pairs")
    pairs = _listed(two, longest)
    many = _counted(texts, unknown, longest, one, filtered(pairs, pairs.count()), ranges, shard_words)

    def as_blobs(batches):
        where = Ranges(*ranges)
        for batch in batches:
            rows = _matrix(batch.column("lang"), batch.column("w"), longest)
            order = in_order(rows)
            made = list(_cut(rows[order], batch.column("a").to_numpy(zero_copy_only=False)[order], where))
            if made:
                yield _blobs(made)

    automata = stored(_united(singles.mapInArrow(as_blobs, BLOBS).unionByName(two).unionByName(many), longest + 1, least), "automata")

    found = stored(_listed(automata, longest).where(F.size("w") > 1), "candidates")
    size = F.size("w")
    # A candidate that a longer one explains goes.
    inner = F.explode(F.expr(
        "flatten(transform(sequence(2, greatest(size(w) - 1, 2)), k -> transform(sequence(1, size(w) - k + 1), i -> slice(w, i, k))))"))
    longer = found.where(size > 2).select("lang", inner.alias("w"), F.col("a").alias("over")).groupBy("lang", "w").agg(F.max("over").alias("over"))
    kept = found.join(longer, ["lang", "w"], "left").where(F.col("over").isNull() | (100 * F.col("over") < 80 * F.col("a"))).drop("over")
    cuts = stored(kept.select("lang", "w", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
                  .select("lang", "w", "a", "k", F.expr("slice(w, 1, k)").alias("left"), F.expr("slice(w, k + 1, size(w) - k)").alias("right")), "cuts")
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("w")).distinct()
    known = stored(_composed(parts, automata, ranges, longest), "parts")
    both = cuts.join(known.select("lang", F.col("w").alias("left"), F.col("f").alias("l")), ["lang", "left"]) \
        .join(known.select("lang", F.col("w").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = both.withColumn("score", score).groupBy("lang", "w").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b"))
    scored = best.select("lang", "w", "b.a", "b.l", "b.r", "b.score")
    return scored, words.select("code", "label", "word"), langs.select("code", "lang", F.col("f").alias("n"))


def collocations(df: DataFrame, most: int = MOST, **settings) -> DataFrame:
    """`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`: each language's first `most` phrases."""
    scored, words, langs = phrases(df, **settings)
    # What can be among the first by score and count alone, ties included; only these are spelt out.
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= most).drop("place")
    near = stored(near, "near")
    spelt = near.select("lang", "w", F.posexplode("w").alias("i", "label")).join(words.withColumnRenamed("code", "lang"), ["lang", "label"]) \
        .groupBy("lang", "w").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelt"))  # as many words as a phrase has
    told = near.join(spelt, ["lang", "w"]).withColumn("phrase", F.array_join(F.expr("transform(spelt, x -> x.word)"), " "))
    top = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = told.withColumn("rank", F.row_number().over(top).cast("long")).where(F.col("rank") <= most)
    return first.withColumnRenamed("lang", "code").join(langs, "code").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
