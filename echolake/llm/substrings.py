"""Substring deduplication by level-wise doubling.

A word is removed where a window of `window` consecutive words covers it whose words also start earlier (in a smaller id, or
before in the same document). Lengths double from a quarter of the window up: only windows repeated at one length are extended to twice that
length, so the last level hashes few windows.

The first level counts runs of a quarter window, and of those only anchors: the smallest hash among the runs of some window.
Equal windows have equal anchors at equal places, so no repeated window is lost, and an eighth of the runs is dealt out. Repeated
anchors are extended to the left and to the right to half a window; windows whose extended anchor is repeated are hashed whole (96
bits) and the earliest of each hash is found. A window that is not the earliest of its hash is removed.

Rows that a task already knows to be repeated do not go to their hash's task: one of them does, and of windows the earliest. So a
run that a third of all documents share reaches its task once per part of input. Texts are dealt out by id once; both passes over them share that shuffle.

Null and empty texts have no words. Rows of equal id are one document; rows without an id come last and count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import run_hashes, slices, stored, word_hashes

WINDOW = 20
LAST = (1 << 63) - 1
#: Text whose rows are thinned out together before they are dealt out.
PART_BYTES = 8_000_000


class Levels:
    """Hashes of the levels of one text."""

    def __init__(self, text: str, window: int):
        self.words = text.encode().split()
        self.window, self.run = window, window // 4
        self.starts = np.zeros(0, np.int64)
        self.anchors = np.zeros(0, np.int64)
        n = len(self.words) - window + 1
        if n <= 0:
            return
        self.hashes = word_hashes(self.words)
        self.short = run_hashes(self.hashes, self.run, 1)
        view = np.lib.stride_tricks.sliding_window_view(self.short, window - self.run + 1)
        self.place = np.concatenate([view[a : a + 4096].argmin(1) for a in range(0, n, 4096)])
        self.starts = np.arange(n)
        self.anchors = np.unique(self.starts + self.place)

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the half windows that end with and that start with each anchor; 0 where there is none."""
        double, left_bit = run_hashes(self.hashes, 2 * self.run, 2), 1 << 32  # a half that exists is not 0
        left, right = self.anchors - self.run, self.anchors
        pick = lambda at: np.where((at >= 0) & (at < len(double)), double[np.clip(at, 0, len(double) - 1)] | np.uint64(left_bit), np.uint64(0))
        return pick(left), pick(right)

    def candidates(self, sides: dict[int, int]) -> np.ndarray:
        """Starts of the windows whose extended anchor is repeated; `sides` has 1 (left), 2 (right) or 3 by anchor."""
        if not len(self.starts) or not sides:
            return np.zeros(0, np.int64)
        table = np.zeros(len(self.words) + 1, np.int8)
        for a, s in sides.items():
            if a < len(table):
                table[a] = s
        needed = np.where(self.place >= self.run, 1, 2)
        return self.starts[(table[self.starts + self.place] & needed) > 0]

    def whole(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the windows at some starts."""
        a, b = run_hashes(self.hashes, self.window, 3), run_hashes(self.hashes, self.window, 4)
        return a[starts], b[starts] >> np.uint64(32)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _parts(batches, text: str):
    """Runs of rows of about PART_BYTES of text, over batch ends as well."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text, PART_BYTES):
            n = part.column(text).nbytes
            if held and size + n > PART_BYTES:
                yield held
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield held


def _emit(columns: dict[str, np.ndarray]):
    n = len(next(iter(columns.values())))
    for a in range(0, n, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns.values()], names=list(columns))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for part in _parts(batches, "t"):
            h, ids, at, left, right = [], [], [], [], []
            for batch in part:
                for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                    levels = Levels(t, window)
                    if len(levels.anchors):
                        a, b = levels.extended()
                        h.append(levels.short[levels.anchors])
                        left.append(a)
                        right.append(b)
                        at.append(levels.anchors)
                        ids.append(np.full(len(levels.anchors), i, np.int64))
            if h:
                h, ids, at, left, right = map(np.concatenate, (h, ids, at, left, right))
                rep, known = _thin(h)
                half = (left >> np.uint64(32) << np.uint64(32)) | right >> np.uint64(32)
                yield from _emit({"h": _signed(h), "id": ids, "p": at << 2 | known.astype(np.int64) << 1 | (~rep).astype(np.int64) << 62, "half": _signed(half)})

    return docs.mapInArrow(run, "h long, id long, p long, half long")


def _thin(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of one row of each hash, and of the rows whose hash occurs more than once here."""
    _, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    rep = np.zeros(len(h), bool)
    rep[first] = True
    return rep, counts[inverse] > 1


def survivors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`id`, `anchors` (place * 4 + sides): the anchors that are repeated after doubling, per document."""
    rows = _anchors(docs, window)
    lone = F.shiftrightunsigned("p", 62) == 0
    spread = F.when(lone, F.col("h")).otherwise(F.xxhash64("id", "p"))  # rows that need no partner go anywhere

    def first(batches):
        """Rows sorted by hash, those that may meet another first: the ones known to be repeated and the ones that do."""
        held = None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in OUT}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in OUT}
            if not len(cols["h"]):
                continue
            rep = cols["p"] < 1 << 62
            same = (cols["h"][1:] == cols["h"][:-1]) & rep[1:] & rep[:-1]
            keep = (cols["p"] & 2) > 0
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None:
                keep[0] |= held_keep
            held, held_keep = {c: cols[c][-1:] for c in OUT}, keep[-1]
            yield from _emit({c: cols[c][:-1][keep[:-1]] for c in OUT})
        if held is not None and held_keep:
            yield from _emit(held)

    OUT = ("h", "id", "p", "half")
    met = rows.repartition(spread).sortWithinPartitions("h", "p").mapInArrow(first, "h long, id long, p long, half long")
    left, right = F.shiftrightunsigned("half", 32), F.col("half").bitwiseAND(F.lit(0xFFFFFFFF))
    at = F.shiftright(F.col("p").bitwiseAND(F.lit((1 << 62) - 1)), 2)
    both = met.select("h", "id", at.alias("at"), F.explode(F.array(
        F.struct(left.alias("x"), F.lit(1).alias("side")), F.struct(right.alias("x"), F.lit(2).alias("side")))).alias("e")) \
        .where("e.x <> 0").select(F.xxhash64("h", "e.x", "e.side").alias("h"), "id", (F.col("at") * 4 + F.col("e.side")).alias("a"))
    both = stored(both, "halves")
    counts = both.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    kept = both.join(counts, "h", "left_semi").select("id", "a")
    return kept.groupBy("id").agg(F.collect_list("a").alias("anchors"))  # at most two for each word of the document


def _sides(packed) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in packed or ():
        out[x >> 2] = out.get(x >> 2, 0) | x & 3
    return out


def _firsts(joined: DataFrame, window: int) -> DataFrame:
    """`id`, `at`: the windows among the candidates that are the earliest of their words."""

    def run(batches):
        for part in _parts(batches, "t"):
            a, b, ids, at = [], [], [], []
            for batch in part:
                for i, t, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "anchors"))):
                    if packed:
                        levels = Levels(t, window)
                        starts = levels.candidates(_sides(packed))
                        if len(starts):
                            x, y = levels.whole(starts)
                            a.append(x)
                            b.append(y)
                            ids.append(np.full(len(starts), i, np.int64))
                            at.append(starts)
            if a:
                a, b, ids, at = map(np.concatenate, (a, b, ids, at))
                order = np.lexsort((at, ids, b, a))
                a, b, ids, at = a[order], b[order], ids[order], at[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield from _emit({"h": _signed(a[new]), "g": _signed(b[new] << np.uint64(31) | at[new].astype(np.uint64)), "id": ids[new]})

    def earliest(batches):
        last = None
        for batch in batches:
            h, g, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "id"))
            if not len(h):
                continue
            b = g >> 31
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
            if last is not None:
                new[0] = (h[0], b[0]) != last
            last = (h[-1], b[-1])
            yield from _emit({"id": ids[new], "at": g[new] & ((1 << 31) - 1)})

    found = joined.mapInArrow(run, "h long, g long, id long").withColumn("b", F.shiftright("g", 31))
    return found.repartition("h").sortWithinPartitions("h", "b", "id", "g").select("h", "g", "id").mapInArrow(earliest, "id long, at long")


def deduplicate(df: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `kept` (the kept words joined by one space), `n_words`, `n_removed` per row."""
    if window < 8 or window % 4:
        raise ValueError("the window is a multiple of four, eight at least")
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.col(doc_id).isNull().alias("lost"), F.coalesce(text, F.lit("")).alias("t"))
    marks = stored(survivors(docs.select("id", "t"), window), "anchors")
    joined = docs.join(marks.hint("merge"), "id", "left")
    firsts = _firsts(joined.select("id", "lost", "t", "anchors"), window).groupBy("id").agg(F.collect_list("at").alias("firsts"))  # at most one for each word
    both = joined.join(firsts.hint("merge"), "id", "left")
    schema = T.StructType([T.StructField(doc_id, T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                made = []
                for i, lost, t, packed, own in zip(*(part.column(c).to_pylist() for c in ("id", "lost", "t", "anchors", "firsts"))):
                    levels = Levels(t, window) if packed else None
                    words = levels.words if levels else t.encode().split()
                    starts = levels.candidates(_sides(packed)) if levels else ()
                    keep = np.ones(len(words) + 1, bool)
                    if len(starts):
                        again = np.setdiff1d(starts, np.asarray(own or [], np.int64))
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, again, 1)
                        np.add.at(edge, again + window, -1)
                        keep = np.cumsum(edge) == 0
                    left = [w for w, k in zip(words, keep.tolist()) if k]
                    made.append((None if lost else i, b" ".join(left).decode(), len(words), len(words) - len(left)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=schema.names)

    return both.select("id", "lost", "t", "anchors", "firsts").mapInArrow(cut, schema)
