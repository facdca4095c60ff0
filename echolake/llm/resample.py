"""Importance resampling towards a target corpus, and the radix sort that ranks its draws.

Features are the runs of 1 to `words` consecutive words of a text, hashed to `buckets` buckets (CRC-32). A bucket's gain is the floored
log ratio, in thousandths, of its add-one shares in the target and in the corpus; a document weighs the floored mean of its features'
gains. A Gumbel number from a hash of the id makes the highest scores a draw without replacement.

Scores are ranked by a least-significant-digit radix sort. Each pass is a stable counting sort by one digit of the composite key: rows
lie in parts of bounded size, every part counts its digits, prefix sums of the counts (digits first, then parts) give each row its place, and
places make the parts of the next pass. A pass moves a row once and groups no more rows than a part holds, whatever the
keys are, so hot keys cost nothing. Each pass is stored, so a lost executor costs at most one pass.

Null texts have no words and weigh 0, as empty ones do; long texts are read whole. A null id hashes as the empty text and sorts last among equal
scores; ids are whole numbers. Repeated rows are drawn each by itself; rows that agree in score and id take their places in
stored order. Empty tables give empty results; columns of any name are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, stored, worker_cache

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bits of a digit; rows of a part (more in huge inputs, so that there are at most MOST_PARTS).
DIGIT = 11
PART = 1_024
MOST_PARTS = 1 << 20

#: Lower-cases A-Z; bytes that are neither letters, digits nor part of a longer character become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Buckets of words, kept for the words seen last."""

    most = 400_000

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = zlib.crc32(word) % self.buckets
        return value


def features(text: str, words: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    found = text.encode().translate(_PLAIN).split()
    cache = worker_cache("buckets").setdefault(buckets, _Buckets(buckets))
    runs = [np.fromiter(map(cache.__getitem__, found), np.int32, len(found))]
    for n in range(2, words + 1):
        runs.append(np.asarray([zlib.crc32(b" ".join(found[i : i + n])) % buckets for i in range(len(found) - n + 1)], np.int32))
    return len(found), np.concatenate(runs)


def bucket_counts(df: DataFrame, text: str = "text", words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; each task sends one row per bucket it has met."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(features(value.as_py() or "", words, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    sums = df.select(F.col(f"`{text}`")).mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a natural logarithm for each bucket."""
    extra = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    total_s, total_t = float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (total_s + extra) / ((s + 1) * (total_t + extra)))).astype(np.int64)


def gumbel(key: Column) -> Column:
    """Thousandths of a standard Gumbel number, by hash of a string."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(df: DataFrame, gain: np.ndarray, words: int = 1, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight`, `score` per row."""
    buckets = len(gain)
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]

    def weigh(texts):
        rows = []
        for value in texts:
            n, found = features(value, words, buckets)
            rows.append((n, len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
        return [list(c) for c in zip(*rows)]

    weighed = add_columns(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", fields, weigh)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(key)).alias("score"))


def _codes(rows: DataFrame, keys: list[tuple[str, bool]]) -> tuple[int, list[tuple[Column, int]]]:
    """Number of rows, and for each key a non-negative code that sorts as the key does, with the bits it takes."""
    parts = [F.count(F.lit(1))]
    for name, _ in keys:
        value = F.col(f"row.`{name}`").cast("long")
        parts += [F.min(value), F.max(value), F.count(value)]
    n, *stats = rows.agg(*parts).first()
    out = []
    for i, (name, down) in enumerate(keys):
        low, high, filled = stats[3 * i : 3 * i + 3]
        value = F.col(f"row.`{name}`").cast("long")
        if filled < n:
            out.append((F.when(value.isNull(), 1).otherwise(0).cast("long"), 1))
        if filled and low < high:
            if high - low < 1 << 62:
                code, bits = (F.lit(high) - value if down else value - F.lit(low)), (high - low).bit_length()
            else:  # the sign bit turned: unsigned order
                code, bits = F.bitwise_not(value.bitwiseXOR(F.lit(-(1 << 63)))) if down else value.bitwiseXOR(F.lit(-(1 << 63))), 64
            out.append((F.coalesce(code, F.lit(0)).cast("long"), bits))
    if sum(bits for _, bits in out) <= 62:
        joined, width = F.lit(0).cast("long"), 0
        for code, bits in reversed(out):
            joined, width = joined.bitwiseOR(F.shiftleft(code, width)), width + bits
        out = [(joined, width)] if width else []
    return n, out


def ranked(df: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank", part: int = PART) -> DataFrame:
    """The rows of `df` with their place (1 first) in the order of whole-number `keys` (name, whether descending); nulls come last.

    Rows of equal keys keep the order in which they are stored. Rows travel whole, so select what is needed first.
    """
    spark = df.sparkSession
    rows = stored(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "unsorted")
    n, codes = _codes(rows, keys)
    part = max(part, -(-n // MOST_PARTS))
    names = [f"code{i}" for i in range(len(codes))]
    # the first order: stored parts, cut where they are long
    now = rows.select("row", *[c.alias(name) for (c, _), name in zip(codes, names)], F.expr(f"at div {part}").alias("part"), "at")
    passes = [(name, shift, min(DIGIT, bits - shift)) for (_, bits), name in reversed(list(zip(codes, names))) for shift in range(0, bits, DIGIT)]
    if not passes:
        passes = [(None, 0, 0)]  # all keys equal: one pass gives dense places
    for name, shift, width in passes:
        digit = F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int") if name else F.lit(0)
        dealt = now.withColumn("digit", digit)
        counts = dealt.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"))
        totals = {r.digit: r.n for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()}  # 2 ** DIGIT rows at most
        before, first = 0, []
        for d in range(1 << width):
            first.append(before)
            before += totals.get(d, 0)
        starts = spark.createDataFrame([(d, x) for d, x in enumerate(first) if d in totals], "digit int, first long")
        earlier = _sums_before(counts).join(F.broadcast(starts), "digit").select("part", "digit", (F.col("first") + F.col("before")).alias("start"))
        inside = F.row_number().over(Window.partitionBy("part", "digit").orderBy("at"))
        placed = dealt.withColumn("i", inside).join(earlier, ["part", "digit"]) \
            .select("row", *names, (F.col("start") + F.col("i") - 1).alias("at")).withColumn("part", F.expr(f"at div {part}")).select("row", *names, "part", "at")
        now = stored(placed, "radix")
    return now.select("row.*", (F.col("at") + 1).alias(rank))


def _sums_before(counts: DataFrame, fan: int = 1_024) -> DataFrame:
    """`part`, `digit`, `before`: rows of a digit in earlier parts, in two levels so that no window holds all parts of a digit."""
    blocked = counts.withColumn("block", F.expr(f"part div {fan}"))
    blocks = blocked.groupBy("digit", "block").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("digit", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("outer"))
    within = Window.partitionBy("digit", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.select("part", "digit", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner"))
    return local.join(blocks, ["digit", "block"]).select("part", "digit", (F.col("inner") + F.col("outer")).alias("before"))


def draw(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, words: int = 1, buckets: int = BUCKETS, seed: int = SEED,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight`, `score`, `rank` per row of `df`.

    `percent` of the rows with `least_words` words or more are drawn, and have a rank; the others' is null. `target` has a column of the same name
    as the text of `df`.
    """
    gain = gains(bucket_counts(df, text, words, buckets), bucket_counts(target, text, words, buckets))
    rows = stored(scored(df, gain, words, seed, doc_id, text), "scored")
    long_ = F.col("n_words") >= least_words
    n = rows.where(long_).count()
    sorted_ = ranked(rows.where(long_), [("score", True), ("doc_id", False)])
    drawn = sorted_.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(rows.where(~long_).withColumn("rank", F.lit(None).cast("long")))


def sample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of `df` whose id was drawn; ids are unique."""
    ids = draw(df, target, doc_id=doc_id, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias(doc_id))
    return df.join(ids, doc_id, "left_semi")
