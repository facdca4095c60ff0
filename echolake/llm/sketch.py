"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles of `WORDS` words (a shorter text is one shingle, a text without
words has none), in ASCII lower case. Sketches of parts merge to the sketch of the whole. Of two sketches the k smallest
hashes of both tell the resemblance; with the estimated numbers of distinct shingles it gives containment.

`with_next` pairs every row with the next one by id without ordering all rows in one task: ids are cut at quantiles, each part's
first row is also sent to the part before it, and each part is walked in order. After the last id comes the first. Rows of equal
id follow each other by text; a row without an id is its own next. Null texts are empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, run_hashes, word_hashes

K = 128
WORDS = 5


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    """Sorted hashes, k at most."""
    hashes = word_hashes(text.encode().lower().split())
    if not len(hashes):
        return np.zeros(0, np.uint64)
    found = run_hashes(hashes, min(words, len(hashes)))
    if len(found) > 2 * k:
        small = np.unique(np.partition(found, 2 * k)[: 2 * k])
        if len(small) >= k:  # else repeats fill the smallest places
            return small[:k]
    return np.unique(found)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared share of the distinct shingles of both; two empty texts are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's distinct shingles that are in b."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b)) / len(a)
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def written(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """Add `fingerprint` (16 hexadecimal digits per hash) and `n_shingles` (estimated)."""
    fields = [T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())]

    def run(texts):
        made = [sketch(t, k) for t in texts]
        return [pa.array([written(m) for m in made], pa.string()), pa.array([distinct(m, k) for m in made], pa.float64())]

    return add_columns(df, text, fields, run)


def merged(df: DataFrame, key: str, k: int = K) -> DataFrame:
    """One `fingerprint` per key from those of its parts; each task keeps only its k smallest hashes of a key."""
    parts = df.select(key, F.explode(F.expr("transform(sequence(0, greatest(length(fingerprint) div 16 - 1, 0)), i -> substr(fingerprint, i * 16 + 1, 16))")).alias("h")).distinct()
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("n") <= k + 1)
    joined = first.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("h"))  # at most k + 1 hashes
    return joined.select(key, F.array_join(F.slice(F.filter("h", lambda x: x != ""), 1, k), "").alias("fingerprint"))


def with_next(df: DataFrame, fields: list[T.StructField], fn, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and what `fn` makes of each text, given (prepared own text, prepared next text).

    `fn` is a pair of functions: prepare(text) -> anything, once per row, and make(own, next) -> tuple of field values.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    cuts = sorted(set(rows.where("id is not null").approxQuantile("id", [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(cuts, ids.fillna(0).to_numpy(np.float64), side="right"))).astype(np.int32)

    place = F.pandas_udf(place, T.IntegerType())
    placed = rows.withColumn("part", place("id"))
    heads = sorted((r.part, r.head) for r in rows.select("id", place("id").alias("part")).where("part >= 0").groupBy("part").agg(F.min("id").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # one entry per part
    if before:
        also = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("id")]
    else:
        also = F.lit(None).cast("int")
    to = F.when(F.col("id").isNotNull() & also.isNotNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("guest")), F.struct(also.alias("p"), F.lit(1).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("guest"))))
    dealt = placed.withColumn("to", F.explode(to)).select(F.col("to.p").alias("p"), F.col("to.guest").alias("guest"), "id", "t")
    ordered = dealt.repartition(parts, "p").sortWithinPartitions("p", "guest", "id", "t")
    prepare, make = fn
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def walk(batches):
        held, done = None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=schema.names)

        for batch in batches:
            for p, guest, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                now = prepare(t) if held is None or not guest or held[0] == p else None
                if held is not None and held[0] == p and p >= 0:
                    done.append((held[1], *make(held[2], now)))
                    held = None
                if p < 0:
                    done.append((i, *make(now, now)))
                elif not guest:
                    held = (p, i, now)
                if len(done) >= 500:
                    yield flush()
                    done.clear()
        if done:
            yield flush()

    return ordered.mapInArrow(walk, schema)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]


def compared(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and the next document's."""

    def prepare(t):
        return t, sketch(t, k)

    def make(own, following):
        other = edited(own[0], following[0])
        changed = sketch(other, k)
        return (len(own[0]), hashlib.sha256(other.encode()).hexdigest(), written(own[1]), written(changed),
                resemblance(own[1], changed, k), resemblance(own[1], following[1], k))

    return with_next(df, COMPARED, (prepare, make), doc_id, text)
