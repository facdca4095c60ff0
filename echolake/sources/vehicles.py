"""Signal, spectrum and catalogue views over plain business tables.

The tables carry no audio, so each view maps columns of a table onto the library's row shapes. Indices are dense
positions found with bucketed counts, never with one window per recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.plans.chunking import dense_index, div

SIG_CHUNK = 32
SIG_ALL_CHUNK = 512
INTS_CHUNK = 1024
EVENT_BUCKET_MICROS = 86_400_000_000
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _signal(events: DataFrame, recording: F.Column) -> DataFrame:
    keyed = events.select(recording.cast("long").alias("recording_id"), "ts", ((F.col("value") - 50) / 511).alias("y"))
    bucket = F.floor(F.unix_micros("ts") / EVENT_BUCKET_MICROS)
    return dense_index(keyed, ["recording_id"], bucket, ["ts"]).select("recording_id", "idx", "y")


def sig(spark: SparkSession, folder: str) -> DataFrame:
    """One short recording per user."""
    return _signal(_events(spark, folder), F.col("user_id"))


def sig_all(spark: SparkSession, folder: str) -> DataFrame:
    """All events as one long recording."""
    return _signal(_events(spark, folder), F.lit(0))


def sig_lengths(spark: SparkSession, folder: str, single: bool = False) -> DataFrame:
    """Sample counts of ``sig`` (or ``sig_all``) from a plain count, without placing the samples."""
    recording = F.lit(0).cast("long") if single else F.col("user_id").cast("long")
    return table(spark, folder, "events").groupBy(recording.alias("recording_id")).agg(F.count(F.lit(1)).alias("n"))


def ints(spark: SparkSession, folder: str) -> DataFrame:
    """16-bit integer samples from order lines."""
    lines = table(spark, folder, "lineitem").withColumn("recording_id", F.col("l_suppkey") % 10)
    return dense_index(lines, ["recording_id"], div("l_orderkey", 512), LINE_COLUMNS).select(
        "recording_id",
        "idx",
        (F.round(F.col("l_extendedprice") * 100).cast("long") % 65536 - 32768).alias("v"),
    )


def spec(spark: SparkSession, folder: str) -> DataFrame:
    """Spectrum columns: one array of magnitudes per embedding."""
    vectors = table(spark, folder, "embeddings").select(F.col("label").alias("recording_id"), "vec_id", "embedding")
    return dense_index(vectors, ["recording_id"], div("vec_id", 256), ["vec_id"], out="col").select(
        "recording_id",
        "col",
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("mags"),
    )


def spec_bins(spark: SparkSession, folder: str) -> DataFrame:
    return spec(spark, folder).select("recording_id", "col", F.posexplode("mags").alias("bin", "mag"))


def cplx(spark: SparkSession, folder: str) -> DataFrame:
    """Complex columns: the imaginary part is the next vector of the label."""
    vectors = table(spark, folder, "embeddings").select(F.col("label").alias("recording_id"), "vec_id", "embedding")
    cols = dense_index(vectors, ["recording_id"], div("vec_id", 256), ["vec_id"], out="col").select(
        "recording_id", "col", F.transform("embedding", lambda v: v.cast("double")).alias("re")
    )
    nxt = cols.select("recording_id", (F.col("col") - 1).alias("col"), F.col("re").alias("im"))
    return cols.join(nxt, ["recording_id", "col"])


def segs(spark: SparkSession, folder: str) -> DataFrame:
    """Timeline segments, times in seconds (one day counts as one second)."""
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % 50).alias("timeline_id"),
        F.col("o_orderkey").alias("seg_id"),
        F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")).cast("double").alias("start"),
        (F.col("o_orderkey") % 7 + 1).cast("double").alias("dur"),
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Recording catalogue: one entry per order line, all species fields as text."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    part = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
            F.col("p_type").alias("gen"),
            F.col("p_brand").alias("sp"),
            F.col("p_name").alias("en"),
            F.col("l_returnflag").alias("q"),
            (F.col("l_quantity") * 1000).cast("long").alias("smp"),
            F.col("n_name").alias("cnt"),
            F.col("l_shipdate").cast("timestamp").alias("recorded"),
        )
    )


def identities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("filename"),
        F.col("n_chars").alias("file_size"),
        F.sha2("text", 256).alias("full_hash"),
        F.sha2(F.lower(F.trim("text")), 256).alias("content_hash"),
    )


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation trees: turn t of a conversation hangs under turn t div 2."""
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.expr("turn div 2")).alias("parent_id"),
        F.when(F.col("turn") % 3 != 0, (F.col("turn") % 3).cast("double")).alias("sort_order"),
        F.length("text").cast("long").alias("created_at"),
    )


def names(spark: SparkSession, folder: str) -> DataFrame:
    """File names of recording sessions and their tracks."""
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"),
        F.concat(
            F.lit("site"), F.col("conv_id"), F.lit("_"), F.lpad(F.expr("turn div 2").cast("string"), 3, "0"),
            F.when(F.col("turn") % 2 == 0, F.lit("_Ch1")).otherwise(F.lit("_MIX")), F.lit(".wav"),
        ).alias("name"),
        F.length("text").cast("long").alias("n_chars"),
    )


def metadata_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(
            F.lit("Lang: "), "lang", F.lit("\nSource|Name: "), "source", F.lit("\n\nNote: a:b\nbad line\nLength:"),
            F.col("n_chars").cast("string"),
        ).alias("text"),
    )
