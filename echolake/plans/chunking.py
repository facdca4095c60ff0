"""Chunk keys, halos and carries: how per-sample work stays independent of recording length.

No window here is partitioned by recording alone. Rows are keyed by (recording, chunk); what a chunk needs from its
past arrives either as copied neighbour rows (``with_halo``) or as one summary row per chunk scanned in two levels
(``carry_in``), so one recording that holds most of the corpus is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 96_000
SUMMARY_FAN = 1024


def div(column: str, size: int) -> Column:
    return F.expr(f"{column} div {int(size)}")


def with_chunk(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    return df.withColumn("chunk", div(idx, size))


def with_halo(df: DataFrame, size: int, before: int = 0, after: int = 0, idx: str = "idx") -> DataFrame:
    """Key rows by chunk and copy each row into every chunk that needs it as context.

    ``core`` marks the copy that belongs to the chunk; operators compute on all copies and keep core rows only.
    """
    first = F.greatest(F.floor((F.col(idx) - after) / size), F.lit(0)).cast("long")
    last = F.floor((F.col(idx) + before) / size).cast("long")
    return (
        df.withColumn("chunk", F.explode(F.sequence(first, last)))
        .withColumn("core", div(idx, size) == F.col("chunk"))
    )


def chunk_window(keys: Sequence[str], idx: str = "idx"):
    return Window.partitionBy(*keys, "chunk").orderBy(idx)


_JOIN = {
    "sum": lambda outer, inner: F.coalesce(outer, F.lit(0)) + F.coalesce(inner, F.lit(0)),
    "max": lambda outer, inner: F.greatest(outer, inner),
    "min": lambda outer, inner: F.least(outer, inner),
    "last": lambda outer, inner: F.coalesce(inner, outer),
}


def _total(kind: str, source: str) -> Column:
    if kind == "last":
        return F.max_by(source, F.when(F.col(source).isNotNull(), F.col("chunk")))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](source)


def _running(kind: str, source: str, window) -> Column:
    if kind == "last":
        return F.last(source, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](source).over(window)


def carry_in(
    summary: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple[str, str]],
    fan: int = SUMMARY_FAN,
) -> DataFrame:
    """Add, per (keys, chunk) summary row, the state accumulated over all earlier chunks.

    ``specs`` maps output name to (sum|max|min|last, summary column). The scan has two levels, ``fan`` summaries per
    inner window, so no window grows with the number of chunks of one recording.
    """
    keys = list(keys)
    blocked = summary.withColumn("_blk", div("chunk", fan))
    inner = Window.partitionBy(*keys, "_blk").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_blk").agg(
        *[_total(kind, source).alias(f"_t_{out}") for out, (kind, source) in specs.items()]
    )
    totals = totals.select(
        *keys,
        "_blk",
        *[_running(kind, f"_t_{out}", outer).alias(f"_o_{out}") for out, (kind, _) in specs.items()],
    )
    local = blocked.select(
        *blocked.columns,
        *[_running(kind, source, inner).alias(f"_i_{out}") for out, (kind, source) in specs.items()],
    )
    joined = local.join(totals, [*keys, "_blk"])
    return joined.select(
        *summary.columns,
        *[_JOIN[kind](F.col(f"_o_{out}"), F.col(f"_i_{out}")).alias(out) for out, (kind, _) in specs.items()],
    )


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, out: str, order: Sequence[str] = ("idx",)) -> DataFrame:
    """Inclusive running sum over ``order`` for rows already keyed by chunk; chunk totals are carried."""
    keys = list(keys)
    valued = df.withColumn("_v", value)
    w = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = valued.groupBy(*keys, "chunk").agg(F.sum("_v").alias("_s"))
    carried = carry_in(sums, keys, {"_c": ("sum", "_s")}).drop("_s")
    return (
        valued.withColumn("_l", F.sum("_v").over(w))
        .join(carried, [*keys, "chunk"])
        .withColumn(out, F.col("_l") + F.col("_c"))
        .drop("_v", "_l", "_c")
    )


def running_last(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], idx: str = "idx", exclusive: bool = False) -> DataFrame:
    """Last non-null value of each expression up to each row (before it, if ``exclusive``)."""
    keys = list(keys)
    for i, value in enumerate(values.values()):
        df = df.withColumn(f"_v{i}", value)
    w = Window.partitionBy(*keys, "chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    n = range(len(values))
    lasts = df.groupBy(*keys, "chunk").agg(
        *[F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(idx))).alias(f"_s{i}") for i in n]
    )
    carried = carry_in(lasts, keys, {f"_c{i}": ("last", f"_s{i}") for i in n}).drop(*[f"_s{i}" for i in n])
    local = df.select("*", *[F.last(f"_v{i}", ignorenulls=True).over(w).alias(f"_l{i}") for i in n])
    joined = local.join(carried, [*keys, "chunk"])
    for i, out in enumerate(values):
        joined = joined.withColumn(out, F.coalesce(f"_l{i}", f"_c{i}"))
    return joined.drop(*[f"_{p}{i}" for p in "vlc" for i in n])


def dense_index(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str = "idx") -> DataFrame:
    """0-based position within ``keys`` by ``order``; ``bucket`` must be monotone in the first order column."""
    keys = list(keys)
    bucketed = df.withColumn("chunk", bucket)
    counts = bucketed.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    carried = carry_in(counts, keys, {"_c": ("sum", "_n")}).drop("_n")
    w = Window.partitionBy(*keys, "chunk").orderBy(*order)
    return (
        bucketed.withColumn("_r", F.row_number().over(w))
        .join(carried, [*keys, "chunk"])
        .withColumn(out, (F.col("_r") - 1 + F.col("_c")).cast("long"))
        .drop("_r", "_c", "chunk")
    )


def to_chunks(samples: DataFrame, size: int = DEFAULT_CHUNK, keys: Sequence[str] = ("recording_id",), value: str = "y") -> DataFrame:
    """Long samples to one array per chunk; the group is at most ``size`` rows."""
    return (
        with_chunk(samples, size)
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("_a"))
        .select(*keys, "chunk", F.col("_a")[0]["idx"].alias("start_sample"), F.col(f"_a.{value}").alias("samples"))
    )


def to_samples(chunks: DataFrame, keys: Sequence[str] = ("recording_id",), value: str = "y") -> DataFrame:
    return chunks.select(*keys, "chunk", "start_sample", F.posexplode("samples").alias("_p", value)).select(
        *keys, "chunk", (F.col("start_sample") + F.col("_p")).alias("idx"), value
    )


def lengths(samples: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    return samples.groupBy(*keys).agg((F.max("idx") + 1).alias("n"))


def running_max(df: DataFrame, keys: Sequence[str], value: Column, out: str, idx: str, exclusive: bool = True) -> DataFrame:
    """Largest ``value`` over earlier rows (and the row itself unless ``exclusive``)."""
    keys = list(keys)
    df = df.withColumn("_v", value)
    w = Window.partitionBy(*keys, "chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    tops = df.groupBy(*keys, "chunk").agg(F.max("_v").alias("_s"))
    carried = carry_in(tops, keys, {"_c": ("max", "_s")}).drop("_s")
    local = df.select("*", F.max("_v").over(w).alias("_l"))
    return local.join(carried, [*keys, "chunk"]).withColumn(out, F.greatest("_l", "_c")).drop("_v", "_l", "_c")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """0-based position within ``keys`` for any total order, without one window per key.

    Rows are range-partitioned by key and order, numbered inside each range, and offset by the counts of earlier ranges.
    """
    from echolake.session import materialize

    keys = list(keys)
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("chunk", F.spark_partition_id().cast("long"))
    placed = materialize(spread)
    counts = placed.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    carried = carry_in(counts, keys, {"_c": ("sum", "_n")}).drop("_n")
    w = Window.partitionBy(*keys, "chunk").orderBy(*order)
    return (
        placed.withColumn("_r", F.row_number().over(w)).join(carried, [*keys, "chunk"])
        .withColumn(out, (F.col("_r") - 1 + F.col("_c")).cast("long")).drop("_r", "_c", "chunk")
    )
