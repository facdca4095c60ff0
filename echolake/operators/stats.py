"""Sample statistics: one or two hash aggregations, combined map-side, but for sums that are taken in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.functions.levels import amplitude_db
from echolake.plans.chunking import chunk_window, div, with_halo

KEYS = ("recording_id",)
GAP_RMS = 1e-4


def channel_view(samples: DataFrame, view: str, channels: int = 2, channel: int = 0) -> DataFrame:
    """Mono mix, left-minus-right or one channel; absent channels read as silence."""
    wide = samples.groupBy("recording_id", "idx")
    if view == "mono":
        return wide.agg((F.sum("y") / channels).alias("y"))
    if view == "difference":
        left, right = (F.sum(F.when(F.col("channel") == c, F.col("y")).otherwise(0.0)) for c in (0, 1))
        return wide.agg((left - right).alias("y"))
    if view == "channel":
        return wide.agg(F.sum(F.when(F.col("channel") == channel, F.col("y")).otherwise(0.0)).alias("y"))
    raise ValueError(f"unknown channel view {view}")


def chunk_range(chunks: DataFrame, start: int, count: int) -> DataFrame:
    """Samples [start, start+count) from chunk arrays; untouched chunks are pruned by their start column."""
    size = F.size("samples")
    lo = F.greatest(F.lit(start) - F.col("start_sample"), F.lit(0))
    hi = F.least(F.lit(start + count) - F.col("start_sample"), size)
    return (
        chunks.where((F.col("start_sample") < start + count) & (F.col("start_sample") + size > start))
        .withColumn("samples", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")))
        .withColumn("start_sample", F.col("start_sample") + lo)
    )


def analysis_window(samples: DataFrame, sample_rate: Column | int, seconds: float = 30.0) -> DataFrame:
    rate = sample_rate if isinstance(sample_rate, Column) else F.lit(sample_rate)
    return samples.where(F.col("idx") < F.floor(rate * seconds))


def _finite_db(value: Column) -> Column:
    return F.when(F.abs(value) > 0, 20 * F.log10(F.abs(value)))


def signal_stats(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extremes, RMS and mean of each recording, and these in dB.

    Sums of doubles depend on their order, so a mean at a tie of the rounding, or of zero, would change with the tasks that rows lie in. Both sums run
    through the samples by idx, one recording in one task, which holds a running sum and spills its sort.
    """
    order = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = samples.select(*keys, "idx", "y", F.sum("y").over(order).alias("_sum"), F.sum(F.col("y") * F.col("y")).over(order).alias("_squares"))
    base = summed.groupBy(*keys).agg(
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
        F.sqrt(F.max_by("_squares", "idx") / F.count("y")).alias("rms"),
        (F.max_by("_sum", "idx") / F.count("y")).alias("dc_bias"),
        F.count(F.lit(1)).alias("n"),
    )
    return base.select(
        *base.columns,
        _finite_db(F.col("min_y")).alias("min_db"),
        _finite_db(F.col("max_y")).alias("max_db"),
        _finite_db(F.col("rms")).alias("rms_db"),
        _finite_db(F.col("dc_bias")).alias("dc_db"),
    )


def peak_level(samples: DataFrame, sample_rate: int, selection: tuple[int, int] | None = None, seconds: float = 30.0,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Peak dBFS of the first seconds, of everything and of a sample range, in one pass."""
    mag = F.abs("y")

    def db(peak: Column) -> Column:
        return F.when(peak > 1e-10, 20 * F.log10(peak))

    lo, hi = selection or (0, 0)
    agg = samples.groupBy(*keys).agg(
        F.max(F.when(F.col("idx") < int(seconds * sample_rate), mag)).alias("head"),
        F.max(mag).alias("full"),
        F.max(F.when((F.col("idx") >= lo) & (F.col("idx") < hi), mag)).alias("sel"),
    )
    return agg.select(
        *keys, db(F.col("head")).alias("peak_db"), db(F.col("full")).alias("full_peak_db"),
        db(F.col("sel")).alias("selection_peak_db"),
    )


def silence_check(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    peak = samples.groupBy(*keys).agg(F.max(F.abs("y")).alias("peak"))
    gain = F.when(F.col("peak") >= 0.002, -3.0 - 20 * F.log10("peak"))
    return peak.withColumn("auto_gain_db", gain).withColumn(
        "status",
        F.when(F.col("peak") < 0.002, "silent").when(F.col("auto_gain_db") > 30, "high_gain").otherwise("ok"),
    )


def clipping(samples: DataFrame, level: float = 0.999, peak_level_: float = 0.9999, min_count: int = 4,
             keys: Sequence[str] = KEYS) -> DataFrame:
    agg = samples.groupBy(*keys).agg(
        F.max(F.abs("y")).alias("peak"), F.count_if(F.abs("y") > level).alias("clip_count")
    )
    return agg.withColumn("is_clipped", (F.col("peak") > peak_level_) & (F.col("clip_count") > min_count))


def window_rms(samples: DataFrame, window: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return samples.groupBy(*keys, div("idx", window).alias("win")).agg(
        F.count(F.lit(1)).alias("m"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms")
    )


def min_window_rms_db(samples: DataFrame, window: int = 512, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quietest full window above the gap level; a recording shorter than one window is one window."""
    wins = window_rms(samples, window, keys)
    usable = (F.col("m") == window) | (F.col("win") == 0)
    active = F.min(F.when(usable & (F.col("rms") > GAP_RMS), F.col("rms")))
    return wins.groupBy(*keys).agg(
        F.coalesce(20 * F.log10(active), F.lit(-120.0)).alias("noise_floor_db")
    )


def noise_window(sample_rate: int) -> int:
    return min(max(sample_rate // 200, 40), 2400)


def gap_aware_floor(samples: DataFrame, window: int, keys: Sequence[str] = KEYS) -> DataFrame:
    wins = window_rms(samples, window, keys).where((F.col("m") == window) | (F.col("win") == 0))
    agg = wins.groupBy(*keys).agg(
        F.min(F.when(F.col("rms") > GAP_RMS, F.col("rms"))).alias("active_rms"),
        F.min("rms").alias("all_rms"),
        F.count_if(F.col("rms") <= GAP_RMS).alias("silent_windows"),
    )
    return agg.select(
        *keys,
        amplitude_db(F.coalesce("active_rms", "all_rms")).alias("noise_db"),
        (F.col("active_rms").isNotNull() & (F.col("silent_windows") > 0)).alias("has_silent_gaps"),
    )


def dense_soundscape(samples: DataFrame, floors: DataFrame, window: int = 40, min_count: int = 30,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of short windows within 3 dB of the floor in ``floors(keys, noise_db)``."""
    wins = window_rms(samples, window, keys).where((F.col("m") == window) | (F.col("win") == 0))
    near = amplitude_db(F.col("rms")) < F.col("noise_db") + 3.0
    agg = wins.join(floors.select(*keys, "noise_db"), list(keys)).groupBy(*keys).agg(
        F.count_if(near).alias("near_floor"), F.count(F.lit(1)).alias("windows")
    )
    return agg.withColumn("pct", F.col("near_floor") * 100.0 / F.col("windows")).withColumn(
        "is_dense", (F.col("near_floor") < min_count) | (F.col("pct") < 1.0)
    )


def cell_envelope(samples: DataFrame, cell: int = 256, keys: Sequence[str] = KEYS) -> DataFrame:
    return samples.groupBy(*keys, div("idx", cell).alias("cell")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))


def envelope_rollup(cells: DataFrame, factor: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coarser min/max cells from finer ones, without loss."""
    return cells.groupBy(*keys, div("cell", factor).alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def envelope_range(cells: DataFrame, first: int, last: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return cells.where(F.col("cell").between(first, last)).groupBy(*keys).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def pixel_envelope(samples: DataFrame, lengths: DataFrame, pixels: int, gain: float = 1.0,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Min/max per pixel column of a fixed-width overview."""
    per_px = F.col("n") / F.lit(float(pixels))
    px = F.ceil((F.col("idx") + 1) / per_px).cast("long") - 1
    # The division can be off by one ulp at an edge; settle it with the forward mapping.
    px = F.when(F.floor((px + 1) * per_px) <= F.col("idx"), px + 1).when(F.floor(px * per_px) > F.col("idx"), px - 1).otherwise(px)
    return (
        samples.join(lengths, list(keys))
        .withColumn("px", F.least(px, F.lit(pixels - 1)))
        .groupBy(*keys, "px")
        .agg((F.min("y") * gain).alias("lo"), (F.max("y") * gain).alias("hi"))
    )


def zero_crossings(samples: DataFrame, sample_rate: int, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sign changes (zero counts as positive) and the frequency they imply."""
    rows = with_halo(samples, chunk, before=1)
    positive = F.col("y") >= 0
    prev = F.lag(positive).over(chunk_window(keys))
    marked = rows.withColumn("cross", prev.isNotNull() & (prev != positive)).where("core")
    agg = marked.groupBy(*keys).agg(F.count_if("cross").alias("crossings"), F.count(F.lit(1)).alias("n"))
    secs = (F.col("n") - 1) / F.lit(float(sample_rate))
    return agg.select(
        *keys, "crossings", secs.alias("duration_secs"),
        F.when(secs > 0, F.col("crossings") / (2 * secs)).otherwise(0.0).alias("freq_hz"),
    )


def edge_transients(samples: DataFrame, lengths: DataFrame, sample_rate: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Loud first 0.2 s or last 0.7 s against the second next to them."""
    a, b, c, d = (int(s * sample_rate) for s in (0.2, 1.2, 0.7, 1.7))
    mag, idx, n = F.abs("y"), F.col("idx"), F.col("n")

    def peak(cond):
        return F.max(F.when(cond, mag))

    agg = samples.join(lengths, list(keys)).groupBy(*keys).agg(
        F.first("n").alias("n"),
        peak(idx < a).alias("head"), peak((idx >= a) & (idx < b)).alias("head_ref"),
        peak(idx >= n - c).alias("tail"), peak((idx >= n - d) & (idx < n - c)).alias("tail_ref"),
    )

    def loud(edge, ref, need):
        return F.coalesce((F.col("n") > need) & (F.col(ref) > 1e-10) & (F.col(edge) > 2 * F.col(ref)), F.lit(False))

    return agg.select(*keys, loud("head", "head_ref", b).alias("start_transient"), loud("tail", "tail_ref", d).alias("end_transient"))
