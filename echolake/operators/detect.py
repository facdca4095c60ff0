"""Event detection on sample series: envelopes, hysteresis, pulses and zero-crossing rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.operators import pulses
from echolake.operators.intervals import points_in_intervals
from echolake.operators.ranks import nth_smallest
from echolake.plans.chunking import chunk_window, dense_index, div, running_last, running_sum, with_chunk, with_halo

KEYS = ("recording_id",)


def mean_envelope(samples: DataFrame, window: int, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing mean of |y|."""
    rows = with_halo(samples, chunk, before=window - 1)
    w = chunk_window(keys).rowsBetween(-(window - 1), 0)
    return rows.withColumn("env", F.avg(F.abs("y")).over(w)).where("core").drop("core")


def noise_floor(envelope: DataFrame, lengths: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tenth percentile of all envelope values, exact at every length; ``n`` is their number (or that of ``lengths``)."""
    tenth = nth_smallest(envelope, keys, "env", F.expr("n div 10"), "_tenth", count="n")
    if lengths is not None:
        tenth = tenth.drop("n").join(lengths, list(keys))
    return tenth.select(*keys, "n", F.greatest("_tenth", F.lit(1e-10)).alias("floor"))


def latch(rows: DataFrame, rise: Column, fall: Column, out: str = "armed", keys: Sequence[str] = KEYS) -> DataFrame:
    """Hysteresis state per sample: set by ``rise``, cleared by ``fall``, kept otherwise."""
    event = F.when(rise, F.lit(1)).when(fall, F.lit(0))
    return running_last(rows, keys, {out: event}).withColumn(out, F.coalesce(F.col(out), F.lit(0)) == 1)


def raw_pulses(rows: DataFrame, min_gap: int, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pulses of any length of rows(keys, chunk, idx, env, high, low, n), with thresholds that are the same for all rows of a recording."""
    facts = ("high", "low", "n")
    packed = pulses.packed(rows, keys, "env", *facts)
    one = packed.select(*keys, "chunk", "first", "env", *[F.col(c)[0].cast("long" if c == "n" else "double").alias(c) for c in facts], F.lit(0.0).alias("floor"))
    return pulses.find_pulses(one, min_gap, 0, 1 << 62, keys).select(*keys, "start_idx", "end_idx", "peak_idx", "peak_amp")


@dataclass(frozen=True)
class PulseSettings:
    threshold_db: float = 6.0
    min_gap_ms: float = 5.0
    min_ms: float = 0.5
    max_ms: float = 50.0

    def samples(self, ms: float, rate: int) -> int:
        return max(int(rate * ms / 1000.0), 1)


def detect_pulses(envelope: DataFrame, lengths: DataFrame, sample_rate: int, settings: PulseSettings, chunk: int,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Numbered pulses with SNR against the recording's own noise floor."""
    keys = list(keys)
    if settings.threshold_db < 0:
        raise ValueError("threshold_db must not be negative")
    chunks = pulses.packed(envelope, keys, "env")
    floors = noise_floor(chunks, lengths, keys)
    high = F.col("floor") * 10 ** (settings.threshold_db / 20)
    low = F.col("floor") * 10 ** (max(settings.threshold_db - 3.0, 0.0) / 20)
    rows = chunks.join(floors, keys).withColumn("high", high).withColumn("low", low)
    gap, shortest, longest = (settings.samples(x, sample_rate) for x in (settings.min_gap_ms, settings.min_ms, settings.max_ms))
    rate = float(sample_rate)
    return pulses.find_pulses(rows, gap, shortest, longest, keys).select(
        *keys,
        (F.col("no") + 1).alias("pulse_no"),
        (F.col("start_idx") / rate).alias("start_time"),
        (F.col("end_idx") / rate).alias("end_time"),
        (F.col("peak_idx") / rate).alias("peak_time"),
        "peak_amp",
        (20 * F.log10(F.col("peak_amp") / F.col("floor"))).alias("snr_db"),
    )


def pulse_peak_bins(found: DataFrame, columns: DataFrame, keys: Sequence[str] = KEYS, width: float = 0.1) -> DataFrame:
    """Strongest bin of spectrum columns(keys, t, mags) inside each pulse; earliest column, then lowest bin, on ties.

    Each column is reduced to its own maximum before the range join.
    """
    top = columns.select(*keys, "t", F.array_max("mags").alias("mag"), (F.array_position("mags", F.array_max("mags")) - 1).alias("bin"))
    hits = points_in_intervals(top.where("mag > 0"), found.select(*keys, "pulse_no", "start_time", "end_time"), keys, "t", "start_time", "end_time", width)
    best = hits.groupBy(*keys, "pulse_no").agg(F.max_by("bin", F.struct("mag", -F.col("t"))).alias("peak_bin"))
    return found.join(best, [*keys, "pulse_no"], "left").withColumn("peak_bin", F.coalesce("peak_bin", F.lit(0)))


def _armed_crossings(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows(keys, chunk, core, idx, y, env, high, low) -> core rows with the armed flag, crossing flag and last disarm."""
    positive = F.col("y") >= 0
    prev = F.lag(positive).over(chunk_window(keys))
    crossed = rows.withColumn("cross", prev.isNotNull() & (prev != positive)).where("core").drop("core")
    later = F.col("idx") > 0
    event = F.when(later & (F.col("env") > F.col("high")), 1).when(later & (F.col("env") < F.col("low")), 0)
    held = running_last(crossed, keys, {"armed": event, "island": F.when(event == 0, F.col("idx"))})
    return held.withColumn("cross", F.col("cross") & (F.coalesce("armed", F.lit(0)) == 1)).withColumn(
        "island", F.coalesce("island", F.lit(-1).cast("long"))
    )


def adaptive_thresholds(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """5 % of the peak to arm, 40 % of that to disarm."""
    high = F.greatest(F.max(F.abs("y")) * 0.05, F.lit(1e-5))
    return samples.groupBy(*keys).agg(high.alias("high"), (F.max("idx") + 1).alias("n")).withColumn("low", F.col("high") * 0.4)


def crossing_rate_bins(envelope: DataFrame, thresholds: DataFrame, sample_rate: int, bin_samples: int, chunk: int,
                       keys: Sequence[str] = KEYS) -> DataFrame:
    """Crossings per second in bins (k*b, (k+1)*b], counted while armed; envelope(keys, chunk, idx, y, env)."""
    keys = list(keys)
    rows = pulses.packed(envelope if "chunk" in envelope.columns else with_chunk(envelope, chunk), keys, "y", "env").join(thresholds, keys)
    bins = pulses.crossing_bins(rows, bin_samples, keys)
    secs = F.when(F.col("last") == F.col("n") - 1, (F.col("last") % bin_samples + 1) / F.lit(float(sample_rate))).otherwise(
        bin_samples / float(sample_rate)
    )
    return bins.select(*keys, "bin", "crossings", (F.col("crossings") / (2 * secs)).alias("rate"), (F.col("crossings") > 0).alias("armed"))


def divided_crossings(envelope: DataFrame, thresholds: DataFrame, factor: int, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every ``factor``-th armed crossing, counted afresh after each disarm."""
    keys = list(keys)
    rows = with_halo(envelope.drop("chunk"), chunk, before=1).join(thresholds, keys)
    crossings = _armed_crossings(rows, keys).where("cross").select(*keys, "island", "idx", "env", "high")
    numbered = dense_index(crossings, [*keys, "island"], div("idx", chunk), ["idx"], out="k")
    return numbered.where((F.col("k") + 1) % factor == 0).select(
        *keys, "idx", F.least(F.col("env") / F.col("high"), F.lit(1.0)).alias("amp")
    )


def zero_crossing_dots(intervals: DataFrame, resolution: Column | float, divisor: int, chunk: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Times and frequencies of zero-crossing dots from intervals(keys, idx, ticks, is_off).

    A dot's period spans its two neighbours; edge dots and periods outside the readable range have frequency zero.
    """
    keys = list(keys)
    scale = 25_000.0 / resolution
    timed = running_sum(with_chunk(intervals, chunk), keys, F.col("ticks").cast("double"), "_ticks")
    timed = timed.withColumn("t_us", F.col("_ticks") * scale).drop("_ticks", "chunk")
    rows = with_halo(timed, chunk, before=1, after=1)
    w = chunk_window(keys)
    period = F.lead("t_us").over(w) - F.lag("t_us").over(w)
    lo, hi = max(48.0, 4.0 * divisor), min(12_589.0, 250.0 * divisor)
    freq = F.when((period >= lo) & (period <= hi), divisor * 1e6 / period).otherwise(0.0)
    return rows.withColumn("freq_hz", F.coalesce(freq, F.lit(0.0))).where("core").select(
        *keys, "idx", (F.col("t_us") / 1e6).alias("t"), "freq_hz", "is_off"
    )


def dot_summary(dots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dot counts and frequency range; the median is the upper one of visible non-zero dots.

    The median comes from per-frequency counts, so equal readings collapse before they are ranked.
    """
    keys = list(keys)
    from echolake.operators.ranks import upper_median

    good = ~F.col("is_off") & (F.col("freq_hz") > 0)
    agg = dots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dots"), F.count_if(~F.col("is_off")).alias("on_dots"), F.count_if("is_off").alias("off_dots"),
        F.min(F.when(good, F.col("freq_hz"))).alias("min_hz"), F.max(F.when(good, F.col("freq_hz"))).alias("max_hz"),
        F.avg(F.when(good, F.col("freq_hz"))).alias("mean_hz"), F.max("t").alias("duration_secs"),
    )
    return agg.join(upper_median(dots.where(good), keys, "freq_hz", "median_hz"), keys, "left")
