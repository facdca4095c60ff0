"""Weighted signal-to-noise quality of whole recordings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.functions.levels import amplitude_db
from echolake.operators import filters, spectral, stats
from echolake.plans.chunking import lengths, to_chunks, to_samples
from echolake.session import materialize

KEYS = ("recording_id",)

# Fade checkpoints in seconds with the shortest recording each applies to, and the first two defaults.
FADE_CHECKPOINTS = (
    (0.30, 2.0), (0.40, 2.0), (0.50, 2.0), (0.75, 5.0), (1.00, 5.0), (1.25, 8.0), (1.50, 8.0), (2.00, 8.0), (2.50, 8.0),
    (3.00, 15.0), (4.00, 15.0), (5.00, 30.0), (6.00, 30.0), (7.00, 30.0), (8.00, 30.0), (9.00, 30.0), (10.00, 30.0),
)
# Margin in seconds kept off both ends of the middle section, by minimum duration.
MIDDLE_MARGINS = ((30.0, 10.0), (15.0, 3.0), (8.0, 2.0), (5.0, 1.0), (2.0, 0.5))


def _rms_db(total: Column, count: Column) -> Column:
    return F.when(count > 0, amplitude_db(F.sqrt(total / count))).otherwise(-120.0)


def fades(samples: DataFrame, sample_rate: int, keys: Sequence[str] = KEYS, sample_counts: DataFrame | None = None) -> DataFrame:
    """Lengths of quiet starts and ends: short slices at fixed distances against the level of the middle.

    All slices are conditional sums of one aggregation, so samples are read and shuffled once.
    """
    keys, sr = list(keys), sample_rate
    counted = samples.join(lengths(samples, keys) if sample_counts is None else sample_counts, keys)
    n, i, sq = F.col("n"), F.col("idx"), F.col("y") * F.col("y")
    secs = n / float(sr)
    margin = F.lit(0.3)
    for least, m in reversed(MIDDLE_MARGINS):
        margin = F.when(secs > least, m).otherwise(margin)
    ranges = {"mid": (F.floor(margin * sr), F.floor((secs - margin) * sr)), "head": (F.lit(0), F.lit(int(0.1 * sr))), "tail": (n - int(0.1 * sr), n)}
    for k, (t, _) in enumerate(FADE_CHECKPOINTS):
        ranges[f"in{k}"] = (F.lit(int((t - 0.1) * sr)), F.lit(int(t * sr)))
        ranges[f"out{k}"] = (n - int(t * sr), n - int((t - 0.1) * sr))
    aggs = [F.first("n").alias("n")]
    for name, (lo, hi) in ranges.items():
        hit = (i >= lo) & (i < hi)
        aggs += [F.sum(F.when(hit, sq)).alias(f"s_{name}"), F.count_if(hit).alias(f"c_{name}")]
    rows = counted.groupBy(*keys).agg(*aggs)
    db = {name: _rms_db(F.col(f"s_{name}"), F.col(f"c_{name}")) for name in ranges}
    dur = F.col("n") / float(sr)

    def length_of(edge: str, first: str) -> Column:
        found = F.lit(0.2)
        for k, (t, least) in enumerate(FADE_CHECKPOINTS):
            reachable = (dur >= least) & (F.col("n") > int(t * sr) if edge == "in" else F.col("n") >= int(t * sr))
            found = F.when(reachable & (db[f"{edge}{k}"] - db["mid"] < -1.0), t).otherwise(found)
        return F.when((db["mid"] < -100.0) | (db[first] - db["mid"] > -10.0), 0.0).otherwise(found)

    return rows.select(*keys, length_of("in", "head").alias("fade_in_secs"), length_of("out", "tail").alias("fade_out_secs"))


def _bell(f, center, gain_db, q):
    x = (f / center - center / f) * q
    return 1.0 + (10 ** (gain_db / 20) - 1.0) / (1.0 + x * x)


def noise_weighting(fft: int, rate: int) -> np.ndarray:
    """Noise curve: first-order rise at 6.5 kHz, sixth-order fall at 9.7 kHz, level set by rate."""
    f = np.arange(fft // 2 + 1) * (rate / fft)
    rise, fall = f / 6500.0, f / 9700.0
    lift = 17.0 + (2.6 if rate == 48_000 else 2.9 if rate <= 44_100 else 1.1 if rate == 96_000 else 0.0)
    return np.where(f < 1.0, 0.0, rise / np.sqrt(1 + rise**2) / (1 + fall**2) ** 3 * 10 ** (lift / 20))


def loudness_weighting(fft: int, rate: int) -> np.ndarray:
    """Equal-loudness curve for 80 phon as a product of simple sections."""
    f = np.maximum(np.arange(fft // 2 + 1) * (rate / fft), 1e-9)
    r = f / 220.0
    out = (r / np.sqrt(1 + r * r)) ** 2
    if rate > 31_000:
        out = out / (1 + (f / 15_500.0) ** 2) ** 8
    # Bells as (centre Hz, gain dB, q).
    bells = [(80.0, 4.0, 2.5), (800.0, 3.0, 2.0), (1600.0, -8.0, 1.0), (3000.0, 8.0, 2.2), (8900.0, -14.0, 1.4),
             (19_000.0, 5.0 if rate <= 48_000 else 12.0, 0.7)]
    for bell in bells:
        out = out * _bell(f, *bell)
    return np.where(f < 0.1, 0.0, out)


def snr_grade(snr: Column) -> Column:
    return F.when(snr > 49.5, "A").when(snr > 34.5, "B").when(snr > 19.5, "C").when(snr > 4.5, "D").otherwise("E")


def weighted_snr(samples: DataFrame, sample_rate: int, chunk: int, fft: int = 4096, min_rate: int = 30_000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Grade, signal and noise levels and warnings per recording; guards come first, as in a ladder."""
    keys, sr = list(keys), sample_rate
    n_rows = materialize(lengths(samples, keys))
    chunks = to_chunks(samples, chunk, keys)
    clip = stats.clipping(samples, keys=keys)
    ultra = spectral.ultrasonic_share(samples, n_rows, sr, keys=keys) if sr > 48_000 else None
    high = to_samples(filters.linear_filter(chunks, filters.high_pass(100.0, sr), keys), keys).select(*keys, "idx", "y")
    edges = stats.edge_transients(high, n_rows, sr, keys).join(fades(high, sr, keys, n_rows), keys)
    cut_in = F.when(F.col("start_transient"), F.greatest("fade_in_secs", F.lit(0.2))).otherwise(F.col("fade_in_secs"))
    cut_out = F.when(F.col("end_transient"), F.greatest("fade_out_secs", F.lit(0.7))).otherwise(F.col("fade_out_secs"))
    # One row per recording each: kept, so that later branches do not repeat the filters behind them.
    spans = materialize(edges.join(n_rows, keys).select(
        "*", F.floor(cut_in * sr).alias("a"), (F.col("n") - F.floor(cut_out * sr)).alias("b"), cut_in.alias("cut_in"), cut_out.alias("cut_out")
    ))
    usable = spans.where(F.col("b") > F.col("a") + sr // 10)
    region = samples.join(usable.select(*keys, "a", "b"), keys).where((F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b")))
    region_chunks = to_chunks(region.select(*keys, (F.col("idx") - F.col("a")).alias("idx"), "y"), chunk, keys)

    def weighted(curve):
        return to_samples(filters.spectral_gain(region_chunks, chunk, fft, curve(fft, sr), keys), keys).select(*keys, "idx", "y")

    noise = weighted(noise_weighting)
    floors = materialize(stats.gap_aware_floor(noise, stats.noise_window(sr), keys))
    dense = stats.dense_soundscape(noise, floors, keys=keys).select(*keys, F.col("pct").alias("dense_pct"), F.col("is_dense").alias("dense"))
    loud = weighted(loudness_weighting).groupBy(*keys).agg((amplitude_db(F.max(F.abs("y"))) - 3.0).alias("signal_db"))
    rows = spans.join(clip, keys).join(floors, keys, "left").join(dense, keys, "left").join(loud, keys, "left")
    rows = rows.join(ultra, keys, "left") if ultra is not None else rows.withColumn("content", F.lit("none"))
    guard = (
        F.when(F.col("n") / float(sr) < 0.6, "too_short").when(F.lit(sr < min_rate), "rate_too_low").when(F.col("peak") < 1e-10, "silent")
        .when(F.col("noise_db").isNull(), "no_usable_region")
    )
    rows = rows.withColumn("guard", guard).withColumn("snr_db", F.when(guard.isNull(), F.col("signal_db") - F.col("noise_db")).otherwise(0.0))
    rows = rows.withColumn("grade", F.when(F.col("guard").isNull(), snr_grade(F.col("snr_db"))).otherwise("E"))
    open_ = F.col("guard").isNull()
    early = ~F.coalesce(F.col("guard").isin("too_short", "rate_too_low"), F.lit(False))
    ranged = early & ~F.coalesce(F.col("guard") == "silent", F.lit(False))
    warnings = F.array(
        F.when(early & F.col("is_clipped"), "clipped"), F.when(early & (F.col("content") != "none"), F.concat("content", F.lit("_content"))),
        F.when(ranged & F.col("start_transient") & (F.col("cut_in") <= 0.2), "start_transient"),
        F.when(ranged & F.col("end_transient") & (F.col("cut_out") <= 0.7), "end_transient"),
        F.when(ranged & (F.col("fade_in_secs") > 0), "fade_in"), F.when(ranged & (F.col("fade_out_secs") > 0), "fade_out"), F.col("guard"),
        F.when(open_ & F.col("dense"), "dense_soundscape"), F.when(open_ & (F.col("snr_db") < 20) & ~F.col("dense"), "low_snr"),
        F.when(open_ & F.col("has_silent_gaps"), "silent_gaps"),
        F.when(open_ & (F.col("content") == "ultrasonic") & (F.col("grade") == "A"), "grade_reflects_audible_band"),
    )
    return rows.select(
        *keys, "snr_db", "grade", "signal_db", "noise_db", "fade_in_secs", "fade_out_secs", "is_clipped", "clip_count", "content", "dense_pct",
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )
