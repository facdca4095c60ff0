"""Recorder fingerprints: window picking, integer-multiple and inverse-filter tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.functions.levels import butterworth_gain, butterworth_pole
from echolake.operators.intervals import points_in_intervals

KEYS = ("recording_id",)
WARMUP, WINDOW, MAX_WINDOWS, QUIET_SD = 1024, 8192, 6, 20.0

# High-pass cutoffs of the firmware in Hz and its oversampling-times-divider settings.
CUTOFFS_HZ = (48, 8)
OVERSAMPLING = (1, 2, 4, 8)

# Biquad presets of the firmware as (dB cut, b0, b1, b2, a2).
PRESETS = (
    (3, 0.99192746, -1.79668601, 0.95279146, 0.94471892),
    (6, 0.98369852, -1.78737325, 0.95094035, 0.93463886),
    (9, 0.97509378, -1.77642980, 0.94769998, 0.92279376),
    (12, 0.91071516, -1.59205495, 0.81251270, 0.72322786),
    (32, 0.99209049, -1.83314419, 0.99209049, 0.98418098),
)


def pick_windows(lengths: DataFrame, warmup: int = WARMUP, window: int = WINDOW, most: int = MAX_WINDOWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Starts of evenly spaced windows after a warm-up, for recordings of at least two windows."""
    usable = F.col("n") - warmup - window
    count = F.least(F.lit(most), 1 + F.floor(usable / window))
    stride = F.when(count > 1, F.floor(usable / (count - 1))).otherwise(0)
    rows = lengths.where(F.col("n") >= warmup + 2 * window)
    return rows.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("win"), (warmup + i * stride).alias("start")))).alias("w")).select(*keys, "w.*")


def window_samples(samples: DataFrame, windows: DataFrame, window: int = WINDOW, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples of the picked windows, joined by index bucket, so samples outside every window drop out unmultiplied."""
    spans = windows.withColumn("_end", F.col("start") + window)
    return points_in_intervals(samples, spans, list(keys), "idx", "start", "_end", float(window), closed=False).drop("_end")


def window_arrays(samples: DataFrame, windows: DataFrame, window: int = WINDOW, quiet_sd: float = QUIET_SD, keys: Sequence[str] = KEYS) -> DataFrame:
    """One array per window loud enough to test."""
    rows = window_samples(samples, windows, window, keys)
    grouped = rows.groupBy(*keys, "win").agg(F.array_sort(F.collect_list(F.struct("idx", "v")))["v"].alias("w"), F.stddev_pop("v").alias("sd"))
    return grouped.where(F.col("sd") >= quiet_sd).drop("sd")


def integer_multiple_scores(samples: DataFrame, windows: DataFrame, sample_rate: int, window: int = WINDOW, quiet_sd: float = QUIET_SD,
                            keys: Sequence[str] = KEYS) -> DataFrame:
    """How closely de-filtered sample differences sit on multiples of each candidate gain."""
    return integer_multiples_of(window_arrays(samples, windows, window, quiet_sd, keys), F.lit(float(sample_rate)), keys)


def integer_multiples_of(arrays: DataFrame, rate: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from arrays(keys, w) of loud windows; ``rate`` may be a column of them."""
    presets = []
    for cutoff in CUTOFFS_HZ:
        pole = butterworth_pole(F.lit(float(cutoff)), rate)
        for os_div in OVERSAMPLING:
            presets.append(F.struct(F.lit(cutoff).alias("cutoff_hz"), F.lit(os_div).alias("os_div"), pole.alias("pole"),
                                    (butterworth_gain(pole) * (16.0 / os_div)).alias("gain")))
    diffs = arrays.select(*keys, "w", F.inline(F.array(*presets))).where("gain >= 1.5")
    pairs = diffs.select(
        *keys, "cutoff_hz", "os_div", "pole", "gain",
        F.explode(F.zip_with(F.slice("w", F.lit(2), F.size("w") - 1), F.slice("w", F.lit(1), F.size("w") - 1), lambda y, p: (y - F.col("pole") * p) / F.col("gain"))).alias("x"),
    )
    off = F.abs(F.col("x") - F.round("x"))
    return pairs.groupBy(*keys, "cutoff_hz", "os_div").agg(
        F.first("gain").alias("gain"), F.avg(off).alias("mean_abs_frac"), F.avg((off < 0.1).cast("double")).alias("near_integer_frac")
    )


def integer_multiple_verdict(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    order = F.struct("mean_abs_frac", (-F.col("cutoff_hz")).alias("_c"), "os_div")
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("cutoff_hz", "os_div", "gain", "mean_abs_frac", "near_integer_frac"), order).alias("b"))
    frac = F.col("b.mean_abs_frac")
    return best.select(*keys, "b.*", F.when(frac < 0.04, "match").when(frac < 0.10, "possible").otherwise("no_match").alias("verdict"))


SCORE_TYPE = "array<struct<db_cut:int,in_range:bigint,near:bigint,frac:double,recovered:bigint,resid_sq:double,actual_sq:double>>"
NEAR_INTEGER = 0.1


def inverse_filter_scores(samples: DataFrame, windows: DataFrame, window: int = WINDOW, quiet_sd: float = QUIET_SD, keys: Sequence[str] = KEYS) -> DataFrame:
    """Undo each preset's filter, round to converter codes, redo it, and compare with the recording."""
    return inverse_filters_of(window_arrays(samples, windows, window, quiet_sd, keys), keys).select(*keys, "db_cut", "in_range_frac", "residual")


def inverse_filters_of(arrays: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from arrays(keys, w) of loud windows, with how near the codes in range lie to whole numbers."""

    def recursion(x, num, den):
        """Direct form over all windows at once: y = (num * x - den[1:] * y) / den[0]."""
        y = np.zeros_like(x)
        for i in range(x.shape[1]):
            acc = sum(num[k] * x[:, i - k] for k in range(min(len(num), i + 1)))
            acc = acc - sum(den[k] * y[:, i - k] for k in range(1, min(len(den), i + 1)))
            y[:, i] = acc / den[0]
        return y

    def leak(codes):
        level = np.zeros(codes.shape[0])
        out = np.empty_like(codes)
        for i in range(codes.shape[1]):
            step = (codes[:, i] - 2048) * 65536.0 - level
            level = level + step / 16.0
            out[:, i] = step / 4096.0
        return out

    def score(y):
        settle = min(1024, y.shape[1] // 4)
        rows = [[] for _ in range(len(y))]
        for cut, b0, b1, b2, a2 in PRESETS:
            flat = recursion(y, (1.0, b1, a2), (b0, b1, b2))
            sums = np.cumsum(flat, axis=1) - flat
            codes = ((flat * 4096.0 + 256.0 * sums) / 65536.0 + 2048.0)[:, settle:]
            actual = y[:, settle:]
            within = (codes >= 0) & (codes <= 4095)
            inside = within.sum(axis=1)
            off = np.where(within, np.abs(codes - np.round(codes)), 0.0)
            near = (within & (off < NEAR_INTEGER)).sum(axis=1)
            again = recursion(leak(np.clip(np.sign(codes) * np.floor(np.abs(codes) + 0.5), 0, 4095)), (b0, b1, b2), (1.0, b1, a2))
            skip = min(256, codes.shape[1] // 4)
            resid = ((actual - again)[:, skip:] ** 2).sum(axis=1)
            power = (actual[:, skip:] ** 2).sum(axis=1)
            for j in range(len(y)):
                rows[j].append((cut, int(inside[j]), int(near[j]), float(off[j].sum()), codes.shape[1], float(resid[j]), float(power[j])))
        return rows

    def run(series: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack([np.asarray(x, dtype=float) for x in series])) if len(series) else [])

    rows = arrays.select(*keys, F.inline(F.pandas_udf(run, SCORE_TYPE)("w")))
    agg = rows.groupBy(*keys, "db_cut").agg(*[F.sum(c).alias(c) for c in ("in_range", "near", "frac", "recovered", "resid_sq", "actual_sq")])
    return agg.select(
        *keys, "db_cut", (F.col("in_range") / F.col("recovered")).alias("in_range_frac"),
        F.when(F.col("actual_sq") > 0, F.sqrt(F.col("resid_sq") / F.col("actual_sq"))).alias("residual"),
        F.when(F.col("in_range") > 0, F.col("near") / F.col("in_range")).otherwise(0.0).alias("near_integer_frac"),
        F.when(F.col("in_range") > 0, F.col("frac") / F.col("in_range")).alias("mean_abs_frac"),
    )


def inverse_filter_verdict(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    kept = [c for c in ("db_cut", "in_range_frac", "residual", "near_integer_frac", "mean_abs_frac") if c in scores.columns]
    best = scores.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct("residual", "db_cut")).alias("b"))
    default = F.col("b.db_cut") == 12
    return best.select(
        *keys, "b.*",
        F.when((F.col("b.residual") < 0.02) & (F.abs(F.col("b.in_range_frac") - 1.0) < 1e-9) & default, "match")
        .when((F.col("b.residual") < 0.06) & (F.col("b.in_range_frac") > 0.99) & default, "possible").otherwise("no_match").alias("verdict"),
    )


# The rates at which each test means something.
MULTIPLE_RATES = (8_000, 384_000)
INVERSE_RATES = (384_000 * 0.99, 384_000 * 1.01)


def gated(verdicts: DataFrame, recordings: DataFrame, rates: tuple[float, float], padded: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Verdicts with ``not_applicable`` where recordings(keys, sample_rate, bits_per_sample, is_float, zero_padded) rule the test out:
    anything but 16-bit integers, a rate outside the range, or (unless ``padded``) low bits that are all zero.
    """
    fits = ~F.col("is_float") & (F.col("bits_per_sample") == 16) & F.col("sample_rate").between(*rates)
    if not padded:
        fits = fits & ~F.coalesce(F.col("zero_padded"), F.lit(False))
    facts = recordings.select(*keys, F.coalesce(fits, F.lit(False)).alias("_fits"))
    joined = verdicts.join(facts, list(keys), "left")
    return joined.withColumn("verdict", F.when(F.coalesce("_fits", F.lit(True)), F.col("verdict")).otherwise("not_applicable")).drop("_fits")
