"""Measures on one summary spectrum per recording, held as an array bounded by the transform size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.operators.columns import at, indices, total

KEYS = ("recording_id",)


def gather(bins: DataFrame, value: str, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bin rows to one array per recording; the group is at most one row per bin."""
    return bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", value)))[value].alias(out))


def bin_means(columns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean magnitude per bin over spectrum columns."""
    return columns.select(*keys, F.posexplode("mags").alias("bin", "m")).groupBy(*keys, "bin").agg(F.avg("m").alias("mean_mag"))


def _upper_median(arr: Column) -> Column:
    return F.get(F.sort_array(arr), F.floor(F.size(arr) / 2).cast("int"))


def running_upper_median(profiles: DataFrame, value: str, half: int = 15, out: str = "floor") -> DataFrame:
    def around(i):
        lo = F.greatest(i - half, F.lit(0))
        return _upper_median(F.slice(value, (lo + 1).cast("int"), (F.least(i + half + 1, F.size(value)) - lo).cast("int")))

    return profiles.withColumn(out, F.transform(indices(F.size(value)), around))


BAND_TYPE = "array<struct<center_hz:double,bandwidth_hz:double,q:double,strength_db:double>>"


def _per_row(fn, dtype: str):
    """A pandas UDF that applies a small function to one bounded array (or list of structs) per row."""
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([fn(x) for x in series], index=series.index)

    return F.pandas_udf(run, dtype)


def _first_beyond(values: np.ndarray, ok: np.ndarray) -> int:
    """Offset of the first element for which ``ok`` is false, or the length."""
    bad = np.flatnonzero(~ok)
    return int(bad[0]) if len(bad) else len(values)


def noise_bands(profiles: DataFrame, hz_per_bin: float, threshold: float = 6.0, half: int = 15, min_q: float = 5.0,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Bands that stand out of the running median of profiles(keys, mean): array of structs in centre order."""

    def find(mean):
        mean = np.asarray(mean, dtype=float)
        n = len(mean)
        floor = np.array([np.sort(w)[len(w) // 2] for w in (mean[max(i - half, 0):i + half + 1] for i in range(n))])
        p = np.where(floor > 1e-20, mean / np.where(floor > 1e-20, floor, 1.0), 0.0)
        inner = np.arange(1, n - 1)
        found = []
        for i in inner[(p[inner] >= threshold) & (p[inner] > p[inner - 1]) & (p[inner] >= p[inner + 1])]:
            above = p > p[i] / math.sqrt(2.0)
            below_n = _first_beyond(p[:i], above[:i][::-1])
            width = (below_n + _first_beyond(p[i + 1:], above[i + 1:]) + 1) * hz_per_bin
            center = i * hz_per_bin
            strength = 20 * math.log10(mean[i] / floor[i]) if floor[i] > 1e-20 else 0.0
            found.append((float(center), float(width), float(max(center / width, min_q)), strength))
        return found

    return profiles.select(*keys, _per_row(find, BAND_TYPE)("mean").alias("bands"))


def merge_bands(profiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fold overlapping bands, in centre order, into their union around the stronger centre."""

    def merge(bands):
        # Structs arrive as dicts from Arrow, and as tuples where Spark chains this function to the one above.
        rows = sorted(tuple(b.values()) if isinstance(b, dict) else tuple(b) for b in bands)
        done = []
        for center, width, sharp, strength in rows:
            lo, hi = center - width / 2, center + width / 2
            if not done or lo > done[-1][0] + done[-1][1] / 2:
                done.append((center, width, sharp, strength))
                continue
            c, w, q, s = done[-1]
            union = max(c + w / 2, hi) - min(c - w / 2, lo)
            if strength > s:
                c, s = center, strength
            done[-1] = (c, union, max(c / union, min(q, sharp)), s)
        return done

    return profiles.select(*keys, _per_row(merge, BAND_TYPE)("bands").alias("bands"))


PEAK_TYPE = (
    "array<struct<bin:int,freq_hz:double,power_db:double,lo_6db:double,hi_6db:double,lo_10db:double,hi_10db:double>>"
)


def spectral_peaks(profiles: DataFrame, hz_per_bin: float, hz_range: tuple[float, float] | None = None, limit: int = 8,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Prominent local maxima of profiles(keys, db), strongest first, with -6 and -10 dB widths by interpolation."""

    def width(db, i, drop):
        level = db[i] - drop
        left = np.flatnonzero(db[1:i] < level)
        right = np.flatnonzero(db[i + 1:] < level)
        if not len(left) or not len(right):
            return None, None

        def edge(outside, inside):
            gap = db[inside] - db[outside]
            return outside + (inside - outside) * ((level - db[outside]) / gap if abs(gap) > 1e-12 else 0.5)

        a, b = int(left[-1]) + 1, int(right[0]) + i + 1
        return edge(a, a + 1) * hz_per_bin, edge(b, b - 1) * hz_per_bin

    def prominence(db, i):
        def valley(side):
            walls = np.flatnonzero(side > db[i])
            side = side[:walls[0] + 1] if len(walls) else side
            return min(side.min(initial=db[i]), db[i])

        return db[i] - max(valley(db[1:i][::-1]), valley(db[i + 1:]))

    def find(db):
        db = np.asarray(db, dtype=float)
        n = len(db)
        lo, hi = 2, n - 2
        if hz_range:
            lo, hi = max(math.floor(hz_range[0] / hz_per_bin), 2), min(math.ceil(hz_range[1] / hz_per_bin), n - 2)
        if n < 3 or lo > hi:
            return []
        span = np.arange(lo, hi + 1)
        local = span[(db[span] > db[span - 1]) & (db[span] >= db[span + 1])]
        strongest = lambda ids: ids[np.flatnonzero(db[ids] == db[ids].max())[-1:]]
        candidates = local if len(local) else strongest(span)
        proud = np.array([i for i in candidates if prominence(db, i) >= 3.0], dtype=int)
        kept = proud if len(proud) else strongest(candidates)
        ranked = kept[np.lexsort((kept, -db[kept]))][:limit]
        return [(int(i), float(i * hz_per_bin), float(db[i]), *width(db, i, 6.0), *width(db, i, 10.0)) for i in ranked]

    return profiles.select(*keys, _per_row(find, PEAK_TYPE)("db").alias("peaks"))


def effective_nyquist(profiles: DataFrame, sample_rate: float | Column, bands: int = 32, populated_db: float = 50.0,
                      silent_db: float = -100.0, limited_ratio: float = 0.95, keys: Sequence[str] = KEYS) -> DataFrame:
    """Highest band with content, from profiles(keys, db); band-limited only if nothing but rounding noise lies above."""
    size = F.floor(F.size("db") / bands).cast("int")
    tops = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.array_max(F.slice("db", F.greatest(b * size, F.lit(1)) + 1, (b + 1) * size - F.greatest(b * size, F.lit(1)))),
    )
    rows = profiles.where(F.size("db") >= 2 * bands).withColumn("tops", tops).withColumn("_size", size)
    last = bands - F.array_position(F.reverse(F.transform("tops", lambda p: p > F.array_max("tops") - populated_db)), True)
    rows = rows.withColumn("_split", (last + 1).cast("int"))
    nyquist = sample_rate / 2
    hz = sample_rate / (2.0 * (F.size("db") - 1))
    low = _upper_median(F.slice("tops", F.lit(1), F.col("_split")))
    upper = F.when(F.col("_split") < bands, _upper_median(F.slice("tops", F.col("_split") + 1, bands)))
    out = rows.select(
        *keys, (F.col("_split") * F.col("_size") * hz).alias("effective_hz"), low.alias("low_floor_db"),
        F.coalesce(upper, low).alias("upper_floor_db"),
    )
    ratio = F.least(F.col("effective_hz") / nyquist, F.lit(1.0))
    return out.select(
        "*", (F.col("low_floor_db") - F.col("upper_floor_db")).alias("drop_db"), ratio.alias("ratio"),
        F.when((ratio < limited_ratio) & (F.col("upper_floor_db") < silent_db), "band_limited").otherwise("full_bandwidth").alias("verdict"),
    )


def fundamental(profiles: DataFrame, value: str = "mean", out: str = "f_bin") -> DataFrame:
    """Bin with the largest product over its first four multiples; the highest such bin on ties."""

    def find(mean):
        mean = np.asarray(mean, dtype=float)
        n, limit = len(mean), len(mean) // 4
        if n < 8 or limit < 2:
            return None
        k = np.arange(max(limit // 100, 1), limit)
        product = np.prod([mean[np.minimum(k * h, n - 1)] for h in (1, 2, 3, 4)], axis=0)
        if not len(k) or product.max() <= 0:
            return None
        return int(k[np.flatnonzero(product == product.max())[-1]])

    return profiles.withColumn(out, _per_row(find, "int")(value))


def harmonic_decay(profiles: DataFrame, hz_per_bin: float, max_hz: float, value: str = "mean") -> DataFrame:
    """Amplitudes at up to eight multiples of f_bin, their power-law exponent and the multiples that break the decay."""
    n = F.size(value)
    bins = F.filter(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda h: h * F.col("f_bin")), lambda b: (b < n) & (b * hz_per_bin <= max_hz))
    around = F.transform("_bins", lambda b: F.array_max(F.slice(value, F.greatest(b, F.lit(1)), 3)))
    rows = profiles.withColumn("_bins", bins).withColumn("_amp", around)
    norm = F.transform("_amp", lambda a: a / F.greatest(F.get("_amp", F.lit(0)), F.lit(1e-10)))
    rows = rows.withColumn("harmonics", F.coalesce(norm, F.array().cast("array<double>")))
    fit = F.transform(
        "harmonics", lambda a, i: F.struct((-F.ln(F.greatest(a, F.lit(1e-10))) * F.ln(i + 1.0)).alias("u"), F.pow(F.ln(i + 1.0), F.lit(2.0)).alias("d"))
    )
    rows = rows.withColumn("_fit", F.slice(fit, 2, 8))
    num, den = (total(F.transform("_fit", lambda s: s[x])) for x in "ud")
    bad = F.filter(F.transform("harmonics", lambda a, i: F.when((i > 0) & (a >= 0.95 * F.get("harmonics", i - 1)), i)), lambda i: i.isNotNull())
    return (
        rows.withColumn("decay_exponent", F.when(den > 0, num / den).otherwise(1.0))
        .withColumn("anomalies", bad)
        .withColumn("monotonic", F.size("anomalies") == 0)
        .drop("_amp", "_bins", "_fit")
    )


def coherence_ratio(profiles: DataFrame, value: str = "coherence") -> DataFrame:
    """Coherence at the first five multiples of f_bin over the mean of all bins, in [0, 2]."""
    n = F.size(value)
    mean_all = total(F.col(value)) / n
    hits = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda h: at(value, F.col("f_bin") * h)), lambda x: x.isNotNull())
    ratio = F.least(F.greatest(total(hits) / F.size(hits) / mean_all, F.lit(0.0)), F.lit(2.0))
    usable = F.col("f_bin").isNotNull() & (mean_all >= 1e-6) & (F.size(hits) > 0)
    active = F.greatest(F.size(F.filter(value, lambda c: c > 0)), F.lit(1))
    return profiles.withColumn("coherence_ratio", F.when(usable, ratio).otherwise(0.5)).withColumn("coherence_mean", total(F.col(value)) / active)


def artifact_indicators(rows: DataFrame) -> DataFrame:
    """Codes of suspicious measures, in a fixed order."""
    checks = F.array(
        F.when(F.col("coherence_mean") < 0.35, "low_phase_coherence").when(F.col("coherence_mean") < 0.55, "moderate_phase_drift"),
        F.when((F.col("coherence_ratio") < 0.7) & F.col("f_bin").isNotNull(), "harmonics_less_coherent"),
    )
    anomalies = F.transform("anomalies", lambda i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit("_anomaly")))
    late = F.array(F.when(F.col("preringing") > 0, "preringing"), F.when(F.col("staircasing") > 0.5, "staircasing"))
    found = F.filter(F.concat(checks, anomalies, late), lambda c: c.isNotNull())
    return rows.withColumn("indicators", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none"))))
