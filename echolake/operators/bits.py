"""Bit-level forensics of integer (and raw float) samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.functions.levels import binary_entropy

KEYS = ("recording_id",)


def float_bits(samples: DataFrame, value: str = "y") -> DataFrame:
    """The 32-bit pattern of each sample as an integer column ``v``."""

    def view(series: pd.Series) -> pd.Series:
        return pd.Series(series.to_numpy(dtype=np.float32).view(np.int32), index=series.index)

    return samples.withColumn("v", F.pandas_udf(view, "int")(value))


def _set(bits: int, b: int) -> Column:
    """Whether bit ``b`` (0 = most significant) is set."""
    return F.col("v").bitwiseAND(F.lit(1 << (bits - 1 - b))) != 0


def value_histogram(samples: DataFrame, keys: Sequence[str] = KEYS, is_float: bool = False) -> DataFrame:
    """Count, first and last index per distinct sample value.

    A recording of any length has at most 2^bits of these, combined before the shuffle; bit statistics read this table.
    """
    zero = (F.col("y") == 0) if is_float else (F.col("v") == 0)
    return samples.groupBy(*keys, F.col("v").cast("long").alias("v")).agg(
        F.count(F.lit(1)).alias("k"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.first(zero).alias("zero")
    )


def bit_table(samples: DataFrame, bits: int, is_float: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per bit: use count, first and last index, split by sign; plus recording totals on each row."""
    values = value_histogram(samples, keys, is_float)
    keys = list(keys)
    negative = _set(bits, 0)
    total = values.groupBy(*keys).agg(
        F.sum("k").alias("total"), F.sum(F.when(F.col("zero"), F.col("k")).otherwise(0)).alias("zeros"),
        F.sum(F.when(negative & ~F.col("zero"), F.col("k")).otherwise(0)).alias("negatives"),
        F.sum(F.when(~negative & ~F.col("zero"), F.col("k")).otherwise(0)).alias("positives"),
    )
    per_bit = values.select(*keys, "k", "first_idx", "last_idx", negative.alias("neg"), F.posexplode(F.array(*[_set(bits, b) for b in range(bits)])).alias("bit", "on"))
    hit = per_bit.groupBy(*keys, "bit").agg(
        F.sum(F.when(F.col("on"), F.col("k")).otherwise(0)).alias("count"),
        F.sum(F.when(F.col("on") & ~F.col("neg"), F.col("k")).otherwise(0)).alias("pos_count"),
        F.sum(F.when(F.col("on") & F.col("neg"), F.col("k")).otherwise(0)).alias("neg_count"),
        F.min(F.when(F.col("on"), F.col("first_idx"))).alias("first_index"), F.max(F.when(F.col("on"), F.col("last_idx"))).alias("last_index"),
    )
    return hit.join(total, keys).select(*keys, "total", "zeros", "negatives", "positives", "bit", "count", "pos_count", "neg_count", "first_index", "last_index")


def bit_pairs(samples: DataFrame, bits: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Histogram of adjacent bit pairs 00/01/10/11 from the top bit down, all four listed for every pair."""
    pairs = bits // 2
    values = value_histogram(samples, keys)
    combo = F.array(*[F.shiftright("v", bits - 2 - 2 * p).bitwiseAND(F.lit(3)).cast("int") for p in range(pairs)])
    seen = values.select(*keys, "k", F.posexplode(combo).alias("pair", "c")).groupBy(*keys, "pair").agg(
        *[F.sum(F.when(F.col("c") == c, F.col("k")).otherwise(0)).alias(f"c{c}") for c in range(4)]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("combo"), F.col(f"c{c}").alias("count")) for c in range(4)])
    return seen.select(*keys, "pair", F.inline(rows))


def bit_summary(table: DataFrame, bits: int, is_float: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Effective, fractional and headroom bits from a bit table (at most one row per bit and recording)."""
    used, b = F.col("count") > 0, F.col("bit")
    entropy = binary_entropy(F.col("count") / F.col("total"))
    considered = (b == 0) | (b >= 9) if is_float else F.lit(True)
    deepest = F.max(F.when(used & ((b >= 9) if is_float else F.lit(True)), b))
    padded = (b >= 1) & ~(
        ((F.col("positives") == 0) | (F.col("pos_count") == 0))
        & ((F.col("negatives") == 0) | (F.col("neg_count") == F.col("negatives")))
    )
    agg = table.groupBy(*keys).agg(
        F.first("total").alias("total"), F.first("positives").alias("positives"), F.first("negatives").alias("negatives"),
        F.first("zeros").alias("zeros"), deepest.alias("_deep"),
        F.least(F.sum(F.when(considered, entropy).otherwise(0.0)), F.lit(float(bits))).alias("fractional_bits"),
        F.min(F.when(padded, b)).alias("_stop"),
    )
    if is_float:
        effective = F.least(F.coalesce(F.col("_deep") - 8, F.lit(0)) + 1, F.lit(bits))
        headroom = F.lit(0)
        text = F.when(F.col("effective_bits") < 24, F.concat(F.lit("~"), F.col("effective_bits"), F.lit("-bit precision in 32-bit float"))).otherwise("32-bit float")
    else:
        effective = F.coalesce(F.col("_deep") + 1, F.lit(0))
        headroom = F.when(F.col("positives") + F.col("negatives") == 0, 0).otherwise(F.coalesce(F.col("_stop"), F.lit(bits)) - 1)
        text = F.when(F.col("effective_bits") < bits, F.concat("effective_bits", F.lit(f"-bit recording stored as {bits}-bit"))).otherwise(f"{bits}-bit")
    return agg.withColumn("effective_bits", effective).select(
        *keys, "total", "positives", "negatives", "zeros", "effective_bits", "fractional_bits", headroom.alias("headroom_bits"), text.alias("summary")
    )


def bit_label(bit: Column, bits: int, is_float: bool = False) -> Column:
    if is_float:
        return F.when(bit == 0, "sign").when(bit <= 8, F.concat(F.lit("E"), 8 - bit)).otherwise(F.concat(F.lit("M"), 31 - bit))
    return F.when(bit == 0, "sign").otherwise(F.concat(F.lit("B"), bits - 1 - bit))


def bit_cautions(table: DataFrame, summary: DataFrame, bits: int, sample_rate: int, is_float: bool = False,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Warnings per bit, and whether the bit is one that should be in use."""
    keys = list(keys)
    n, total, b = F.col("count"), F.col("total"), F.col("bit")
    voiced = F.col("positives") + F.col("negatives")
    skewed = (voiced >= 5000) & (F.abs(F.col("negatives") / voiced - 0.5) > 0.15)
    sec = F.lit(sample_rate)
    edges = (F.col("first_index") < sec) & (F.col("last_index") >= F.greatest(total - sec, F.lit(0))) & (
        F.col("last_index") - F.col("first_index") < 2 * sec) & (n < 2 * sec)
    fade = (total >= 3 * sec) & edges & (n < F.floor(total / 2))
    rare = F.lit(not is_float) & (n <= F.greatest(F.floor(total / F.when(b == 0, 1000).otherwise(10_000)), F.lit(1))) & (total > 1000)
    codes = F.filter(
        F.array(
            F.when((b == 0) & skewed, "sign_bit_skewed"), F.when(n == total, "always_one"),
            F.when(fade, "only_in_fade"), F.when(rare, "very_low_usage"),
        ),
        lambda c: c.isNotNull(),
    )
    if is_float:
        expected = (b <= 8) | (b - 9 < F.greatest(F.col("effective_bits") - 1, F.lit(0)))
    else:
        expected = b < F.col("effective_bits")
    joined = table.join(summary.select(*keys, "effective_bits"), keys)
    return joined.select(
        *keys, "bit", bit_label(b, bits, is_float).alias("label"), "count",
        F.when(n > 0, codes).otherwise(F.array().cast("array<string>")).alias("cautions"), expected.alias("expected_used"),
    )


def value_coverage(samples: DataFrame, bits: int, approximate: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct sample values against the value space of the container (16 and 24 bit)."""
    if bits not in (16, 24):
        raise ValueError("value coverage is defined for 16 and 24 bit samples")
    distinct = F.approx_count_distinct("v") if approximate else F.count_distinct("v")
    agg = samples.groupBy(*keys).agg(distinct.alias("unique_count"))
    n = F.col("unique_count")
    return agg.select(
        *keys, "unique_count", (n * 100.0 / 2**bits).alias("coverage_pct"), F.when(n > 1, F.log2(n)).otherwise(0.0).alias("resolution_bits")
    )


def stride_gcd(samples: DataFrame, bits: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Greatest common divisor of the magnitudes of non-zero samples; a power of two means zero padding.

    Only distinct values are read; Arrow batches are reduced in place, and the few distinct partial divisors are folded per recording.
    """
    keys = list(keys)
    schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys) + ", g bigint"

    def partial(batches):
        for pdf in batches:
            pdf = pdf[pdf["v"] != 0]
            if len(pdf):
                yield pdf.assign(g=pdf["v"].abs()).groupby(keys, as_index=False)["g"].agg(lambda s: np.gcd.reduce(s.to_numpy(np.int64)))

    def fold(series: pd.Series) -> pd.Series:
        return pd.Series([int(np.gcd.reduce(np.asarray(x, dtype=np.int64))) for x in series])

    parts = samples.select(*keys, F.col("v").cast("long").alias("v")).distinct().mapInPandas(partial, schema).distinct()
    agg = parts.groupBy(*keys).agg(F.collect_set("g").alias("gs")).select(*keys, F.pandas_udf(fold, "bigint")("gs").alias("gcd"))
    return agg.select(*keys, "gcd", padding_bits(F.col("gcd"), F.lit(bits)).alias("padding_bits"))


def padding_bits(gcd: Column, bits: Column) -> Column:
    """Low bits that are always zero, where the divisor is a power of two."""
    return F.when((gcd >= 2) & (F.bit_count(gcd) == 1), F.least(F.log2(gcd).cast("int"), bits - 1))


def quietest_window(samples: DataFrame, lengths: DataFrame, window: int = 4096, keys: Sequence[str] = KEYS) -> DataFrame:
    """Start and deviation of the quietest full window after a short warm-up; the earliest on ties."""
    keys = list(keys)
    skip = F.least(F.lit(window), F.floor(F.col("n") / 8))
    after = samples.join(lengths, keys).where(F.col("n") >= 2 * window).withColumn("_o", F.col("idx") - skip).where("_o >= 0")
    wins = after.groupBy(*keys, F.floor(F.col("_o") / window).alias("_w")).agg(
        F.count(F.lit(1)).alias("_m"), F.stddev_pop("v").alias("sd"), F.min("idx").alias("start_idx")
    )
    best = wins.where(F.col("_m") == window).groupBy(*keys).agg(F.min(F.struct("sd", "start_idx")).alias("_b"))
    return best.select(*keys, F.col("_b.start_idx").alias("start_idx"), F.col("_b.sd").alias("sd"))


LOW_TYPE = "struct<chi2:double,nonzero_frac:double,acf1:double,acf256:double,period:int,period_match:double>"


def low_bit_structure(samples: DataFrame, quiet: DataFrame, low_bits: int = 4, window: int = 4096, max_period: int = 512,
                      min_match: float = 0.99, keys: Sequence[str] = KEYS) -> DataFrame:
    """Uniformity, autocorrelation and repetition of the low bits inside each recording's quietest window."""
    keys = list(keys)
    inside = samples.join(quiet.select(*keys, "start_idx"), keys).where(
        (F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("start_idx") + window)
    )
    return low_bits_of(inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "v")))["v"].alias("w")), low_bits, max_period, min_match, keys)


def low_bits_of(arrays: DataFrame, low_bits: int = 4, max_period: int = 512, min_match: float = 0.99, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from arrays(keys, w) of a window's samples."""

    def acf(x, lag):
        if len(x) <= lag or x.var() == 0:
            return 0.0
        c = x - x.mean()
        return float((c[:-lag] * c[lag:]).sum() / ((len(x) - lag) * x.var()))

    def measure(values):
        low = np.asarray(values, dtype=np.int64) & ((1 << low_bits) - 1)
        half = 1 << (low_bits - 1)
        signed = ((low ^ half) - half).astype(float)
        expected = len(low) / (1 << low_bits)
        chi2 = float((((np.bincount(low, minlength=1 << low_bits) - expected) ** 2) / expected).sum())
        rates = [float((low[:-p] == low[p:]).mean()) for p in range(1, min(max_period, len(low) // 2) + 1)]
        hit = next((i for i, r in enumerate(rates) if r >= min_match), None)
        match = rates[hit] if hit is not None else max(rates, default=0.0)
        far = acf(signed, 256) if len(low) > 512 else 0.0
        return chi2, float((low != 0).mean()), acf(signed, 1), far, None if hit is None else hit + 1, match

    def run(series: pd.Series) -> pd.DataFrame:
        names = ["chi2", "nonzero_frac", "acf1", "acf256", "period", "period_match"]
        return pd.DataFrame([measure(x) for x in series], columns=names).astype({"period": "Int32"})

    return arrays.select(*keys, F.pandas_udf(run, LOW_TYPE)("w").alias("s")).select(*keys, "s.*")


def lsb_verdict(gcds: DataFrame, quiet: DataFrame, low: DataFrame, bits: int, low_bits: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ordered verdict on the low bits: first matching rule wins."""
    keys = list(keys)
    return with_lsb_verdict(gcds.join(quiet, keys, "left").join(low, keys, "left"), F.lit(bits), low_bits)


def with_lsb_verdict(rows: DataFrame, bits: Column, low_bits: int = 4) -> DataFrame:
    """Add `verdict` and `effective_bits` to rows(padding_bits, sd, chi2, nonzero_frac, acf1, acf256, period, period_match)."""
    structured = (F.col("chi2") > 200) | (F.abs("acf1") > 0.05) | (F.abs("acf256") > 0.05)
    silent = (F.col("period") == 1) & (F.col("period_match") >= 0.999) & (F.col("sd") < 0.5) & (F.col("nonzero_frac") < 0.01)
    short = (bits < low_bits + 4) | F.col("sd").isNull()
    verdict = (
        F.when(short, "not_applicable").when(F.col("padding_bits").isNotNull(), "zero_padded").when(F.coalesce(silent, F.lit(False)), "quiet_section_zero_padded")
        .when(structured, "dsp_padded").when(F.col("sd") > 16, "inconclusive").otherwise("consistent")
    )
    effective = (
        F.when(F.col("verdict") == "zero_padded", bits - F.col("padding_bits"))
        .when(F.col("verdict").isin("quiet_section_zero_padded", "dsp_padded"), bits - low_bits)
    )
    return rows.withColumn("verdict", verdict).withColumn("effective_bits", effective)
