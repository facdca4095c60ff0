"""One wide row per recording on its bits, bandwidth and probable recorder.

Chunks are read twice. The first pass leaves one row of sums per chunk: masks of bits, divisor, quietest window, window levels, powers by
frequency and the values met. All of these merge in any order, so a recording of any length comes down to one row in a few aggregations. The second pass
fetches the few windows that the first has chosen, by the chunks they lie in. Rates and bit depths are columns: one call takes recordings of any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.functions.levels import amplitude_db
from echolake.operators import bits, fingerprint, profile, provenance, spectral
from echolake.operators.stats import GAP_RMS
from echolake.session import stored

KEYS = ("recording_id",)

# Deviation below which a window is too quiet for the inverse-filter and the integer-multiple test.
INVERSE_QUIET, MULTIPLE_QUIET = 20.0, 30.0


@dataclass(frozen=True)
class Sizes:
    """Samples of the windows for levels, the quietest stretch, spectra, and the fingerprint tests with their warm-up."""

    level: int = 512
    quiet: int = 4096
    fft: int = 4096
    test: int = 8192
    warmup: int = 1024


def chunk_sums(chunks: DataFrame, chunk_size: int, sizes: Sizes = Sizes(), keys: Sequence[str] = KEYS) -> DataFrame:
    """One row of mergeable sums per chunk of chunks(keys, chunk, start_sample, samples, bits, n); samples lie in [-1, 1]."""
    keys = list(keys)
    long_, double = T.LongType(), T.DoubleType()
    fields = [("n", long_), ("bits", long_), ("gcd", long_), ("any", long_), ("any_positive", long_), ("all_negative", long_), ("positives", long_), ("negatives", long_),
              ("active_ms", double), ("least_ms", double), ("quiet_sd", double), ("quiet_start", long_), ("frames", long_), ("power", T.ArrayType(double)),
              ("words", T.ArrayType(long_)), ("met", T.ArrayType(long_))]
    schema = T.StructType([*[chunks.schema[k] for k in keys], *[T.StructField(n, t) for n, t in fields]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def starts(first, core, step, length, have, offset=0):
        """Multiples of `step` from `offset` on that lie in the core and have `length` samples, relative to the chunk."""
        a = offset + max(-(-(first - offset) // step), 0) * step - first
        return np.arange(a, min(core, have - length + 1), step) if a < core else np.zeros(0, np.int64)

    def measure(y, first, core, depth, n):
        v = np.round(y * float(1 << (depth - 1))).astype(np.int64)
        own = v[:core]
        positive, negative = own[own > 0], own[own < 0]
        mask = (1 << depth) - 1
        gcd = int(np.gcd.reduce(np.abs(own[own != 0]))) if (own != 0).any() else 0
        at = starts(first, core, sizes.level, sizes.level, len(y))
        if first == 0 and len(y) < sizes.level:
            levels = np.asarray([np.mean(y * y)])
        else:
            levels = np.asarray([np.mean(y[i : i + sizes.level] ** 2) for i in at])
        active = levels[np.sqrt(levels) > GAP_RMS]
        quiet = (None, None)
        if n >= 2 * sizes.quiet:
            skip = min(sizes.quiet, n // 8)
            if len(at := starts(first, core, sizes.quiet, sizes.quiet, len(v), skip)):
                sd = np.asarray([v[i : i + sizes.quiet].std() for i in at])
                quiet = float(sd.min()), int(first + at[sd.argmin()])
        power, frames = np.zeros(sizes.fft // 2 + 1), 0
        window = spectral.hann(sizes.fft)
        for i in starts(first, core, sizes.fft // 2, sizes.fft, len(y)):
            power += np.abs(np.fft.rfft(y[i : i + sizes.fft] * window)) ** 2
            frames += 1
        code = np.unique(own & mask)
        words, place = np.unique(code >> 6, return_inverse=True)
        met = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(met, place, np.uint64(1) << (code & 63).astype(np.uint64))
        return (len(own), depth, gcd, int(np.bitwise_or.reduce(own & mask, initial=0)), int(np.bitwise_or.reduce(positive & mask, initial=0)),
                int(np.bitwise_and.reduce(negative & mask)) if len(negative) else mask, len(positive), len(negative),
                float(active.min()) if len(active) else None, float(levels.min()) if len(levels) else None, *quiet, frames, power.tolist(), words.tolist(), met.view(np.int64).tolist())

    def run(batches):
        for batch in batches:
            heads = [batch.column(k) for k in keys]
            flat, cuts = batch.column("samples").values.to_numpy(zero_copy_only=False), batch.column("samples").offsets.to_numpy()
            rows = [(*(h[i].as_py() for h in heads), *measure(flat[cuts[i] : cuts[i + 1]], first, core, depth, n))
                    for i, (first, core, depth, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start_sample", "core", "bits", "n"))))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    ahead = max(sizes.level, sizes.quiet, sizes.fft) - 1
    facts = chunks.select(*keys, "chunk", "bits", "n")
    return spectral.reach(chunks.select(*keys, "chunk", "start_sample", "samples"), chunk_size, ahead, keys).join(facts, [*keys, "chunk"]).mapInArrow(run, schema)


def _fold_gcd(lists: Column) -> Column:
    def fold(series: pd.Series) -> pd.Series:
        return pd.Series([int(np.gcd.reduce(np.asarray(x, np.int64))) if len(x) else 0 for x in series])

    return F.pandas_udf(fold, "bigint")(lists)


def _spread(windows: Column) -> Column:
    def deviation(series: pd.Series) -> pd.Series:
        return pd.Series([float(np.std(np.asarray(x, float))) for x in series])

    return F.pandas_udf(deviation, "double")(windows)


def windows_of(chunks: DataFrame, chunk_size: int, spans: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`w`, the samples of spans(keys, win, start, length): only chunks that hold part of a span are matched, and only those parts move on."""
    keys = list(keys)
    where = F.explode(F.sequence(F.expr(f"start div {chunk_size}"), F.expr(f"(start + length - 1) div {chunk_size}"))).alias("chunk")
    parts = chunks.join(spans.select(*keys, "win", "start", "length", where), [*keys, "chunk"])
    low = F.greatest(F.col("start") - F.col("start_sample"), F.lit(0))
    high = F.least(F.col("start") + F.col("length") - F.col("start_sample"), F.size("samples"))
    cut = parts.select(*keys, "win", "length", "start_sample", F.slice("samples", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("s"))
    whole = cut.groupBy(*keys, "win", "length").agg(F.sort_array(F.collect_list(F.struct("start_sample", "s"))).alias("p"))  # a window's parts
    return whole.select(*keys, "win", F.flatten("p.s").alias("w"), "length").where(F.size("w") == F.col("length")).drop("length")


def device_report(chunks: DataFrame, recordings: DataFrame, chunk_size: int, sizes: Sizes = Sizes(), keys: Sequence[str] = KEYS) -> DataFrame:
    """The report from chunks(keys, chunk, start_sample, samples in [-1, 1]) and recordings(keys, name, dvc, mic, smp_meta, channels, bits_per_sample,
    is_float, sample_rate, n). Both are read several times: store what takes long to make.

    A test that cannot mean anything for a recording (float samples, another depth, a rate outside its range, too few or too quiet samples, and for the
    integer-multiple test low bits that are all zero) says `not_applicable`.
    """
    keys = list(keys)
    facts = recordings.select(*keys, F.col("bits_per_sample").cast("long").alias("bits"), F.col("n").cast("long").alias("n"), "is_float",
                              F.col("sample_rate").cast("double").alias("rate"))
    known = chunks.join(facts, keys)
    sums = stored(chunk_sums(known, chunk_size, sizes, keys), "report-sums")  # a row per chunk, read by four aggregations
    total = sums.groupBy(*keys).agg(
        F.bit_or("any").alias("any"), F.bit_or("any_positive").alias("any_positive"), F.bit_and("all_negative").alias("all_negative"), F.sum("positives").alias("positives"),
        F.sum("negatives").alias("negatives"), F.collect_set(F.when(F.col("gcd") > 0, F.col("gcd"))).alias("gcds"), F.min("active_ms").alias("active_ms"), F.min("least_ms").alias("least_ms"),
        F.min(F.when(F.col("quiet_sd").isNotNull(), F.struct("quiet_sd", "quiet_start"))).alias("quiet"))
    met = sums.select(*keys, F.explode(F.arrays_zip("words", "met")).alias("m")).groupBy(*keys, "m.words").agg(F.bit_or("m.met").alias("met"))
    unique = met.groupBy(*keys).agg(F.sum(F.bit_count("met")).alias("unique_count"))
    by_rate = sums.join(facts.select(*keys, "rate"), keys).select(*keys, "rate", "frames", F.posexplode("power").alias("bin", "p"))
    powers = by_rate.groupBy(*keys, "rate", "bin").agg(F.sum("frames").alias("frames"), F.sum("p").alias("total")).where("frames > 0")
    psd = spectral.density_db(powers, sizes.fft, F.col("rate"), [*keys, "rate"])
    enough = facts.where(F.col("n") >= 4 * sizes.fft).select(*keys)
    nyquist = profile.effective_nyquist(profile.gather(psd, "power_db", "db", [*keys, "rate"]).join(enough, keys), F.col("rate"), keys=[*keys, "rate"])

    # The windows to look at again.
    quiet = total.where("quiet IS NOT NULL").select(*keys, F.lit(-1).alias("win"), F.col("quiet.quiet_start").alias("start"), F.lit(sizes.quiet).cast("long").alias("length"))
    tests = fingerprint.pick_windows(facts.where("NOT is_float AND bits = 16"), sizes.warmup, sizes.test, keys=keys)
    spans = quiet.unionByName(tests.select(*keys, F.col("win").cast("int").alias("win"), F.col("start").cast("long").alias("start"), F.lit(sizes.test).cast("long").alias("length")))
    scale = F.pow(F.lit(2.0), F.col("bits") - 1)
    taken = windows_of(chunks, chunk_size, spans, keys).join(facts, keys)
    taken = stored(taken.select(*keys, "win", "rate", F.transform("w", lambda y: F.round(y * scale).cast("long")).alias("w")), "report-windows")  # seven windows at most each
    low = bits.low_bits_of(taken.where("win < 0").select(*keys, "w"), keys=keys)
    loud = taken.where("win >= 0").withColumn("sd", _spread(F.col("w")))
    used = loud.groupBy(*keys).agg(F.count_if(F.col("sd") >= INVERSE_QUIET).alias("windows_used"), F.count_if(F.col("sd") < INVERSE_QUIET).alias("windows_skipped"))
    inverse = fingerprint.inverse_filter_verdict(fingerprint.inverse_filters_of(loud.where(F.col("sd") >= INVERSE_QUIET).select(*keys, "w"), keys), keys)
    multiple = fingerprint.integer_multiple_verdict(
        fingerprint.integer_multiples_of(loud.where(F.col("sd") >= MULTIPLE_QUIET).select(*keys, "rate", "w"), F.col("rate"), [*keys, "rate"]), [*keys, "rate"])

    def named(df, prefix, *columns):
        return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    rows = recordings.join(facts.select(*keys, "bits", "rate"), keys).join(total.withColumn("gcd", _fold_gcd(F.col("gcds"))), keys, "left").join(unique, keys, "left") \
        .join(low, keys, "left").join(used, keys, "left") \
        .join(named(inverse, "inverse", "db_cut", "residual", "in_range_frac", "near_integer_frac", "mean_abs_frac", "verdict"), keys, "left") \
        .join(named(multiple, "multiple", "cutoff_hz", "os_div", "gain", "mean_abs_frac", "near_integer_frac", "verdict"), keys, "left") \
        .join(named(nyquist, "nyquist", "effective_hz", "ratio", "drop_db", "upper_floor_db", "verdict"), keys, "left")
    ints = ~F.col("is_float")
    padding = bits.padding_bits(F.col("gcd"), F.col("bits"))
    rows = rows.withColumn("sd", F.when(ints, F.col("quiet.quiet_sd"))).withColumn("padding_bits", F.when(ints, padding))
    rows = bits.with_lsb_verdict(rows, F.col("bits")).withColumnRenamed("verdict", "lsb_verdict").withColumnRenamed("effective_bits", "lsb_bits")

    def gate(test, rates, padded):
        fits = ints & (F.col("bits") == 16) & F.col("rate").between(*rates)
        if not padded:
            fits = fits & (F.col("lsb_verdict") != "zero_padded")
        return F.when(F.coalesce(fits, F.lit(False)), F.coalesce(F.col(f"{test}_verdict"), F.lit("not_applicable"))).otherwise("not_applicable")

    rows = rows.withColumn("inverse_verdict", gate("inverse", fingerprint.INVERSE_RATES, True)) \
        .withColumn("multiple_verdict", gate("multiple", fingerprint.MULTIPLE_RATES, False)) \
        .withColumn("nyquist_verdict", F.coalesce("nyquist_verdict", F.lit("not_applicable")))
    ran = {t: F.col(f"{t}_verdict") != "not_applicable" for t in ("inverse", "multiple")}

    # Bits: the deepest one in use, and those under the sign that only repeat it.
    depth = F.col("bits").cast("int")
    trailing = F.when(F.col("any") == 0, depth).otherwise(F.bit_count(F.col("any").bitwiseXOR(F.col("any") - 1)) - 1)
    mask = F.pow(F.lit(2.0), F.col("bits")).cast("long") - 1
    moving = F.when(F.col("positives") > 0, F.col("any_positive")).otherwise(F.lit(0)).bitwiseOR(
        F.when(F.col("negatives") > 0, mask - F.col("all_negative")).otherwise(F.lit(0)))
    top = F.when(moving > 0, F.length(F.bin(moving))).otherwise(0)
    headroom = F.when(F.col("positives") + F.col("negatives") == 0, 0).otherwise(depth - 1 - top)
    space = F.col("unique_count")
    evidence = rows.withColumn("container_bits", depth).withColumn("coverage_pct", space * 100.0 / F.pow(F.lit(2.0), F.col("bits"))) \
        .withColumn("resolution_bits", F.when(space > 1, F.log2(space)).otherwise(0.0))
    key = keys[0]
    hints = provenance.device_hints(evidence, key)
    claims = recordings.select(key, provenance.device_claim(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("dvc"), F.col("mic")).alias("claim"))
    agreed = provenance.claim_matches(claims, hints, key).select(key, F.col("outcome").alias("metadata_match"), F.col("matched").alias("matched_candidate"))
    first = F.get("hints", F.lit(0))
    return rows.join(hints, key, "left").join(agreed, key, "left").select(
        *keys, "name", "dvc", "mic", "smp_meta", "channels", F.col("bits_per_sample").alias("bits"), "sample_rate", (F.col("n") / F.col("rate")).alias("duration_secs"),
        F.when(ints, depth - trailing).alias("effective_bits"), F.when(ints, headroom).alias("headroom_bits"),
        amplitude_db(F.sqrt(F.coalesce("active_ms", "least_ms"))).alias("noise_floor_db"),
        "lsb_verdict", F.when(ints, F.col("gcd")).alias("lsb_gcd"), F.col("chi2").alias("lsb_chi2"), F.col("acf1").alias("lsb_lag1"), F.col("acf256").alias("lsb_lag256"),
        (F.col("nonzero_frac") * 100).alias("lsb_nonzero_pct"), F.col("sd").alias("lsb_quiet_sd"), F.col("period").alias("lsb_period"), F.col("period_match").alias("lsb_period_match"),
        "inverse_verdict", *[F.when(ran["inverse"], F.col(f"inverse_{c}")).alias(f"inverse_{c}") for c in ("db_cut", "residual", "in_range_frac", "near_integer_frac", "mean_abs_frac")],
        F.when(ran["inverse"], F.col("windows_used")).alias("inverse_windows_used"), F.when(ran["inverse"], F.col("windows_skipped")).alias("inverse_windows_skipped"),
        (F.col("nyquist_effective_hz") / 1000).alias("nyquist_khz"), "nyquist_ratio", "nyquist_drop_db", F.col("nyquist_upper_floor_db").alias("nyquist_upper_db"),
        "multiple_verdict", *[F.when(ran["multiple"], F.col(f"multiple_{c}")).alias(f"multiple_{c}") for c in ("cutoff_hz", "os_div", "gain", "mean_abs_frac", "near_integer_frac")],
        first["rule"].alias("top_hint"), first["confidence"].alias("top_hint_confidence"), "metadata_match", "matched_candidate")
