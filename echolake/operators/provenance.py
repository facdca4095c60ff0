"""What a recording's evidence says about its bit depth and recorder, and whether the stated device agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSSY = ("MP3", "OGG", "M4A", "W4V")


def is_lossy(fmt: Column | str) -> Column:
    return (F.col(fmt) if isinstance(fmt, str) else fmt).isin(*LOSSY)


def bit_depth_certainty(rows: DataFrame) -> DataFrame:
    """Upper bound, best estimate, certainty, headline code and ordered facts.

    rows: container_bits, is_float, format, lsb_verdict, lsb_bits, unique_count, coverage_pct, resolution_bits,
    inverse_verdict, multiple_verdict. Facts are listed from certain to suggestive.
    """
    bits, verdict = F.col("container_bits"), F.col("lsb_verdict")
    padded = verdict == "zero_padded"
    after_pad = F.when(padded, F.least(bits, F.col("lsb_bits"))).otherwise(bits)
    ceil_bits = F.ceil("resolution_bits").cast("int")
    narrow = F.coalesce(ceil_bits < after_pad, F.lit(False))
    upper = F.when(narrow, ceil_bits).otherwise(after_pad)
    best = upper
    full = F.coalesce(F.abs(F.col("coverage_pct") - 100.0) < 0.01, F.lit(False))
    wide = F.coalesce(F.col("coverage_pct") > 50.0, F.lit(False))
    dsp = verdict == "dsp_padded"
    best = F.when(dsp & (best > F.col("lsb_bits")), F.col("lsb_bits")).otherwise(best)
    firmware = (F.col("inverse_verdict") == "match") | (F.col("multiple_verdict") == "match")
    firmware = F.coalesce(firmware, F.lit(False))
    best = F.when(firmware & (best > 12), F.lit(12)).otherwise(best)
    confirming = padded | verdict.isin("quiet_section_zero_padded", "dsp_padded") | firmware
    genuine = (~narrow & ~full & wide) | (verdict == "consistent")
    facts = F.filter(
        F.array(
            F.when(padded, "certain:all_samples_multiple_of_power_of_two"), F.when(narrow, "certain:few_distinct_values"),
            F.when(~narrow & full, "certain:all_values_used"), F.when(~narrow & ~full & wide, "high:most_values_used"),
            F.when(verdict == "quiet_section_zero_padded", "high:quiet_low_bits_zero").when(dsp, "high:low_bits_structured").when(verdict == "consistent", "high:low_bits_noise"),
            F.when(verdict == "inconclusive", "suggestive:low_bits_inconclusive"), F.when(F.col("inverse_verdict") == "match", "suggestive:inverse_filter_match"),
            F.when(F.col("multiple_verdict") == "match", "suggestive:integer_multiple_match"),
        ),
        lambda x: x.isNotNull(),
    )
    reduced = upper < bits
    level = F.when(reduced & (confirming | padded | narrow), "certain").when(reduced | confirming | genuine, "high").otherwise("suggestive")
    headline = (
        F.when(reduced & confirming, "recorder_depth_bounded").when(reduced & (padded | narrow), "signal_information_bounded").when(reduced, "reduced")
        .when(confirming, "lower_depth_suspected").when(genuine, "genuine").otherwise("inconclusive")
    )
    lossy, flt = is_lossy("format"), F.col("is_float")
    skip = lossy | flt
    return rows.select(
        *[c for c in rows.columns if c in ("recording_id", "row_id")],
        F.when(skip, bits).otherwise(upper).alias("upper_bound"), F.when(skip, bits).otherwise(best).alias("best_estimate"),
        F.when(lossy, "suggestive").when(flt, "certain").otherwise(level).alias("certainty"),
        F.when(lossy, "lossy").when(flt, "float").otherwise(headline).alias("headline"),
        F.when(lossy, F.array(F.lit("certain:lossy_format"))).when(flt, F.array().cast("array<string>")).otherwise(facts).alias("facts"),
    )


# Recorders that share each signature.
FAMILY_FIRMWARE = (
    "Pipistrelle (Omenie)", "Pippyg", "Pipmini", "Pipistrelle USB Microphone", "Batsynth", "AudioMoth (with custom HPF cutoff)", "Pettersson D1000 / D1000X / D500x", "Wildlife Acoustics Song Meter Mini Bat (firmware 2+)",
    "Elekon Batlogger M / M2", "Echo Meter Touch (some firmware versions)", "Other 12-bit-ADC + DSP ultrasonic recorders",
)
HIGH_PASS_FIRMWARE = (
    "AudioMoth (default 8 or 48 Hz DC blocker)", "Wildlife Acoustics Song Meter Mini Bat (firmware 2+)", "Other 12-bit-ADC recorders with HPF DC blocking",
)
HIGH_PASS_POSSIBLE = ("AudioMoth", "Wildlife Acoustics Song Meter Mini Bat (firmware 2+)")
PADDED_4 = (
    "Wildlife Acoustics Song Meter Mini Bat", "Wildlife Acoustics Echo Meter Touch (some firmware versions)", "AudioMoth (some firmware versions)",
    "Teensy-based DIY recorders (e.g. Tensy ActiveRecorder)", "Other 12-bit-ADC bat recorders",
)
PADDED_1 = ("Pettersson u384 USB microphone", "Pettersson 256", "Other devices that drop the LSB at the ADC interface")
PADDED_N = ("Recorder with N-bit ADC → larger container",)
QUIET_GATED = ("Pettersson D1000 / D1000X / D500x", "AudioMoth (some firmware versions)", "Other recorders with DSP noise-gate / AGC behaviour")
DSP_RESIDUE = ("AudioMoth (12-bit ADC + DC-block / gain stage)", "Pipistrelle-family firmware", "Other DIY / open-source recorders with on-chip filtering")
BAND_LIMITED = ("File upsampled from a lower-rate source", "Recorder with aggressive anti-aliasing filter")
LOW_COVERAGE = ("Recorder using a lower-bit-depth ADC", "File downsampled in bit depth before saving")
RATE_RECORDERS = {
    312_500: "Elekon Batlogger M / M2", 333_333: "Avisoft UltraSoundGate (various models)", 375_000: "Avisoft UltraSoundGate (various models)",
    400_000: "Avisoft UltraSoundGate (various models)", 38_400: "Wildlife Acoustics EM3",
}


def device_hints(rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """Ordered hints (rule, confidence, candidates) from the evidence columns of ``bit_depth_certainty`` plus
    sample_rate, padding_bits and nyquist_verdict.
    """
    verdict, pad, ints = F.col("lsb_verdict"), F.col("padding_bits"), ~F.col("is_float")
    other_family = F.coalesce(F.col("multiple_verdict").isin("match", "possible"), F.lit(False)) | verdict.isin("zero_padded", "quiet_section_zero_padded")
    ceiled = F.ceil("resolution_bits")
    coarse = ((F.col("container_bits") == 16) & (ceiled <= 12)) | ((F.col("container_bits") == 24) & (ceiled <= 16))
    zero_padded = ints & (verdict == "zero_padded")

    def hint(order, when, rule, confidence, candidates):
        names = F.array(*[F.lit(c) for c in candidates]) if isinstance(candidates, tuple) else F.array(candidates)
        return F.when(when, F.struct(F.lit(order).alias("rule_no"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), names.alias("candidates")))

    rate = F.element_at(F.create_map(*[F.lit(x) for kv in RATE_RECORDERS.items() for x in kv]), F.col("sample_rate"))
    hints = F.array(
        hint(1, ~other_family & (F.col("inverse_verdict") == "match"), "family_firmware", "strong", FAMILY_FIRMWARE),
        hint(1, ~other_family & (F.col("inverse_verdict") == "possible"), "possible_family_firmware", "possible", FAMILY_FIRMWARE),
        hint(2, F.col("multiple_verdict") == "match", "high_pass_firmware", "strong", HIGH_PASS_FIRMWARE),
        hint(2, F.col("multiple_verdict") == "possible", "possible_high_pass_firmware", "possible", HIGH_PASS_POSSIBLE),
        hint(3, zero_padded & (pad == 4), "zero_padded_12_bit", "strong", PADDED_4),
        hint(3, zero_padded & (pad == 1), "zero_padded_one_bit", "strong", PADDED_1),
        hint(3, zero_padded & ~pad.isin(1, 4), "zero_padded", "strong", PADDED_N),
        hint(3, ints & (verdict == "quiet_section_zero_padded"), "quiet_sections_gated", "strong", QUIET_GATED),
        hint(3, ints & (verdict == "dsp_padded"), "filter_residue", "likely", DSP_RESIDUE),
        hint(4, F.col("nyquist_verdict") == "band_limited", "band_limited", "likely", BAND_LIMITED),
        hint(5, rate.isNotNull(), "sample_rate", "possible", rate),
        hint(6, ints & coarse & ~zero_padded, "low_value_coverage", "likely", LOW_COVERAGE),
    )
    return rows.select(key, F.filter(hints, lambda h: h.isNotNull()).alias("hints"))


# Words of a device claim that say nothing about the maker.
NOISE_WORDS = (
    "the", "and", "with", "for", "from", "any", "all", "wav", "wave", "ultrasound", "ultrasonic", "microphone", "mic", "recorder", "detector", "device",
    "built", "internal", "ext", "version", "ver",
)


def device_claim(make: Column, model: Column, dvc: Column, mic: Column) -> Column:
    """Stated device: metadata make and model first, else the catalogue's device and microphone."""
    a, b, d, m = (F.coalesce(F.trim(c), F.lit("")) for c in (make, model, dvc, mic))
    own = F.trim(F.concat_ws(" ", a, b))
    same = F.lower(d).contains(F.lower(m)) | F.lower(m).contains(F.lower(d))
    return F.when(own != "", own).when((d != "") & (m != "") & ~same, F.concat(d, F.lit(" ("), m, F.lit(")"))).when(d != "", d).when(m != "", m)


def claim_matches(claims: DataFrame, hints: DataFrame, key: str = "recording_id") -> DataFrame:
    """no_claim, no_analysis, match or mismatch per claims(key, claim) against device_hints(key, hints).

    Claims and candidates meet per recording and per hint list, both a handful, so this is a row expression, not a join
    of all claims with all recorders.
    """
    joined = claims.join(hints, key, "left")
    low = F.lower("claim")
    squeeze = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*NOISE_WORDS))
    rows = joined.select(
        key, "claim", low.alias("low"), squeeze(low).alias("joined"), words.alias("words"), F.coalesce("hints", F.array().cast(hints.schema["hints"].dataType)).alias("hints")
    )
    candidates = F.flatten(F.transform("hints", lambda h: h["candidates"]))

    def fits(candidate):
        c = F.lower(candidate)
        cj = squeeze(c)
        whole = F.col("low").contains(c) | c.contains(F.col("low"))
        packed = ((F.length("joined") >= 5) & cj.contains(F.col("joined"))) | ((F.length(cj) >= 5) & F.col("joined").contains(cj))
        parts = F.split(c, r"[^\p{L}\p{N}]+")
        word = F.exists("words", lambda w: F.array_contains(parts, w) | ((F.length(w) >= 4) & cj.contains(w)))
        return whole | packed | word

    matched = F.get(F.filter(candidates, fits), F.lit(0))
    strong = F.exists("hints", lambda h: h["confidence"] == "strong")
    rows = rows.withColumn("matched", F.when(F.col("claim").isNotNull(), matched))
    outcome = (
        F.when(F.col("claim").isNull(), "no_claim").when(F.size("hints") == 0, "no_analysis").when(F.col("matched").isNotNull(), "match")
        .when(strong, "mismatch").otherwise("no_analysis")
    )
    return rows.select(key, "claim", outcome.alias("outcome"), "matched")
