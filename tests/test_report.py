"""The device report against numpy, recording by recording, with rates, depths and lengths mixed and chunks of several sizes."""

import numpy as np
import pytest

from echolake.functions import levels
from echolake.operators import report

COLUMNS = 42


def pole_and_gain(spark, cutoff, rate):
    from pyspark.sql import functions as F

    p = levels.butterworth_pole(F.lit(float(cutoff)), F.lit(float(rate)))
    return spark.range(1).select(p, levels.butterworth_gain(p)).first()


def recordings(spark):
    rng = np.random.default_rng(3)
    n = 40_000
    noise = lambda sd, size=n: np.round(rng.normal(0, sd, size)).astype(np.int64)
    pole, gain = pole_and_gain(spark, 48, 48_000)
    steps, level, made = noise(60), 0.0, []
    for k in steps:
        level = pole * level + gain * 16 * k
        made.append(level)
    burst = noise(900)
    burst[12_000:22_000] = noise(3, 10_000)
    return [  # name, dvc, mic, bits, float, rate, integers
        ("high_pass", "AudioMoth 1.2", None, 16, False, 48_000, np.clip(np.round(made), -32768, 32767).astype(np.int64)),
        ("white", "Some Maker", "", 16, False, 384_000, rng.integers(-32_768, 32_768, n)),
        ("padded", None, None, 16, False, 96_000, noise(90) * 16),
        ("deep", None, None, 24, False, 192_000, noise(5_000)),
        ("slow", None, None, 16, False, 4_000, burst),
        ("short", None, None, 16, False, 48_000, noise(50, 300)),
        ("silent", None, None, 16, False, 48_000, np.zeros(n, np.int64)),
        ("float", None, None, 32, True, 48_000, noise(700)),
    ]


@pytest.mark.parametrize("size", [5_000, 16_384])
def test_report(spark, size):
    made = recordings(spark)
    heads = [(i, name, dvc, mic, None, 1, bits, flt, rate, len(v)) for i, (name, dvc, mic, bits, flt, rate, v) in enumerate(made)]
    schema = "recording_id long, name string, dvc string, mic string, smp_meta string, channels int, bits_per_sample int, is_float boolean, sample_rate int, n long"
    chunks = [(i, k // size, k, (v[k : k + size] / (1 << (min(bits, 24 if flt else bits) - 1))).tolist()) for i, (_, _, _, bits, flt, _, v) in enumerate(made) for k in range(0, len(v), size)]
    table = report.device_report(spark.createDataFrame(chunks, "recording_id long, chunk long, start_sample long, samples array<double>"), spark.createDataFrame(heads, schema), size)
    assert len(table.columns) == COLUMNS + 1
    rows = {r.name: r for r in table.collect()}
    assert len(rows) == len(made)
    for name, _, _, bits, flt, rate, v in made:
        r = rows[name]
        assert r.duration_secs == pytest.approx(len(v) / rate) and r.sample_rate == rate
        if flt:
            assert r.effective_bits is None and r.inverse_verdict == r.multiple_verdict == "not_applicable"
            continue
        code = v & ((1 << bits) - 1)
        used = [b for b in range(bits) if (code >> (bits - 1 - b) & 1).any()]
        assert r.effective_bits == (used[-1] + 1 if used else 0)
        assert r.lsb_gcd == np.gcd.reduce(v)
        if (v != 0).any():
            moving = next((b for b in range(1, bits) if (code[v > 0] >> (bits - 1 - b) & 1).any() or not (code[v < 0] >> (bits - 1 - b) & 1).all()), bits)
            assert r.headroom_bits == moving - 1
        y = v / (1 << (bits - 1))
        rms = [np.sqrt(np.mean(y[i : i + 512] ** 2)) for i in range(0, max(len(y) - 511, 1), 512)]
        active = [x for x in rms if x > 1e-4] or rms
        if min(active) > 0:
            assert r.noise_floor_db == pytest.approx(20 * np.log10(min(active)), abs=1e-6)
        if len(v) >= 8_192:
            skip = min(4_096, len(v) // 8)
            sds = [v[i : i + 4_096].std() for i in range(skip, len(v) - 4_095, 4_096)]
            assert r.lsb_quiet_sd == pytest.approx(min(sds))
            a = skip + 4_096 * int(np.argmin(sds))
            lo = v[a : a + 4_096] & 15
            assert r.lsb_nonzero_pct == pytest.approx((lo != 0).mean() * 100)
            assert r.lsb_chi2 == pytest.approx((((np.bincount(lo, minlength=16) - 256) ** 2) / 256).sum())
        else:
            assert r.lsb_verdict == "not_applicable" and r.nyquist_khz is None
    assert rows["high_pass"].multiple_verdict == "match" and rows["high_pass"].multiple_cutoff_hz == 48 and rows["high_pass"].metadata_match == "match"
    assert rows["white"].multiple_verdict == "no_match" and rows["white"].inverse_verdict == "no_match" and rows["white"].inverse_windows_used == 4
    assert rows["padded"].lsb_verdict == "zero_padded" and rows["padded"].multiple_verdict == "not_applicable" and rows["padded"].top_hint == "zero_padded_12_bit"
    for name in ("deep", "slow", "short", "silent", "float"):
        assert rows[name].multiple_verdict == rows[name].inverse_verdict == "not_applicable" and rows[name].multiple_gain is None
    assert rows["high_pass"].inverse_verdict == "not_applicable"  # its rate is not the firmware's
    assert rows["white"].nyquist_khz == pytest.approx(192, rel=0.04) and rows["deep"].nyquist_khz == pytest.approx(96, rel=0.04)
    assert rows["white"].metadata_match in ("no_analysis", "mismatch") and rows["deep"].metadata_match == "no_claim"


def test_samples_are_placed_once(spark):
    """Order lines become chunks once, however often the report reads these."""
    import __spark_entry__ as entry

    read = entry.queries()["corpus_report"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any("lineitem" in f or "/rdd-" in f for f in read)
    assert sum("report-recordings" in f for f in read) >= 1
