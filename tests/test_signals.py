"""Chunked operators against one-pass numpy models, for several chunk sizes of the same signal."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echolake.operators import columns, detect, filters, fingerprint, profile, resonators, spectral
from echolake.plans.chunking import carry_in, lengths, ranked, to_chunks, to_samples, with_chunk

CHUNKS = (7, 64, 1000)


def samples(spark, *signals):
    rows = pd.concat([pd.DataFrame({"recording_id": r, "idx": np.arange(len(y)), "y": y}) for r, y in enumerate(signals)])
    return spark.createDataFrame(rows)


def signal(n=700, seed=1):
    t = np.arange(n) / 100.0
    return np.sin(2 * np.pi * 5 * t) * (np.sin(2 * np.pi * 0.7 * t) > 0) + np.random.default_rng(seed).normal(0, 0.05, n)


def collected(df, order="idx", value="y", recording=0):
    pdf = df.where(F.col("recording_id") == recording).orderBy(order).toPandas()
    return pdf[order].to_numpy(), pdf[value]


def one_pass(system, x):
    s, out = system.init * x[0], []
    for v in x:
        out.append(float(system.c @ s + system.d * v))
        s = system.a @ s + system.b * v
    return np.array(out)


SYSTEMS = {
    "low": filters.low_pass(8.0, 100.0, 4), "band": filters.band_pass(5.0, 30.0, 100.0), "high": filters.high_pass(3.0, 100.0),
    "notch": filters.notch_chain([(11.0, 4.0), (20.0, 5.0)], 100.0, 0.5),
    "equalizer": filters.fast_equalizer(8.0, 20.0, {"below": -20, "selected": 3, "harmonics": -3, "above": -30}, 4, 100.0),
}


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("name", list(SYSTEMS))
def test_linear_filter_is_chunk_invariant(spark, chunk, name):
    a, b = signal(), signal(333, 2)
    out = to_samples(filters.linear_filter(to_chunks(samples(spark, a, b), chunk), SYSTEMS[name]))
    for r, x in enumerate((a, b)):
        _, got = collected(out, recording=r)
        np.testing.assert_allclose(got, one_pass(SYSTEMS[name], x), atol=1e-9)


def test_carries_compose_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(filters, "CARRY_FAN", 3)
    x = signal()
    _, got = collected(to_samples(filters.linear_filter(to_chunks(samples(spark, x), 7), SYSTEMS["band"])))
    np.testing.assert_allclose(got, one_pass(SYSTEMS["band"], x), atol=1e-9)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_attack_release(spark, chunk):
    x, w = signal(), 3
    env, state = [], 0.0
    for v in np.abs(x):
        state += (1 / w if v > state else 1 / (4 * w)) * (v - state)
        env.append(state)
    _, got = collected(filters.attack_release(samples(spark, x), w, chunk), value="env")
    np.testing.assert_allclose(got, env, atol=1e-6)


def overlap_add(x, fft, change):
    w, hop = spectral.hann(fft), fft // 2
    out, weight = np.zeros(len(x) + fft), np.zeros(len(x) + fft)
    for p in range(0, len(x), hop):
        frame = np.zeros(fft)
        part = x[p:p + fft]
        frame[:len(part)] = part
        out[p:p + fft] += np.fft.irfft(change(np.fft.rfft(frame * w)), n=fft) * w
        weight[p:p + fft] += w * w
    out, weight = out[:len(x)], weight[:len(x)]
    return np.where(weight > 1e-6, out / np.where(weight > 1e-6, weight, 1), out)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_spectral_gain_and_subtraction(spark, chunk):
    x = signal()
    gains = filters.equalizer_gains(32, 100.0, 8.0, 20.0, {"below": -20, "selected": 3, "harmonics": -3, "above": -30}, 4)
    chunks = to_chunks(samples(spark, x), chunk)
    _, got = collected(to_samples(filters.spectral_gain(chunks, chunk, 32, gains)))
    np.testing.assert_allclose(got, overlap_add(x, 32, lambda z: z * gains), atol=1e-9)
    floor = np.linspace(0.1, 0.5, 17)
    raised = floor.copy()
    for b in range(17):
        for m in (2, 3):
            if b * m < 17:
                raised[b * m] += 0.3 * floor[b]

    def change(z):
        mag = np.abs(z)
        return z * np.maximum(mag - 0.8 * raised, 0.05 * mag) / np.maximum(mag, 1e-300)

    floors = spark.createDataFrame([(0, floor.tolist())], "recording_id long, floor array<double>")
    _, got = collected(to_samples(filters.spectral_subtraction(chunks, floors, chunk, 32, 0.8, 0.05, 0.3)))
    np.testing.assert_allclose(got, overlap_add(x, 32, change), atol=1e-9)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_stft_and_psd(spark, chunk):
    x, fft, hop = signal(), 64, 16
    chunks = to_chunks(samples(spark, x), chunk)
    frames = np.stack([x[p:p + fft] for p in range(0, len(x) - fft + 1, hop)]) * spectral.hann(fft)
    want = np.abs(np.fft.rfft(frames, axis=1))
    cols, got = collected(spectral.stft(chunks, chunk, fft, hop, 100.0), "col", "mags")
    assert list(cols) == list(range(len(want)))
    np.testing.assert_allclose(np.stack(got), want, atol=1e-9)
    half = np.stack([x[p:p + fft] for p in range(0, len(x) - fft + 1, fft // 2)]) * spectral.hann(fft)
    power = (np.abs(np.fft.rfft(half, axis=1)) ** 2).mean(axis=0) / ((spectral.hann(fft) ** 2).sum() * 100)
    power[1:-1] *= 2
    _, db = collected(spectral.welch_psd(chunks, chunk, fft, 100.0), "bin", "power_db")
    np.testing.assert_allclose(db, 10 * np.log10(power), atol=1e-6)


@pytest.mark.parametrize("chunk", (8, 64, 1000))
def test_resonators(spark, chunk):
    x, bank = signal(), resonators.spectrum_bank(100.0, 16, 4.0)
    z, want = np.zeros(9, dtype=complex), []
    for i, v in enumerate(x):
        z = (1 - bank.alphas) * z + bank.alphas * v * np.exp(-2j * np.pi * bank.freqs / 100 * i)
        if (i + 1) % 8 == 0:
            want.append(np.abs(z) * 8)
    _, got = collected(resonators.resonator_columns(to_chunks(samples(spark, x), chunk), bank, chunk, 8), "col", "mags")
    np.testing.assert_allclose(np.stack(got), want, atol=1e-9)


def sequential_pulses(env, high, low, gap):
    done, start, peak = [], None, None
    for i, e in enumerate(env):
        if start is None:
            if e >= high:
                start, peak = i, (e, i)
            continue
        if e > peak[0]:
            peak = (e, i)
        if e < low:
            if done and start - done[-1][1] < gap:
                a, _, p = done[-1]
                done[-1] = (a, i, peak if peak[0] > p[0] else p)
            else:
                done.append((start, i, peak))
            start = None
    if start is not None:
        done.append((start, len(env), peak))
    return [(a, b, p[1]) for a, b, p in done]


@pytest.mark.parametrize("chunk", (5, 40, 1000))
@pytest.mark.parametrize("seed", (1, 2, 3))
def test_pulses_equal_a_sequential_scan(spark, chunk, seed):
    rng = np.random.default_rng(seed)
    env = np.abs(np.convolve(rng.normal(0, 1, 600), np.ones(4) / 4, "same"))
    rows = with_chunk(samples(spark, env), chunk).select("recording_id", "chunk", "idx", F.col("y").alias("env"), F.lit(0.8).alias("high"), F.lit(0.5).alias("low"), F.lit(600).alias("n"))
    got = [tuple(r) for r in detect.raw_pulses(rows, 4, chunk).select("start_idx", "end_idx", "peak_idx").orderBy("start_idx").collect()]
    assert got == sequential_pulses(env, 0.8, 0.5, 4)


def test_two_level_carry(spark):
    rows = spark.createDataFrame([(k, c, float(k + c)) for k in (0, 1) for c in range(50)], "recording_id int, chunk long, v double")
    got = carry_in(rows, ["recording_id"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}, fan=4).orderBy("recording_id", "chunk").collect()
    for r in got:
        before = [float(r.recording_id + c) for c in range(r.chunk)]
        assert r.s == sum(before)
        assert r.m == (max(before) if before else None)
        assert r.l == (before[-1] if before else None)


def test_ranked_without_a_window_per_key(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.xxhash64("id") % 100).alias("v"), "id")
    got = ranked(rows, ["k"], [F.col("v"), F.col("id")]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values(["v", "id"])
        assert (g["pos"].to_numpy() == np.arange(len(g))).all()


def test_inverse_filter_recognises_its_own_output(spark):
    n, rng = 4096, np.random.default_rng(3)
    codes = np.round(2048 + 600 * np.sin(2 * np.pi * 0.11 * np.arange(n)) + rng.normal(0, 80, n)).clip(0, 4095)
    level, flat = 0.0, []
    for c in codes:
        step = (c - 2048) * 65536.0 - level
        level += step / 16
        flat.append(step / 4096)
    _, b0, b1, b2, a2 = fingerprint.PRESETS[3]
    y = np.zeros(n)
    for i in range(n):
        x1, x2 = (flat[i - 1] if i else 0), (flat[i - 2] if i > 1 else 0)
        y[i] = b0 * flat[i] + b1 * (x1 - (y[i - 1] if i else 0)) + b2 * x2 - a2 * (y[i - 2] if i > 1 else 0)
    v = spark.createDataFrame(pd.DataFrame({"recording_id": 0, "idx": np.arange(n), "v": np.round(y).astype(int)}))
    scores = fingerprint.inverse_filter_scores(v, fingerprint.pick_windows(lengths(v), 0, 2048), 2048)
    best = fingerprint.inverse_filter_verdict(scores).collect()[0]
    assert best.db_cut == 12 and best.residual < 0.2


def test_tone_shows_in_bank_chroma_and_peaks(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(8192) / 8000)
    chunks = to_chunks(samples(spark, x), 1024)
    psd = profile.gather(spectral.welch_psd(chunks, 1024, 512, 8000.0), "power_db", "db")
    peak = profile.spectral_peaks(psd, 8000 / 512).select(F.inline("peaks")).orderBy(F.desc("power_db")).first()
    assert abs(peak.freq_hz - 440) < 8
    cols = spectral.stft(chunks, 1024, 512, 256, 8000.0)
    top = columns.chroma_classes(columns.chroma(cols, 257, 8000 / 512)).groupBy("pitch_class").agg(F.sum("energy").alias("e")).orderBy(F.desc("e")).first()
    assert top.pitch_class == 9
    bank = resonators.note_bank(8000.0, 60, 24)
    mags = resonators.resonator_columns(chunks, bank, 1024, 512).orderBy(F.desc("col")).first().mags
    assert int(np.argmax(mags)) == 9 and math.isclose(bank.freqs[9], 440.0)
