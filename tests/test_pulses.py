"""Chunk kernels against one-pass programs, for chunks and blocks of any size; exact selection against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.operators import pulses
from echolake.operators.ranks import nth_smallest


def one_pass(env, high, low, gap, shortest, longest):
    found, start, peak = [], None, None
    for i, e in enumerate(env):
        if start is None:
            if e >= high:
                start, peak = i, (e, i)
        else:
            if e > peak[0]:
                peak = (e, i)
            if e < low:
                if found and start - found[-1][1] < gap:
                    last = found[-1]
                    found[-1] = (last[0], i, *(peak if peak[0] > last[2] else last[2:]))
                else:
                    found.append((start, i, *peak))
                start = None
    if start is not None:
        found.append((start, len(env), *peak))
    return [(k, *p) for k, p in enumerate(p for p in found if shortest <= p[1] - p[0] <= longest)]


@pytest.mark.parametrize("chunk,block", [(1, 3), (4, 2), (7, 1), (16, 3), (1_000, 8)])
def test_pulses_of_any_cut(spark, chunk, block):
    rng = random.Random(chunk)
    signals = {k: [rng.choice([0.0, 0.5, 0.5, 1.0, 2.0, 2.0 if k % 3 else 0.5]) for _ in range(rng.choice([1, 5, 90, 300]))] for k in range(12)}
    signals[20], signals[21], signals[22] = [0.5] * 40, [2.0] * 40, [0.0] * 3 + [2.0] + [0.5] * 60
    rows = [(k, i // chunk, i, float(e), len(env)) for k, env in signals.items() for i, e in enumerate(env)]
    df = spark.createDataFrame(rows, "recording_id long, chunk long, idx long, env double, n long")
    chunks = pulses.packed(df, ["recording_id"], "env", "n")
    chunks = chunks.withColumn("n", F.col("n")[0]).withColumn("high", F.lit(1.0)).withColumn("low", F.lit(0.5)).withColumn("floor", F.lit(0.1))
    for gap, shortest, longest in ((3, 2, 25), (1, 1, 1_000)):
        got = pulses.find_pulses(chunks, gap, shortest, longest, ["recording_id"], block).collect()
        want = {(k, *p) for k, env in signals.items() for p in one_pass(env, 1.0, 0.5, gap, shortest, longest)}
        assert {(r.recording_id, r.no, r.start_idx, r.end_idx, r.peak_amp, r.peak_idx) for r in got} == want and len(got) == len(want)


def test_pulses_plan_groups_samples_once_and_starts_no_job(spark):
    from echolake.operators import detect

    df = spark.range(2_000).select(F.lit(1).alias("recording_id"), F.col("id").alias("idx"), F.abs(F.sin(F.col("id") / 9)).alias("y"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    env = detect.mean_envelope(df, 4, 128)
    found = detect.detect_pulses(env, None, 1_000, detect.PulseSettings(6.0, 3.0, 1.0, 500.0), 128)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert found.count() > 5


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_crossing_bins_of_any_cut(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], set()
    for k in range(8):
        n = rng.choice([1, 2, 30, 200])
        y = [rng.uniform(-1, 1) for _ in range(n)]
        env = [rng.choice([0.0, 0.5, 1.0]) for _ in range(n)]
        armed, bins = False, {}
        for i in range(n):
            if i:
                armed = True if env[i] > 0.7 else False if env[i] < 0.3 else armed
                bins[(i - 1) // 10] = bins.get((i - 1) // 10, 0) + (armed and (y[i] >= 0) != (y[i - 1] >= 0))
            rows.append((k, i // chunk, i, y[i], env[i], n))
        want |= {(k, b, c, min(n - 1, (b + 1) * 10)) for b, c in bins.items()}
    df = spark.createDataFrame(rows, "recording_id long, chunk long, idx long, y double, env double, n long")
    chunks = pulses.packed(df, ["recording_id"], "y", "env", "n").withColumn("n", F.col("n")[0]).withColumn("high", F.lit(0.7)).withColumn("low", F.lit(0.3))
    got = pulses.crossing_bins(chunks, 10, ["recording_id"]).collect()
    assert {(r.recording_id, r.bin, r.crossings, r.last) for r in got} == want and len(got) == len(want)


def test_nth_smallest_is_exact(spark):
    rng = random.Random(9)
    odd = [-0.0, 0.0, 1e-300, -1e-300, 5e-324, 1e308, -1e308, 0.1, 0.1 + 1e-16, 0.1 + 2e-16]
    groups = {k: [rng.choice(odd) if rng.random() < 0.4 else rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(rng.choice([1, 2, 50, 900]))] for k in range(10)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(5)
    for rank in ("0", "n div 10", "n div 2", "n - 1"):
        got = {r.k: r.q for r in nth_smallest(df, ["k"], "x", F.expr(rank), "q").collect()}
        assert got == {k: sorted(xs)[eval(rank.replace("div", "//"), {"n": len(xs)})] for k, xs in groups.items()}
    ints = spark.createDataFrame([(1, x) for x in (-(1 << 62) - 1, -(1 << 62), 5, (1 << 62) + 1, 5)], "k int, x long")
    assert nth_smallest(ints, ["k"], "x", F.expr("n div 2"), "q").first().q == 5
    assert nth_smallest(ints, ["k"], "x", F.expr("0"), "q").first().q == -(1 << 62) - 1
    lists = df.where("k IS NOT NULL").groupBy("k", F.expr("pmod(hash(x), 3)").alias("p")).agg(F.collect_list("x").alias("xs"))
    got = {r.k: (r.q, r.m) for r in nth_smallest(lists, ["k"], "xs", F.expr("n div 3"), "q", count="m").collect()}
    assert got == {k: (sorted(xs)[len(xs) // 3], len(xs)) for k, xs in groups.items()}
    assert nth_smallest(df.limit(0), ["k"], "x", F.expr("0"), "q").count() == 0
