"""Queries against their SQL on values and table shapes that the smallest tables do not hold."""

import datetime
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tools.check import rows_of
import __spark_entry__ as entry
from echolake.operators import annotations, columns, stats, timeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wide")
    values = [0.0, 49.99, 355.53, 355.54, 355.55, 177.77, 177.78, 561.0, 561.01, 700.55, 819.1, 819.2, 820.0, 900.37, 5000.0, 20_000.0]
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=977 * i), i % 3, "view", values[i * 7 % len(values)], "{}") for i in range(400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{root}/events.parquet'")
    return str(root)


@pytest.mark.parametrize("name", ["duration_labels", "wav_samples", "wav_headers", "interval_files"])
def test_large_values(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_earliest_segments_by_brute_force(spark):
    rng = np.random.default_rng(3)
    segs = [(int(k), i, float(s), float(n)) for i, (k, s, n) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(-200, 900, 900), rng.integers(-1, 90, 900)))]
    segs += [(0, 5000 + i, float(s), 7.5) for i, s in enumerate(rng.random(200) * 700)] + [(1, 6000, None, 3.0), (1, 6001, 4.0, None)]
    points = [(int(k), i, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 1500), rng.integers(-420, 2000, 1500) / 2))]
    points += [points[0], (1, 9000, None)]
    got = timeline.segment_at(spark.createDataFrame(points, "timeline_id long, point_id long, t double"),
                              spark.createDataFrame(segs, "timeline_id long, seg_id long, start double, dur double"), 8.0).collect()
    want = {}
    for k, p, t in points:
        held = [(s, i) for q, i, s, n in segs if q == k and None not in (t, s, n) and s <= t < s + n]
        if held:
            want[p] = (k, min(held)[1], t - min(held)[0])
    assert len(got) == len(want) and {r.point_id: (r.timeline_id, r.seg_id, r.inside) for r in got} == want


def test_smallest_boxes_by_brute_force(spark):
    rng = np.random.default_rng(5)
    boxes = []
    for i in range(1500):
        a, lo = float(rng.integers(0, 64)) / 8, float(rng.integers(0, 40) * 16)
        b, hi = a + float(rng.choice([0.0, 0.125, 0.7, 1.0, 9.0, -0.5])) * float(rng.choice([1.0, rng.random()])), lo + float(rng.choice([0.0, 16.0, 150.0, 500.5]))
        boxes.append((int(rng.integers(0, 3)), i, a, b, None if i % 5 == 0 else lo, None if i % 7 == 0 else hi))
    boxes += [(0, 7000, 0.0, 2.0, 0.0, float("inf")), (0, 7001, None, 2.0, 0.0, 5.0), (1, 7002, -3.0, 1e6, -5.0, 1e9)]
    points = [(int(rng.integers(0, 4)), i, float(rng.integers(0, 80)) / 8, float(rng.integers(0, 82)) * 8) for i in range(1200)]
    points += [(0, 9000, 1.0, 1e17), (0, 9001, None, 1.0), (1, 9002, -2.0, -4.5)]
    got = annotations.smallest_box(spark.createDataFrame(points, "recording_id long, point_id long, t double, freq_hz double"),
                                   spark.createDataFrame(boxes, "recording_id long, box_id long, time_start double, time_end double, freq_low double, freq_high double"),
                                   640.0, ["recording_id"]).collect()
    want = {}
    for r, p, t, f in points:
        found = []
        for q, i, a, b, lo, hi in boxes:
            lo, hi = 0.0 if lo is None else lo, 640.0 if hi is None else hi
            if q == r and None not in (t, a) and a <= t <= b and lo <= f <= hi:
                found.append(((b - a) * (hi - lo), i))
        if found:
            want[p] = (r, min(found)[1])
    assert len(got) == len(want) and {r.point_id: (r.recording_id, r.box_id) for r in got} == want


def test_lookups_form_no_pairs(spark):
    """Thousands of nested segments or boxes around thousands of points: all pairs would be 1.6 billion rows."""
    n = 40_000
    i = F.col("id")
    start = time.time()
    segs = spark.range(n).select(F.lit(0).alias("timeline_id"), i.alias("seg_id"), (i / n).alias("start"), (60 - 2 * i / n).alias("dur"))
    at = timeline.segment_at(spark.range(n).select(F.lit(0).alias("timeline_id"), i.alias("point_id"), (2 + i / n).alias("t")), segs)
    assert at.where("seg_id = 0").count() == n
    boxes = spark.range(n).select(F.lit(0).alias("recording_id"), i.alias("box_id"), (-i / n).alias("time_start"), (9 + i / n).alias("time_end"),
                                  (-i / n).alias("freq_low"), (9 + i / n).alias("freq_high"))
    points = spark.range(n).select(F.lit(0).alias("recording_id"), i.alias("point_id"), (4 + i / n).alias("t"), (5 - i / n).alias("freq_hz"))
    assert annotations.smallest_box(points, boxes, 640.0, ["recording_id"]).where("box_id = 0").count() == n
    assert time.time() - start < 60


def test_flow_of_wide_columns_goes_in_blocks(spark):
    """A batch of many wide columns, of recordings with different numbers of bins, is worked on in blocks of bounded size."""
    rng = np.random.default_rng(8)
    mags = {0: rng.random((40, 5000)), 1: rng.random((30, 64)), 2: rng.random((3, 1))}
    rows = [(k, c, m.tolist()) for k, ms in mags.items() for c, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "recording_id int, col long, mags array<double>")
    got = {(r.recording_id, r.col): r["shift"] for r in columns.flow_shift(df, "gradient").collect()}
    assert len(got) == 70
    for (k, c), shift in got.items():
        p, m = mags[k][c - 1], mags[k][c]
        d = np.pad(m - p, 1)
        np.testing.assert_allclose(shift, (d[2:] - d[:-2]) / (2 * np.maximum(m, p)))


def test_signal_stats_sums_in_order(spark):
    values = [1e16, 1.0, -1e16, 3.0]  # in order the 1 is lost; by even and odd indices it stays
    rows = spark.createDataFrame([(r, i, y * (r + 1)) for i, y in enumerate(values) for r in range(2)], "recording_id long, idx long, y double").coalesce(1)
    got = stats.signal_stats(rows.where("idx % 2 = 0").union(rows.where("idx % 2 = 1"))).orderBy("recording_id").collect()
    assert [(r.n, r.min_y, r.max_y, r.dc_bias) for r in got] == [(4, -1e16, 1e16, 0.75), (4, -2e16, 2e16, 1.5)]


def test_signal_stats_without_values(spark):
    rows = spark.createDataFrame([(0, 0, None), (0, 1, None), (1, 0, None), (1, 1, 0.5)], "recording_id long, idx long, y double")
    got = stats.signal_stats(rows).orderBy("recording_id").collect()
    assert [(r.n, r.rms, r.dc_bias) for r in got] == [(2, None, None), (2, 0.5, 0.5)]


BOXES, POINTS = ("recording_id string, box_id long, time_start double, time_end double, freq_low double, freq_high double",
                 "recording_id string, point_id long, t double, freq_hz double")


@pytest.mark.parametrize("tile", [2, 16, 100])
def test_smallest_boxes_in_tiles(spark, tile):
    """Points in many tiles, some far out and many that coincide, which are dealt to several tasks; ties by area; keys that are null or lack boxes."""
    rng = np.random.default_rng(11)
    boxes = [(str(rng.integers(0, 2)), i, a, a + float(rng.integers(0, 6)) / 8, lo, None if i % 9 == 0 else lo + float(rng.integers(0, 4)) * 40)
             for i, (a, lo) in enumerate(zip((rng.integers(0, 60, 500) / 8).tolist(), (rng.integers(0, 14, 500) * 40.0).tolist()))]
    points = [(str(rng.integers(0, 3)), i, float(rng.integers(0, 64)) / 8, float(rng.integers(0, 16)) * 40) for i in range(600)]
    points += [("0", 600 + i, 3.5, 120.0) for i in range(300)] + [("1", 900, 1e17, -1e17), ("1", 901, -1e17, 1e17), (None, 902, 3.5, 120.0)]
    got = annotations.smallest_box(spark.createDataFrame(points, POINTS), spark.createDataFrame([*boxes, (None, 999, 0.0, 9.0, None, None)], BOXES), 640.0, ["recording_id"], tile)
    want = {}
    for r, p, t, f in points:
        found = [((b - a) * ((640.0 if hi is None else hi) - lo), i) for q, i, a, b, lo, hi in boxes if q == r and a <= t <= b and lo <= f <= (640.0 if hi is None else hi)]
        if found:
            want[p] = (r, min(found)[1])
    rows = got.collect()
    assert len(rows) == len(want) > 500 and {r.point_id: (r.recording_id, r.box_id) for r in rows} == want


def test_boxes_that_end_with_the_points_form_no_pairs(spark):
    """Boxes of the whole range of frequency, around points near its end: all pairs would be 3.6 billion rows."""
    n = 60_000
    i, start = F.col("id"), time.time()
    boxes = spark.range(n).select(F.lit("a").alias("recording_id"), i.alias("box_id"), (i / n / 1000).alias("time_start"), F.lit(0.05).alias("time_end"),
                                  F.lit(None).cast("double").alias("freq_low"), F.lit(None).cast("double").alias("freq_high"))
    points = spark.range(n).select(F.lit("a").alias("recording_id"), i.alias("point_id"), (0.02 + i / n / 100).alias("t"), (520 + i / n * 100).alias("freq_hz"))
    assert annotations.smallest_box(points, boxes, 640.0, ["recording_id"]).where(f"box_id = {n - 1}").count() == n
    assert time.time() - start < 50
