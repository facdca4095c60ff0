"""Queries over sample statistics."""

from pyspark.sql import functions as F

from echolake.functions.levels import r6
from echolake.operators import stats
from echolake.plans.chunking import lengths, to_chunks, to_samples
from echolake.plans.registry import SIG, SIG_ALL, ctes, query
from echolake.sources import vehicles as v

SR = 10


def _two_channels(spark, d):
    return v.sig(spark, d).select(
        F.expr("recording_id div 2").alias("recording_id"), (F.col("recording_id") % 2).alias("channel"), "idx", "y"
    )


@query("channel_mix", ctes(SIG) + """SELECT recording_id // 2 AS recording_id, idx, round(sum(y) / 2, 6) + 0.0 AS mono,
 round(sum(CASE WHEN recording_id % 2 = 0 THEN y ELSE 0 END) - sum(CASE WHEN recording_id % 2 = 1 THEN y ELSE 0 END), 6) + 0.0 AS diff
 FROM sig GROUP BY 1, 2""")
def channel_mix(spark, d):
    two = _two_channels(spark, d)
    mono = stats.channel_view(two, "mono").withColumnRenamed("y", "mono")
    diff = stats.channel_view(two, "difference").withColumnRenamed("y", "diff")
    return mono.join(diff, ["recording_id", "idx"]).select("recording_id", "idx", r6("mono").alias("mono"), r6("diff").alias("diff"))


@query("sample_range", ctes(SIG) + "SELECT recording_id, idx, round(y, 6) + 0.0 AS y FROM sig WHERE idx >= 20 AND idx < 75")
def sample_range(spark, d):
    return to_samples(stats.chunk_range(to_chunks(v.sig(spark, d), v.SIG_CHUNK), 20, 55)).select("recording_id", "idx", r6("y").alias("y"))


@query("analysis_window", ctes(SIG) + "SELECT recording_id, count(*) AS n, round(max(y), 6) AS hi FROM sig WHERE idx < 60 GROUP BY 1")
def analysis_window(spark, d):
    return stats.analysis_window(v.sig(spark, d), 2).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("y")).alias("hi"))


@query("silence_check", ctes(SIG, "p AS (SELECT recording_id, max(abs(y)) / 100 AS peak FROM sig GROUP BY 1)") + """
 SELECT recording_id, round(peak, 6) AS peak, CASE WHEN peak >= 0.002 THEN round(-3.0 - 20 * log10(peak), 6) END AS auto_gain_db,
 CASE WHEN peak < 0.002 THEN 'silent' WHEN -3.0 - 20 * log10(peak) > 30 THEN 'high_gain' ELSE 'ok' END AS status FROM p""")
def silence_check(spark, d):
    quiet = v.sig(spark, d).withColumn("y", F.col("y") / 100)
    return stats.silence_check(quiet).select("recording_id", r6("peak").alias("peak"), r6("auto_gain_db").alias("auto_gain_db"), "status")


@query("signal_stats", ctes(SIG, "a AS (SELECT recording_id, min(y) mn, max(y) mx, sqrt(avg(y*y)) rms, avg(y) dc, count(*) n FROM sig GROUP BY 1)") + """
 SELECT recording_id, n, round(mn, 6) AS min_y, round(mx, 6) AS max_y, round(rms, 6) AS rms, round(dc, 6) + 0.0 AS dc_bias,
 CASE WHEN abs(mn) > 0 THEN round(20*log10(abs(mn)), 6) END AS min_db, CASE WHEN abs(mx) > 0 THEN round(20*log10(abs(mx)), 6) END AS max_db,
 CASE WHEN rms > 0 THEN round(20*log10(rms), 6) END AS rms_db, CASE WHEN abs(dc) > 0 THEN round(20*log10(abs(dc)), 6) END AS dc_db FROM a""")
def signal_stats(spark, d):
    s = stats.signal_stats(v.sig(spark, d))
    return s.select("recording_id", "n", *[r6(c).alias(c) for c in ("min_y", "max_y", "rms", "dc_bias", "min_db", "max_db", "rms_db", "dc_db")])


@query("peak_level", ctes(SIG, "a AS (SELECT recording_id, max(abs(y)) FILTER (idx < 30) h, max(abs(y)) f, max(abs(y)) FILTER (idx >= 60 AND idx < 80) s FROM sig GROUP BY 1)") + """
 SELECT recording_id, CASE WHEN h > 1e-10 THEN round(20*log10(h), 6) END AS peak_db, CASE WHEN f > 1e-10 THEN round(20*log10(f), 6) END AS full_peak_db,
 CASE WHEN s > 1e-10 THEN round(20*log10(s), 6) END AS selection_peak_db FROM a""")
def peak_level(spark, d):
    p = stats.peak_level(v.sig(spark, d), 1, (60, 80))
    return p.select("recording_id", *[r6(c).alias(c) for c in ("peak_db", "full_peak_db", "selection_peak_db")])


@query("clipping", ctes(SIG, "a AS (SELECT recording_id, max(abs(y * 1.8)) pk, count(*) FILTER (abs(y * 1.8) > 0.999) c FROM sig GROUP BY 1)") + """
 SELECT recording_id, round(pk, 6) AS peak, c AS clip_count, pk > 0.9999 AND c > 4 AS is_clipped FROM a""")
def clipping(spark, d):
    loud = v.sig(spark, d).withColumn("y", F.col("y") * 1.8)
    return stats.clipping(loud).select("recording_id", r6("peak").alias("peak"), "clip_count", "is_clipped")


WIN16 = "w AS (SELECT recording_id, idx // 16 AS win, count(*) m, sqrt(avg(y*y)) rms FROM sig GROUP BY 1, 2)"


@query("window_noise_floor", ctes(SIG, WIN16) + """SELECT recording_id,
 coalesce(round(20*log10(min(CASE WHEN (m = 16 OR win = 0) AND rms > 1e-4 THEN rms END)), 6), -120.0) AS noise_floor_db FROM w GROUP BY 1""")
def window_noise_floor(spark, d):
    return stats.min_window_rms_db(v.sig(spark, d), 16).select("recording_id", r6("noise_floor_db").alias("noise_floor_db"))


GATED = "sig0 AS (SELECT recording_id, idx, CASE WHEN (idx // 32 + recording_id) % 3 = 0 THEN 0 ELSE y END AS y FROM sig)"
WIN8 = "w AS (SELECT recording_id, idx // 8 AS win, count(*) m, sqrt(avg(y*y)) rms FROM sig0 GROUP BY 1, 2)"


def _gated(spark, d):
    quiet = (F.expr("idx div 32") + F.col("recording_id")) % 3 == 0
    return v.sig(spark, d).withColumn("y", F.when(quiet, 0.0).otherwise(F.col("y")))


@query("gap_aware_floor", ctes(SIG, GATED, WIN8, """a AS (SELECT recording_id, min(CASE WHEN rms > 1e-4 THEN rms END) act, min(rms) al,
 count(*) FILTER (rms <= 1e-4) sil FROM w WHERE m = 8 OR win = 0 GROUP BY 1)""") + """SELECT recording_id,
 CASE WHEN coalesce(act, al) < 1e-20 THEN -120.0 ELSE round(20*log10(coalesce(act, al)), 6) END AS noise_db, act IS NOT NULL AND sil > 0 AS has_silent_gaps FROM a""")
def gap_aware_floor(spark, d):
    return stats.gap_aware_floor(_gated(spark, d), 8).select("recording_id", r6("noise_db").alias("noise_db"), "has_silent_gaps")


@query("dense_soundscape", ctes(SIG, GATED, WIN8, """a AS (SELECT recording_id, min(CASE WHEN rms > 1e-4 THEN rms END) act, min(rms) al FROM w WHERE m = 8 OR win = 0 GROUP BY 1)""",
 "f AS (SELECT recording_id, CASE WHEN coalesce(act, al) < 1e-20 THEN -120.0 ELSE 20*log10(coalesce(act, al)) END nd FROM a)",
 "w4 AS (SELECT recording_id, idx // 4 AS win, count(*) m, sqrt(avg(y*y)) rms FROM sig0 GROUP BY 1, 2)",
 "c AS (SELECT recording_id, count(*) FILTER (CASE WHEN rms < 1e-20 THEN -120.0 ELSE 20*log10(greatest(rms, 1e-20)) END < nd + 3) nf, count(*) k FROM w4 JOIN f USING (recording_id) WHERE m = 4 OR win = 0 GROUP BY 1)") +
 "SELECT recording_id, nf AS near_floor, k AS windows, round(nf * 100.0 / k, 6) AS pct, nf < 6 OR nf * 100.0 / k < 1 AS is_dense FROM c")
def dense_soundscape(spark, d):
    s = _gated(spark, d)
    out = stats.dense_soundscape(s, stats.gap_aware_floor(s, 8), 4, 6)
    return out.select("recording_id", "near_floor", "windows", r6("pct").alias("pct"), "is_dense")


@query("cell_envelope", ctes(SIG_ALL) + "SELECT recording_id, idx // 256 AS cell, round(min(y), 6) AS lo, round(max(y), 6) AS hi FROM sig GROUP BY 1, 2")
def cell_envelope(spark, d):
    fine = stats.cell_envelope(v.sig_all(spark, d), 64)
    return stats.envelope_rollup(fine, 4).select("recording_id", "cell", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("envelope_range", ctes(SIG) + """SELECT recording_id, round(min(y), 6) AS lo, round(max(y), 6) AS hi FROM sig WHERE idx // 8 BETWEEN 2 AND 5 GROUP BY 1""")
def envelope_range(spark, d):
    return stats.envelope_range(stats.cell_envelope(v.sig(spark, d), 8), 2, 5).select("recording_id", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("pixel_envelope", ctes(SIG, "n AS (SELECT recording_id, count(*) n FROM sig GROUP BY 1)", "p AS (SELECT recording_id, CAST(px AS BIGINT) px, CAST(floor(px * (n / 20.0::DOUBLE)) AS BIGINT) a, CAST(floor((px+1) * (n / 20.0::DOUBLE)) AS BIGINT) b FROM n, generate_series(0, 19) g(px))") +
 "SELECT p.recording_id, px, round(min(y) * 2, 6) AS lo, round(max(y) * 2, 6) AS hi FROM p JOIN sig s ON s.recording_id = p.recording_id AND idx >= a AND idx < b GROUP BY 1, 2")
def pixel_envelope(spark, d):
    s = v.sig(spark, d)
    return stats.pixel_envelope(s, lengths(s), 20, 2.0).select("recording_id", "px", r6("lo").alias("lo"), r6("hi").alias("hi"))


ZC = "z AS (SELECT recording_id, idx, (y >= 0) <> (lag(y) OVER (PARTITION BY recording_id ORDER BY idx) >= 0) AS x FROM sig)"
ZC_OUT = """SELECT recording_id, count(*) FILTER (x) AS crossings, round((count(*) - 1) / 10.0, 6) AS duration_secs,
 round(CASE WHEN count(*) > 1 THEN count(*) FILTER (x) / (2 * (count(*) - 1) / 10.0) ELSE 0 END, 6) AS freq_hz FROM z GROUP BY 1"""


def _zc(s, chunk):
    z = stats.zero_crossings(s, SR, chunk)
    return z.select("recording_id", "crossings", r6("duration_secs").alias("duration_secs"), r6("freq_hz").alias("freq_hz"))


@query("zero_crossings", ctes(SIG, ZC) + ZC_OUT)
def zero_crossings(spark, d):
    return _zc(v.sig(spark, d), v.SIG_CHUNK)


@query("zero_crossings_long_recording", ctes(SIG_ALL, ZC) + ZC_OUT)
def zero_crossings_long(spark, d):
    return _zc(v.sig_all(spark, d), v.SIG_ALL_CHUNK)


@query("edge_transients", ctes(SIG, "n AS (SELECT recording_id, count(*) n FROM sig GROUP BY 1)", """a AS (SELECT recording_id, n, max(abs(y)) FILTER (idx < 2) h,
 max(abs(y)) FILTER (idx >= 2 AND idx < 12) hr, max(abs(y)) FILTER (idx >= n - 7) t, max(abs(y)) FILTER (idx >= n - 17 AND idx < n - 7) tr FROM sig JOIN n USING (recording_id) GROUP BY 1, 2)""") + """
 SELECT recording_id, coalesce(n > 12 AND hr > 1e-10 AND h > 2 * hr, false) AS start_transient, coalesce(n > 17 AND tr > 1e-10 AND t > 2 * tr, false) AS end_transient FROM a""")
def edge_transients(spark, d):
    s = v.sig(spark, d)
    return stats.edge_transients(s, lengths(s), SR)
