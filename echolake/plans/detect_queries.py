"""Queries over detected events."""

from pyspark.sql import functions as F

from echolake.functions.levels import r6
from echolake.operators import detect
from echolake.operators.ranks import nth_smallest
from echolake.plans.chunking import lengths
from echolake.plans.registry import SIG, SIG_ALL, ctes, query
from echolake.sources import vehicles as v

RATE = 100
SETTINGS = detect.PulseSettings(threshold_db=6.0, min_gap_ms=30.0, min_ms=20.0, max_ms=400.0)

ENV = """nn AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY 1),
env AS (SELECT recording_id, idx, y, avg(abs(y)) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS env FROM sig),
pick AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY env) - 1 AS r, count(*) OVER (PARTITION BY recording_id) AS m, env
  FROM env JOIN nn USING (recording_id)),
flr AS (SELECT recording_id, greatest(env, 1e-10) AS flr FROM pick WHERE r = m // 10)"""
PULSES = """ev AS (SELECT recording_id, idx, env, flr, n, CASE WHEN env >= flr * 10 ** (6.0 / 20) THEN 1 WHEN env < flr * 10 ** (3.0 / 20) THEN 0 END AS e
  FROM env JOIN flr USING (recording_id) JOIN nn USING (recording_id)),
st AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY idx), 0) AS s FROM ev),
fl AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (PARTITION BY recording_id ORDER BY idx), 0) = 0 THEN 1 ELSE 0 END AS f FROM st),
isl AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM fl),
raw AS (SELECT recording_id, g, min(idx) AS a, max(idx) + 1 AS b, max(env) AS pk, arg_max(idx, (env, -idx)) AS pi, any_value(n) AS n, any_value(flr) AS flr
  FROM isl WHERE s = 1 GROUP BY 1, 2),
lk AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY recording_id ORDER BY a) < 3 AND b < n THEN 0 ELSE 1 END AS h FROM raw),
mg AS (SELECT *, sum(h) OVER (PARTITION BY recording_id ORDER BY a) AS k FROM lk),
pl AS (SELECT recording_id, k, min(a) AS a, max(b) AS b, max(pk) AS pk, arg_max(pi, (pk, -pi)) AS pi, any_value(flr) AS flr FROM mg GROUP BY 1, 2),
pulses AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY a) AS pulse_no, a / 100.0::DOUBLE AS start_time, b / 100.0::DOUBLE AS end_time,
  pi / 100.0::DOUBLE AS peak_time, pk AS peak_amp, 20 * log10(pk / flr) AS snr_db FROM pl WHERE b - a BETWEEN 2 AND 40)"""
PULSES_OUT = """SELECT recording_id, pulse_no, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(peak_time, 6) AS peak_time,
 round(peak_amp, 6) AS peak_amp, round(snr_db, 6) AS snr_db FROM pulses"""
PULSE_COLS = ("start_time", "end_time", "peak_time", "peak_amp", "snr_db")


def _pulses(samples, counts, chunk):
    env = detect.mean_envelope(samples, 4, chunk)
    return detect.detect_pulses(env, counts, RATE, SETTINGS, chunk)


def _rounded(p):
    return p.select("recording_id", "pulse_no", *[r6(c).alias(c) for c in PULSE_COLS])


@query("pulse_detection", ctes(SIG, ENV, PULSES) + PULSES_OUT)
def pulse_detection(spark, d):
    return _rounded(_pulses(v.sig(spark, d), v.sig_lengths(spark, d), v.SIG_CHUNK))


@query("pulse_detection_long_recording", ctes(SIG_ALL, ENV, PULSES) + PULSES_OUT)
def pulse_detection_long(spark, d):
    return _rounded(_pulses(v.sig_all(spark, d), v.sig_lengths(spark, d, single=True), v.SIG_ALL_CHUNK))


SPEC_BY_USER = """sc AS (SELECT vec_id // 3 AS recording_id, (vec_id % 3) * 0.25 AS t, CAST(bin AS BIGINT) - 1 AS bin, abs(CAST(embedding[bin] AS DOUBLE)) AS mag
  FROM embeddings, generate_series(1, 64) g(bin))"""


@query("pulse_peak_frequency", ctes(SIG, ENV, PULSES, SPEC_BY_USER,
 "hit AS (SELECT p.recording_id, pulse_no, bin, mag, t FROM pulses p JOIN sc ON sc.recording_id = p.recording_id AND t BETWEEN start_time AND end_time WHERE mag > 0)",
 "best AS (SELECT recording_id, pulse_no, bin, row_number() OVER (PARTITION BY recording_id, pulse_no ORDER BY mag DESC, t, bin) r FROM hit)") +
 """SELECT p.recording_id, p.pulse_no, coalesce(bin, 0) AS peak_bin FROM pulses p LEFT JOIN best b ON b.recording_id = p.recording_id AND b.pulse_no = p.pulse_no AND r = 1""")
def pulse_peak_frequency(spark, d):
    columns = v.table(spark, d, "embeddings").select(
        F.expr("vec_id div 3").alias("recording_id"), ((F.col("vec_id") % 3) * 0.25).alias("t"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("mags"),
    )
    out = detect.pulse_peak_bins(_pulses(v.sig(spark, d), v.sig_lengths(spark, d), v.SIG_CHUNK), columns)
    return out.select("recording_id", "pulse_no", F.col("peak_bin").cast("long").alias("peak_bin"))


@query("noise_floor_percentile", ctes(SIG, ENV) + "SELECT recording_id, n, round(flr, 6) AS floor FROM flr JOIN nn USING (recording_id)")
def noise_floor_percentile(spark, d):
    s = v.sig(spark, d)
    f = detect.noise_floor(detect.mean_envelope(s, 4, v.SIG_CHUNK), lengths(s))
    return f.select("recording_id", "n", r6("floor").alias("floor"))


@query("upper_median_level", ctes(SIG_ALL, "o AS (SELECT recording_id, y, row_number() OVER (PARTITION BY recording_id ORDER BY y) - 1 r, count(*) OVER (PARTITION BY recording_id) m FROM sig)") +
 "SELECT recording_id, round(y, 6) + 0.0 AS median_y FROM o WHERE r = m // 2")
def upper_median_level(spark, d):
    m = nth_smallest(v.sig_all(spark, d), ["recording_id"], "y", F.expr("n div 2"), "median_y")
    return m.select("recording_id", r6("median_y").alias("median_y"))


@query("schmitt_latch", ctes(SIG_ALL, "l AS (SELECT recording_id, idx, coalesce(last_value(CASE WHEN y > 0.2 THEN 1 WHEN y < 0.0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY idx), 0) = 1 AS armed FROM sig)") +
 "SELECT recording_id, idx, armed FROM l")
def schmitt_latch(spark, d):
    from echolake.plans.chunking import with_chunk

    rows = with_chunk(v.sig_all(spark, d), v.SIG_ALL_CHUNK)
    return detect.latch(rows, F.col("y") > 0.2, F.col("y") < 0.0).select("recording_id", "idx", "armed")


ARMED = """th AS (SELECT recording_id, greatest(max(abs(y)) * 0.3, 1e-5) AS hi, greatest(max(abs(y)) * 0.3, 1e-5) * 0.4 AS lo, count(*) AS n FROM sig GROUP BY 1),
ar AS (SELECT recording_id, idx, y, env, hi, n, CASE WHEN idx > 0 AND env > hi THEN 1 WHEN idx > 0 AND env < lo THEN 0 END AS e,
  (y >= 0) <> (lag(y) OVER (PARTITION BY recording_id ORDER BY idx) >= 0) AS x FROM env JOIN th USING (recording_id)),
a2 AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY idx), 0) = 1 AND x AS c,
  count(*) FILTER (e = 0) OVER (PARTITION BY recording_id ORDER BY idx) AS isl FROM ar)"""


def _armed(s, chunk):
    env = detect.mean_envelope(s, 4, chunk)
    th = detect.adaptive_thresholds(s)
    # The vehicle is noisy, so it arms at 10 % of the peak.
    high = F.greatest(F.col("high") * 2, F.lit(1e-5))
    return env, th.select("recording_id", "n", high.alias("high"), (high * 0.4).alias("low"))


@query("crossing_rate_bins", ctes(SIG, ENV, ARMED.replace("0.3", "0.05 * 2"), """bn AS (SELECT recording_id, (idx - 1) // 10 AS bin, count(*) FILTER (c) AS crossings, any_value(n) n, max(idx) li
 FROM a2 WHERE idx > 0 GROUP BY 1, 2)""") + """SELECT recording_id, bin, crossings, round(crossings / (2 * CASE WHEN li = n - 1 THEN (li % 10 + 1) / 100.0 ELSE 0.1 END), 6) AS rate,
 crossings > 0 AS armed FROM bn""")
def crossing_rate_bins(spark, d):
    env, th = _armed(v.sig(spark, d), v.SIG_CHUNK)
    b = detect.crossing_rate_bins(env, th, RATE, 10, v.SIG_CHUNK)
    return b.select("recording_id", "bin", "crossings", r6("rate").alias("rate"), "armed")


@query("divided_crossings", ctes(SIG_ALL, ENV, ARMED.replace("0.3", "0.05 * 2"), "kk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, isl ORDER BY idx) AS k FROM a2 WHERE c)") +
 "SELECT recording_id, idx, round(least(env / hi, 1.0), 6) AS amp FROM kk WHERE k % 3 = 0")
def divided_crossings(spark, d):
    env, th = _armed(v.sig_all(spark, d), v.SIG_ALL_CHUNK)
    return detect.divided_crossings(env, th, 3, v.SIG_ALL_CHUNK).select("recording_id", "idx", r6("amp").alias("amp"))


TICKS = """tk AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx, CAST(round(value * 10) AS BIGINT) AS ticks,
  event_type = 'error' AS is_off FROM events),
tt AS (SELECT *, sum(ticks) OVER (PARTITION BY recording_id ORDER BY idx) * (25000.0::DOUBLE / 21370) AS us FROM tk),
tp AS (SELECT *, lead(us) OVER (PARTITION BY recording_id ORDER BY idx) - lag(us) OVER (PARTITION BY recording_id ORDER BY idx) AS p FROM tt),
dots AS (SELECT recording_id, idx, us / 1e6 AS t, CASE WHEN p BETWEEN 48 AND 2000 THEN 8e6 / p ELSE 0 END AS freq_hz, is_off FROM tp)"""


def _dots(spark, d):
    ev = v.table(spark, d, "events")
    from echolake.plans.chunking import dense_index

    keyed = ev.select(
        F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 10).cast("long").alias("ticks"), (F.col("event_type") == "error").alias("is_off"),
    )
    rows = dense_index(keyed, ["recording_id"], F.floor(F.unix_micros("ts") / v.EVENT_BUCKET_MICROS), ["ts"])
    return detect.zero_crossing_dots(rows, 21_370.0, 8, v.SIG_CHUNK)


@query("zero_crossing_dots", ctes(TICKS) + "SELECT recording_id, idx, round(t, 6) AS t, round(freq_hz, 6) AS freq_hz, is_off FROM dots")
def zero_crossing_dots(spark, d):
    return _dots(spark, d).select("recording_id", "idx", r6("t").alias("t"), r6("freq_hz").alias("freq_hz"), "is_off")


@query("zero_crossing_summary", ctes(TICKS, "g AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY freq_hz) - 1 r, count(*) OVER (PARTITION BY recording_id) m FROM dots WHERE NOT is_off AND freq_hz > 0)",
 "md AS (SELECT recording_id, freq_hz AS md FROM g WHERE r = m // 2)",
 "s AS (SELECT recording_id, count(*) dots, count(*) FILTER (NOT is_off) on_dots, count(*) FILTER (is_off) off_dots, min(freq_hz) FILTER (NOT is_off AND freq_hz > 0) mn, max(freq_hz) FILTER (NOT is_off AND freq_hz > 0) mx, avg(freq_hz) FILTER (NOT is_off AND freq_hz > 0) av, max(t) du FROM dots GROUP BY 1)") +
 "SELECT s.recording_id, dots, on_dots, off_dots, round(mn, 6) AS min_hz, round(mx, 6) AS max_hz, round(av, 6) AS mean_hz, round(md, 6) AS median_hz, round(du, 6) AS duration_secs FROM s LEFT JOIN md USING (recording_id)")
def zero_crossing_summary(spark, d):
    s = detect.dot_summary(_dots(spark, d))
    return s.select("recording_id", "dots", "on_dots", "off_dots", *[r6(c).alias(c) for c in ("min_hz", "max_hz", "mean_hz", "median_hz", "duration_secs")])
