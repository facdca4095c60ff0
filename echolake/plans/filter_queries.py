"""Queries over filtered samples, recorder fingerprints and quality."""

import numpy as np
from pyspark.sql import functions as F

from echolake.functions.levels import r6
from echolake.operators import columns as C
from echolake.operators import detect, fingerprint, quality
from echolake.operators import filters as L
from echolake.operators import profile as P
from echolake.operators import spectral as S
from echolake.plans.chunking import lengths, to_chunks, to_samples
from echolake.plans.registry import INTS, SIG, SPEC, ctes, query
from echolake.sources import vehicles as v

RATE = 100.0
N = v.SIG_CHUNK


def _y(df):
    return df.select("recording_id", "idx", r6("y").alias("y"))


def _filtered(spark, d, system):
    return _y(to_samples(L.linear_filter(to_chunks(v.sig(spark, d), N), system)))


K10 = "(0.01 / (1 / (2 * pi() * 10) + 0.01))"
LP4 = f"""k AS (SELECT {K10} AS k),
lp AS (SELECT recording_id, idx, y AS x, y AS a, y AS b, y AS c, y AS e FROM sig WHERE idx = 0 UNION ALL
 SELECT s.recording_id, s.idx, s.y, k*s.y + (1-k)*a, k*(k*s.y + (1-k)*a) + (1-k)*b, k*(k*(k*s.y + (1-k)*a) + (1-k)*b) + (1-k)*c,
 k*(k*(k*(k*s.y + (1-k)*a) + (1-k)*b) + (1-k)*c) + (1-k)*e FROM lp l JOIN sig s ON s.recording_id = l.recording_id AND s.idx = l.idx + 1, k)"""


@query("low_pass", ctes(SIG, LP4) + "SELECT recording_id, idx, round(e, 6) + 0.0 AS y FROM lp")
def low_pass(spark, d):
    return _filtered(spark, d, L.low_pass(10.0, RATE, 4))


@query("band_pass", ctes(SIG, LP4) + "SELECT recording_id, idx, round(x - e, 6) + 0.0 AS y FROM lp")
def band_pass(spark, d):
    return _filtered(spark, d, L.band_pass(10.0, 60.0, RATE))


@query("high_pass", ctes(SIG, "k AS (SELECT (1 / (2 * pi() * 10)) / (1 / (2 * pi() * 10) + 0.01) AS k)",
 "hp AS (SELECT recording_id, idx, y AS x, 0.0::DOUBLE AS o FROM sig WHERE idx = 0 UNION ALL SELECT s.recording_id, s.idx, s.y, k * (o + s.y - x) FROM hp h JOIN sig s ON s.recording_id = h.recording_id AND s.idx = h.idx + 1, k)") +
 "SELECT recording_id, idx, round(o, 6) + 0.0 AS y FROM hp")
def high_pass(spark, d):
    return _filtered(spark, d, L.high_pass(10.0, RATE))


@query("attack_release_envelope", ctes(SIG, """ev AS (SELECT recording_id, idx, abs(y) / 3 AS e FROM sig WHERE idx = 0 UNION ALL
 SELECT s.recording_id, s.idx, e + CASE WHEN abs(s.y) > e THEN 1.0 / 3 ELSE 1.0 / 12 END * (abs(s.y) - e) FROM ev JOIN sig s ON s.recording_id = ev.recording_id AND s.idx = ev.idx + 1)""") +
 "SELECT recording_id, idx, round(e, 6) AS env FROM ev")
def attack_release_envelope(spark, d):
    return L.attack_release(v.sig(spark, d), 3, N).select("recording_id", "idx", r6("env").alias("env"))


@query("notch_filter", ctes(SIG, "p AS (SELECT sin(2*pi()*0.2) / 8 AS al, cos(2*pi()*0.2) AS co)",
 """nf AS (SELECT recording_id, idx, y AS x1, 0.0::DOUBLE AS x2, y / (1 + al) AS y1, 0.0::DOUBLE AS y2 FROM sig, p WHERE idx = 0 UNION ALL
 SELECT s.recording_id, s.idx, s.y, x1, (s.y - 2*co*x1 + x2 + 2*co*y1 - (1-al)*y2) / (1+al), y1 FROM nf n JOIN sig s ON s.recording_id = n.recording_id AND s.idx = n.idx + 1, p)""") +
 "SELECT recording_id, idx, round(y1, 6) + 0.0 AS y FROM nf")
def notch_filter(spark, d):
    return _filtered(spark, d, L.notch_chain([(20.0, 4.0)], RATE))


@query("notch_filter_with_harmonics")
def notch_with_harmonics(spark, d):
    return _filtered(spark, d, L.notch_chain([(11.0, 4.0), (20.0, 5.0)], RATE, 0.5))


EQ = {"below": -20.0, "selected": 3.0, "harmonics": -3.0, "above": -30.0}


@query("equalizer_fast", ctes(SIG, "k AS (SELECT 0.01 / (1 / (2 * pi() * 10) + 0.01) AS k, 0.01 / (1 / (2 * pi() * 20) + 0.01) AS j)",
 "lo AS (SELECT recording_id, idx, y AS x, [y, y, y, y] AS s FROM sig WHERE idx = 0 UNION ALL SELECT g.recording_id, g.idx, g.y, [k*g.y+(1-k)*s[1], k*(k*g.y+(1-k)*s[1])+(1-k)*s[2], k*(k*(k*g.y+(1-k)*s[1])+(1-k)*s[2])+(1-k)*s[3], k*(k*(k*(k*g.y+(1-k)*s[1])+(1-k)*s[2])+(1-k)*s[3])+(1-k)*s[4]] FROM lo JOIN sig g ON g.recording_id = lo.recording_id AND g.idx = lo.idx + 1, k)",
 "hi AS (SELECT recording_id, idx, x, s[4] AS l, x - s[4] AS r FROM lo)",
 "mi AS (SELECT recording_id, idx, l, r, [r, r, r, r] AS s FROM hi WHERE idx = 0 UNION ALL SELECT g.recording_id, g.idx, g.l, g.r, [j*g.r+(1-j)*s[1], j*(j*g.r+(1-j)*s[1])+(1-j)*s[2], j*(j*(j*g.r+(1-j)*s[1])+(1-j)*s[2])+(1-j)*s[3], j*(j*(j*(j*g.r+(1-j)*s[1])+(1-j)*s[2])+(1-j)*s[3])+(1-j)*s[4]] FROM mi JOIN hi g ON g.recording_id = mi.recording_id AND g.idx = mi.idx + 1, k)") +
 "SELECT recording_id, idx, round(l * 10 ** (-20.0/20) + s[4] * 10 ** (3.0/20) + (r - s[4]) * 10 ** (-30.0/20), 6) + 0.0 AS y FROM mi")
def equalizer_fast(spark, d):
    return _filtered(spark, d, L.fast_equalizer(10.0, 20.0, EQ, 3, RATE))


OLA = """nn AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY 1),
h AS (SELECT CAST(m AS BIGINT) AS m, (SELECT sum(g * cos(2 * pi() * k * m / 8)) / 8 FROM (SELECT k, {gain} AS g FROM generate_series(0, 7) q(k0), LATERAL (SELECT k0 AS k, least(k0, 8 - k0) AS b) z)) AS h FROM generate_series(0, 7) g(m)),
w AS (SELECT CAST(j AS BIGINT) AS j, 0.5 * (1 - cos(2 * pi() * j / 7)) AS w FROM generate_series(0, 7) g(j)),
fp AS (SELECT recording_id, n, unnest(range(0, n, 4)) AS p FROM nn),
fi AS (SELECT f.recording_id, p, j, w * y AS x FROM fp f JOIN w ON p + j < n JOIN sig s ON s.recording_id = f.recording_id AND s.idx = p + j),
fo AS (SELECT f.recording_id, p + o.j AS idx, sum(x * h) * max(o.w) AS y, max(o.w) ** 2 AS ww FROM fi f JOIN w o ON true JOIN h ON h.m = (o.j - f.j + 8) % 8 GROUP BY f.recording_id, p, o.j),
oa AS (SELECT recording_id, idx, CASE WHEN sum(ww) > 1e-6 THEN sum(y) / sum(ww) ELSE sum(y) END AS y FROM fo JOIN nn USING (recording_id) WHERE idx < n GROUP BY 1, 2)"""


@query("equalizer_spectral", ctes(SIG, OLA.replace("{gain}", "CASE WHEN b * 12.5 < 15 THEN 10 ** (-20.0/20) WHEN b * 12.5 <= 26 THEN 10 ** (3.0/20) WHEN b * 12.5 BETWEEN 30 AND 52 THEN 10 ** (-3.0/20) ELSE 10 ** (-30.0/20) END")) +
 "SELECT recording_id, idx, round(y, 6) + 0.0 AS y FROM oa")
def equalizer_spectral(spark, d):
    gains = L.equalizer_gains(8, RATE, 15.0, 26.0, EQ, 4)
    return _y(to_samples(L.spectral_gain(to_chunks(v.sig(spark, d), N), N, 8, gains)))


@query("band_split", ctes(SIG, OLA.replace("{gain}", "CASE WHEN b BETWEEN 1 AND 2 THEN 1.0 ELSE 0.0 END")) + "SELECT recording_id, idx, round(y, 6) + 0.0 AS y FROM oa")
def band_split(spark, d):
    middle = L.split_gains(8, RATE, 12.5, 25.0)[1]
    return _y(to_samples(L.spectral_gain(to_chunks(v.sig(spark, d), N), N, 8, middle)))


@query("spectral_subtraction")
def spectral_subtraction(spark, d):
    chunks = to_chunks(v.sig(spark, d), N)
    floors = P.gather(S.mean_spectrum(chunks, N, 16), "mean_mag", "floor")
    return _y(to_samples(L.spectral_subtraction(chunks, floors, N, 16, 0.8, 0.05, 0.3)))


@query("band_demodulation", ctes(SIG.replace("sig AS", "sg AS"), "sig AS (SELECT recording_id, idx, y * (cos(2*pi()*12.0*idx/100) + cos(2*pi()*20.0*idx/100) + cos(2*pi()*28.0*idx/100)) / 3 AS y FROM sg)", LP4) + "SELECT recording_id, idx, round(e, 6) + 0.0 AS y FROM lp")
def band_demodulation(spark, d):
    return _y(L.demodulate(v.sig(spark, d), RATE, L.comb_carriers(12.0, 8.0, 3), 10.0, N))


@query("decimated_signal", ctes(SIG, LP4) + "SELECT recording_id, idx // 5 AS idx, round(e, 6) + 0.0 AS y FROM lp WHERE idx % 5 = 0")
def decimated_signal(spark, d):
    out, _ = L.decimate(to_chunks(v.sig(spark, d), N), 100, 20)
    return _y(out)


@query("resampled_signal", ctes(SIG, "nn AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY 1)", "o AS (SELECT recording_id, n, unnest(range(0, CAST(floor(n * 1.5) AS BIGINT))) AS i FROM nn)") +
 """SELECT o.recording_id, i AS idx, round(a.y + (i / 1.5::DOUBLE - floor(i / 1.5::DOUBLE)) * (b.y - a.y), 6) + 0.0 AS y FROM o JOIN sig a ON a.recording_id = o.recording_id AND a.idx = floor(i / 1.5::DOUBLE)
 JOIN sig b ON b.recording_id = o.recording_id AND b.idx = least(floor(i / 1.5::DOUBLE) + 1, n - 1)""")
def resampled_signal(spark, d):
    s = v.sig(spark, d)
    return _y(L.resample(s, lengths(s), 1.5, N))


@query("normalized_peak", ctes(SIG, "p AS (SELECT recording_id, max(abs(y)) AS pk FROM sig GROUP BY 1)") + "SELECT recording_id, idx, round(y * 10 ** (6.0 / 20) * 10 ** (-3.0 / 20) / (pk * 10 ** (6.0 / 20)), 6) + 0.0 AS y FROM sig JOIN p USING (recording_id)")
def normalized_peak(spark, d):
    return _y(L.normalize_peak(L.apply_gain(v.sig(spark, d), 6.0)))


CHAIN = L.Chain(rate=100, band=(10.0, 30.0), notches=((20.0, 4.0),), subtract=0.5, carriers=(15.0,), cutoff=10.0, expansion=10.0, fft=16)


@query("filter_chain")
def filter_chain(spark, d):
    s = v.sig(spark, d)
    floors = P.gather(S.mean_spectrum(to_chunks(s, N), N, 16), "mean_mag", "floor")
    return _y(L.run_chain(s, CHAIN, N, floors)[0])


@query("region_export", ctes(SIG, LP4, "rg AS (SELECT user_id AS recording_id, event_id AS region_id, (event_id % 50) / 100.0::DOUBLE AS a, (event_id % 50) / 100.0::DOUBLE + 0.1 AS b FROM events WHERE event_type = 'error')") +
 "SELECT l.recording_id, region_id, idx - CAST(floor(r.a * 100) AS BIGINT) AS pos, round(x - e, 6) + 0.0 AS y, 100.0::DOUBLE AS rate FROM lp l JOIN rg r ON r.recording_id = l.recording_id AND idx >= floor(r.a * 100) AND idx < floor(r.b * 100)")
def region_export(spark, d):
    ev = v.table(spark, d, "events").where(F.col("event_type") == "error")
    start = (F.col("event_id") % 50) / 100.0
    regions = ev.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("region_id"), start.alias("start_time"), (start + 0.1).alias("end_time"))
    out = L.export_regions(v.sig(spark, d), regions, L.Chain(rate=100, band=(10.0, 60.0)), N)
    return out.withColumn("y", r6("y"))


@query("smoothed_peaks", ctes(SPEC, "pk AS (SELECT recording_id, col AS i, max(mag) AS y, max(max(col)) OVER (PARTITION BY recording_id) AS m FROM spec GROUP BY 1, 2)", "k AS (SELECT 1 - exp(-1.0 / 4) AS k)",
 "fw AS (SELECT recording_id, i, m, y AS s FROM pk WHERE i = 0 UNION ALL SELECT p.recording_id, p.i, p.m, (1-k)*s + k*p.y FROM fw JOIN pk p ON p.recording_id = fw.recording_id AND p.i = fw.i + 1, k)",
 "bw AS (SELECT recording_id, i, s FROM fw WHERE i = m UNION ALL SELECT f.recording_id, f.i, (1-k)*b.s + k*f.s FROM bw b JOIN fw f ON f.recording_id = b.recording_id AND f.i = b.i - 1, k)") +
 "SELECT recording_id, i AS idx, round(s, 6) AS y FROM bw")
def smoothed_peaks(spark, d):
    series = v.spec(spark, d).select("recording_id", F.col("col").alias("idx"), F.array_max("mags").alias("y"))
    return _y(L.smooth_both_ways(series, 4.0, 16))


@query("adaptive_chroma_levels")
def adaptive_chroma_levels(spark, d):
    cells = C.chroma(v.spec(spark, d), 64, 40.0, "musical")
    peaks = C.chroma_maxima(cells)
    local = cells.groupBy("recording_id", "col").agg(F.max("energy").alias("y")).withColumnRenamed("col", "idx")
    smooth = L.smooth_both_ways(local, 32.0, 64).select("recording_id", F.col("idx").alias("col"), F.col("y").alias("local"))
    rows = cells.join(smooth, ["recording_id", "col"]).join(peaks, "recording_id")
    level = L.adaptive_norm(F.col("energy"), F.col("max_note"), F.col("local"), 3.0, 0.5, -40.0)
    return rows.select("recording_id", "col", "pitch_class", "octave", r6(level).alias("level"))


@query("pulse_detection_bandpassed")
def pulse_detection_bandpassed(spark, d):
    """The full chain: band-pass, attack/release envelope, hysteresis pulses."""
    s = v.sig_all(spark, d)
    band = to_samples(L.linear_filter(to_chunks(s, v.SIG_ALL_CHUNK), L.band_pass(5.0, 40.0, RATE))).select("recording_id", "idx", "y")
    env = L.attack_release(band, 2, v.SIG_ALL_CHUNK)
    p = detect.detect_pulses(env, lengths(s), 100, detect.PulseSettings(6.0, 30.0, 20.0, 400.0), v.SIG_ALL_CHUNK)
    return p.select("recording_id", "pulse_no", *[r6(c).alias(c) for c in ("start_time", "end_time", "peak_time", "peak_amp", "snr_db")])


PW = """nn AS (SELECT recording_id, count(*) AS n FROM ints GROUP BY 1),
pw AS (SELECT recording_id, CAST(i AS BIGINT) AS win, 64 + i * CASE WHEN k > 1 THEN (n - 576) // (k - 1) ELSE 0 END AS start FROM (SELECT recording_id, n, least(6, 1 + (n - 576) // 512) AS k FROM nn WHERE n >= 1088), generate_series(0, 5) g(i) WHERE i < k)"""


@query("window_picker", ctes(INTS, PW) + "SELECT recording_id, win, start FROM pw")
def window_picker(spark, d):
    w = fingerprint.pick_windows(lengths(v.ints(spark, d)), 64, 512)
    return w.select("recording_id", F.col("win").cast("long").alias("win"), F.col("start").cast("long").alias("start"))


IM = """ww AS (SELECT i.recording_id, win, idx, v, lag(v) OVER (PARTITION BY i.recording_id, win ORDER BY idx) AS p, stddev_pop(v) OVER (PARTITION BY i.recording_id, win) AS sd FROM ints i JOIN pw ON pw.recording_id = i.recording_id AND idx >= start AND idx < start + 512),
ca AS (SELECT c AS cutoff_hz, o AS os_div, (1 - tan(pi() * c / 48000)) / (1 + tan(pi() * c / 48000)) AS pole FROM (VALUES (48), (8)) a(c), (VALUES (1), (2), (4), (8)) b(o)),
sc AS (SELECT recording_id, cutoff_hz, os_div, (1 + pole) / 2 * 16.0 / os_div AS gain, abs((v - pole * p) / ((1 + pole) / 2 * 16.0 / os_div) - round((v - pole * p) / ((1 + pole) / 2 * 16.0 / os_div))) AS f FROM ww, ca WHERE p IS NOT NULL AND sd >= 20 AND (1 + pole) / 2 * 16.0 / os_div >= 1.5),
ag AS (SELECT recording_id, cutoff_hz, os_div, max(gain) AS gain, avg(f) AS m, avg(CASE WHEN f < 0.1 THEN 1.0 ELSE 0 END) AS ni FROM sc GROUP BY 1, 2, 3)"""


def multiples(spark, d):
    s = v.ints(spark, d)
    return fingerprint.integer_multiple_scores(s, fingerprint.pick_windows(lengths(s), 64, 512), 48_000, 512)


@query("integer_multiple_scores", ctes(INTS, PW, IM) + "SELECT recording_id, cutoff_hz, os_div, round(gain, 6) AS gain, round(m, 6) AS mean_abs_frac, round(ni, 6) AS near_integer_frac FROM ag")
def integer_multiple_scores(spark, d):
    return multiples(spark, d).select("recording_id", "cutoff_hz", "os_div", *[r6(c).alias(c) for c in ("gain", "mean_abs_frac", "near_integer_frac")])


@query("integer_multiple_verdict", ctes(INTS, PW, IM, "b AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY m, cutoff_hz DESC, os_div) AS r FROM ag)") +
 "SELECT recording_id, cutoff_hz, os_div, CASE WHEN m < 0.04 THEN 'match' WHEN m < 0.1 THEN 'possible' ELSE 'no_match' END AS verdict FROM b WHERE r = 1")
def integer_multiple_verdict(spark, d):
    return fingerprint.integer_multiple_verdict(multiples(spark, d)).select("recording_id", "cutoff_hz", "os_div", "verdict")


def inverse_scores(spark, d):
    s = v.ints(spark, d)
    return fingerprint.inverse_filter_scores(s, fingerprint.pick_windows(lengths(s), 64, 512), 512)


@query("inverse_filter_scores")
def inverse_filter_scores(spark, d):
    return inverse_scores(spark, d).select("recording_id", "db_cut", r6("in_range_frac").alias("in_range_frac"), r6("residual").alias("residual"))


@query("inverse_filter_verdict")
def inverse_filter_verdict(spark, d):
    return fingerprint.inverse_filter_verdict(inverse_scores(spark, d)).select("recording_id", "db_cut", "verdict")


FADE_VEHICLE_RATE = 20


@query("fade_detection", ctes(SIG, "f AS (SELECT recording_id, idx, CASE WHEN idx < recording_id % 20 THEN y * 0.02 ELSE y END AS y FROM sig)", "nn AS (SELECT recording_id, count(*) AS n FROM f GROUP BY 1)",
 "mg AS (SELECT recording_id, n, n / 20.0::DOUBLE AS du, CASE WHEN n / 20.0 > 30 THEN 10 WHEN n / 20.0 > 15 THEN 3 WHEN n / 20.0 > 8 THEN 2 WHEN n / 20.0 > 5 THEN 1 WHEN n / 20.0 > 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS mg FROM nn)",
 "cp(t, lo) AS (VALUES (0.3, 2), (0.4, 2), (0.5, 2), (0.75, 5), (1.0, 5), (1.25, 8), (1.5, 8), (2.0, 8), (2.5, 8), (3.0, 15), (4.0, 15), (5.0, 30), (6.0, 30), (7.0, 30), (8.0, 30), (9.0, 30), (10.0, 30))",
 "md AS (SELECT m.recording_id, 20 * log10(sqrt(avg(y*y))) AS md FROM mg m JOIN f USING (recording_id) WHERE idx >= floor(mg * 20) AND idx < floor((du - mg) * 20) GROUP BY 1)",
 "hd AS (SELECT recording_id, 20 * log10(greatest(sqrt(avg(y*y)), 1e-6)) AS h FROM f WHERE idx < 2 GROUP BY 1)", "tl AS (SELECT f.recording_id, 20 * log10(greatest(sqrt(avg(y*y)), 1e-6)) AS h FROM f JOIN nn USING (recording_id) WHERE idx >= n - 2 GROUP BY 1)",
 "si AS (SELECT m.recording_id, t, 20 * log10(greatest(sqrt(avg(y*y)), 1e-6)) AS l FROM mg m JOIN cp ON du >= lo AND n > CAST(trunc(t * 20) AS BIGINT) JOIN f ON f.recording_id = m.recording_id AND idx >= trunc((t::DOUBLE - 0.1::DOUBLE) * 20) AND idx < trunc(t * 20) GROUP BY 1, 2)",
 "so AS (SELECT m.recording_id, t, 20 * log10(greatest(sqrt(avg(y*y)), 1e-6)) AS l FROM mg m JOIN cp ON du >= lo AND n >= CAST(trunc(t * 20) AS BIGINT) JOIN f ON f.recording_id = m.recording_id AND idx >= n - trunc(t * 20) AND idx < n - trunc((t::DOUBLE - 0.1::DOUBLE) * 20) GROUP BY 1, 2)",
 "fi AS (SELECT m.recording_id, max(t) AS t FROM md m JOIN si USING (recording_id) WHERE l - md < -1 GROUP BY 1)", "fo AS (SELECT m.recording_id, max(t) AS t FROM md m JOIN so USING (recording_id) WHERE l - md < -1 GROUP BY 1)") +
 "SELECT m.recording_id, CAST(CASE WHEN md < -100 OR hd.h - md > -10 THEN 0 ELSE coalesce(fi.t, 0.2) END AS DOUBLE) AS fade_in_secs, CAST(CASE WHEN md < -100 OR tl.h - md > -10 THEN 0 ELSE coalesce(fo.t, 0.2) END AS DOUBLE) AS fade_out_secs FROM md m JOIN hd USING (recording_id) JOIN tl USING (recording_id) LEFT JOIN fi USING (recording_id) LEFT JOIN fo USING (recording_id)")
def fade_detection(spark, d):
    quiet = v.sig(spark, d).withColumn("y", F.when(F.col("idx") < F.col("recording_id") % 20, F.col("y") * 0.02).otherwise(F.col("y")))
    return quality.fades(quiet, FADE_VEHICLE_RATE)


@query("weighted_snr")
def weighted_snr(spark, d):
    # The vehicle has no audio rate; 2 kHz makes it long enough to grade.
    q = quality.weighted_snr(v.sig_all(spark, d), 2000, v.SIG_ALL_CHUNK, fft=256, min_rate=1000)
    return q.select("recording_id", "grade", r6("snr_db").alias("snr_db"), r6("noise_db").alias("noise_db"), F.array_join("warnings", ",").alias("warnings"))
