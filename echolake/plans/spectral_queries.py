"""Queries over spectra."""

import math

from pyspark.sql import functions as F

from echolake.functions.levels import pitch_name, r6
from echolake.operators import columns as C
from echolake.operators import profile as P
from echolake.operators import spectral as S
from echolake.plans.chunking import lengths, to_chunks
from echolake.plans.registry import CPLX, SIG, SIG_ALL, SPEC, ctes, query
from echolake.sources import vehicles as v

FFT, HOP, RATE = 16, 8, 100.0
NN = "nn AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY 1)"
FR = """cols AS (SELECT recording_id, unnest(range(0, (n - 16) // 8 + 1)) AS col FROM nn WHERE n >= 16),
fr AS (SELECT c.recording_id, c.col, idx - c.col * 8 AS pos, y, 0.5 * (1 - cos(2 * pi() * (idx - c.col * 8) / 15)) AS w
  FROM cols c JOIN sig s ON s.recording_id = c.recording_id AND idx BETWEEN c.col * 8 AND c.col * 8 + 15)"""
DFT = """dft AS (SELECT recording_id, col, k AS bin, sum(y * w * cos(2 * pi() * k * pos / 16)) AS re, -sum(y * w * sin(2 * pi() * k * pos / 16)) AS im
  FROM fr, generate_series(0, 8) g(k) GROUP BY 1, 2, 3)"""
W2 = "(SELECT sum((0.5 * (1 - cos(2 * pi() * i / 15))) ** 2) FROM generate_series(0, 15) g(i))"


def _chunks(samples, size):
    return to_chunks(samples, size)


@query("frame_energy", ctes(SIG, NN, FR) + "SELECT recording_id, col, count(*) AS n, round(sum(y * y), 6) AS energy FROM fr GROUP BY 1, 2")
def frame_energy(spark, d):
    s = v.sig(spark, d)
    rows = S.frame_rows(s, v.SIG_CHUNK, FFT, HOP, lengths(s))
    return rows.groupBy("recording_id", "col").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("y") * F.col("y"))).alias("energy"))


@query("stft_magnitude", ctes(SIG_ALL, NN, FR, DFT) + "SELECT recording_id, col, bin, round(col * 8 / 100.0::DOUBLE, 6) AS t, round(sqrt(re * re + im * im), 6) + 0.0 AS mag FROM dft")
def stft_magnitude(spark, d):
    cols = S.stft(_chunks(v.sig_all(spark, d), v.SIG_ALL_CHUNK), v.SIG_ALL_CHUNK, FFT, HOP, RATE)
    return cols.select("recording_id", "col", r6("t").alias("t"), F.posexplode("mags").alias("bin", "mag")).select(
        "recording_id", "col", F.col("bin").cast("long").alias("bin"), "t", r6("mag").alias("mag"))


@query("stft_complex", ctes(SIG, NN, FR, DFT) + "SELECT recording_id, col, bin, round(re, 6) + 0.0 AS re, CASE WHEN bin IN (0, 8) THEN 0.0 ELSE round(im, 6) + 0.0 END AS im FROM dft")
def stft_complex(spark, d):
    cols = S.stft(_chunks(v.sig(spark, d), v.SIG_CHUNK), v.SIG_CHUNK, FFT, HOP, RATE, complex_output=True)
    flat = cols.select("recording_id", "col", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "x"))
    return flat.select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("x.re").alias("re"), r6("x.im").alias("im"))


@query("welch_psd", ctes(SIG_ALL, NN, FR, DFT, "a AS (SELECT recording_id, bin, count(*) fr, sum(re * re + im * im) s FROM dft GROUP BY 1, 2)") +
 f"""SELECT recording_id, bin, fr AS frames, round(bin * 6.25::DOUBLE, 6) AS freq_hz,
 round(10 * log10(s / (fr * {W2} * 100.0) * CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END), 6) AS power_db FROM a""")
def welch_psd(spark, d):
    psd = S.welch_psd(_chunks(v.sig_all(spark, d), v.SIG_ALL_CHUNK), v.SIG_ALL_CHUNK, FFT, RATE)
    return psd.select("recording_id", F.col("bin").cast("long").alias("bin"), "frames", r6("freq_hz").alias("freq_hz"), r6("power_db").alias("power_db"))


@query("mean_spectrum", ctes(SIG, NN, FR, DFT) + "SELECT recording_id, bin, count(*) AS frames, round(avg(sqrt(re * re + im * im)), 6) AS mean_mag FROM dft GROUP BY 1, 2 HAVING count(*) >= 2")
def mean_spectrum(spark, d):
    m = S.mean_spectrum(_chunks(v.sig(spark, d), v.SIG_CHUNK), v.SIG_CHUNK, FFT)
    return m.select("recording_id", F.col("bin").cast("long").alias("bin"), "frames", r6("mean_mag").alias("mean_mag"))


@query("reassigned_spectrum", ctes(SIG, NN, FR,
 """rs AS (SELECT recording_id, col, k, sum(y*w*cos(2*pi()*k*pos/16)) hr, -sum(y*w*sin(2*pi()*k*pos/16)) hi,
 sum(y*w*(pos-7.5)*cos(2*pi()*k*pos/16)) tr, -sum(y*w*(pos-7.5)*sin(2*pi()*k*pos/16)) ti,
 sum(y*(-pi()/15)*sin(2*pi()*pos/15)*cos(2*pi()*k*pos/16)) dr, -sum(y*(-pi()/15)*sin(2*pi()*pos/15)*sin(2*pi()*k*pos/16)) di FROM fr, generate_series(0, 8) g(k) GROUP BY 1, 2, 3)""",
 """rc AS (SELECT r.recording_id, least(greatest(round(col - (tr*hr + ti*hi)/(hr*hr + hi*hi)), 0), (n - 16) // 8) AS col,
 least(greatest(round(k + 16/(2*pi()) * (di*hr - dr*hi)/(hr*hr + hi*hi)), 0), 8) AS bin, hr*hr + hi*hi AS p FROM rs r JOIN nn USING (recording_id) WHERE hr*hr + hi*hi >= 1e-3)""") +
 "SELECT recording_id, CAST(col AS BIGINT) AS col, CAST(bin AS BIGINT) AS bin, round(10 * log10(sum(p)), 6) AS power_db FROM rc GROUP BY 1, 2, 3")
def reassigned_spectrum(spark, d):
    s = v.sig(spark, d)
    r = S.reassigned(_chunks(s, v.SIG_CHUNK), lengths(s), v.SIG_CHUNK, FFT, HOP, -30.0)
    return r.select("recording_id", "col", "bin", r6("power_db").alias("power_db"))


@query("ultrasonic_share", ctes(SIG, NN, """ff AS (SELECT recording_id, f AS col, greatest(n // 2 - 16, 0) + f * 8 AS a FROM nn, generate_series(0, 2) g(f) WHERE greatest(n // 2 - 16, 0) + f * 8 + 8 <= n)""",
 "sp AS (SELECT f.recording_id, col, k, sum(y * (0.5 * (1 - cos(2*pi()*(idx-a)/7))) * cos(2*pi()*k*(idx-a)/8)) re, sum(y * (0.5 * (1 - cos(2*pi()*(idx-a)/7))) * sin(2*pi()*k*(idx-a)/8)) im FROM ff f JOIN sig s ON s.recording_id = f.recording_id AND idx >= a AND idx < a + 8, generate_series(0, 4) g(k) GROUP BY 1, 2, 3)",
 "sh AS (SELECT recording_id, sum(re*re+im*im) FILTER (k >= 2) / sum(re*re+im*im) AS share FROM sp GROUP BY 1)") +
 "SELECT recording_id, round(share, 6) AS share, CASE WHEN share > 0.5 THEN 'ultrasonic' WHEN share > 0.001 THEN 'possible' ELSE 'none' END AS content FROM sh")
def ultrasonic_share(spark, d):
    s = v.sig(spark, d)
    u = S.ultrasonic_share(s, lengths(s), 300_000, 8, 75_000.0)
    return u.select("recording_id", r6("share").alias("share"), "content")


# Profiles: every spectrum column on its own.
PK = """db AS (SELECT recording_id, col, bin, 20 * log10(mag) AS db FROM spec),
nb AS (SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS r FROM db WINDOW w AS (PARTITION BY recording_id, col ORDER BY bin)),
cand AS (SELECT recording_id, col, bin, db FROM nb WHERE bin BETWEEN 2 AND 62 AND db > l AND db >= r),
wall AS (SELECT c.recording_id, c.col, c.bin, c.db, coalesce(max(d.bin) FILTER (d.bin < c.bin AND d.db > c.db), 1) AS lw, coalesce(min(d.bin) FILTER (d.bin > c.bin AND d.db > c.db), 63) AS rw
  FROM cand c JOIN db d ON c.recording_id = d.recording_id AND c.col = d.col AND d.bin >= 1 GROUP BY 1, 2, 3, 4),
prom AS (SELECT w.recording_id, w.col, w.bin, w.db, w.db - greatest(least(min(d.db) FILTER (d.bin >= lw AND d.bin < w.bin), w.db), least(min(d.db) FILTER (d.bin > w.bin AND d.bin <= rw), w.db)) AS p
  FROM wall w JOIN db d ON w.recording_id = d.recording_id AND w.col = d.col AND d.bin BETWEEN lw AND rw GROUP BY 1, 2, 3, 4),
good AS (SELECT *, row_number() OVER (PARTITION BY recording_id, col ORDER BY db DESC, bin) AS rk FROM prom WHERE p >= 3),
top AS (SELECT * FROM good WHERE rk <= 8),
ed AS (SELECT t.recording_id, t.col, t.rk, t.bin, t.db, dr,
  max(d.bin) FILTER (d.bin < t.bin AND d.bin >= 1 AND d.db < t.db - dr) AS li, min(d.bin) FILTER (d.bin > t.bin AND d.db < t.db - dr) AS ri
  FROM top t JOIN db d ON t.recording_id = d.recording_id AND t.col = d.col, (VALUES (6.0::DOUBLE), (10.0::DOUBLE)) g(dr) GROUP BY 1, 2, 3, 4, 5, 6),
wd AS (SELECT e.recording_id, e.col, e.rk, e.bin, e.db, e.dr,
  CASE WHEN li IS NOT NULL AND ri IS NOT NULL THEN (li + (e.db - dr - a.db) / (b.db - a.db)) * 10 END AS lo,
  CASE WHEN li IS NOT NULL AND ri IS NOT NULL THEN (ri - 1 + (e.db - dr - c.db) / (f.db - c.db)) * 10 END AS hi
  FROM ed e LEFT JOIN db a ON a.recording_id = e.recording_id AND a.col = e.col AND a.bin = li LEFT JOIN db b ON b.recording_id = e.recording_id AND b.col = e.col AND b.bin = li + 1
  LEFT JOIN db c ON c.recording_id = e.recording_id AND c.col = e.col AND c.bin = ri - 1 LEFT JOIN db f ON f.recording_id = e.recording_id AND f.col = e.col AND f.bin = ri)"""


def _db_profiles(spark, d):
    return v.spec(spark, d).select("recording_id", "col", F.transform("mags", lambda m: 20 * F.log10(m)).alias("db"))


@query("spectral_peaks", ctes(SPEC, PK) + """SELECT recording_id, col, rk AS rank, bin, round(db, 6) AS power_db, round(max(lo) FILTER (dr = 6), 6) AS lo_6db, round(max(hi) FILTER (dr = 6), 6) AS hi_6db,
 round(max(lo) FILTER (dr = 10), 6) AS lo_10db, round(max(hi) FILTER (dr = 10), 6) AS hi_10db FROM wd GROUP BY 1, 2, 3, 4, db""")
def spectral_peaks(spark, d):
    p = P.spectral_peaks(_db_profiles(spark, d), 10.0, keys=("recording_id", "col"))
    flat = p.select("recording_id", "col", F.posexplode("peaks").alias("r", "p"))
    return flat.select(
        "recording_id", "col", (F.col("r") + 1).cast("long").alias("rank"), F.col("p.bin").cast("long").alias("bin"), r6("p.power_db").alias("power_db"),
        *[r6(f"p.{c}").alias(c) for c in ("lo_6db", "hi_6db", "lo_10db", "hi_10db")])


@query("effective_nyquist", ctes(SPEC, """dq AS (SELECT recording_id, col, bin, 20 * log10(mag) - CASE WHEN bin >= 40 + col % 8 THEN 90 ELSE 0 END AS db FROM spec)""",
 "tp AS (SELECT recording_id, col, bin // 2 AS b, max(db) AS p FROM dq WHERE bin >= 1 GROUP BY 1, 2, 3)",
 "gp AS (SELECT recording_id, col, max(p) AS g FROM tp GROUP BY 1, 2)",
 "sp AS (SELECT t.recording_id, t.col, max(b) FILTER (p > g - 50) + 1 AS s FROM tp t JOIN gp USING (recording_id, col) GROUP BY 1, 2)",
 "fl AS (SELECT t.recording_id, t.col, s, list_sort(list(p) FILTER (b < s)) AS lo, list_sort(list(p) FILTER (b >= s)) AS hi FROM tp t JOIN sp USING (recording_id, col) GROUP BY 1, 2, 3)",
 "r AS (SELECT recording_id, col, s * 2 * (100.0 / 63) AS e, lo[len(lo) // 2 + 1] AS lf, coalesce(hi[len(hi) // 2 + 1], lo[len(lo) // 2 + 1]) AS uf FROM fl)") +
 """SELECT recording_id, col, round(e, 6) AS effective_hz, round(lf, 6) AS low_floor_db, round(uf, 6) AS upper_floor_db, round(lf - uf, 6) + 0.0 AS drop_db,
 CASE WHEN least(e / 100, 1) < 0.95 AND uf < -100 THEN 'band_limited' ELSE 'full_bandwidth' END AS verdict FROM r""")
def effective_nyquist(spark, d):
    cut = _db_profiles(spark, d).withColumn("db", F.transform("db", lambda x, i: x - F.when(i >= 40 + F.col("col") % 8, 90).otherwise(0)))
    e = P.effective_nyquist(cut, 200.0, keys=("recording_id", "col"))
    return e.select("recording_id", "col", *[r6(c).alias(c) for c in ("effective_hz", "low_floor_db", "upper_floor_db", "drop_db")], "verdict")


RM = """md AS (SELECT recording_id, col, bin, mag, list_sort(list(mag) OVER (PARTITION BY recording_id, col ORDER BY bin ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) AS l FROM spec),
fl AS (SELECT recording_id, col, bin, mag, l[len(l) // 2 + 1] AS fl FROM md)"""


@query("running_median_floor", ctes(SPEC, RM) + "SELECT recording_id, col, bin, round(fl, 6) AS floor FROM fl")
def running_median_floor(spark, d):
    m = P.running_upper_median(v.spec(spark, d), "mags", 15)
    return m.select("recording_id", "col", F.posexplode("floor").alias("bin", "f")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("f").alias("floor"))


NB = """pr AS (SELECT *, CASE WHEN fl > 1e-20 THEN mag / fl ELSE 0 END AS p FROM fl),
pk AS (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r FROM pr WINDOW w AS (PARTITION BY recording_id, col ORDER BY bin)),
bd AS (SELECT k.recording_id, k.col, k.bin, k.mag, k.fl, coalesce(max(q.bin) FILTER (q.bin < k.bin AND q.p <= k.p / sqrt(2)), -1) AS lo, coalesce(min(q.bin) FILTER (q.bin > k.bin AND q.p <= k.p / sqrt(2)), 64) AS hi
  FROM pk k JOIN pr q USING (recording_id, col) WHERE k.bin BETWEEN 1 AND 62 AND k.p >= 1.7 AND k.p > k.l AND k.p >= k.r GROUP BY 1, 2, 3, 4, 5),
bands AS (SELECT recording_id, col, bin * 10.0::DOUBLE AS c, (hi - lo - 1) * 10.0::DOUBLE AS w, greatest(bin::DOUBLE / (hi - lo - 1), 5.0) AS q, 20 * log10(mag / fl) AS s,
  row_number() OVER (PARTITION BY recording_id, col ORDER BY bin) AS i FROM bd)"""


def _profiles(spark, d):
    return v.spec(spark, d).withColumnRenamed("mags", "mean")


def _band_rows(bands):
    flat = bands.select("recording_id", "col", F.inline("bands"))
    return flat.select("recording_id", "col", *[r6(c).alias(c) for c in ("center_hz", "bandwidth_hz", "q", "strength_db")])


@query("noise_bands", ctes(SPEC, RM, NB) + "SELECT recording_id, col, round(c, 6) AS center_hz, round(w, 6) AS bandwidth_hz, round(q, 6) AS q, round(s, 6) AS strength_db FROM bands")
def noise_bands(spark, d):
    return _band_rows(P.noise_bands(_profiles(spark, d), 10.0, threshold=1.7, keys=("recording_id", "col")))


@query("noise_band_merge", ctes(SPEC, RM, NB, """fold AS (SELECT recording_id, col, i, 1 AS g, c, w, q, s FROM bands WHERE i = 1 UNION ALL
 SELECT b.recording_id, b.col, b.i, CASE WHEN b.c - b.w / 2 <= f.c + f.w / 2 THEN f.g ELSE f.g + 1 END,
 CASE WHEN b.c - b.w / 2 <= f.c + f.w / 2 AND b.s <= f.s THEN f.c ELSE b.c END,
 CASE WHEN b.c - b.w / 2 <= f.c + f.w / 2 THEN greatest(f.c + f.w / 2, b.c + b.w / 2) - least(f.c - f.w / 2, b.c - b.w / 2) ELSE b.w END,
 CASE WHEN b.c - b.w / 2 <= f.c + f.w / 2 THEN greatest(CASE WHEN b.s > f.s THEN b.c ELSE f.c END / (greatest(f.c + f.w / 2, b.c + b.w / 2) - least(f.c - f.w / 2, b.c - b.w / 2)), least(f.q, b.q)) ELSE b.q END,
 CASE WHEN b.c - b.w / 2 <= f.c + f.w / 2 THEN greatest(b.s, f.s) ELSE b.s END
 FROM fold f JOIN bands b ON b.recording_id = f.recording_id AND b.col = f.col AND b.i = f.i + 1)""",
 "fin AS (SELECT *, row_number() OVER (PARTITION BY recording_id, col, g ORDER BY i DESC) AS z FROM fold)") +
 "SELECT recording_id, col, round(c, 6) AS center_hz, round(w, 6) AS bandwidth_hz, round(q, 6) AS q, round(s, 6) AS strength_db FROM fin WHERE z = 1")
def noise_band_merge(spark, d):
    return _band_rows(P.merge_bands(P.noise_bands(_profiles(spark, d), 10.0, threshold=1.7, keys=("recording_id", "col")), keys=("recording_id", "col")))


FX = """dl AS (SELECT recording_id, col, bin, mag, mag - lag(mag) OVER (PARTITION BY recording_id, bin ORDER BY col) AS dm FROM spec),
fx AS (SELECT recording_id, col, sqrt(sum(CASE WHEN dm > 0 THEN dm * dm ELSE 0 END)) AS flux FROM dl WHERE dm IS NOT NULL GROUP BY 1, 2)"""


@query("spectral_flux", ctes(SPEC, FX) + "SELECT recording_id, col, round(flux, 6) AS flux FROM fx")
def spectral_flux(spark, d):
    return C.flux(v.spec(spark, d)).select("recording_id", "col", r6("flux").alias("flux"))


FA = """pkb AS (SELECT recording_id, col, bin AS pb, row_number() OVER (PARTITION BY recording_id, col ORDER BY mag DESC, bin DESC) AS r FROM spec),
pb AS (SELECT recording_id, col, pb, lag(pb) OVER (PARTITION BY recording_id ORDER BY col) AS pp FROM pkb WHERE r = 1),
gp AS (SELECT recording_id, avg(flux) AS fm, max(flux) AS fp FROM fx GROUP BY 1),
ah AS (SELECT recording_id, col, flux, max(flux) OVER (PARTITION BY recording_id ORDER BY col ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx FROM fx),
fa AS (SELECT a.recording_id, any_value(fm) AS fm, any_value(fp) AS fp, count(*) FILTER (flux >= 0.12 * fp AND flux < 0.4 * fp AND nx > 0.4 * fp) AS pr,
 count(*) FILTER (flux >= 0.1 * fp) AS act, count(*) FILTER (flux >= 0.1 * fp AND pb = pp) AS stk FROM ah a JOIN gp USING (recording_id) JOIN pb USING (recording_id, col) GROUP BY 1)"""


@query("flux_artifacts", ctes(SPEC, FX, FA) + "SELECT recording_id, round(fm, 6) AS flux_mean, round(fp, 6) AS flux_peak, pr AS preringing, round(CASE WHEN act > 0 THEN stk / act ELSE 0 END, 6) AS staircasing FROM fa")
def flux_artifacts(spark, d):
    f = C.flux_summary(C.flux(v.spec(spark, d)))
    return f.select("recording_id", r6("flux_mean").alias("flux_mean"), r6("flux_peak").alias("flux_peak"), "preringing", r6("staircasing").alias("staircasing"))


PH = """px AS (SELECT recording_id, col, bin, re, im, lag(re) OVER w AS pr, lag(im) OVER w AS pi_ FROM cplx WINDOW w AS (PARTITION BY recording_id, bin ORDER BY col)),
pd AS (SELECT recording_id, col, bin, CASE WHEN sqrt(re*re+im*im) >= 1e-8 AND sqrt(pr*pr+pi_*pi_) >= 1e-8 THEN atan2(im*pr - re*pi_, re*pr + im*pi_) - bin * (2*pi()*32/126) END AS raw FROM px WHERE pr IS NOT NULL),
dv AS (SELECT recording_id, col, bin, raw - 2*pi()*ceil((raw - pi()) / (2*pi())) AS dev FROM pd),
co AS (SELECT recording_id, bin, coalesce(1 - least(sqrt(avg(dev*dev)) / pi(), 1), 0) AS coh, avg(coalesce(1 / (1 + abs(dev)/pi()), 0)) AS fc FROM dv GROUP BY 1, 2)"""


@query("phase_deviation", ctes(CPLX, PH) + "SELECT recording_id, col, bin, round(dev, 6) + 0.0 AS deviation FROM dv")
def phase_deviation(spark, d):
    p = C.phase_deviation(v.cplx(spark, d), 126, 32)
    return p.select("recording_id", "col", F.posexplode("deviation").alias("bin", "x")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("x").alias("deviation"))


@query("phase_coherence", ctes(CPLX, PH) + "SELECT recording_id, bin, round(coh, 6) AS coherence, round(fc, 6) AS frame_coherence FROM co")
def phase_coherence(spark, d):
    p = C.phase_coherence(C.phase_deviation(v.cplx(spark, d), 126, 32))
    return p.select("recording_id", F.col("bin").cast("long").alias("bin"), r6("coherence").alias("coherence"), r6("frame_coherence").alias("frame_coherence"))


@query("phase_angle", ctes(CPLX) + "SELECT recording_id, col, bin, round(CASE WHEN sqrt(re*re+im*im) < 1e-8 THEN 0 ELSE atan2(im, re) / pi() END, 6) + 0.0 AS angle FROM cplx")
def phase_angle(spark, d):
    p = C.phase_angle(v.cplx(spark, d))
    return p.select("recording_id", "col", F.posexplode("angle").alias("bin", "x")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("x").alias("angle"))


PREV = "pv AS (SELECT recording_id, col, bin, mag AS c, lag(mag) OVER (PARTITION BY recording_id, bin ORDER BY col) AS p FROM spec)"


def _shift_rows(spark, d, method):
    f = C.flow_shift(v.spec(spark, d), method)
    return f.select("recording_id", "col", F.posexplode("shift").alias("bin", "x")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("x").alias("shift"))


@query("flow_centroid", ctes(SPEC, PREV) + """SELECT recording_id, col, bin, round((coalesce(sum(c*c*bin) OVER w / sum(c*c) OVER w, bin) - coalesce(sum(p*p*bin) OVER w / sum(p*p) OVER w, bin)) / 3, 6) + 0.0 AS shift
 FROM pv WHERE p IS NOT NULL WINDOW w AS (PARTITION BY recording_id, col ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def flow_centroid(spark, d):
    return _shift_rows(spark, d, "centroid")


@query("flow_gradient", ctes(SPEC, PREV) + """SELECT recording_id, col, bin, round((coalesce(lead(c - p) OVER w, 0) - coalesce(lag(c - p) OVER w, 0)) / (2 * greatest(c, p, 1e-10)), 6) + 0.0 AS shift
 FROM pv WHERE p IS NOT NULL WINDOW w AS (PARTITION BY recording_id, col ORDER BY bin)""")
def flow_gradient(spark, d):
    return _shift_rows(spark, d, "gradient")


@query("flow_correlation", ctes(SPEC, PREV, "lp AS (SELECT recording_id, col, list(c ORDER BY bin) AS c, list(p ORDER BY bin) AS p FROM pv WHERE p IS NOT NULL GROUP BY 1, 2)",
 """cr AS (SELECT recording_id, col, CAST(b AS BIGINT) AS bin, d, sum(CASE WHEN i + d BETWEEN 0 AND 63 THEN c[i+1] * p[i+d+1] ELSE 0 END) AS s, sum(c[i+1]) AS e
 FROM lp, generate_series(0, 63) g(b), generate_series(-3, 3) h(d), generate_series(-3, 3) k(o), LATERAL (SELECT b + o AS i) q WHERE i BETWEEN 0 AND 63 GROUP BY 1, 2, 3, 4)""",
 "bs AS (SELECT recording_id, col, bin, arg_max(d, (s, -d)) FILTER (d BETWEEN -2 AND 2) AS bd, any_value(e) AS e FROM cr GROUP BY 1, 2, 3)",
 "rf AS (SELECT b.recording_id, b.col, b.bin, bd, any_value(b.e) AS e, max(s) FILTER (d = bd) AS c1, max(s) FILTER (d = bd - 1) AS c0, max(s) FILTER (d = bd + 1) AS c2 FROM bs b JOIN cr USING (recording_id, col, bin) GROUP BY 1, 2, 3, 4)") +
 """SELECT recording_id, col, bin, round(CASE WHEN e < 1e-8 THEN 0 WHEN abs(bd) < 2 AND abs(2*(2*c1-c0-c2)) > 1e-10 THEN (bd + (c0-c2)/(2*(2*c1-c0-c2))) / 2 ELSE bd / 2.0 END, 6) + 0.0 AS shift FROM rf""")
def flow_correlation(spark, d):
    return _shift_rows(spark, d, "correlation")


HZ = 40.0
CH = """cb AS (SELECT recording_id, col, bin, mag, CAST(round(69 + 12 * log2(bin * 40.0 / 440)) AS BIGINT) AS nt FROM spec WHERE bin >= 1),
cc AS (SELECT recording_id, col, nt % 12 AS pitch_class, nt // 12 - 1 AS octave, sum(mag * mag) AS e FROM cb WHERE nt // 12 - 1 BETWEEN 0 AND 8 GROUP BY 1, 2, 3, 4)"""


def _chroma(spark, d):
    return C.chroma(v.spec(spark, d), 64, HZ, "musical")


@query("chroma_cells", ctes(SPEC, CH) + "SELECT recording_id, col, pitch_class, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][pitch_class + 1] AS name, octave, round(e, 6) AS energy FROM cc")
def chroma_cells(spark, d):
    c = _chroma(spark, d)
    return c.select("recording_id", "col", F.col("pitch_class").cast("long").alias("pitch_class"), pitch_name(F.col("pitch_class")).alias("name"), F.col("octave").cast("long").alias("octave"), r6("energy").alias("energy"))


@query("chroma_maxima", ctes(SPEC, CH, "cl AS (SELECT recording_id, col, pitch_class, sum(e) c, max(e) m FROM cc GROUP BY 1, 2, 3)") + "SELECT recording_id, round(max(c), 6) AS max_class, round(max(m), 6) AS max_note FROM cl GROUP BY 1")
def chroma_maxima(spark, d):
    return C.chroma_maxima(_chroma(spark, d)).select("recording_id", r6("max_class").alias("max_class"), r6("max_note").alias("max_note"))


@query("chroma_rollup", ctes(SPEC, CH) + "SELECT recording_id, pitch_class, octave, round(sum(e), 6) AS energy FROM cc GROUP BY ROLLUP (recording_id, pitch_class, octave)")
def chroma_rollup(spark, d):
    c = _chroma(spark, d).select("recording_id", F.col("pitch_class").cast("long").alias("pitch_class"), F.col("octave").cast("long").alias("octave"), "energy")
    return c.rollup("recording_id", "pitch_class", "octave").agg(r6(F.sum("energy")).alias("energy"))


def _col_counts(columns):
    return columns.groupBy("recording_id").agg((F.max("col") + 1).alias("n"))


@query("lod_rollup", ctes(SPEC, "nc AS (SELECT recording_id, max(col) + 1 AS n FROM spec GROUP BY 1)") + """SELECT recording_id, col // 4 AS col, bin, round(max(mag), 6) AS mag FROM spec JOIN nc USING (recording_id) WHERE col < n // 4 * 4 GROUP BY 1, 2, 3""")
def lod_rollup(spark, d):
    s = v.spec(spark, d)
    r = C.lod_rollup(s, 4, _col_counts(s))
    return r.select("recording_id", "col", F.posexplode("mags").alias("bin", "m")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("m").alias("mag"))


@query("lod_plan", """WITH nn AS (SELECT o_custkey AS recording_id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS n FROM orders GROUP BY 1),
 lv(lod, fft, base, hop) AS (VALUES (0,1024,256,8192),(1,1024,256,2048),(2,1024,256,512),(3,512,256,128),(4,512,256,32),(5,256,256,8),(6,128,256,2),(7,64,128,1))
 SELECT recording_id, lod, fft, hop, CAST(CASE WHEN n < base THEN 0 ELSE ceil(((n - base) // hop + 1) / 256.0) END AS BIGINT) AS tiles FROM nn, lv""")
def lod_plan(spark, d):
    n = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("recording_id")).agg(F.sum(F.floor("o_totalprice")).alias("n"))
    return C.lod_plan(n, "M")


@query("overview_grid", ctes(SPEC, "sz AS (SELECT recording_id, max(col) + 1 AS w, max(mag) AS pk FROM spec GROUP BY 1)",
 "gx AS (SELECT recording_id, w, pk, x, x * w // least(w, 24) AS col, y, 63 - y * 64 // 20 AS bin FROM sz, generate_series(0, 23) g(x), generate_series(0, 19) h(y) WHERE x < least(w, 24))") +
 """SELECT g.recording_id, x, CAST(y AS INTEGER) AS y, CAST(floor(least(greatest((20*log10(mag/pk) + 80) / 80, 0), 1) * 255) AS BIGINT) AS grey FROM gx g JOIN spec s ON s.recording_id = g.recording_id AND s.col = g.col AND s.bin = g.bin""")
def overview_grid(spark, d):
    return C.overview_grid(v.spec(spark, d), 24, 20)


GT = """tp AS (SELECT recording_id, max(mag) AS mx, max(col) AS lc FROM spec GROUP BY 1)"""


@query("clean_gate", ctes(SPEC, GT) + """SELECT s.recording_id, s.col, s.bin, round(s.mag * 2 * least(greatest(g.mag / greatest(0.03 * mx, 1e-9), 0), 1), 6) AS mag
 FROM spec s JOIN tp USING (recording_id) JOIN spec g ON g.recording_id = s.recording_id AND g.bin = s.bin AND g.col = least(greatest(s.col - 1, 0), lc)""")
def clean_gate(spark, d):
    s = v.spec(spark, d)
    r = C.clean_gate(s.withColumn("mags", F.transform("mags", lambda m: m * 2)), s, 126, 32)
    return r.select("recording_id", "col", F.posexplode("mags").alias("bin", "m")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("m").alias("mag"))


@query("adaptive_blend", ctes(SPEC, GT, "td AS (SELECT recording_id, col, bin, abs(mag - coalesce(lag(mag) OVER (PARTITION BY recording_id, bin ORDER BY col), mag)) AS df FROM spec WHERE bin < 32)",
 "tm AS (SELECT recording_id, max(mag) AS tx FROM spec WHERE bin < 32 GROUP BY 1)") +
 """SELECT s.recording_id, s.col, s.bin, round(1 / (1 + 80 * df / tx) * s.mag + (1 - 1 / (1 + 80 * df / tx)) * s.mag * 0.5, 6) AS mag FROM spec s JOIN tp USING (recording_id) JOIN tm USING (recording_id)
 JOIN td t ON t.recording_id = s.recording_id AND t.bin = least(round(s.bin * (62.0 / 126)), 31) AND t.col = least(greatest(s.col, 0), lc)""")
def adaptive_blend(spark, d):
    s = v.spec(spark, d)
    fast = s.withColumn("mags", F.transform("mags", lambda m: m * 0.5))
    tonal = s.withColumn("mags", F.slice("mags", 1, 32))
    r = C.adaptive_blend(s, fast, tonal, 126, 62, 32)
    return r.select("recording_id", "col", F.posexplode("mags").alias("bin", "m")).select("recording_id", "col", F.col("bin").cast("long").alias("bin"), r6("m").alias("mag"))


@query("nearest_columns", """WITH a AS (SELECT user_id AS recording_id, epoch_us(ts) / 1e6 AS t, event_id AS col FROM events WHERE event_type = 'click'),
 b AS (SELECT user_id AS recording_id, epoch_us(ts) / 1e6 AS t, event_id AS col FROM events WHERE event_type <> 'click'),
 j AS (SELECT a.recording_id, a.col, b.col AS nearest, row_number() OVER (PARTITION BY a.recording_id, a.col ORDER BY abs(b.t - a.t), b.t) AS r FROM a JOIN b USING (recording_id))
 SELECT recording_id, col, nearest FROM j WHERE r = 1""")
def nearest_columns(spark, d):
    ev = v.table(spark, d, "events").select(
        F.col("user_id").alias("recording_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("col"), "event_type")
    click = F.col("event_type") == "click"
    return C.nearest_columns(ev.where(click).drop("event_type"), ev.where(~click).drop("event_type"), 86_400.0)


FUSED = ("near AS (SELECT a.recording_id, a.col, b.col AS nearest, row_number() OVER (PARTITION BY a.recording_id, a.col ORDER BY abs(b.col * 2.0 + 1.5 - a.col * 2.0), b.col) AS r "
         "FROM (SELECT DISTINCT recording_id, col FROM spec) a JOIN (SELECT DISTINCT recording_id, col FROM spec WHERE col % 3 = 0) b USING (recording_id))")


@query("fused_spectra", ctes(SPEC, FUSED) + """SELECT a.recording_id, a.col, a.bin, round(sqrt(a.mag * b.mag), 6) AS mag, round(least(a.mag, b.mag), 6) AS least_mag FROM spec a JOIN near n ON n.recording_id = a.recording_id AND n.col = a.col AND r = 1
 JOIN spec b ON b.recording_id = a.recording_id AND b.col = n.nearest AND b.bin = least(round(a.bin * (62.0 / 126)), 31)""")
def fused_spectra(spark, d):
    s = v.spec(spark, d)
    left = s.withColumn("t", F.col("col") * 2.0)
    right = s.where("col % 3 = 0").select("recording_id", "col", (F.col("col") * 2.0 + 1.5).alias("t"), F.slice("mags", 1, 32).alias("mags"))
    both = C.resample_to(left, right, 62 / 126, 512.0).where("other IS NOT NULL")
    mean, least = F.zip_with("mags", "other", C.geometric_mean), F.zip_with("mags", "other", lambda x, y: F.least(x, y))
    return both.select("recording_id", "col", F.posexplode(F.arrays_zip(mean.alias("m"), least.alias("l"))).alias("bin", "x")).select(
        "recording_id", "col", F.col("bin").cast("long").alias("bin"), r6(F.col("x.m")).alias("mag"), r6(F.col("x.l")).alias("least_mag"))


@query("band_gains", ctes(SPEC, "mm AS (SELECT recording_id, bin, avg(mag) AS m FROM spec GROUP BY 1, 2)",
 "gr AS (SELECT recording_id, bin, bin * (320.0 / 32) AS f FROM (SELECT DISTINCT recording_id FROM spec), generate_series(0, 32) g(bin))",
 "nt AS (SELECT CAST(s AS INTEGER) AS recording_id, 50.0 + s * 7 AS c, 25.0 AS w, 12.0 + s AS st FROM generate_series(0, 9) g(s))",
 "cu AS (SELECT g.recording_id, g.bin, sum(CASE WHEN m = 1 THEN st ELSE st * 0.5 END) AS x FROM gr g JOIN nt USING (recording_id), generate_series(1, 3) k(m) WHERE abs(f - c * m) <= w / 2 * m GROUP BY 1, 2)",
 "q AS (SELECT g.recording_id, g.bin, CASE WHEN f < 60 THEN -20 WHEN f <= 100 THEN 3 WHEN f >= 120 AND f <= 200 THEN -3 ELSE -30 END AS eq, 20 * log10(m) * 0.8 AS fd FROM gr g JOIN mm ON mm.recording_id = g.recording_id AND mm.bin = round(f / 320 * 63))") +
 "SELECT recording_id, CAST(bin AS INTEGER) AS bin, round(eq - coalesce(x, 0) - fd, 6) AS gain_db FROM q LEFT JOIN cu USING (recording_id, bin)")
def band_gains(spark, d):
    floors = P.bin_means(v.spec(spark, d))
    i = F.col("recording_id")
    notches = floors.select("recording_id").distinct().select(
        "recording_id", (50.0 + i * 7).alias("center_hz"), F.lit(25.0).alias("bandwidth_hz"), (12.0 + i).alias("strength_db"))
    eq = {"below": -20.0, "selected": 3.0, "harmonics": -3.0, "above": -30.0}
    g = C.band_gains(floors, 33, 320.0, 60.0, 100.0, eq, 4, notches, 0.5, 0.8)
    return g.select("recording_id", "bin", r6("gain_db").alias("gain_db"))


TQ = """rk AS (SELECT recording_id, col, bin AS k, mag AS best, row_number() OVER (PARTITION BY recording_id, col ORDER BY mag DESC, bin) AS r FROM spec WHERE bin BETWEEN 1 AND 62),
k1 AS (SELECT * FROM rk WHERE r = 1),
nb AS (SELECT k.recording_id, k.col, k.k, k.best, max(mag) FILTER (bin = k - 1) AS m0, max(mag) FILTER (bin = k + 1) AS m2,
  min(bin) FILTER (bin > k AND mag * mag <= best * best * 0.5) AS ro, max(bin) FILTER (bin < k AND mag * mag <= best * best * 0.5) AS lo,
  sum(mag * mag) AS sw, sum(mag * mag * bin) AS sf FROM k1 k JOIN spec s USING (recording_id, col) GROUP BY 1, 2, 3, 4),
n2 AS (SELECT n.recording_id, n.col, k, best, m0, m2, ro, lo, sqrt(sum(mag * mag * (bin - sf / sw) ** 2) / max(sw)) AS sp FROM nb n JOIN spec USING (recording_id, col) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
n3 AS (SELECT n.*, CASE WHEN ro IS NULL THEN 63 - k ELSE ro - 1 - k + (a.mag * a.mag - best * best * 0.5) / (a.mag * a.mag - b.mag * b.mag) END AS rw,
  CASE WHEN lo IS NULL THEN k ELSE k - lo - 1 + (c.mag * c.mag - best * best * 0.5) / (c.mag * c.mag - e.mag * e.mag) END AS lw
  FROM n2 n LEFT JOIN spec a ON a.recording_id = n.recording_id AND a.col = n.col AND a.bin = ro - 1 LEFT JOIN spec b ON b.recording_id = n.recording_id AND b.col = n.col AND b.bin = ro
  LEFT JOIN spec c ON c.recording_id = n.recording_id AND c.col = n.col AND c.bin = lo + 1 LEFT JOIN spec e ON e.recording_id = n.recording_id AND e.col = n.col AND e.bin = lo)"""


@query("spectrum_sharpness", ctes(SPEC, TQ) + """SELECT recording_id, round(sqrt(avg(((k + CASE WHEN abs(m0 - 2 * best + m2) > 1e-12 THEN least(greatest(0.5 * (m0 - m2) / (m0 - 2 * best + m2), -0.5), 0.5) ELSE 0 END) * 10 - 300) ** 2)), 6) AS ridge_rms_hz,
 round(avg(rw + lw) * 10, 6) AS width_3db_hz, round(avg(sp) * 10, 6) AS spread_hz FROM n3 GROUP BY 1""")
def spectrum_sharpness(spark, d):
    q = C.column_quality(v.spec(spark, d), 10.0, F.lit(300.0))
    return q.select("recording_id", *[r6(c).alias(c) for c in ("ridge_rms_hz", "width_3db_hz", "spread_hz")])


@query("time_spread", ctes(SPEC, "bs AS (SELECT recording_id, bin, min(mag) AS b FROM spec GROUP BY 1, 2)",
 "en AS (SELECT recording_id, col, sum(mag * mag) AS e, sum((mag - b) ** 2) AS x, col * 0.01::DOUBLE AS t FROM spec JOIN bs USING (recording_id, bin) WHERE bin >= 10 AND bin < 40 GROUP BY 1, 2)",
 "ce AS (SELECT recording_id, sum(e * t) / sum(e) AS me, sum(x * t) / sum(x) AS mx FROM en GROUP BY 1)") +
 "SELECT recording_id, round(sqrt(sum(e * (t - me) ** 2) / sum(e)) * 1000, 6) AS spread_ms, round(sqrt(sum(x * (t - mx) ** 2) / sum(x)) * 1000, 6) AS transient_ms FROM en JOIN ce USING (recording_id) GROUP BY 1")
def time_spread(spark, d):
    s = v.spec(spark, d).withColumn("t", F.col("col") * 0.01)
    a = C.time_spread(s, 10, 40)
    b = C.time_spread(s, 10, 40, transient=True).withColumnRenamed("spread_ms", "transient_ms")
    return a.join(b, "recording_id").select("recording_id", r6("spread_ms").alias("spread_ms"), r6("transient_ms").alias("transient_ms"))


HP = """mm AS (SELECT recording_id, bin, avg(mag) AS m FROM spec GROUP BY 1, 2),
ht AS (SELECT a.recording_id, a.bin AS k, a.m * b.m * c.m * d.m AS v FROM mm a JOIN mm b ON b.recording_id = a.recording_id AND b.bin = a.bin * 2 JOIN mm c ON c.recording_id = a.recording_id AND c.bin = a.bin * 3
  JOIN mm d ON d.recording_id = a.recording_id AND d.bin = least(a.bin * 4, 63) WHERE a.bin BETWEEN 1 AND 15),
f0 AS (SELECT recording_id, arg_max(k, (v, k)) AS f FROM ht GROUP BY 1)"""
HD = """ha AS (SELECT f.recording_id, f, h, max(m) AS a FROM f0 f JOIN generate_series(1, 8) g(h) ON f * h < 64 JOIN mm ON mm.recording_id = f.recording_id AND mm.bin BETWEEN f * h - 1 AND f * h + 1 GROUP BY 1, 2, 3),
hn AS (SELECT recording_id, f, h, a / max(a) FILTER (h = 1) OVER (PARTITION BY recording_id) AS a FROM ha),
hl AS (SELECT *, lag(a) OVER (PARTITION BY recording_id ORDER BY h) AS pa FROM hn),
hd AS (SELECT recording_id, any_value(f) AS f, count(*) AS k, coalesce(sum(-ln(a) * ln(h)) FILTER (h > 1) / sum(ln(h) ** 2) FILTER (h > 1), 1) AS alpha,
 coalesce(string_agg(CAST(h - 1 AS VARCHAR), ',' ORDER BY h) FILTER (h > 1 AND a >= 0.95 * pa), '') AS an FROM hl GROUP BY 1)"""


def _fundamentals(spark, d):
    return P.fundamental(P.gather(P.bin_means(v.spec(spark, d)), "mean_mag", "mean"))


@query("fundamental_frequency", ctes(SPEC, HP) + "SELECT recording_id, f AS f_bin FROM f0")
def fundamental_frequency(spark, d):
    return _fundamentals(spark, d).select("recording_id", F.col("f_bin").cast("long").alias("f_bin"))


@query("harmonic_decay", ctes(SPEC, HP, HD) + "SELECT recording_id, f AS f_bin, k AS harmonics, round(alpha, 6) AS decay_exponent, an AS anomalies, an = '' AS monotonic FROM hd")
def harmonic_decay(spark, d):
    h = P.harmonic_decay(_fundamentals(spark, d), 10.0, 1e9)
    return h.select("recording_id", F.col("f_bin").cast("long").alias("f_bin"), F.size("harmonics").cast("long").alias("harmonics"), r6("decay_exponent").alias("decay_exponent"),
                    F.array_join(F.col("anomalies").cast("array<string>"), ",").alias("anomalies"), "monotonic")


@query("artifact_indicators", ctes(SPEC, CPLX, FX, FA, PH, HP, HD,
 "cm AS (SELECT recording_id, sum(coh) / greatest(count(*) FILTER (coh > 0), 1) AS cm, avg(coh) AS ca FROM co GROUP BY 1)",
 "cr AS (SELECT c.recording_id, avg(coh) / any_value(ca) AS cr FROM co c JOIN f0 USING (recording_id) JOIN cm USING (recording_id) JOIN generate_series(1, 5) g(h) ON c.bin = f * h GROUP BY 1)",
 "an AS (SELECT recording_id, string_agg('h' || h || '_anomaly', ',' ORDER BY h) FILTER (h > 1 AND a >= 0.95 * pa) AS a FROM hl GROUP BY 1)",
 "fin AS (SELECT recording_id, cm, least(greatest(cr, 0), 2) AS cr, concat_ws(',', CASE WHEN cm < 0.35 THEN 'low_phase_coherence' WHEN cm < 0.55 THEN 'moderate_phase_drift' END, CASE WHEN cr < 0.7 THEN 'harmonics_less_coherent' END, a, CASE WHEN pr > 0 THEN 'preringing' END, CASE WHEN stk / act > 0.5 THEN 'staircasing' END) AS ind FROM cm JOIN cr USING (recording_id) JOIN an USING (recording_id) JOIN fa USING (recording_id))") +
 "SELECT recording_id, round(cm, 6) AS coherence_mean, round(cr, 6) AS coherence_ratio, CASE WHEN ind = '' THEN 'none' ELSE ind END AS indicators FROM fin")
def artifact_indicators(spark, d):
    cols = v.spec(spark, d)
    coh = P.gather(C.phase_coherence(C.phase_deviation(v.cplx(spark, d), 126, 32)), "coherence", "coherence")
    rows = P.harmonic_decay(_fundamentals(spark, d), 10.0, 1e9).join(coh, "recording_id")
    rows = P.coherence_ratio(rows).join(C.flux_summary(C.flux(cols)), "recording_id")
    out = P.artifact_indicators(rows)
    return out.select("recording_id", r6("coherence_mean").alias("coherence_mean"), r6("coherence_ratio").alias("coherence_ratio"), F.array_join("indicators", ",").alias("indicators"))
