"""Queries over sample bits and recorder fingerprints."""

from pyspark.sql import functions as F

from echolake.functions.levels import r6
from echolake.operators import bits as B
from echolake.plans.chunking import lengths
from echolake.plans.registry import INTS, SIG, ctes, query
from echolake.sources import vehicles as v

BITS, RATE, WIN = 16, 100, 512

# Variants of the vehicle: recording 0 zero-padded, 1 with a silent stretch, 2 with a fixed low nibble, 3 with stride 48.
SHAPED = """shaped AS (SELECT recording_id, idx, CASE WHEN recording_id = 0 THEN (v // 16) * 16 WHEN recording_id = 1 AND idx BETWEEN 1024 AND 2600 THEN 0
  WHEN recording_id = 2 THEN (v // 16) * 16 + 5 WHEN recording_id = 3 THEN (v // 48) * 48 ELSE v END AS v FROM ints)"""


def shaped(spark, d):
    r, x, i = F.col("recording_id"), F.col("v"), F.col("idx")
    # Whole division truncates towards zero on both engines.
    shaped = (
        F.when(r == 0, F.expr("(v div 16) * 16")).when((r == 1) & i.between(1024, 2600), F.lit(0).cast("long"))
        .when(r == 2, F.expr("(v div 16) * 16 + 5")).when(r == 3, F.expr("(v div 48) * 48")).otherwise(x)
    )
    return v.ints(spark, d).withColumn("v", shaped)


SHAPED = SHAPED.replace("(v // 16) * 16", "CAST(trunc(v / 16) AS BIGINT) * 16").replace("(v // 48) * 48", "CAST(trunc(v / 48) AS BIGINT) * 48")
BT = """bt AS (SELECT recording_id, b AS bit, count(*) AS total, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives, count(*) FILTER (v > 0) AS positives,
  count(*) FILTER (((v & 65535) >> (15 - b)) & 1 = 1) AS count, count(*) FILTER (((v & 65535) >> (15 - b)) & 1 = 1 AND v >= 0) AS pos_count, count(*) FILTER (((v & 65535) >> (15 - b)) & 1 = 1 AND v < 0) AS neg_count,
  min(idx) FILTER (((v & 65535) >> (15 - b)) & 1 = 1) AS first_index, max(idx) FILTER (((v & 65535) >> (15 - b)) & 1 = 1) AS last_index FROM shaped, (SELECT CAST(unnest(range(16)) AS INTEGER) AS b) g GROUP BY 1, 2)"""


@query("bit_usage", ctes(INTS, SHAPED, BT) + "SELECT recording_id, bit, total, zeros, negatives, positives, count, pos_count, neg_count, first_index, last_index FROM bt")
def bit_usage(spark, d):
    return B.bit_table(shaped(spark, d), BITS)


@query("float_bit_usage", None)
def float_bit_usage(spark, d):
    return B.bit_table(B.float_bits(v.sig(spark, d)), 32, is_float=True)


@query("float_bit_summary", None)
def float_bit_summary(spark, d):
    s = B.bit_summary(B.bit_table(B.float_bits(v.sig(spark, d)), 32, is_float=True), 32, is_float=True)
    return s.withColumn("fractional_bits", r6("fractional_bits"))


@query("bit_pairs", ctes(INTS, SHAPED, """bp AS (SELECT recording_id, p AS pair, CAST(((v & 65535) >> (14 - 2 * p)) & 3 AS INTEGER) AS combo FROM shaped, (SELECT CAST(unnest(range(8)) AS INTEGER) AS p) g)""",
 "al AS (SELECT DISTINCT recording_id, p AS pair, c AS combo FROM ints, (SELECT CAST(unnest(range(8)) AS INTEGER) AS p) g, (SELECT CAST(unnest(range(4)) AS INTEGER) AS c) h)",
 "ct AS (SELECT recording_id, pair, combo, count(*) AS n FROM bp GROUP BY 1, 2, 3)") + "SELECT recording_id, pair, combo, coalesce(n, 0) AS count FROM al LEFT JOIN ct USING (recording_id, pair, combo)")
def bit_pairs(spark, d):
    return B.bit_pairs(shaped(spark, d), BITS)


BS = """bs AS (SELECT recording_id, any_value(total) AS total, any_value(positives) AS positives, any_value(negatives) AS negatives, any_value(zeros) AS zeros, max(bit) FILTER (count > 0) + 1 AS effective_bits,
  sum(CASE WHEN count IN (0, total) THEN 0 ELSE -(count/total) * log2(count/total) - (1 - count/total) * log2(1 - count/total) END) AS fb,
  coalesce(min(bit) FILTER (bit >= 1 AND NOT ((positives = 0 OR pos_count = 0) AND (negatives = 0 OR neg_count = negatives))), 16) - 1 AS headroom_bits FROM bt GROUP BY 1)"""


@query("bit_summary", ctes(INTS, SHAPED, BT, BS) + """SELECT recording_id, total, positives, negatives, zeros, effective_bits, round(least(fb, 16), 6) AS fractional_bits, headroom_bits,
 CASE WHEN effective_bits < 16 THEN effective_bits || '-bit recording stored as 16-bit' ELSE '16-bit' END AS summary FROM bs""")
def bit_summary(spark, d):
    return B.bit_summary(B.bit_table(shaped(spark, d), BITS), BITS).withColumn("fractional_bits", r6("fractional_bits"))


@query("bit_cautions", ctes(INTS, SHAPED, BT, BS) + """SELECT b.recording_id, bit, CASE WHEN bit = 0 THEN 'sign' ELSE 'B' || (15 - bit) END AS label, count,
 CASE WHEN count = 0 THEN '' ELSE concat_ws(',', CASE WHEN bit = 0 AND b.positives + b.negatives >= 5000 AND abs(b.negatives / (b.positives + b.negatives) - 0.5) > 0.15 THEN 'sign_bit_skewed' END,
 CASE WHEN count = b.total THEN 'always_one' END, CASE WHEN b.total >= 300 AND first_index < 100 AND last_index >= b.total - 100 AND last_index - first_index < 200 AND count < 200 AND count < b.total // 2 THEN 'only_in_fade' END,
 CASE WHEN count <= greatest(b.total // CASE WHEN bit = 0 THEN 1000 ELSE 10000 END, 1) AND b.total > 1000 THEN 'very_low_usage' END) END AS cautions, bit < effective_bits AS expected_used
 FROM bt b JOIN bs USING (recording_id)""")
def bit_cautions(spark, d):
    t = B.bit_table(shaped(spark, d), BITS)
    return B.bit_cautions(t, B.bit_summary(t, BITS), BITS, RATE).withColumn("cautions", F.array_join("cautions", ","))


@query("value_coverage", ctes(INTS) + "SELECT recording_id, count(DISTINCT v) AS unique_count, round(count(DISTINCT v) * 100.0::DOUBLE / 65536, 6) AS coverage_pct, round(log2(count(DISTINCT v)), 6) AS resolution_bits FROM ints GROUP BY 1")
def value_coverage(spark, d):
    return B.value_coverage(v.ints(spark, d), BITS).select("recording_id", "unique_count", r6("coverage_pct").alias("coverage_pct"), r6("resolution_bits").alias("resolution_bits"))


GCD = """gc AS (SELECT recording_id, CAST(list_reduce(list(DISTINCT abs(v)), lambda a, b: gcd(a, b)) AS BIGINT) AS gcd FROM shaped WHERE v <> 0 GROUP BY 1),
g2 AS (SELECT recording_id, gcd, CASE WHEN gcd >= 2 AND bit_count(gcd) = 1 THEN CAST(log2(gcd) AS INTEGER) END AS padding_bits FROM gc)"""


@query("stride_gcd", ctes(INTS, SHAPED, GCD) + "SELECT recording_id, gcd, padding_bits FROM g2")
def stride_gcd(spark, d):
    return B.stride_gcd(shaped(spark, d), BITS)


QW = """nn AS (SELECT recording_id, count(*) AS n FROM shaped GROUP BY 1),
qw AS (SELECT s.recording_id, (idx - least(512, n // 8)) // 512 AS w, count(*) AS m, stddev_pop(v) AS sd, min(idx) AS a FROM shaped s JOIN nn USING (recording_id) WHERE n >= 1024 AND idx >= least(512, n // 8) GROUP BY 1, 2),
qu AS (SELECT recording_id, arg_min(a, (sd, a)) AS a, min(sd) AS sd FROM qw WHERE m = 512 GROUP BY 1)"""
LB = """lb AS (SELECT s.recording_id, idx - a AS i, v & 15 AS lo, CAST(xor(v & 15, 8) - 8 AS DOUBLE) AS x FROM shaped s JOIN qu q ON q.recording_id = s.recording_id AND idx >= a AND idx < a + 512),
hs AS (SELECT recording_id, lo, count(*) AS c FROM lb GROUP BY 1, 2),
ch AS (SELECT recording_id, sum((c - 32.0) ** 2 / 32.0) + (16 - count(*)) * 32.0 AS chi2 FROM hs GROUP BY 1),
mo AS (SELECT recording_id, avg(x) AS mu, var_pop(x) AS va, count(*) FILTER (lo <> 0) / 512.0 AS nz FROM lb GROUP BY 1),
ac AS (SELECT a.recording_id, CASE WHEN any_value(va) = 0 THEN 0 ELSE sum((a.x - mu) * (b.x - mu)) / (511 * any_value(va)) END AS acf1 FROM lb a JOIN lb b ON a.recording_id = b.recording_id AND b.i = a.i + 1 JOIN mo ON mo.recording_id = a.recording_id GROUP BY 1),
pe AS (SELECT a.recording_id, b.i - a.i AS p, avg(CASE WHEN a.lo = b.lo THEN 1.0 ELSE 0.0 END) AS r FROM lb a JOIN lb b ON a.recording_id = b.recording_id AND b.i - a.i BETWEEN 1 AND 256 GROUP BY 1, 2),
pm AS (SELECT recording_id, CAST(min(p) FILTER (r >= 0.99) AS INTEGER) AS period, coalesce(arg_min(r, p) FILTER (r >= 0.99), max(r)) AS pmatch FROM pe GROUP BY 1),
ls AS (SELECT recording_id, chi2, nz, acf1, 0.0::DOUBLE AS acf256, period, pmatch FROM ch JOIN mo USING (recording_id) JOIN ac USING (recording_id) JOIN pm USING (recording_id))"""


@query("quietest_window", ctes(INTS, SHAPED, QW) + "SELECT recording_id, a AS start_idx, round(sd, 6) AS sd FROM qu")
def quietest_window(spark, d):
    s = shaped(spark, d)
    return B.quietest_window(s, lengths(s), WIN).select("recording_id", "start_idx", r6("sd").alias("sd"))


def _low(spark, d):
    s = shaped(spark, d)
    q = B.quietest_window(s, lengths(s), WIN)
    return s, q, B.low_bit_structure(s, q, 4, WIN)


@query("low_bit_structure", ctes(INTS, SHAPED, QW, LB) + "SELECT recording_id, round(chi2, 6) AS chi2, round(nz, 6) AS nonzero_frac, round(acf1, 6) + 0.0 AS acf1, acf256, period, round(pmatch, 6) AS period_match FROM ls")
def low_bit_structure(spark, d):
    low = _low(spark, d)[2]
    return low.select("recording_id", r6("chi2").alias("chi2"), r6("nonzero_frac").alias("nonzero_frac"), r6("acf1").alias("acf1"), r6("acf256").alias("acf256"), "period", r6("period_match").alias("period_match"))


LV = """lv AS (SELECT g.recording_id, CASE WHEN sd IS NULL THEN 'not_applicable' WHEN padding_bits IS NOT NULL THEN 'zero_padded' WHEN period = 1 AND pmatch >= 0.999 AND sd < 0.5 AND nz < 0.01 THEN 'quiet_section_zero_padded'
 WHEN chi2 > 200 OR abs(acf1) > 0.05 OR abs(acf256) > 0.05 THEN 'dsp_padded' WHEN sd > 16 THEN 'inconclusive' ELSE 'consistent' END AS verdict, padding_bits FROM g2 g LEFT JOIN qu USING (recording_id) LEFT JOIN ls USING (recording_id))"""


def lsb_rows(spark, d):
    s, q, low = _low(spark, d)
    return B.lsb_verdict(B.stride_gcd(s, BITS), q, low, BITS)


@query("lsb_verdict", ctes(INTS, SHAPED, GCD, QW, LB, LV) + "SELECT recording_id, verdict, CASE WHEN verdict = 'zero_padded' THEN 16 - padding_bits WHEN verdict IN ('quiet_section_zero_padded', 'dsp_padded') THEN 12 END AS effective_bits FROM lv")
def lsb_verdict(spark, d):
    return lsb_rows(spark, d).select("recording_id", "verdict", "effective_bits")
