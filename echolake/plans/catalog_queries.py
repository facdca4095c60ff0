"""Queries over catalogues, books, identities, metadata texts and provenance."""

from pyspark.sql import functions as F

from echolake.functions import levels, text
from echolake.functions.levels import r6
from echolake.operators import catalog as K
from echolake.operators import provenance
from echolake.plans.registry import CAT, IDENT, KV, SIG, SPEC, ctes, query
from echolake.session import scratch_path
from echolake.sources import vehicles as v


@query("metadata_pairs", ctes(KV, "ln AS (SELECT id, i - 1 AS line_no, trim(l[i]) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM kv), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) g)") +
 "SELECT id, CAST(line_no AS INTEGER) AS line_no, trim(line[1:strpos(line, ':') - 1]) AS key, trim(line[strpos(line, ':') + 1:]) AS value FROM ln WHERE strpos(line, ':') > 0")
def metadata_pairs(spark, d):
    return K.metadata_pairs(v.metadata_text(spark, d))


@query("metadata_categories", ctes(KV, "ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM kv)", "ky AS (SELECT id, line[1:strpos(line, ':') - 1] AS k FROM ln WHERE strpos(line, ':') > 0)") +
 "SELECT id, k AS key, CASE WHEN k = 'Source|Name' THEN 'Source' ELSE 'standard' END AS section, CASE WHEN k = 'Source|Name' THEN 'Name' ELSE k END AS name FROM ky")
def metadata_categories(spark, d):
    k = K.metadata_pairs(v.metadata_text(spark, d)).withColumn("c", text.key_category("key"))
    return k.select("id", "key", F.col("c.section").alias("section"), F.col("c.name").alias("name"))


@query("embedded_json", "SELECT event_id AS id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events")
def embedded_json(spark, d):
    noisy = v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("note: "), "props", F.lit(" end }")).alias("t"))
    return noisy.select("id", F.get_json_object(text.embedded_json("t"), "$.k").cast("long").alias("k"))


@query("timestamp_offsets", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN (event_id % 15) * 60 + event_id % 60 WHEN event_id % 5 = 2 THEN -((event_id % 15) * 60 + event_id % 60) WHEN event_id % 5 = 3 THEN NULL ELSE (event_id % 15) * 60 END AS minutes FROM events")
def timestamp_offsets(spark, d):
    e = F.col("event_id")
    base = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    h, m = F.lpad((e % 15).cast("string"), 2, "0"), F.lpad((e % 60).cast("string"), 2, "0")
    stamp = (
        F.when(e % 5 == 0, F.concat(base, F.lit("Z"))).when(e % 5 == 1, F.concat(base, F.lit("+"), h, F.lit(":"), m))
        .when(e % 5 == 2, F.concat(base, F.lit("-"), h, m)).when(e % 5 == 3, F.substring(base, 1, 10)).otherwise(F.concat(base, F.lit("+"), h))
    )
    return v.table(spark, d, "events").select(e.alias("id"), text.utc_offset_minutes(stamp).cast("long").alias("minutes"))


@query("dates_in_names", "SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso FROM events")
def dates_in_names(spark, d):
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    name = F.concat(F.lit("PRE_"), F.when(e % 4 == 0, F.date_format(ts, "yyyyMMdd_HHmmss")).when(e % 4 == 1, F.date_format(ts, "yyyyMMddHHmmss"))
                    .when(e % 4 == 2, F.date_format(ts, "yyyyMMdd")).otherwise(F.concat(F.lit("99"), F.date_format(ts, "yyyyMMdd"))), F.lit(".wav"))
    return v.table(spark, d, "events").select(e.alias("id"), text.date_in_name(name).alias("iso"))


@query("recording_starts", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CAST(epoch_ms(date_trunc('second', ts)) AS DOUBLE) ELSE CAST(epoch_us(ts) // 1000 AS DOUBLE) - round(value) * 1000 END AS epoch_ms, CASE WHEN event_id % 3 = 0 THEN 'metadata' ELSE 'file_modified' END AS source FROM events")
def recording_starts(spark, d):
    ts = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("bad")
    s = text.recording_start(stamp, ts, F.round("value"))
    return v.table(spark, d, "events").select(F.col("event_id").alias("id"), s["epoch_ms"].alias("epoch_ms"), s["source"].alias("source"))


@query("metadata_values", """SELECT event_id AS id, CASE WHEN value <= 90 THEN value END AS lat, CASE WHEN value <= 90 THEN -value / 2 END AS lon, CASE WHEN event_id % 2 = 0 THEN value END AS temp_c,
 CASE event_id % 3 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN 120.0 + user_id ELSE 3600.0 + 120 + user_id END AS seconds, event_id AS number,
 CASE event_id % 3 WHEN 0 THEN 'CC BY-NC-SA 4.0' WHEN 1 THEN 'cc0' END AS licence FROM events""")
def metadata_values(spark, d):
    e, x, u = F.col("event_id"), F.col("value").cast("string"), F.col("user_id").cast("string")
    pos = F.concat(x, F.when(e % 2 == 0, ", ").otherwise(" "), (-F.col("value") / 2).cast("string"))
    temp = F.concat(x, F.when(e % 2 == 0, " °C").otherwise("F"))
    clock = F.when(e % 3 == 0, u).when(e % 3 == 1, F.concat(F.lit("2:"), u)).otherwise(F.concat(F.lit("1:2:"), u))
    num = F.when(e % 3 == 0, e.cast("string")).when(e % 3 == 1, F.concat(F.lit("XC"), e)).otherwise(F.concat(F.lit("https://archive.example/"), e, F.lit("/")))
    lic = F.when(e % 3 == 0, "//creativecommons.org/licenses/by-nc-sa/4.0/").when(e % 3 == 1, "cc0").otherwise("all rights reserved")
    ll = text.lat_lon(pos)
    return v.table(spark, d, "events").select(
        e.alias("id"), ll["lat"].alias("lat"), ll["lon"].alias("lon"), text.temperature_c(temp).alias("temp_c"), text.clock_seconds(clock).alias("seconds"),
        text.catalogue_number(num).alias("number"), text.licence_label(lic).alias("licence"),
    )


@query("file_name_parts", r"""SELECT page_id AS id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS safe, CASE WHEN url LIKE '%.%' THEN regexp_extract(url, '(?s)^(.*)\.[^.]*$', 1) ELSE url END AS stem,
 list_last(string_split(url, '.')) AS ext, concat(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), '_', length(html)) AS key FROM pages""")
def file_name_parts(spark, d):
    url = F.col("url")
    return v.table(spark, d, "pages").select(
        F.col("page_id").alias("id"), text.sanitize(url).alias("safe"), text.stem(url).alias("stem"), text.extension(url).alias("ext"),
        text.storage_key(url, F.length("html"), F.lit(None).cast("string")).alias("key"),
    )


@query("duration_labels", """WITH s AS (SELECT event_id AS id, value * 20.25 AS s FROM events)
 SELECT id, CASE WHEN s < 90 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm%02ds', CAST(round(s) AS BIGINT) // 60, CAST(round(s) AS BIGINT) % 60)
 ELSE printf('%dh%02dm%02ds', CAST(round(s) AS BIGINT) // 3600, CAST(round(s) AS BIGINT) % 3600 // 60, CAST(round(s) AS BIGINT) % 60) END AS label FROM s""")
def duration_labels(spark, d):
    s = v.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") * 20.25).alias("s"))
    return s.select("id", text.compact_duration("s").alias("label"))


@query("frequency_labels", """WITH f AS (SELECT p_partkey AS id, p_size * 1000.0::DOUBLE AS lo, p_retailprice * 37 AS hi FROM part)
 SELECT id, concat(CAST(CAST(round(lo / 1000) AS BIGINT) AS VARCHAR), '–', CASE WHEN abs(hi / 1000 - round(hi / 1000)) < 0.05 THEN CAST(CAST(round(hi / 1000) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', hi / 1000) END, ' kHz') AS label FROM f""")
def frequency_labels(spark, d):
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.frequency_range(F.col("p_size") * 1000.0, F.col("p_retailprice") * 37).alias("label"))


@query("level_scalars", ctes(SIG) + """SELECT recording_id, idx, CASE WHEN abs(y) < 1e-20 THEN -120.0 ELSE round(20 * log10(greatest(abs(y), 1e-20)), 6) END AS amp_db, round(10 ** (y / 20), 6) AS gain,
 CAST(floor(least(greatest((20 * log10(greatest(abs(y), 1e-9)) + 80) / 80, 0), 1) * 255) AS BIGINT) AS grey, round(69 + 12 * log2((abs(y) + 1) * 1000 / 440), 6) AS note,
 round(atan2(sin(y * 40), cos(y * 40)), 6) + 0.0 AS phase FROM sig""")
def level_scalars(spark, d):
    y = F.col("y")
    return v.sig(spark, d).select(
        "recording_id", "idx", r6(levels.amplitude_db(y)).alias("amp_db"), r6(levels.gain_factor(y)).alias("gain"),
        levels.grey_level(F.greatest(F.abs(y), F.lit(1e-9)), F.lit(1.0)).alias("grey"), r6(levels.midi_note((F.abs(y) + 1) * 1000)).alias("note"), r6(levels.wrap_phase(y * 40)).alias("phase"),
    )


@query("filter_design_scalars", """SELECT p_partkey AS id, round((1 - tan(pi() * p_size / 1000.0)) / (1 + tan(pi() * p_size / 1000.0)), 6) AS pole,
 round((1 + (1 - tan(pi() * p_size / 1000.0)) / (1 + tan(pi() * p_size / 1000.0))) / 2, 6) AS gain, round(p_size::DOUBLE, 6) AS cutoff,
 round(1 + (10 ** (6.0 / 20) - 1) / (1 + ((p_retailprice / 900 - 900 / p_retailprice) * 2) ** 2), 6) AS bell,
 CASE WHEN p_size * 60 < p_retailprice AND greatest(p_size * 120, p_retailprice) < 2 * p_retailprice THEN greatest(p_size * 120, p_retailprice) END AS harm_lo FROM part""")
def filter_design_scalars(spark, d):
    pole = levels.butterworth_pole(F.col("p_size").cast("double"), F.lit(1000.0))
    return v.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), r6(pole).alias("pole"), r6(levels.butterworth_gain(pole)).alias("gain"),
        r6(levels.butterworth_cutoff(pole, F.lit(1000.0))).alias("cutoff"), r6(levels.parametric_eq(F.col("p_retailprice"), 900.0, 6.0, 2.0)).alias("bell"),
        levels.harmonics_band(F.col("p_size") * 60.0, F.col("p_retailprice"))["lo"].alias("harm_lo"),
    )


@query("content_hashes", """WITH b AS (SELECT doc_id AS file_id, text, encode(text) AS c FROM documents WHERE strlen(text) > 0)
 SELECT file_id, sha256(c) AS full, sha256(CASE WHEN octet_length(c) > 8 THEN c[9:] ELSE ''::BLOB END) AS content FROM b""")
def content_hashes(spark, d):
    docs = v.table(spark, d, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("c"))
    h = text.content_hashes(F.col("c"), F.lit(8), F.octet_length("c") - 8)
    return docs.select("file_id", h["full"].alias("full"), h["content"].alias("content"))


SPOT = """b AS (SELECT doc_id AS file_id, encode(text) AS c, octet_length(encode(text)) AS z FROM documents), k AS (SELECT *, least(4, greatest(CAST(ceil(z / 64.0::DOUBLE) AS BIGINT), 1)) AS n FROM b),
 p AS (SELECT file_id, i, sha256(c[CAST(floor(i * CASE WHEN n > 1 THEN (z - 64) / (n - 1)::DOUBLE ELSE 0 END) AS BIGINT) + 1 : CAST(floor(i * CASE WHEN n > 1 THEN (z - 64) / (n - 1)::DOUBLE ELSE 0 END) AS BIGINT) + 64]) AS h FROM k, generate_series(0, 3) g(i) WHERE i < n),
spots AS (SELECT file_id AS spot_id, sha256(string_agg(h, '' ORDER BY i)) AS spot FROM p GROUP BY 1)"""


@query("spot_hashes", ctes(SPOT) + """SELECT spot_id AS file_id, spot FROM spots""")
def spot_hashes(spark, d):
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("c"))
    return docs.select("file_id", text.content_hashes(F.col("c"), F.lit(0), F.octet_length("c"), pieces=4, piece=64)["spot"].alias("spot"))


@query("catalogue_pages", ctes(CAT) + "SELECT gen, sp, count(*) AS n FROM cat WHERE smp % 2000 <> 0 AND cnt <> 'NATION_3' GROUP BY 1, 2")
def catalogue_pages(spark, d):
    cat = v.catalogue(spark, d)
    ids = F.when(F.col("smp") % 2000 == 0, F.concat(F.lit("x"), "id")).otherwise(F.abs(F.xxhash64("id") % 10**15).cast("string"))
    rec = F.struct(ids.alias("id"), "gen", "sp", "en", "q", F.col("smp").cast("string").alias("smp"), F.when(F.col("cnt") == "NATION_3", "").otherwise("f.wav").alias("file"))
    # Pages of bounded size: a few dozen recordings each.
    pages = cat.groupBy(F.pmod(F.xxhash64("id"), F.lit(4096)).alias("page"), F.substring("id", 1, 6).alias("part")).agg(F.to_json(F.struct(F.collect_list(rec).alias("recordings"))).alias("body"))
    good, _ = K.parse_pages(pages)
    return good.groupBy("gen", "sp").agg(F.count(F.lit(1)).alias("n"))


SIDECAR = """SELECT doc_id AS id, sha256(text) AS sha256, CAST(n_chars AS VARCHAR) AS file_size FROM documents"""


def _sidecars(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("file_size"), "lang")
    flat = F.to_json(F.struct(F.col("doc_id").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("also"), F.lit(1.5).alias("num"), "sha256", "file_size", F.lit("2024").alias("retrieved")))
    nested = F.to_json(F.struct(F.col("doc_id").alias("id"), F.struct("sha256", "file_size").alias("_app")))
    bare = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang"))
    kind = F.col("file_size") % 4
    return docs.select(F.col("doc_id").alias("id"), F.when(kind == 0, nested).when(kind == 1, bare).when(kind == 2, "not json").otherwise(flat).alias("body"))


@query("sidecar_hashes", "SELECT doc_id AS id, CASE WHEN n_chars % 4 IN (0, 3) THEN sha256(text) END AS sha256, CASE WHEN n_chars % 4 IN (0, 3) THEN CAST(n_chars AS VARCHAR) END AS file_size FROM documents")
def sidecar_hashes(spark, d):
    return K.sidecar_hashes(_sidecars(spark, d), "id").select("id", "sha256", "file_size")


@query("sidecar_migration", """SELECT doc_id AS id, CASE n_chars % 4 WHEN 2 THEN 'error' WHEN 3 THEN 'migrated' ELSE 'skipped' END AS outcome, CASE n_chars % 4
 WHEN 0 THEN concat('{"id":', doc_id, ',"_app":{"sha256":"', sha256(text), '","file_size":', n_chars, '}}') WHEN 1 THEN concat('{"id":', doc_id, ',"lang":"', lang, '"}') WHEN 2 THEN 'not json'
 ELSE concat('{"id":', doc_id, ',"also":["a","b"],"num":1.5,"_app":{"sha256":"', sha256(text), '","file_size":', n_chars, ',"retrieved":"2024"}}') END AS body FROM documents""")
def sidecar_migration(spark, d):
    return K.migrate_sidecars(_sidecars(spark, d), "id").select("id", "outcome", "body")


@query("sidecar_migration_counts", "SELECT CASE n_chars % 4 WHEN 2 THEN 'error' WHEN 3 THEN 'migrated' ELSE 'skipped' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def sidecar_migration_counts(spark, d):
    return K.migration_counts(K.migrate_sidecars(_sidecars(spark, d), "id"))


@query("index_upsert", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey NOT IN (SELECT n_nationkey * 3 FROM nation)")
def index_upsert(spark, d):
    index = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    gone = v.table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("id"))
    return K.upsert(index, changes, "id", gone)


@query("metadata_refresh", "SELECT coalesce(c_custkey, s_suppkey + 1000) AS id, coalesce(s_name, c_name) AS name, c_mktsegment AS app FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 1000")
def metadata_refresh(spark, d):
    local = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("app"))
    fresh = v.table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"))
    return K.refresh(local, fresh, "id", ["name"], ["app"])


def _held(cat):
    return cat.where("smp > 40000")


@query("species_list", ctes(CAT) + "SELECT gen, sp, min(en) AS en, count(*) AS recordings FROM cat GROUP BY 1, 2")
def species_list(spark, d):
    return K.species_list(v.catalogue(spark, d))


@query("needed_recordings", ctes(CAT, "h AS (SELECT gen, sp, count(*) AS have FROM cat WHERE smp > 40000 GROUP BY 1, 2)") +
 "SELECT DISTINCT gen, sp, coalesce(have, 0) AS have, 120 - coalesce(have, 0) AS needed FROM cat LEFT JOIN h USING (gen, sp) WHERE 120 - coalesce(have, 0) > 0")
def needed_recordings(spark, d):
    cat = v.catalogue(spark, d)
    return K.needed_recordings(cat, _held(cat), 120)


@query("best_candidates", ctes(CAT, "h AS (SELECT gen, sp, count(*) AS have FROM cat WHERE smp > 49000 GROUP BY 1, 2)",
 "r AS (SELECT *, row_number() OVER (PARTITION BY gen, sp ORDER BY CASE q WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 WHEN 'E' THEN 4 ELSE 5 END, smp DESC, id) AS rank FROM cat WHERE id NOT IN (SELECT id FROM cat WHERE smp > 49000))") +
 "SELECT gen, sp, id, rank FROM r LEFT JOIN h USING (gen, sp) WHERE rank <= 20 - coalesce(have, 0)")
def best_candidates(spark, d):
    cat = v.catalogue(spark, d)
    return K.best_candidates(cat, cat.where("smp > 49000"), 20).select("gen", "sp", "id", F.col("rank").cast("long").alias("rank"))


@query("catalogue_join_local", ctes(CAT, "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, l_tax FROM lineitem WHERE l_linestatus = 'F')") +
 "SELECT gen, count(*) AS n, count(f.id) AS local FROM (SELECT DISTINCT id, gen FROM cat) c LEFT JOIN (SELECT DISTINCT id FROM f) f USING (id) GROUP BY 1")
def catalogue_join_local(spark, d):
    local = v.table(spark, d, "lineitem").where("l_linestatus = 'F'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id")).distinct().withColumn("here", F.lit(1))
    cat = v.catalogue(spark, d).select("id", "gen").distinct()
    return cat.join(local, "id", "left").groupBy("gen").agg(F.count(F.lit(1)).alias("n"), F.count("here").alias("local"))


@query("catalogue_tags", ctes(CAT) + "SELECT id, en FROM cat WHERE lower(gen) = 'economy' AND lower(cnt) = 'nation_4' AND (contains(lower(gen || ' ' || sp), 'ring') OR contains(lower(en), 'ring'))")
def catalogue_tags(spark, d):
    return K.match_tags(v.catalogue(spark, d), gen="Economy", cnt="nation_4", anything="Ring").select("id", "en")


@query("taxon_filter", "SELECT c_custkey AS id FROM customer WHERE coalesce(CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN true ELSE false END END, c_mktsegment IN ('MACHINERY', 'HOUSEHOLD'))")
def taxon_filter(spark, d):
    c = v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_mktsegment") == "BUILDING", "bats").otherwise("birds")).alias("grp"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Myotis daubentonii").when(F.col("c_mktsegment") == "HOUSEHOLD", "Nyctalus noctula").otherwise("Turdus merula").alias("species"),
    )
    return K.taxon_filter(c, "bats", K.BAT_FRAGMENTS).select("id")


@query("country_regions", ctes(CAT) + "SELECT r_name AS region, n_nationkey % 2 = 0 AS approximate, count(*) AS n FROM cat LEFT JOIN nation ON n_name = cnt AND n_nationkey <> 5 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def country_regions(spark, d):
    return K.country_region(v.catalogue(spark, d), _countries(spark, d)).groupBy("region", "approximate").agg(F.count(F.lit(1)).alias("n"))


def _countries(spark, d):
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey <> 5").select(
        F.upper("n_name").alias("country"), F.col("r_name").alias("region"), (F.col("n_nationkey") % 2 == 0).alias("approximate"))


def _species(spark, d):
    return v.table(spark, d, "part").select(
        F.col("p_partkey").alias("species_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("scientific_name"), F.col("p_brand").alias("description"),
        (F.col("p_size") * 1000.0).alias("freq_lo_hz"), (F.col("p_retailprice") * 50).alias("freq_hi_hz"), (F.col("p_size") % 5 != 0).alias("echolocates"))


ENTRIES = """en AS (SELECT DISTINCT r_name AS region, r_regionkey AS region_order, l_partkey AS species_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _entries(spark, d):
    l, s, n, r = (v.table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    rows = l.select("l_partkey", "l_suppkey").join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("r_name").alias("region"), F.col("l_partkey").alias("species_id")).distinct().select(
        "region", "species_id", F.col("species_id").alias("ordinal"), F.when(F.col("species_id") % 4 == 0, "common").otherwise("rare").alias("commonness"),
        F.when(F.col("species_id") % 3 == 0, F.concat(F.lit("local "), F.col("species_id").cast("string"))).alias("name_override"), F.lit(None).cast("string").alias("description_override"))


@query("species_book", ctes(ENTRIES) + "SELECT region, species_id, CASE WHEN species_id % 3 = 0 THEN 'local ' || species_id ELSE p_name END AS name, p_brand AS description, CASE WHEN species_id % 4 = 0 THEN 'common' ELSE 'rare' END AS commonness, row_number() OVER (PARTITION BY region ORDER BY p_size % 5 = 0, species_id) - 1 AS pos FROM en JOIN part ON p_partkey = species_id")
def species_book(spark, d):
    from echolake.plans.chunking import ranked

    book = K.materialize_book(_entries(spark, d), _species(spark, d))
    placed = ranked(book, ["region"], [F.col("echolocates").desc(), F.col("ordinal")])
    return placed.select("region", "species_id", "name", "description", "commonness", "pos")


@query("species_resolution", ctes(ENTRIES, "q AS (SELECT c_custkey AS row_id, lower(p_type || ' ' || p_brand) AS s, CASE WHEN c_custkey % 4 <> 0 THEN r_name END AS rg FROM customer JOIN part ON c_custkey = p_partkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
 "h AS (SELECT row_id, rg, en.region, species_id, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(en.region <> rg, true), region_order, species_id) AS r FROM q JOIN part ON lower(p_type || ' ' || p_brand) = s JOIN en ON species_id = p_partkey)") +
 "SELECT q.row_id, species_id, coalesce(q.rg, h.region) AS book_region FROM q LEFT JOIN h ON h.row_id = q.row_id AND r = 1")
def species_resolution(spark, d):
    c, p, n, r = (v.table(spark, d, t) for t in ("customer", "part", "nation", "region"))
    rows = c.join(p, c.c_custkey == p.p_partkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("row_id"),
        F.concat(F.lit(" "), F.concat_ws(" ", "p_type", "p_brand"), F.when(F.col("c_custkey") % 3 == 0, " subspecies").otherwise("")).alias("species"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("r_name")).alias("region"))
    regions = r.select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("region_order"))
    entries = _entries(spark, d).join(_species(spark, d).select("species_id", "scientific_name"), "species_id")
    return K.resolve_species(rows, entries, regions)


@query("species_books", ctes(ENTRIES, "q AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 5 <> 0 THEN lower(p_type || ' ' || p_brand) END AS s, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Nowhere' ELSE n_name END AS country, "
 "CASE WHEN c_custkey % 4 > 1 AND n_nationkey <> 5 THEN r_name END AS rg, n_nationkey % 2 = 0 AS approx FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON c_custkey = p_partkey)",
 "h AS (SELECT row_id, en.region, species_id, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(en.region <> rg, true), region_order, species_id) AS r FROM q JOIN part ON lower(p_type || ' ' || p_brand) = s JOIN en ON species_id = p_partkey)") +
 """SELECT q.row_id, coalesce(rg, h.region, 'ASIA') AS region, species_id, lower(coalesce(rg, h.region, 'ASIA')) || CASE WHEN coalesce(rg, h.region) IS NOT NULL AND country IS NOT NULL THEN ' (' || country || CASE WHEN rg IS NOT NULL AND approx THEN ', approx.' ELSE '' END || ')' ELSE '' END AS source_label,
 coalesce(rg, h.region) IS NULL AS from_favourite FROM q LEFT JOIN h ON h.row_id = q.row_id AND r = 1""")
def species_books(spark, d):
    c, p, n, r = (v.table(spark, d, t) for t in ("customer", "part", "nation", "region"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(p, c.c_custkey == p.p_partkey, "left")
    key = F.col("c_custkey")
    rows = named.select(key.alias("row_id"), F.when(key % 5 != 0, F.concat_ws(" ", "p_type", "p_brand")).alias("species"),
                        F.when(key % 4 == 1, "Nowhere").when(key % 4 > 1, F.col("n_name")).alias("country"))
    regions = r.select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("region_order"), F.lower("r_name").alias("label"))
    entries = _entries(spark, d).join(_species(spark, d).select("species_id", "scientific_name"), "species_id")
    return K.resolve_books(rows, entries, regions, _countries(spark, d), "ASIA")


@query("index_versions", """WITH a AS (SELECT c_custkey AS id, c_mktsegment AS gen, c_acctbal AS x FROM customer), b AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'MOVED' ELSE gen END AS gen, CASE WHEN id % 10 = 0 THEN -1 ELSE x END AS x FROM a WHERE id % 7 <> 3)
 SELECT 1 AS version, gen, count(*) AS n, round(sum(x), 2) AS total FROM a GROUP BY gen UNION ALL SELECT 2, gen, count(*), round(sum(x), 2) FROM b GROUP BY gen""")
def index_versions(spark, d):
    """A catalogue index as first committed and after an upsert with deletions, read by version."""
    path = scratch_path(spark, "index")
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("gen"), F.col("c_acctbal").alias("x"))
    first = K.commit_index(rows, path, "gen")
    held = K.read_index(spark, path)
    changes = held.where("id % 10 = 0").select("id", F.lit(-1.0).alias("x"), F.lit("MOVED").alias("gen"))
    K.commit_index(K.upsert(held, changes, "id", held.where("id % 7 = 3")), path, "gen", first)

    def summed(version):
        return K.read_index(spark, path, version).groupBy("gen").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("total")).select(F.lit(version).alias("version"), "gen", "n", "total")

    return summed(1).unionByName(summed(2))


@query("selected_frequency_range", """WITH s AS (SELECT l_orderkey AS recording_id, min(p_size * 1000.0::DOUBLE) AS lo, max(p_retailprice * 50) AS hi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING min(p_size * 1000.0) < max(p_retailprice * 50))
 SELECT recording_id, lo AS lo_hz, least(hi, (20000 + o_custkey * 50) / 2.0::DOUBLE) AS hi_hz, hi > (20000 + o_custkey * 50) / 2.0 AS clamped FROM s JOIN orders ON o_orderkey = recording_id WHERE lo < (20000 + o_custkey * 50) / 2.0""")
def selected_frequency_range(spark, d):
    sel = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.col("l_partkey").alias("species_id"))
    recs = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), (20_000 + F.col("o_custkey") * 50).alias("sample_rate"))
    return K.selected_range(sel, _species(spark, d).select("species_id", "freq_lo_hz", "freq_hi_hz"), recs)


ID_L = """il AS (SELECT file_id, filename, file_size, file_size // 10 AS ds, CASE WHEN file_size % 3 <> 0 THEN full_hash END AS f, CASE WHEN file_size % 5 <> 0 THEN content_hash END AS c, CASE WHEN file_size % 7 <> 0 THEN spot END AS s FROM (SELECT ident.*, spot FROM ident JOIN spots ON spot_id = file_id))"""
ID_R = """ir AS (SELECT file_id, filename, file_size, file_size // 10 AS ds, CASE WHEN file_id % 4 <> 0 THEN full_hash END AS f, CASE WHEN file_id % 3 <> 0 THEN content_hash END AS c, CASE WHEN file_id % 5 <> 0 THEN spot END AS s FROM (SELECT ident.*, spot FROM ident JOIN spots ON spot_id = file_id))"""


def _identity_side(spark, d, by, fmod, cmod, smod):
    docs = spot_hashes(spark, d)
    x = F.col(by)
    return v.identities(spark, d).join(docs, "file_id").select(
        "file_id", "filename", "file_size", F.expr("file_size div 10").alias("data_size"), F.when(x % fmod != 0, F.col("full_hash")).alias("full_hash"),
        F.when(x % cmod != 0, F.col("content_hash")).alias("content_hash"), F.when(x % smod != 0, F.col("spot")).alias("spot_hash"))


@query("identity_matches", ctes(IDENT, SPOT, ID_L, ID_R, """pr AS (SELECT l.file_id, r.file_id AS rid, CASE WHEN l.f IS NOT NULL AND r.f IS NOT NULL THEN CASE WHEN l.f = r.f THEN 4 ELSE 0 END
 WHEN l.c IS NOT NULL AND r.c IS NOT NULL AND l.c = r.c THEN 3 WHEN l.c IS NOT NULL AND r.c IS NOT NULL AND NOT (l.ds = r.ds AND l.ds > 0) THEN 0
 WHEN l.s IS NOT NULL AND r.s IS NOT NULL THEN CASE WHEN l.s = r.s THEN 2 ELSE 0 END WHEN l.filename = r.filename AND l.file_size = r.file_size THEN 1 ELSE 0 END AS lv FROM il l, ir r)""",
 "bp AS (SELECT file_id, rid, lv, row_number() OVER (PARTITION BY file_id ORDER BY lv DESC, rid) AS k FROM pr WHERE lv > 0)") +
 "SELECT il.file_id, ['none', 'weak', 'likely', 'high', 'certain'][coalesce(lv, 0) + 1] AS confidence, rid AS match_id FROM il LEFT JOIN bp ON bp.file_id = il.file_id AND k = 1")
def identity_matches(spark, d):
    return K.match_identities(_identity_side(spark, d, "file_size", 3, 5, 7), _identity_side(spark, d, "file_id", 4, 3, 5))


@query("duplicate_clusters", ctes(IDENT) + "SELECT content_hash, count(*) AS copies, min(file_id) AS first_id FROM ident GROUP BY 1 HAVING count(*) > 1")
def duplicate_clusters(spark, d):
    return K.duplicate_clusters(v.identities(spark, d))


@query("identity_verification", ctes(IDENT, SPOT, ID_L, ID_R, "rf AS (SELECT coalesce(r.file_id, l.file_id) AS file_id, coalesce(r.f, l.f) AS f, coalesce(r.s, l.s) AS s, coalesce(r.c, l.c) AS c FROM ir r FULL JOIN (SELECT file_id + 1 AS file_id, f, s, c FROM il) l ON l.file_id = r.file_id)") +
 """SELECT l.file_id, CASE WHEN CASE WHEN l.file_size < 500 THEN l.f = r.f ELSE l.s = r.s END IS NULL THEN 'pending' WHEN CASE WHEN l.file_size < 500 THEN l.f = r.f ELSE l.s = r.s END THEN 'match'
 WHEN coalesce(l.c = r.c, false) THEN 'content_match' ELSE 'mismatch' END AS outcome FROM il l LEFT JOIN rf r ON r.file_id = l.file_id""")
def identity_verification(spark, d):
    files = _identity_side(spark, d, "file_size", 3, 5, 7)
    catalogue = _identity_side(spark, d, "file_id", 4, 3, 5)
    sidecar = files.withColumn("file_id", F.col("file_id") + 1)
    refs = K.merge_references(catalogue, sidecar, "file_id", ["full_hash", "spot_hash", "content_hash"])
    return K.verify_identities(files, refs, small_file=500)


@query("daily_sample")
def daily_sample(spark, d):
    return K.daily_sample(v.catalogue(spark, d).select("id", "gen", "sp"), 20_000, 50)


@query("result_page", ctes(CAT) + "SELECT id, gen, sp FROM cat ORDER BY id LIMIT 100 OFFSET 200")
def result_page(spark, d):
    return K.page(v.catalogue(spark, d).select("id", "gen", "sp"), ["id"], 3, 100)


@query("file_rollup", "SELECT p_type AS format, p_size AS sample_rate, count(*) AS files, round(sum(p_retailprice), 2) AS duration_secs, CAST(sum(p_partkey) AS BIGINT) AS file_size FROM part GROUP BY CUBE (p_type, p_size)")
def file_rollup(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_type").alias("format"), F.col("p_size").alias("sample_rate"), F.col("p_retailprice").alias("duration_secs"), F.col("p_partkey").alias("file_size"))
    return K.file_rollup(p).withColumn("duration_secs", F.round("duration_secs", 2))


LICENCE = """CASE event_id % 4 WHEN 0 THEN 'CC BY-NC-SA 4.0' WHEN 1 THEN 'cc0' WHEN 2 THEN 'CC BY 3.0' END"""


@query("licence_rollup", f"""SELECT event_type AS format, {LICENCE} AS licence, count(*) AS files, round(sum(value), 2) AS duration_secs, CAST(sum(user_id) AS BIGINT) AS file_size
 FROM events GROUP BY CUBE (event_type, {LICENCE})""")
def licence_rollup(spark, d):
    kind = F.col("event_id") % 4
    stated = (F.when(kind == 0, "//creativecommons.org/licenses/by-nc-sa/4.0/").when(kind == 1, "cc0").when(kind == 2, "https://creativecommons.org/licenses/by/3.0/")
              .otherwise("all rights reserved"))
    files = v.table(spark, d, "events").select(
        F.col("event_type").alias("format"), text.licence_label(stated).alias("licence"), F.col("value").alias("duration_secs"), F.col("user_id").alias("file_size"))
    return K.file_rollup(files, ["format", "licence"]).withColumn("duration_secs", F.round("duration_secs", 2))


EVID = """ev AS (SELECT o_orderkey AS recording_id, CASE WHEN o_custkey % 10 = 0 THEN 24 ELSE 16 END AS container_bits, o_custkey % 13 = 0 AS is_float, CASE o_orderkey % 6 WHEN 0 THEN 'MP3' WHEN 1 THEN 'FLAC' ELSE 'WAV' END AS format,
 ['zero_padded','quiet_section_zero_padded','dsp_padded','inconclusive','consistent'][o_orderkey % 5 + 1] AS lv, 1 + o_custkey % 5 AS pad, CASE WHEN o_orderkey % 5 = 0 THEN 15 - o_custkey % 5 WHEN o_orderkey % 5 IN (1, 2) THEN 12 END AS lb,
 o_totalprice / 5000 AS cov, 8 + o_totalprice / 40000 AS res, ['match','possible','no_match'][o_custkey % 3 + 1] AS iv, ['match','possible','no_match','no_match'][o_custkey % 4 + 1] AS mv,
 [312500, 400000, 38400, 384000][o_orderkey % 4 + 1] AS sr, CASE WHEN o_custkey % 7 = 0 THEN 'band_limited' ELSE 'full_bandwidth' END AS nv FROM orders)"""


def _evidence(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    return v.table(spark, d, "orders").select(
        o.alias("recording_id"), F.when(c % 10 == 0, 24).otherwise(16).alias("container_bits"), (c % 13 == 0).alias("is_float"),
        F.when(o % 6 == 0, "MP3").when(o % 6 == 1, "FLAC").otherwise("WAV").alias("format"),
        pick(["zero_padded", "quiet_section_zero_padded", "dsp_padded", "inconclusive", "consistent"], o % 5).alias("lsb_verdict"), (1 + c % 5).cast("int").alias("padding_bits"),
        F.when(o % 5 == 0, 15 - c % 5).when((o % 5).isin(1, 2), 12).cast("int").alias("lsb_bits"), F.lit(1).alias("unique_count"), (F.col("o_totalprice") / 5000).alias("coverage_pct"),
        (8 + F.col("o_totalprice") / 40000).alias("resolution_bits"), pick(["match", "possible", "no_match"], c % 3).alias("inverse_verdict"),
        pick(["match", "possible", "no_match", "no_match"], c % 4).alias("multiple_verdict"), pick([312500, 400000, 38400, 384000], o % 4).alias("sample_rate"),
        F.when(c % 7 == 0, "band_limited").otherwise("full_bandwidth").alias("nyquist_verdict"))


@query("bit_depth_certainty", ctes(EVID,
 "u AS (SELECT *, CASE WHEN lv = 'zero_padded' THEN least(container_bits, lb) ELSE container_bits END AS ap, ceil(res) AS cb FROM ev)", "w AS (SELECT *, cb < ap AS nar, least(cb, ap) AS up, iv = 'match' OR mv = 'match' AS fw FROM u)",
 "x AS (SELECT *, CASE WHEN lv = 'dsp_padded' AND up > lb THEN lb ELSE up END AS b1, lv IN ('zero_padded','quiet_section_zero_padded','dsp_padded') OR fw AS conf, (NOT nar AND abs(cov - 100) >= 0.01 AND cov > 50) OR lv = 'consistent' AS gen FROM w)") +
 """SELECT recording_id, CAST(CASE WHEN format = 'MP3' OR is_float THEN container_bits ELSE up END AS INTEGER) AS upper_bound, CAST(CASE WHEN format = 'MP3' OR is_float THEN container_bits WHEN fw AND b1 > 12 THEN 12 ELSE b1 END AS INTEGER) AS best_estimate,
 CASE WHEN format = 'MP3' THEN 'suggestive' WHEN is_float THEN 'certain' WHEN up < container_bits THEN 'certain' WHEN conf OR gen THEN 'high' ELSE 'suggestive' END AS certainty,
 CASE WHEN format = 'MP3' THEN 'lossy' WHEN is_float THEN 'float' WHEN up < container_bits AND conf THEN 'recorder_depth_bounded' WHEN up < container_bits THEN 'signal_information_bounded' WHEN conf THEN 'lower_depth_suspected' WHEN gen THEN 'genuine' ELSE 'inconclusive' END AS headline FROM x""")
def bit_depth_certainty(spark, d):
    return provenance.bit_depth_certainty(_evidence(spark, d)).select("recording_id", "upper_bound", "best_estimate", "certainty", "headline")


HINTS = """hh AS (SELECT recording_id, concat_ws(',', CASE WHEN mv NOT IN ('match','possible') AND lv NOT IN ('zero_padded','quiet_section_zero_padded') THEN CASE iv WHEN 'match' THEN 'family_firmware' WHEN 'possible' THEN 'possible_family_firmware' END END,
 CASE mv WHEN 'match' THEN 'high_pass_firmware' WHEN 'possible' THEN 'possible_high_pass_firmware' END, CASE WHEN NOT is_float THEN CASE WHEN lv = 'zero_padded' AND pad = 4 THEN 'zero_padded_12_bit' WHEN lv = 'zero_padded' AND pad = 1 THEN 'zero_padded_one_bit'
 WHEN lv = 'zero_padded' THEN 'zero_padded' WHEN lv = 'quiet_section_zero_padded' THEN 'quiet_sections_gated' WHEN lv = 'dsp_padded' THEN 'filter_residue' END END, CASE WHEN nv = 'band_limited' THEN 'band_limited' END, CASE WHEN sr <> 384000 THEN 'sample_rate' END,
 CASE WHEN NOT is_float AND lv <> 'zero_padded' AND ceil(res) <= CASE WHEN container_bits = 16 THEN 12 ELSE 16 END THEN 'low_value_coverage' END) AS rules FROM ev)"""


@query("device_hints", ctes(EVID, HINTS) + "SELECT recording_id, rules FROM hh")
def device_hints(spark, d):
    h = provenance.device_hints(_evidence(spark, d))
    return h.select("recording_id", F.array_join(F.transform("hints", lambda x: x["rule"]), ",").alias("rules"))


@query("device_claims", ctes(EVID, HINTS, "cl AS (SELECT recording_id, ['Batlogger M2', 'AudioMoth recorder', 'Zoom H5', NULL][recording_id % 4 + 1] AS claim FROM ev)",
 "st AS (SELECT recording_id, regexp_matches(rules, '(^|,)(family_firmware|high_pass_firmware|zero_padded_12_bit|zero_padded_one_bit|zero_padded|quiet_sections_gated)(,|$)') AS strong, rules FROM hh)") +
 """SELECT recording_id, claim, CASE WHEN claim IS NULL THEN 'no_claim' WHEN rules = '' THEN 'no_analysis' WHEN claim = 'Batlogger M2' AND regexp_matches(rules, 'family_firmware|sample_rate') AND (contains(rules, 'family_firmware') OR recording_id % 4 = 0) THEN 'match'
 WHEN claim = 'AudioMoth recorder' AND regexp_matches(rules, 'family_firmware|high_pass_firmware|zero_padded_12_bit|quiet_sections_gated|filter_residue') THEN 'match' WHEN strong THEN 'mismatch' ELSE 'no_analysis' END AS outcome FROM cl JOIN st USING (recording_id)""")
def device_claims(spark, d):
    ev = _evidence(spark, d)
    r = F.col("recording_id")
    empty = F.lit(None).cast("string")
    claim = provenance.device_claim(
        F.when(r % 4 == 0, "Batlogger"), F.when(r % 4 == 0, "M2").otherwise(empty), F.when(r % 4 == 1, "AudioMoth recorder"), F.when(r % 4 == 1, "audiomoth").when(r % 4 == 2, "Zoom H5"))
    claims = ev.select("recording_id", claim.alias("claim"))
    return provenance.claim_matches(claims, provenance.device_hints(ev)).select("recording_id", "claim", "outcome")


@query("lossy_formats", ctes(EVID) + "SELECT format, count(*) AS n FROM ev WHERE format IN ('MP3', 'OGG', 'M4A', 'W4V') GROUP BY 1")
def lossy_formats(spark, d):
    return _evidence(spark, d).where(provenance.is_lossy("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))
