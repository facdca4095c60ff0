"""Queries over timelines, file groups and annotations."""

from pyspark.sql import functions as F

from echolake.functions.levels import r6
from echolake.operators import annotations as A
from echolake.operators import timeline as T
from echolake.plans.registry import NAMES, SEGS, SPEC, TREE, ctes, query
from echolake.sources import vehicles as v


@query("timeline_placement", ctes(SEGS, "s AS (SELECT timeline_id, seg_id, CASE WHEN seg_id % 11 <> 0 THEN start END AS start, dur FROM segs)",
 "o AS (SELECT timeline_id, min(start) AS o, max(start + dur) AS e FROM s GROUP BY 1)", "u AS (SELECT *, sum(dur) OVER (PARTITION BY timeline_id ORDER BY seg_id) - dur AS q FROM s WHERE start IS NULL)") +
 "SELECT timeline_id, seg_id, start - o AS offset, dur FROM s JOIN o USING (timeline_id) WHERE start IS NOT NULL UNION ALL SELECT timeline_id, seg_id, e - o + q, dur FROM u JOIN o USING (timeline_id)")
def timeline_placement(spark, d):
    return T.place(v.segs(spark, d).withColumn("start", F.when(F.col("seg_id") % 11 != 0, F.col("start"))))


@query("overlap_flags", ctes(SEGS) + "SELECT a.timeline_id, a.seg_id, a.start, a.dur, EXISTS (SELECT 1 FROM segs b WHERE b.timeline_id = a.timeline_id AND b.seg_id <> a.seg_id AND a.start < b.start + b.dur AND b.start < a.start + a.dur) AS has_overlap FROM segs a")
def overlap_flags(spark, d):
    return T.flag_overlaps(v.segs(spark, d))


@query("recording_sessions", ctes(SEGS, "g AS (SELECT *, start - lag(start + dur) OVER (PARTITION BY timeline_id ORDER BY start, seg_id) AS gap FROM segs)",
 "h AS (SELECT *, last_value(CASE WHEN gap IS NULL OR gap > 2 THEN seg_id END IGNORE NULLS) OVER (PARTITION BY timeline_id ORDER BY start, seg_id) AS session FROM g)") + "SELECT timeline_id, seg_id, gap, session FROM h")
def recording_sessions(spark, d):
    return T.sessions(v.segs(spark, d), 2.0)


@query("segment_at_time", ctes(SEGS, "p AS (SELECT user_id % 50 AS timeline_id, event_id AS point_id, 9100 + value * 5 AS t FROM events)",
 "h AS (SELECT p.*, seg_id, start, row_number() OVER (PARTITION BY p.timeline_id, point_id ORDER BY start, seg_id) AS r FROM p JOIN segs s ON s.timeline_id = p.timeline_id AND t >= start AND t < start + dur)") +
 "SELECT timeline_id, point_id, seg_id, round(t - start, 6) AS inside FROM h WHERE r = 1")
def segment_at_time(spark, d):
    points = v.table(spark, d, "events").select((F.col("user_id") % 50).alias("timeline_id"), F.col("event_id").alias("point_id"), (9100 + F.col("value") * 5).alias("t"))
    return T.segment_at(points, v.segs(spark, d)).withColumn("inside", r6("inside"))


@query("segments_in_range", ctes(SEGS) + "SELECT timeline_id, seg_id FROM segs WHERE start < 10100 AND start + dur > 10000")
def segments_in_range(spark, d):
    return T.in_range(v.segs(spark, d), 10000.0, 10100.0).select("timeline_id", "seg_id")


@query("region_segment_overlaps", ctes(SEGS, "r AS (SELECT c_custkey % 50 AS timeline_id, c_custkey AS region_id, 9100 + c_acctbal / 5 AS a, 9103 + c_acctbal / 5 AS b FROM customer)") +
 "SELECT r.timeline_id, region_id, seg_id, round(least(b, start + dur) - greatest(a, start), 6) AS shared FROM r JOIN segs s ON s.timeline_id = r.timeline_id AND a < start + dur AND start < b")
def region_segment_overlaps(spark, d):
    a = 9100 + F.col("c_acctbal") / 5
    regions = v.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("timeline_id"), F.col("c_custkey").alias("region_id"), a.alias("r_start"), (9103 + F.col("c_acctbal") / 5).alias("r_end"))
    return T.overlaps_by_region(regions, v.segs(spark, d)).select("timeline_id", "region_id", "seg_id", r6("shared").alias("shared"))


BOX = """bx AS (SELECT user_id % 10 AS recording_id, event_id AS box_id, (value % 50) / 100 AS a, (value % 50) / 100 + 0.03 + (event_id % 5) / 100.0::DOUBLE AS b,
  CASE WHEN event_id % 4 <> 0 THEN (event_id % 30) * 10.0::DOUBLE + 3 END AS f0, CASE WHEN event_id % 4 <> 0 THEN (event_id % 30) * 10.0::DOUBLE + 153 END AS f1 FROM events)"""


def _boxes(spark, d):
    e = F.col("event_id")
    t = (F.col("value") % 50) / 100
    low = F.when(e % 4 != 0, (e % 30) * 10.0 + 3)
    return v.table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("recording_id"), e.alias("box_id"), t.alias("time_start"), (t + 0.03 + (e % 5) / 100.0).alias("time_end"), low.alias("freq_low"), (low + 150).alias("freq_high"))


@query("boxes_in_view", ctes(BOX) + "SELECT recording_id, box_id FROM bx WHERE a < 0.3 AND b > 0.2 AND coalesce(f0 < 200, true) AND coalesce(f1 > 100, true)")
def boxes_in_view(spark, d):
    return T.in_box(_boxes(spark, d), 0.2, 0.3, 100.0, 200.0).select("recording_id", "box_id")


@query("box_energy", ctes(SPEC, BOX) + """SELECT b.recording_id, box_id, count(DISTINCT col) AS columns, round(coalesce(sum(mag * mag) FILTER (bin * 10 >= coalesce(f0, 0) AND bin * 10 <= coalesce(f1, 1e9)), 0), 6) AS energy,
 round(max(mag) FILTER (bin * 10 >= coalesce(f0, 0) AND bin * 10 <= coalesce(f1, 1e9)), 6) AS peak FROM bx b JOIN spec s ON s.recording_id = b.recording_id AND col * 0.01::DOUBLE BETWEEN a AND b GROUP BY 1, 2""")
def box_energy(spark, d):
    cols = v.spec(spark, d).withColumn("t", F.col("col") * 0.01).withColumn("recording_id", F.col("recording_id").cast("long"))
    e = A.box_energy(_boxes(spark, d), cols, 10.0, ["recording_id"])
    return e.select("recording_id", "box_id", "columns", r6("energy").alias("energy"), r6("peak").alias("peak"))


@query("smallest_box_at", ctes(BOX, "p AS (SELECT o_custkey % 10 AS recording_id, o_orderkey AS point_id, (o_orderkey % 53) / 100.0::DOUBLE AS t, (o_totalprice % 640) AS f FROM orders)",
 "h AS (SELECT p.recording_id, point_id, box_id, row_number() OVER (PARTITION BY p.recording_id, point_id ORDER BY (b - a) * (coalesce(f1, 640) - coalesce(f0, 0)), box_id) AS r FROM p JOIN bx ON bx.recording_id = p.recording_id AND t BETWEEN a AND b AND f BETWEEN coalesce(f0, 0) AND coalesce(f1, 640))") +
 "SELECT recording_id, point_id, box_id FROM h WHERE r = 1")
def smallest_box_at(spark, d):
    points = v.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("recording_id"), F.col("o_orderkey").alias("point_id"), ((F.col("o_orderkey") % 53) / 100.0).alias("t"), (F.col("o_totalprice") % 640).alias("freq_hz"))
    return A.smallest_box(points, _boxes(spark, d), 640.0, ["recording_id"])


@query("multitrack_groups", ctes(NAMES, "t AS (SELECT file_id, regexp_replace(name, '_(Ch1|MIX)\\.wav$', '') AS k, regexp_extract(name, '_(Ch1|MIX)\\.wav$', 1) AS l FROM names)", "n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM t)") +
 "SELECT file_id, CASE WHEN n >= 2 THEN k END AS track_key, CASE WHEN n >= 2 THEN l END AS track_label FROM n")
def multitrack_groups(spark, d):
    return T.tracks(v.names(spark, d)).select("file_id", "track_key", "track_label")


SEQ = """t AS (SELECT file_id, regexp_replace(name, '_(Ch1|MIX)\\.wav$', '') AS k, regexp_extract(name, '_(Ch1|MIX)\\.wav$', 1) AS l, file_id % 1000 * 50.0::DOUBLE AS st, (n_chars % 60)::DOUBLE AS du FROM names),
t2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) >= 2 THEN l ELSE '' END AS track, regexp_replace(k, '_\\d+$', '') AS sequence_key, CAST(regexp_extract(k, '_(\\d+)$', 1) AS BIGINT) AS num FROM t),
t3 AS (SELECT *, count(*) OVER (PARTITION BY sequence_key, track) AS c, st - lag(st + du) OVER (PARTITION BY sequence_key, track ORDER BY num, file_id) AS gap FROM t2)"""


def _timed_names(spark, d):
    n = v.names(spark, d)
    return n.withColumn("start_secs", F.col("file_id") % 1000 * 50.0).withColumn("dur", (F.col("n_chars") % 60).cast("double"))


@query("file_sequences", ctes(NAMES, SEQ) + "SELECT file_id, sequence_key, track, num AS sequence_number, gap AS gap_secs FROM t3 WHERE c >= 2")
def file_sequences(spark, d):
    return T.sequences(_timed_names(spark, d))


ORD = """f AS (SELECT n.file_id, name, (n.file_id * 7919) % 100003 AS ao, CASE WHEN n_chars % 5 <> 0 THEN n_chars END AS md, CASE WHEN n_chars % 4 <> 0 THEN CAST(n_chars AS VARCHAR) END AS sm, CASE WHEN c2 >= 2 THEN k END AS g, coalesce(CASE WHEN c2 >= 2 THEN l END, '') AS lb,
  CASE WHEN n_chars % 3 <> 0 THEN n_chars::DOUBLE END AS ss, n.file_id % 7 AS sq FROM names n JOIN (SELECT *, count(*) OVER (PARTITION BY k) AS c2 FROM (SELECT file_id, regexp_replace(name, '_(Ch1|MIX)\\.wav$', '') AS k, regexp_extract(name, '_(Ch1|MIX)\\.wav$', 1) AS l FROM names)) t USING (file_id)),
f2 AS (SELECT *, CASE WHEN g IS NULL THEN ao ELSE min(ao) OVER (PARTITION BY g) END AS fa, CASE WHEN g IS NULL THEN ss ELSE min(ss) OVER (PARTITION BY g) END AS fs FROM f)"""
_ORDERS = {
    "add_order": "ao", "name": "lower(name)", "date": "md NULLS LAST", "metadata_date": "coalesce(sm, '')", "grouped": "g IS NULL, coalesce(g, lower(name)), lb",
    "grouped_added": "g IS NULL, fa, coalesce(g, ''), sq, lb", "date_grouped": "fs NULLS LAST, coalesce(g, ''), sq, lb",
}


def _order_query(mode, by):
    @query(f"file_order_{mode}", ctes(NAMES, ORD) + f"SELECT file_id, row_number() OVER (ORDER BY {by}, file_id) - 1 AS pos FROM f2")
    def run(spark, d):
        f = T.tracks(v.names(spark, d))
        n = F.col("n_chars")
        files = f.select(
            "file_id", "name", ((F.col("file_id") * 7919) % 100003).alias("add_order"), F.when(n % 5 != 0, n).alias("modified"), F.when(n % 4 != 0, n.cast("string")).alias("stamp"),
            F.col("track_key").alias("group_key"), "track_label", F.when(n % 3 != 0, n.cast("double")).alias("start_secs"), (F.col("file_id") % 7).alias("sequence_number"))
        return T.order_files(files, mode).select("file_id", "pos")

    return run


for _mode, _by in _ORDERS.items():
    _order_query(_mode, _by)


@query("shared_settings", "WITH g AS (SELECT event_id AS file_id, user_id % 40 AS grp, epoch_us(ts) AS ca, value, event_type FROM events), l AS (SELECT grp, arg_max(value, (ca, file_id)) AS value FROM g WHERE event_type <> 'click' GROUP BY 1) SELECT file_id, grp, l.value FROM g LEFT JOIN l USING (grp)")
def shared_settings(spark, d):
    ev = v.table(spark, d, "events").select(F.col("event_id").alias("file_id"), (F.col("user_id") % 40).alias("grp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("changed_at"), "value", "event_type")
    return T.share_settings(ev.where("event_type <> 'click'").select("file_id", "changed_at", "value"), ev.select("file_id", "grp"), "grp")


TP = """tp AS (SELECT id, 0 AS depth, [id] AS ids FROM tree WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM tree)
 UNION ALL SELECT t.id, depth + 1, list_append(ids, t.id) FROM tp JOIN tree t ON t.parent_id = tp.id)"""


@query("annotation_tree", ctes(TREE, TP) + "SELECT id, CAST(depth AS INTEGER) AS depth, array_to_string(ids, '/') AS path FROM tp")
def annotation_tree(spark, d):
    p = A.flatten(A.tree_paths(v.tree(spark, d)))
    return p.select("id", "depth", F.array_join(F.col("ids").cast("array<string>"), "/").alias("path"))


@query("annotation_descendants", ctes(TREE, TP) + "SELECT id, CAST(depth AS INTEGER) AS depth FROM tp WHERE list_contains(ids, 1001) AND id <> 1001")
def annotation_descendants(spark, d):
    return A.descendants(A.tree_paths(v.tree(spark, d)), 1001)


@query("annotation_moves", ctes(TREE, TP) + "SELECT m.id, np AS new_parent, NOT list_contains(coalesce(ids, []), m.id) AS allowed FROM (SELECT id, (id // 1000) * 1000 + (id * 7) % 5 AS np FROM tree) m LEFT JOIN tp ON tp.id = np")
def annotation_moves(spark, d):
    nodes = v.tree(spark, d)
    moves = nodes.select("id", (F.expr("id div 1000") * 1000 + (F.col("id") * 7) % 5).alias("new_parent"))
    return A.can_move(A.tree_paths(nodes), moves).select("id", "new_parent", "allowed")


@query("annotation_ungroup", ctes(TREE, "g AS (SELECT id, parent_id FROM tree WHERE id % 1000 IN (1))") + "SELECT t.id, CASE WHEN g.id IS NOT NULL THEN g.parent_id ELSE t.parent_id END AS parent_id FROM tree t LEFT JOIN g ON g.id = t.parent_id WHERE t.id % 1000 <> 1")
def annotation_ungroup(spark, d):
    nodes = v.tree(spark, d)
    return A.ungroup(nodes, nodes.where("id % 1000 = 1").select("id")).select("id", "parent_id")


@query("sibling_order", ctes(TREE) + "SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order NULLS LAST, created_at, id) - 1 AS pos FROM tree WHERE parent_id IS NOT NULL")
def sibling_order(spark, d):
    return A.renumber_siblings(v.tree(spark, d).where("parent_id IS NOT NULL"))


@query("annotation_merge", "WITH a AS (SELECT c_custkey AS id, c_name AS label FROM customer), b AS (SELECT s_suppkey + 1450 AS id, s_name AS label FROM supplier) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def annotation_merge(spark, d):
    a = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return A.merge_sets(a, v.table(spark, d, "supplier").select((F.col("s_suppkey") + 1450).alias("id"), F.col("s_name").alias("label")))


@query("project_fill_missing", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, s_name) AS noise_profile FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def project_fill_missing(spark, d):
    p = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("noise_profile"))
    return A.fill_missing(p, v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("noise_profile")), "id", ["noise_profile"])


@query("merge_history", "SELECT doc_id AS key, doc_id % 5 = 0 OR (n_chars <> 0 AND (source, n_chars) IN (SELECT source, n_chars FROM documents WHERE doc_id % 5 = 0)) AS was_merged FROM documents")
def merge_history(spark, d):
    side = v.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("filename"), F.col("n_chars").alias("file_size"))
    return A.already_merged(side.where("key % 5 = 0"), side).select("key", "was_merged")


@query("newest_copy", "WITH a AS (SELECT c_custkey AS id, c_name AS body, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_acctbal AS VARCHAR) END AS m FROM customer), b AS (SELECT o_orderkey AS id, o_orderpriority AS body, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS m FROM orders), j AS (SELECT coalesce(a.id, b.id) AS id, a.body AS ab, b.body AS bb, a.m AS am, b.m AS bm, a.id IS NULL OR (b.id IS NOT NULL AND b.m IS NOT NULL AND (a.m IS NULL OR b.m > a.m)) AS t FROM a FULL JOIN b ON a.id = b.id) SELECT id, CASE WHEN t THEN bb ELSE ab END AS body, CASE WHEN t THEN 'secondary' ELSE 'primary' END AS source FROM j")
def newest_copy(spark, d):
    c, o = v.table(spark, d, "customer"), v.table(spark, d, "orders")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal").cast("string")).alias("modified_at"))
    b = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("body"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("string")).alias("modified_at"))
    return A.newest_copy(a, b, "id", "body").select("id", "body", "source")


@query("next_labels", "WITH l AS (SELECT user_id AS file_id, CASE WHEN event_id % 3 = 0 THEN 'Region ' || event_id % 97 WHEN event_id % 3 = 1 THEN 'Region x' ELSE 'Marker 500' END AS label FROM events) SELECT file_id, 'Region ' || (coalesce(max(CAST(nullif(regexp_extract(label, '^Region (\\d+)$', 1), '') AS BIGINT)), 0) + 1) AS next_label FROM l GROUP BY 1")
def next_labels(spark, d):
    e = F.col("event_id")
    label = F.when(e % 3 == 0, F.concat(F.lit("Region "), (e % 97).cast("string"))).when(e % 3 == 1, "Region x").otherwise("Marker 500")
    return A.next_labels(v.table(spark, d, "events").select(F.col("user_id").alias("file_id"), label.alias("label")), ["file_id"], "Region")
