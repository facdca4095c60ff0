"""Timelines of recordings: placement, overlaps, sessions, sequences and tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.functions import text
from echolake.operators.intervals import interval_overlaps
from echolake.plans.chunking import div, ranked, running_last, running_max, running_sum

KEYS = ("timeline_id",)
BUCKET = 64.0


def _ordered(segs: DataFrame, width: float) -> DataFrame:
    return segs.withColumn("chunk", F.floor(F.col("start") / width)).withColumn("_o", F.struct("start", "seg_id"))


def place(segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Offsets on a common timeline: timed segments by their start, untimed ones queued after the last end."""
    keys = list(keys)
    timed = segs.where("start IS NOT NULL")
    ends = timed.groupBy(*keys).agg(F.min("start").alias("origin"), F.max(F.col("start") + F.col("dur")).alias("last"))
    untimed = running_sum(segs.where("start IS NULL").withColumn("chunk", div("seg_id", 4096)), keys, F.col("dur"), "upto", ["seg_id"]).drop("chunk")
    queued = untimed.join(ends, keys, "left").withColumn(
        "offset", F.greatest(F.coalesce(F.col("last") - F.col("origin"), F.lit(0.0)), F.lit(0.0)) + F.col("upto") - F.col("dur")
    )
    shown = timed.join(ends, keys).withColumn("offset", F.col("start") - F.col("origin"))
    cols = [*keys, "seg_id", "offset", "dur"]
    return shown.select(*cols).unionByName(queued.select(*cols))


def flag_overlaps(segs: DataFrame, width: float = BUCKET, keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments that overlap another: an earlier one ends after they start, or the next one starts before they end.

    Two scans in start order answer this without forming pairs.
    """
    keys = list(keys)
    rows = running_max(_ordered(segs, width), keys, F.col("start") + F.col("dur"), "before", "_o")
    back = rows.withColumn("chunk", -F.col("chunk")).withColumn("_o", F.struct(-F.col("start"), -F.col("seg_id")))
    both = running_last(back, keys, {"next_start": F.col("start")}, idx="_o", exclusive=True)
    hit = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_start") < F.col("start") + F.col("dur"), F.lit(False))
    return both.select(*keys, "seg_id", "start", "dur", hit.alias("has_overlap"))


def sessions(segs: DataFrame, max_gap: float = 60.0, width: float = BUCKET, keys: Sequence[str] = KEYS) -> DataFrame:
    """Continuous sequences: a segment opens a session when it starts more than ``max_gap`` after its predecessor's end."""
    keys = list(keys)
    rows = running_last(_ordered(segs, width), keys, {"prev_end": F.col("start") + F.col("dur")}, idx="_o", exclusive=True)
    opens = F.col("prev_end").isNull() | (F.col("start") - F.col("prev_end") > max_gap)
    heads = running_last(rows, keys, {"session": F.when(opens, F.col("seg_id"))}, idx="_o")
    return heads.select(*keys, "seg_id", (F.col("start") - F.col("prev_end")).alias("gap"), "session")


def segment_at(points: DataFrame, segs: DataFrame, width: float = BUCKET, keys: Sequence[str] = KEYS) -> DataFrame:
    """The earliest segment that holds each point(keys, point_id, t), and the position inside it.

    A segment that ends no later than one before it in order is never the answer. The rest have growing starts and ends, so a point's
    answer is the first of them that ends after it, if that has begun: one scan from the last end back finds it without forming pairs.
    """
    keys = list(keys)
    spans = segs.select(*keys, "seg_id", "start", (F.col("start") + F.col("dur")).alias("end")).where("end > start")
    single = spans.groupBy(*keys, "start", "end").agg(F.min("seg_id").alias("seg_id"))
    kept = running_max(_ordered(single, width), keys, F.col("end"), "before", "_o").where("before IS NULL OR end > before")
    ends = kept.select(*keys, F.col("end").alias("_t"), F.lit(1).alias("_kind"), F.struct("start", "seg_id").alias("_s"))
    asked = points.where("t IS NOT NULL").select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_kind"), "point_id")
    rows = asked.unionByName(ends, allowMissingColumns=True).withColumn("chunk", -F.floor(F.col("_t") / width)).withColumn("_o", F.struct(-F.col("_t"), F.col("_kind")))
    met = running_last(rows, keys, {"_hit": F.col("_s")}, idx="_o").where("_kind = 0 AND _hit.start <= _t").dropDuplicates([*keys, "point_id", "_t"])
    return met.select(*keys, "point_id", F.col("_hit.seg_id").alias("seg_id"), (F.col("_t") - F.col("_hit.start")).alias("inside"))


def in_range(segs: DataFrame, start: float, end: float) -> DataFrame:
    return segs.where((F.col("start") < end) & (F.col("start") + F.col("dur") > start))


def in_box(boxes: DataFrame, t0: float, t1: float, f0: float | None = None, f1: float | None = None) -> DataFrame:
    """Boxes that meet a time span and, where both are bounded, a frequency span."""
    cond = (F.col("time_start") < t1) & (F.col("time_end") > t0)
    if f1 is not None:
        cond &= F.coalesce(F.col("freq_low") < f1, F.lit(True))
    if f0 is not None:
        cond &= F.coalesce(F.col("freq_high") > f0, F.lit(True))
    return boxes.where(cond)


def _mean_length(spans: DataFrame, start: str, end: str) -> float:
    got = spans.agg(F.avg(F.when(F.col(end) > F.col(start), F.col(end) - F.col(start)))).first()[0]
    return float(got) if got and got < float("inf") else 0.0


def overlaps_by_region(regions: DataFrame, segs: DataFrame, width: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping (region, segment) pairs with the shared duration.

    Buckets are as wide as regions and segments are long on average: wider ones form pairs that lie far apart, narrower ones copy rows.
    """
    a = regions.select(*keys, "region_id", "r_start", "r_end")
    b = segs.select(*keys, "seg_id", F.col("start").alias("s_start"), (F.col("start") + F.col("dur")).alias("s_end"))
    width = width or max(_mean_length(a, "r_start", "r_end"), _mean_length(b, "s_start", "s_end")) or BUCKET
    hits = interval_overlaps(a, b, keys, ("r_start", "r_end"), ("s_start", "s_end"), width)
    return hits.withColumn("shared", F.least("r_end", "s_end") - F.greatest("r_start", "s_start"))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def tracks(files: DataFrame) -> DataFrame:
    """Multitrack key and label of files(file_id, name); groups of one are dropped."""
    parsed = files.withColumn("_t", text.track_group("name"))
    sizes = parsed.where("_t IS NOT NULL").groupBy(F.col("_t.key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    joined = parsed.withColumn("_k", F.col("_t.key")).join(sizes, "_k", "left")
    grouped = F.col("_n").isNotNull()
    return joined.select(*files.columns, F.when(grouped, F.col("_k")).alias("track_key"), F.when(grouped, F.col("_t.label")).alias("track_label"))


def sequences(files: DataFrame) -> DataFrame:
    """Sequence prefix, number and gap to the previous file of files(file_id, name, start_secs, dur)."""
    tracked = tracks(files)
    base = F.coalesce(_or_null(F.regexp_extract(text.stem("name"), text.TRACK, 1)), F.substring_index(text.stem("name"), " ", 1))
    parsed = tracked.withColumn("_b", base).withColumn("_s", text.sequence_number(F.col("_b"))).drop("_b").where("_s IS NOT NULL").select(
        "*", F.col("_s.prefix").alias("sequence_key"), F.col("_s.number").alias("sequence_number"), F.coalesce("track_label", F.lit("")).alias("track")
    ).drop("_s")
    keys = ["sequence_key", "track"]
    sizes = parsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    rows = parsed.join(sizes, keys).withColumn("chunk", div("sequence_number", 1024)).withColumn("_o", F.struct("sequence_number", "file_id"))
    linked = running_last(rows, keys, {"prev_end": F.col("start_secs") + F.col("dur")}, idx="_o", exclusive=True)
    return linked.select("file_id", *keys, "sequence_number", (F.col("start_secs") - F.col("prev_end")).alias("gap_secs"))


def order_files(files: DataFrame, mode: str) -> DataFrame:
    """Position of files(file_id, name, add_order, modified, stamp, start_secs, group_key, sequence_number, track_label).

    Grouped modes sort by the group's earliest member, found with one aggregate; missing dates come last.
    """
    low, no_group = F.lower("name"), F.col("group_key").isNull()
    seq, label = F.coalesce("sequence_number", F.lit(0)), F.coalesce("track_label", F.lit(""))
    tie = F.col("file_id")

    def earliest(value: Column) -> DataFrame:
        firsts = files.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(value).alias("_first"))
        return files.join(firsts, "group_key", "left").withColumn("_first", F.when(no_group, value).otherwise(F.col("_first")))

    plain = {
        "add_order": [F.col("add_order")], "name": [low], "date": [F.col("modified").asc_nulls_last()], "metadata_date": [F.coalesce("stamp", F.lit(""))],
        "grouped": [no_group, F.coalesce("group_key", low), label],
    }
    if mode in plain:
        return ranked(files, [], [*plain[mode], tie])
    if mode == "grouped_added":
        return ranked(earliest(F.col("add_order")), [], [no_group, F.col("_first"), F.coalesce("group_key", F.lit("")), seq, label, tie]).drop("_first")
    if mode == "date_grouped":
        return ranked(earliest(F.col("start_secs")), [], [F.col("_first").asc_nulls_last(), F.coalesce("group_key", F.lit("")), seq, label, tie]).drop("_first")
    raise ValueError(f"unknown file order {mode}")


def share_settings(changes: DataFrame, files: DataFrame, group_key: str) -> DataFrame:
    """Latest value per group from changes(file_id, changed_at, value), spread over files(file_id, group_key)."""
    keyed = changes.join(files.select("file_id", group_key), "file_id").where(F.col(group_key).isNotNull())
    latest = keyed.groupBy(group_key).agg(F.max_by("value", F.struct("changed_at", "file_id")).alias("value"))
    return files.join(latest, group_key, "left").select("file_id", group_key, "value")
