"""Annotation sets: merging, trees, boxes and labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.operators.columns import total
from echolake.operators.intervals import points_in_intervals
from echolake.plans.chunking import ranked
from echolake.session import materialize, stored


def merge_sets(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Append what is new; the existing row wins on a shared id, and the first one within each side."""
    ranked_ = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    columns = existing.columns
    first = ranked_.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_side", *[c for c in columns if c != key])).alias("_r"))
    return first.select("_r.*")


def fill_missing(project: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Take incoming values only where the project has none."""
    other = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return project.join(other, key, "left").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def already_merged(history: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars(key, filename, file_size) flagged if merged before, by key or by stable name and size."""
    by_key = history.select("key").distinct().withColumn("_a", F.lit(True))
    by_name = history.where("file_size <> 0").select("filename", "file_size").distinct().withColumn("_b", F.lit(True))
    joined = sidecars.join(by_key, "key", "left").join(by_name, ["filename", "file_size"], "left")
    return joined.select(*sidecars.columns, (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("was_merged"))


def newest_copy(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """The newer of two stores' copies; ties and missing times keep the primary one."""
    a = primary.select(key, F.col(value).alias("_v1"), F.col("modified_at").alias("_m1"), F.lit(True).alias("_h1"))
    b = secondary.select(key, F.col(value).alias("_v2"), F.col("modified_at").alias("_m2"), F.lit(True).alias("_h2"))
    newer = F.col("_m2").isNotNull() & (F.col("_m1").isNull() | (F.col("_m2") > F.col("_m1")))
    take = F.col("_h1").isNull() | (F.col("_h2").isNotNull() & newer)
    return a.join(b, key, "full_outer").select(
        key, F.when(take, F.col("_v2")).otherwise(F.col("_v1")).alias(value), F.when(take, F.col("_m2")).otherwise(F.col("_m1")).alias("modified_at"),
        F.when(take, "secondary").otherwise("primary").alias("source"),
    )


def check_acyclic(nodes: DataFrame) -> int:
    """The rounds of pointer doubling that reach every root; a ValueError if parents form a cycle. Only ids are moved."""
    known = nodes.select(F.col("id").alias("up"))
    rows = materialize(nodes.select("id", F.col("parent_id").alias("up")).join(known, "up").select("id", "up"))
    most = max(nodes.count(), 1).bit_length() + 1
    for done in range(most + 1):
        if rows.limit(1).count() == 0:
            return done
        rows = materialize(rows.join(rows.select(F.col("id").alias("up"), F.col("up").alias("_up2")), "up").select("id", F.col("_up2").alias("up")))
    raise ValueError("annotation parents form a cycle")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Sortable root path and depth of nodes(id, parent_id, sort_order, created_at); unknown parents make roots.

    Paths double in length each round, so a tree of depth d needs log2(d) joins. Cycles are found on ids alone, before paths grow.
    """
    rounds = check_acyclic(nodes)
    known = nodes.select(F.col("id").alias("_p"), F.lit(True).alias("_k"))
    step = F.struct(
        F.col("sort_order").isNull().alias("unsorted"), F.coalesce("sort_order", F.lit(0.0)).alias("sort_order"), "created_at", "id"
    )
    rows = materialize(
        nodes.join(known, F.col("parent_id") == F.col("_p"), "left")
        .select("id", F.when(F.col("_k"), F.col("parent_id")).alias("up"), F.array(step).alias("path"))
    )
    for _ in range(rounds):
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up2"), F.col("path").alias("_above"))
        rows = materialize(
            rows.join(above, "up", "left").select(
                "id", F.col("_up2").alias("up"), F.concat(F.coalesce("_above", F.array().cast(rows.schema["path"].dataType)), "path").alias("path")
            )
        )
    return rows.select("id", (F.size("path") - 1).alias("depth"), F.transform("path", lambda s: s["id"]).alias("ids"), "path")


def flatten(paths: DataFrame) -> DataFrame:
    """Depth-first order: a distributed sort by path."""
    return paths.orderBy("path").select("id", "depth", "ids")


def descendants(paths: DataFrame, node: int) -> DataFrame:
    return paths.where(F.array_contains("ids", node) & (F.col("id") != node)).select("id", "depth")


def can_move(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """Whether moves(id, new_parent) keep the tree a tree: not under the node itself or its descendants."""
    target = paths.select(F.col("id").alias("new_parent"), F.col("ids").alias("_ids"))
    return moves.join(target, "new_parent", "left").select("id", "new_parent", (~F.array_contains(F.coalesce("_ids", F.array()), F.col("id"))).alias("allowed"))


def ungroup(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Remove groups(id) and lift their children to the group's own parent."""
    lifted = groups.join(nodes.select("id", "parent_id"), "id").select(F.col("id").alias("parent_id"), F.col("parent_id").alias("_up"), F.lit(True).alias("_g"))
    kept = nodes.join(groups.select("id"), "id", "left_anti").join(lifted, "parent_id", "left")
    return kept.withColumn("parent_id", F.when(F.col("_g"), F.col("_up")).otherwise(F.col("parent_id"))).drop("_up", "_g").select(*nodes.columns)


def renumber_siblings(nodes: DataFrame) -> DataFrame:
    order = [F.col("sort_order").asc_nulls_last(), F.col("created_at"), F.col("id")]
    return ranked(nodes, ["parent_id"], order).select("id", "parent_id", "pos")


def next_labels(annotations: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """"Prefix N" with the next free N over annotations(keys, label)."""
    number = F.regexp_extract("label", rf"^{prefix}\s*(\d+)$", 1).try_cast("long")
    return annotations.groupBy(*keys).agg(
        F.concat(F.lit(f"{prefix} "), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_label")
    )


def box_energy(boxes: DataFrame, columns: DataFrame, hz_per_bin: float, keys: Sequence[str], width: float = 0.25) -> DataFrame:
    """Columns, energy and peak magnitude inside each box(keys, box_id, time_start, time_end, freq_low, freq_high).

    Columns are matched by time; the frequency bounds cut the array, so cells are never exploded.
    """
    hits = points_in_intervals(columns.select(*keys, "t", "mags"), boxes, keys, "t", "time_start", "time_end", width)
    n = F.size("mags")
    lo = F.greatest(F.ceil(F.coalesce("freq_low", F.lit(0.0)) / hz_per_bin), F.lit(0)).cast("int")
    hi = F.least(F.floor(F.coalesce(F.col("freq_high") / hz_per_bin, n - 1.0)), n - 1).cast("int")
    cut = F.slice("mags", lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
    return hits.groupBy(*keys, "box_id").agg(
        F.count(F.lit(1)).alias("columns"), F.sum(total(F.transform(cut, lambda m: m * m))).alias("energy"), F.max(F.array_max(cut)).alias("peak")
    )


TILE = 2048  # points that a tile is laid out for
PAIRS = 50_000  # of points and boxes that are compared at once
MOST_CUTS = 6  # a key's points are cut into at most 2 ** MOST_CUTS strips of time and as many bands of frequency


def smallest_box(points: DataFrame, boxes: DataFrame, max_hz: float, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """The box of least area around each point(keys, point_id, t, freq_hz).

    The points of a key are cut at quantiles of time and of frequency into tiles of about ``tile`` points. Of the boxes around all points of a tile only the
    first by area and id can be an answer there, and of those around some of them only the ones before that; what is left meets the tile's points in one
    task, which halves them and drops boxes likewise (``first_boxes``). A tile of many points, as where these coincide, is dealt to several tasks.
    Where quantiles lie changes the work and not the result. Tables by tile are stored first, so that small ones are broadcast and boxes need not be shuffled for them.
    """
    keys, steps = list(keys), 1 << MOST_CUTS
    cell = [*keys, "_strip", "_band"]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    asked = points.where("t IS NOT NULL AND freq_hz IS NOT NULL").where(known).select(*keys, "point_id", "t", "freq_hz")

    def every(quantiles: str, level: Column) -> Column:
        """The 2 ** level - 1 different cuts among the quantiles, fewer where these are equal."""
        return F.array_distinct(F.filter(quantiles, lambda _, i: (i + 1) % F.pow(F.lit(2.0), MOST_CUTS - level).cast("int") == 0))

    quantiles = [F.percentile_approx(c, [i / steps for i in range(1, steps)], 1000).alias(n) for c, n in (("t", "_qt"), ("freq_hz", "_qf"))]
    many = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *quantiles).where(F.col("_n") > tile)
    levels = F.ceil(F.log2(F.col("_n") / tile)).cast("int")
    many = many.withColumn("_lt", F.least(F.ceil(levels / 2).cast("int"), F.lit(MOST_CUTS))).withColumn("_lf", F.least(F.floor(levels / 2).cast("int"), F.lit(MOST_CUTS)))
    cuts = stored(many.select(*keys, every("_qt", F.col("_lt")).alias("_qt"), every("_qf", F.col("_lf")).alias("_qf")), "box-cuts")

    def place(value: str, quantiles: str) -> Column:
        return F.coalesce(F.size(F.filter(F.coalesce(quantiles, F.array().cast("array<double>")), lambda q: q <= F.col(value))), F.lit(0))

    placed = asked.join(cuts, keys, "left").select(*asked.columns, place("t", "_qt").alias("_strip"), place("freq_hz", "_qf").alias("_band"))
    tiles = stored(placed.groupBy(*cell).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.min("freq_hz").alias("_f0"), F.max("freq_hz").alias("_f1"),
                                               F.ceil(F.count(F.lit(1)) / (4 * tile)).cast("int").alias("_deals")), "box-tiles")
    spans = boxes.where(known).select(*keys, "box_id", F.col("time_start").alias("_a"), F.col("time_end").alias("_b"),
                                      F.coalesce("freq_low", F.lit(0.0)).alias("_lo"), F.coalesce("freq_high", F.lit(max_hz)).alias("_hi")).where("_a <= _b AND _lo <= _hi")
    area = (F.col("_b") - F.col("_a")) * (F.col("_hi") - F.col("_lo"))
    box = ["_a", "_b", "_lo", "_hi", "_first"]
    sized = spans.withColumn("_first", F.struct(area.alias("area"), F.col("box_id"))).join(cuts, keys, "left").select(
        *keys, *box, F.sequence(place("_a", "_qt"), place("_b", "_qt")).alias("_strips"), F.sequence(place("_lo", "_qf"), place("_hi", "_qf")).alias("_bands"))
    laid = sized.select(*keys, *box, "_bands", F.explode("_strips").alias("_strip")).select(*keys, *box, "_strip", F.explode("_bands").alias("_band"))
    met = laid.join(tiles, cell).where("_a <= _t1 AND _b >= _t0 AND _lo <= _f1 AND _hi >= _f0")
    whole = F.expr("_a <= _t0 AND _b >= _t1 AND _lo <= _f0 AND _hi >= _f1")
    best = stored(met.where(whole).groupBy(*cell).agg(F.min("_first").alias("_best")), "box-best")
    part = met.where(~whole).join(best, cell, "left").where("_best IS NULL OR _first < _best").groupBy(*cell, "_a", "_b", "_lo", "_hi").agg(F.min("_first").alias("_first"))
    group = [*cell, "_deal"]
    offers = part.unionByName(best.withColumnRenamed("_best", "_first"), allowMissingColumns=True).join(tiles.select(*cell, "_deals"), cell)
    offers = offers.select(*cell, F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"), "_a", "_b", "_lo", "_hi", F.col("_first.area").alias("area"), F.col("_first.box_id").alias("box_id"))
    dealt = placed.join(tiles.select(*cell, "_deals"), cell).select(*cell, F.pmod(F.xxhash64("point_id"), "_deals").cast("int").alias("_deal"), "point_id", "t", "freq_hz")

    def meet(own: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by([("area", "ascending"), ("box_id", "ascending")])
        values = [own.column(c).to_numpy().astype(float) for c in ("t", "freq_hz")]
        spans = [found.column(c).to_numpy().astype(float) for c in ("_a", "_b", "_lo", "_hi")]
        spans = [np.where(np.isnan(c), end, c) for c, end in zip(spans, (-np.inf, np.inf, -np.inf, np.inf))]  # the one around all points comes without bounds
        at = first_boxes(*values, *spans)
        hit = pa.array(np.flatnonzero(at < found.num_rows))
        box = found.select(["area", "box_id"]).take(pa.array(at[at < found.num_rows]))
        return pa.table([*own.select([*keys, "point_id"]).take(hit).columns, *box.columns], names=[*keys, "point_id", "area", "box_id"])

    fields = [*[placed.schema[c] for c in (*keys, "point_id")], T.StructField("area", T.DoubleType()), offers.schema["box_id"]]
    hits = dealt.groupBy(*group).cogroup(offers.groupBy(*group)).applyInArrow(meet, T.StructType(fields))
    return hits.groupBy(*keys, "point_id").agg(F.min(F.struct("area", "box_id")).alias("_f")).select(*keys, "point_id", F.col("_f.box_id").alias("box_id"))


def first_boxes(t: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The number of the first box [a, b] x [lo, hi] around each point, or the count of boxes.

    Points are halved at medians; a half keeps the boxes that touch it, up to the first one around all of it, until few pairs are left.
    """
    out = np.full(len(t), len(a))
    todo = [(np.arange(len(t)), np.arange(len(a)), len(a), True)]
    while todo:
        own, boxes, last, by_time = todo.pop()
        if not len(own):
            continue
        x, y = t[own], f[own]
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        boxes = boxes[(a[boxes] <= x1) & (b[boxes] >= x0) & (lo[boxes] <= y1) & (hi[boxes] >= y0)]
        whole = np.flatnonzero((a[boxes] <= x0) & (b[boxes] >= x1) & (lo[boxes] <= y0) & (hi[boxes] >= y1))
        if len(whole):
            last, boxes = boxes[whole[0]], boxes[: whole[0]]
        if not len(boxes):
            out[own] = last
        elif len(own) * len(boxes) <= PAIRS:
            met = (a[boxes, None] <= x) & (b[boxes, None] >= x) & (lo[boxes, None] <= y) & (hi[boxes, None] >= y)
            first = met.argmax(0)
            out[own] = np.where(met[first, np.arange(len(own))], boxes[first], last)
        else:  # points that coincide have boxes around all of them only, so some differ here
            by_time = x0 < x1 and (by_time or y0 == y1)
            v = x if by_time else y
            middle = np.partition(v, len(v) // 2)[len(v) // 2]
            left = v < middle if middle > v.min() else v <= middle
            todo += [(own[left], boxes, last, not by_time), (own[~left], boxes, last, not by_time)]
    return out
