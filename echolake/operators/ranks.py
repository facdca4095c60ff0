"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a value's order-preserving form that each round of a selection looks at, from the high end.
ROUNDS = (22, 21, 21)


def _order_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values; negative zero counts as zero."""
    if values.dtype.kind in "iu":
        return values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    bits = (values.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _cells(df: DataFrame, keys: list[str], value: str, seen: int, width: int) -> DataFrame:
    """Rows per group and cell (the next `width` bits), among values that begin with the `seen` bits in `_cell`; each batch is counted before the shuffle.

    `value` may be an array; `_want` and `_n` go along.
    """
    kind = df.schema[value].dataType
    listed = isinstance(kind, T.ArrayType)
    kind = kind.elementType if listed else kind
    along = ["_want", "_n"] if seen else []
    longs = [T.StructField(c, T.LongType()) for c in [*along, "_next", "_k"]]
    schema = T.StructType([*[df.schema[k] for k in keys], *longs, T.StructField("_x", kind)])
    shift = 64 - seen - width

    def count(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if listed:
                lists = batch.column(value)
                t = t.select([*keys, *(["_cell", *along] if seen else [])]).take(pc.list_parent_indices(lists)).append_column(value, lists.flatten())
            t = t.filter(pc.is_valid(t[value]))
            bits = _order_bits(t[value].to_numpy())
            if seen:
                own = (bits >> np.uint64(64 - seen)).view(np.int64) == t["_cell"].to_numpy()
                t, bits = t.filter(pa.array(own)), bits[own]
            t = t.select([*keys, *along, value]).append_column("_next", pa.array((bits >> np.uint64(shift)).view(np.int64)))
            sums = t.group_by([*keys, *along, "_next"]).aggregate([([], "count_all"), (value, "min")])
            sums = sums.rename_columns([{"count_all": "_k", f"{value}_min": "_x"}.get(c, c) for c in sums.column_names])
            yield from sums.select(schema.names).to_batches()

    counted = df.select(*keys, value, *(["_cell", *along] if seen else [])).mapInArrow(count, schema)
    return counted.groupBy(*keys, *along, "_next").agg(F.sum("_k").alias("_k"), F.min("_x").alias("_x"))


def nth_smallest(df: DataFrame, keys: Sequence[str], value: str, rank: Column, out: str, count: str | None = None) -> DataFrame:
    """Exact 0-based ``rank`` (an expression over column ``n``, the group size) of ``value`` (a column or array of numbers) per group; ``count`` also keeps
    that size.

    Radix selection: each round counts the next bits of the values that still fit, so tasks exchange counts of cells only, and a group of any size
    comes down to a few thousand of them. Nulls and groups without a key are left out.
    """
    keys = list(keys)
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    found, seen = None, 0
    for width in ROUNDS:
        source = df if found is None else df.join(found.drop("_x"), keys)
        cells = _cells(source, keys, value, seen, width)
        kind = cells.schema["_x"].dataType.simpleString()
        seen += width
        ordered = F.col("_next").bitwiseXOR(F.lit(-(1 << 63))) if seen == 64 else F.col("_next")  # all 64 bits are an unsigned number
        along = [F.first(c).alias(c) for c in ("_want", "_n")] if found is not None else [F.sum("_k").alias("n")]
        lists = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ordered.alias("o"), F.col("_next").alias("cell"), F.col("_k").alias("k"), F.col("_x").alias("x")))).alias("_c"), *along)
        if found is None:
            lists = lists.withColumn("_want", rank.cast("long")).withColumnRenamed("n", "_n")
        pick = F.expr(
            f"aggregate(_c, named_struct('seen', 0L, 'cell', CAST(NULL AS BIGINT), 'x', CAST(NULL AS {kind}), 'hit', false), (s, c) -> CASE WHEN s.hit THEN s "
            "WHEN s.seen + c.k > _want THEN named_struct('seen', s.seen, 'cell', c.cell, 'x', c.x, 'hit', true) "
            "ELSE named_struct('seen', s.seen + c.k, 'cell', s.cell, 'x', s.x, 'hit', false) END)")
        found = lists.select(*keys, "_want", "_n", pick.alias("_p")).where("_p.hit") \
            .select(*keys, F.col("_p.cell").alias("_cell"), (F.col("_want") - F.col("_p.seen")).alias("_want"), "_n", F.col("_p.x").alias("_x"))
    return found.select(*keys, *([F.col("_n").alias(count)] if count else []), F.col("_x").alias(out))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return nth_smallest(df, keys, value, F.expr("n div 2"), out)


def best_per_group(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str], largest: bool = True) -> DataFrame:
    """The row with the largest (smallest) order key per group, as a map-side-combined aggregate instead of a sort."""
    pick = F.max_by if largest else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*columns), order).alias("_p"))
    return picked.select(*keys, "_p.*")
