"""Interval and point joins keyed by time buckets, so no pair outside a shared bucket is ever formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def spread(df: DataFrame, start: Column, end: Column, width: float, out: str = "_bucket") -> DataFrame:
    """One row per time bucket an interval touches."""
    return df.withColumn(out, F.explode(F.sequence(bucket_of(start, width), bucket_of(end, width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str,
                        width: float, closed: bool = True) -> DataFrame:
    """Pairs with start <= t <= end (or < end); a point sits in one bucket, an interval in each it touches."""
    left = points.withColumn("_bucket", bucket_of(F.col(t), width))
    right = spread(intervals, F.col(start), F.col(end), width)
    inside = (F.col(t) >= F.col(start)) & ((F.col(t) <= F.col(end)) if closed else (F.col(t) < F.col(end)))
    return left.join(right, [*keys, "_bucket"]).where(inside).drop("_bucket")


def interval_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], l_span: tuple[str, str],
                      r_span: tuple[str, str], width: float) -> DataFrame:
    """Half-open overlaps ls < re and rs < le; each pair is formed in the first bucket both touch."""
    (ls, le), (rs, re_) = l_span, r_span
    a = spread(left, F.col(ls), F.col(le), width)
    b = spread(right, F.col(rs), F.col(re_), width)
    first = F.greatest(bucket_of(F.col(ls), width), bucket_of(F.col(rs), width))
    return (
        a.join(b, [*keys, "_bucket"])
        .where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col("_bucket") == first))
        .drop("_bucket")
    )
