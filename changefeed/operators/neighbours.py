"""Next and previous row of a group, without sorting a whole group in one task.

A plain ``lead`` over a hot group puts that group into one task. Here each group is cut
into buckets of its order value; rows look at their neighbours inside a bucket, to which the
nearest row of the next bucket is added as a guest. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column, into: str, forward: bool) -> DataFrame:
    carried = [*order, *[v for v in values if v not in order]]
    rows = df.withColumn("__b", bucket)

    # The row of each bucket that faces the bucket before (or after) it.
    outermost = F.min if forward else F.max
    group = rows.groupBy(*keys, "__b")
    if len(carried) == 1:  # a plain number aggregates in place, a struct would be sorted
        ends = group.agg(outermost(carried[0]).alias(carried[0]))
    else:
        ends = group.agg(outermost(F.struct(*carried)).alias("__end")).select(*keys, "__b", "__end.*")

    # It joins the neighbouring bucket as one extra row, so a window per bucket sees across the border.
    between = W.partitionBy(*keys).orderBy("__b")
    neighbour = (F.lag if forward else F.lead)("__b").over(between)
    guests = ends.withColumn("__b", neighbour).filter(F.col("__b").isNotNull()).withColumn("__guest", F.lit(True))

    step = F.lead if forward else F.lag
    inside = W.partitionBy(*keys, "__b").orderBy(*order)
    seen = rows.unionByName(guests, allowMissingColumns=True)
    linked = seen.withColumn(into, step(F.struct(*carried)).over(inside))
    return linked.filter(F.col("__guest").isNull()).drop("__b", "__guest")


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column, into: str = "next") -> DataFrame:
    """Add a struct of the following row's ``order`` and ``values`` columns (null for the last).

    ``bucket`` must be set and must not decrease along ``order``.
    """
    return _neighbour(df, keys, order, values, bucket, into, True)


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column, into: str = "previous") -> DataFrame:
    """Add a struct of the preceding row's ``order`` and ``values`` columns (null for the first)."""
    return _neighbour(df, keys, order, values, bucket, into, False)
