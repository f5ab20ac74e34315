"""Neighbours in an order, for keys of any number of rows.

A window partitioned by a key puts all rows of the key in one task. Here rows
are dealt in ranges of (key, order), windows run within a key's part of a range,
and what must pass from one part to the next is one row a part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.tables import staged


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with _part, stored: equal (by, order) share a part, and parts follow the order."""
    return staged(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def _joined(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    keyed = edges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_kp"), *[c for c in edges.columns if c not in (*by, "_part")])
    same: Column = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_kp"))
    return rows.join(keyed, same)


def with_adjacent(rows: DataFrame, by: list[str], order: list[str], value: str, after: str = "next", before: str = "previous", wrap: bool = False) -> DataFrame:
    """``rows`` with the values of the following and the preceding row of each key; ``order`` must leave no ties.

    At the ends null, or with ``wrap`` the other end's value.
    """
    parts = dealt(rows, by, order)
    within = W.partitionBy(*by, "_part").orderBy(*order)
    held = F.struct(value)
    led = parts.withColumn("_after", F.lead(held).over(within)).withColumn("_before", F.lag(held).over(within))
    key = F.struct(*order)
    edges = parts.groupBy(*by, "_part").agg(F.min_by(held, key).alias("_first"), F.max_by(held, key).alias("_last"))
    ring = W.partitionBy(*by).orderBy("_part")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follow, precede = F.lead("_first").over(ring), F.lag("_last").over(ring)
    if wrap:
        follow, precede = F.coalesce(follow, F.first("_first").over(whole)), F.coalesce(precede, F.last("_last").over(whole))
    edges = edges.withColumn("_follow", follow).withColumn("_precede", precede).drop("_first", "_last")
    found = _joined(led, edges, by)
    return found.select(*rows.columns, F.coalesce("_after", "_follow")[value].alias(after), F.coalesce("_before", "_precede")[value].alias(before))


def with_last(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last value that isn't null up to each row."""
    parts = dealt(rows.withColumn("_v", value), by, order)
    upto = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = parts.withColumn("_own", F.last("_v", ignorenulls=True).over(upto))
    ends = parts.groupBy(*by, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_came", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    return _joined(carried, ends, by).select(*rows.columns, F.coalesce("_own", "_came").alias(name))
