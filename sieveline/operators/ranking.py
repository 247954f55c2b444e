"""Ranks and running sums over all rows, without a window that takes them all to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut

#: Place of the partition number in monotonically_increasing_id().
_SHIFT = 33


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name in sums, the total of its value over the rows before them.

    Rows are dealt to ranges of ``order``, which must be a total one, and
    written; totals of the ranges before (a row for each range) are added to
    the running sums within a range.  Nulls count as 0.
    """
    rows = df.withColumns({f"_sum_of{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())})
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", _SHIFT))
    per = rows.groupBy("_part").agg(*[F.sum(f"_sum_of{i}").alias(f"_sum_in{i}") for i in range(len(sums))])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.select("_part", *[F.coalesce(F.sum(f"_sum_in{i}").over(w), F.lit(0)).alias(f"_sum_to{i}") for i in range(len(sums))])
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(per), "_part")
    out = out.withColumns({name: F.col(f"_sum_to{i}") + F.coalesce(F.sum(f"_sum_of{i}").over(own), F.lit(0)) for i, name in enumerate(sums)})
    return out.drop("_part", "_at", *[f"_sum_{c}{i}" for c in ("of", "to") for i in range(len(sums))])


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The rows with their place in the order, from 1."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) + 1)
