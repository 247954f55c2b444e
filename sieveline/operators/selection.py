"""Filters, ranks and samples that pick rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stable_order
from .ranking import ranked


def single_row_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter("_n = 1").drop("_n")


def qualified(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows for which every condition is true; unknown is not true."""
    out = df
    for c in conditions:
        out = out.filter(c)  # as it is, so that the scan can take it
    return out


def tiered(df: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first tier whose key set has a row's key; rows in none are dropped."""
    marks = None
    for i, (name, keys) in enumerate(tiers):
        one = keys.select(key).distinct().select(key, F.struct(F.lit(i).alias("i"), F.lit(name).alias("tier")).alias("m"))
        marks = one if marks is None else marks.unionByName(one)
    return df.join(marks.groupBy(key).agg(F.min("m").alias("m")), key).withColumn("tier", F.col("m.tier")).drop("m")


def round_robin(df: DataFrame, group: str, order: list, limit: int, tier: str | None = None) -> DataFrame:
    """Take every group's first row, then every group's second, ... until limit; lower tiers first."""
    by = [tier, group] if tier else [group]
    ranked = df.withColumn("depth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked.orderBy(*([tier] if tier else []), "depth", group).limit(limit)


def largest_remainder(groups: DataFrame, weight: str, key: str, total: int) -> DataFrame:
    """Whole shares of total in proportion to weight: floors first, then the largest fractions (ties by key)."""
    all_ = groups.agg(F.sum(weight).alias("_all"))
    share = F.col(weight) * F.lit(total) / F.col("_all")
    parts = groups.crossJoin(F.broadcast(all_)).withColumn("_f", F.floor(share)).withColumn("_r", F.round(share - F.col("_f"), 9))
    left = parts.agg((F.lit(total) - F.sum("_f")).alias("_left"))
    turn = ranked(parts, [F.desc("_r"), F.col(key)], "_turn").crossJoin(F.broadcast(left))  # one row
    return turn.select(key, (F.col("_f") + (F.col("_turn") <= F.col("_left")).cast("int")).cast("bigint").alias("n"))


def stable_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the same in every engine and partitioning."""
    return df.orderBy(stable_order(F.col(key), seed), key).limit(n)


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def first_source_wins(df: DataFrame, key: list[str], priority: str, strict: bool = True, tie: str | None = None) -> DataFrame:
    """Rows of the first source that has a key; strict keeps one row of it, else its own repeats survive."""
    w = Window.partitionBy(*key).orderBy(priority, *([tie] if strict and tie else []))
    rank = F.row_number() if strict else F.dense_rank()
    return df.withColumn("_r", rank.over(w)).filter("_r = 1").drop("_r")


def appearance_codes(df: DataFrame, value: str, position: str) -> DataFrame:
    """Codes 0, 1, ... of values in the order in which they first appear."""
    first = df.groupBy(value).agg(F.min(position).alias("first"))
    return ranked(first, [F.col("first"), F.col(value)], "code").select(value, (F.col("code") - 1).alias("code"))


def offsets(df: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """Where each row's slice begins if slices of a group lie one after another."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def top_member(df: DataFrame, by: str, index: str) -> DataFrame:
    """The index with the most rows in each group; the smallest of equals."""
    n = df.groupBy(by, index).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by(index, F.struct(F.col("n"), -F.col(index))).alias(index), F.max("n").alias("n"))
