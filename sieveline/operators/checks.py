"""A data-quality suite: each check is one aggregate row (check, passed, observed); claims compare figures with what was quoted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(name: str, observed: DataFrame, passed: Column) -> DataFrame:
    """observed has one row with a column observed."""
    return observed.select(F.lit(name).alias("check"), passed.alias("passed"), F.col("observed").cast("double").alias("observed"))


def measured(name: str, observed: DataFrame, passed: Column) -> DataFrame:
    """A check of what was measured: one row with a column observed, and others that the test may use."""
    return _row(name, observed, F.coalesce(passed, F.lit(False)))


def pattern_check(name: str, df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Every value that is there has the pattern as a whole."""
    return count_check(name, df, ~F.col(column).rlike(f"^(?:{pattern})$"))


def same_keys_check(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables have the same keys."""
    both = a.select(key, F.lit(1).alias("_a")).distinct().join(b.select(key, F.lit(1).alias("_b")).distinct(), key, "full")
    return _row(name, both.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("observed")), F.col("observed") == 0)


def count_check(name: str, df: DataFrame, bad: Column, most: int = 0) -> DataFrame:
    """At most so many rows may be bad."""
    return _row(name, df.agg(F.count_if(bad).alias("observed")), F.col("observed") <= most)


def unique_check(name: str, df: DataFrame, key: list[str]) -> DataFrame:
    return _row(name, df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("observed")), F.col("observed") == 0)


def reference_check(name: str, df: DataFrame, key: str, to: DataFrame, to_key: str) -> DataFrame:
    """Every key is in the other table."""
    return _row(name, df.select(key).distinct().join(to.select(F.col(to_key).alias(key)), key, "left_anti").agg(F.count("*").alias("observed")), F.col("observed") == 0)


def disjoint_check(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _row(name, a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count("*").alias("observed")), F.col("observed") == 0)


def constant_check(name: str, df: DataFrame, column: str) -> DataFrame:
    return _row(name, df.agg(F.count_distinct(column).alias("observed")), F.col("observed") == 1)


def vocabulary_check(name: str, df: DataFrame, column: str, words: list[str]) -> DataFrame:
    return count_check(name, df, ~F.coalesce(F.col(column).isin(words), F.lit(False)))


def schema_check(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    same = [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    return a.sparkSession.createDataFrame([(name, same, float(same))], "check string, passed boolean, observed double")


def suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


@dataclass(frozen=True)
class Claim:
    section: str
    name: str
    quoted: float
    tolerance: float = 0.0


def claims_report(figures: DataFrame, claims: list[Claim]) -> DataFrame:
    """figures: name, value.  A claim is reproduced within its tolerance, exactly if that is 0; one without a figure is manual."""
    spark = figures.sparkSession
    rows = spark.createDataFrame([(c.section, c.name, float(c.quoted), float(c.tolerance)) for c in claims], "section string, name string, quoted double, tolerance double")
    out = rows.join(figures.select("name", F.col("value").cast("double").alias("value")), "name", "left")
    status = F.when(F.col("value").isNull(), "manual").when(F.abs(F.col("value") - F.col("quoted")) <= F.col("tolerance"), "pass").otherwise("fail")
    return out.select("section", "name", "quoted", "value", status.alias("status"))


def null_census(df: DataFrame) -> DataFrame:
    """(column, populated, total) for every column, in one pass."""
    one = df.agg(F.count("*").alias("_total"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return one.select("_total", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("populated")) for c in df.columns]))).select("column", "populated", F.col("_total").alias("total"))
