"""Entity resolution: joins that state what they expect, and reports on how sources agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JoinError(ValueError):
    """Sources do not agree, or a key isn't unique where it must be."""


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that fails as it runs if the key repeats on either side: no separate pass over the inputs."""
    a = left.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in left.columns if c != key])
    b = right.groupBy(key).agg(F.count("*").alias("_m"), *[F.first(c).alias(c) for c in right.columns if c != key])
    out = a.join(b, key, how)
    ok = (F.coalesce("_n", F.lit(1)) == 1) & (F.coalesce("_m", F.lit(1)) == 1)
    return out.filter(F.assert_true(ok, F.concat(F.lit("key repeats: "), F.col(key).cast("string"))).isNull()).drop("_n", "_m")


def mapped(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """A lookup whose missing keys are an error as it runs."""
    out = df.join(lookup.select(key, value), key, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.raise_error(F.concat(F.lit("unmapped: "), F.col(key).cast("string"))).cast(lookup.schema[value].dataType)))


def fallback(df: DataFrame, key: str, sources: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """The first source that knows a key gives its value."""
    out = df
    for i, (s, c) in enumerate(sources):
        out = out.join(s.select(key, F.col(c).alias(f"_v{i}")), key, "left")
    names = [f"_v{i}" for i in range(len(sources))]
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def inconsistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one value in some column."""
    n = df.groupBy(key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return n.filter(" OR ".join(f"n_{c} > 1" for c in columns))


def agreement_report(joined: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Rows, and for each named pair of columns the share of rows where they agree (nulls agree with nulls)."""
    return joined.agg(F.count("*").alias("n"), *[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(name) for name, a, b in pairs])


def require_agreement(joined: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """The rows, or JoinError with the first disagreements."""
    for name, a, b in pairs:
        bad = joined.filter(~F.col(a).eqNullSafe(F.col(b))).limit(5).collect()
        if bad:
            raise JoinError(f"{name}: {bad}")
    return joined


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How often keys recur: distinct keys, singletons and their share, most and median rows, rows whose key recurs."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("singletons"), F.avg((F.col("n") == 1).cast("int")).alias("singleton_share"),
        F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("recurring_rows"),
    )


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks; a null key is never matched."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return only_in(left, right, key).withColumn("side", F.lit("left")).unionByName(only_in(right, left, key).withColumn("side", F.lit("right")))


def difference(left: DataFrame, right: DataFrame, by: str, tasks: int) -> DataFrame:
    """Distinct rows of left that right lacks, nulls being alike, as EXCEPT gives them; dealt by a column to so many tasks, and by that column they stay."""
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False))).repartition(tasks, by)
    return both.groupBy(*left.columns).agg(F.bool_and("_left").alias("_left")).filter("_left").drop("_left")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def in_interval(points: DataFrame, spans: DataFrame, by: str, point: str) -> DataFrame:
    """Join points to the span [offset, offset + size) of their group that holds them, by equality on the group and a range."""
    return points.join(spans, by).filter((F.col(point) >= F.col("offset")) & (F.col(point) < F.col("offset") + F.col("size")))


def remapped(predicted: DataFrame, deposited: DataFrame, tasks: int | None = None) -> DataFrame:
    """(system, chain, pos) to (system, row) by the chain's name, and whether a system's rows are a permutation of 0..n-1.

    predicted: system, chain, pos; deposited: system, chain, offset, size.
    Each shuffle is cut to so many tasks, by default as the session says.
    """
    dealt = lambda df, *c: df.repartition(tasks, *c) if tasks else df
    rows = dealt(predicted, "system", "chain").join(dealt(deposited, "system", "chain"), ["system", "chain"], "left").select("system", (F.col("offset") + F.col("pos")).alias("row"), (F.col("pos") < F.col("size")).alias("inside"))
    total = dealt(deposited, "system").groupBy("system").agg(F.sum("size").alias("n"))
    per = dealt(rows, "system").groupBy("system").agg(F.count("row").alias("rows"), F.count_distinct("row").alias("distinct_rows"), F.min("row").alias("low"), F.max("row").alias("high"), F.coalesce(F.bool_and("inside"), F.lit(False)).alias("inside"))
    ok = F.col("inside") & (F.col("rows") == F.col("n")) & (F.col("distinct_rows") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return per.join(total, "system").select("system", "rows", ok.alias("is_permutation"))


def consistency_report(base: DataFrame, key: str, sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(source, column, rows, known, agree, share): for every source and column, base's rows whose key it knows, and those it agrees on.

    Sources have the key once, and some of the columns; nulls agree with nulls.
    A source that has none of the columns, or a key twice, is an error.
    """
    out = None
    for name, source in sources.items():
        mine = [c for c in columns if c in source.columns]
        if not mine:
            raise JoinError(f"{name} has none of {columns}")
        twice = source.groupBy(key).count().filter("count > 1").limit(5).collect()
        if twice:
            raise JoinError(f"{name} has keys twice: {[r[key] for r in twice]}")
        s = source.select(key, F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in mine])
        both = base.join(s, key, "left").agg(F.count("*").alias("rows"), F.count("_known").alias("known"), *[F.count_if(F.col("_known") & F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"_{c}") for c in mine])
        one = both.select("rows", "known", F.inline(F.array(*[F.struct(F.lit(name).alias("source"), F.lit(c).alias("column"), F.col(f"_{c}").alias("agree")) for c in mine])))
        one = one.select("source", "column", "rows", "known", "agree", (F.col("agree") / F.nullif(F.col("known"), F.lit(0))).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def require_consistency(base: DataFrame, key: str, sources: dict[str, DataFrame], columns: list[str], complete: bool = True) -> DataFrame:
    """The report, or JoinError: every source agrees with base on all it knows, and, if complete, knows every row."""
    rows = consistency_report(base, key, sources, columns).collect()
    bad = [r.asDict() for r in rows if r["agree"] < r["known"] or (complete and r["known"] < r["rows"])]
    if bad:
        raise JoinError(f"sources disagree: {bad}")
    return base.sparkSession.createDataFrame(rows, "source string, column string, rows bigint, known bigint, agree bigint, share double")


def remap_problems(predicted: DataFrame, deposited: DataFrame) -> DataFrame:
    """(system, chain, problem) where chains can't be told by their names: unknown, repeated or lacking ones, and those whose length or sequence differs.

    Both: system, chain, sequence.
    """
    sides = []
    for df, c in ((predicted, "p"), (deposited, "d")):
        sides.append(df.groupBy("system", "chain").agg(F.count("*").alias(f"n_{c}"), F.first("sequence").alias(f"s_{c}")))
    both = sides[0].join(sides[1], ["system", "chain"], "full")
    rules = [
        ("unknown", F.col("n_d").isNull()), ("lacking", F.col("n_p").isNull()), ("repeated", (F.coalesce("n_p", F.lit(0)) > 1) | (F.coalesce("n_d", F.lit(0)) > 1)),
        ("length", F.length("s_p") != F.length("s_d")), ("sequence", ~F.col("s_p").eqNullSafe(F.col("s_d"))),
    ]
    problem = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])
    return both.select("system", "chain", problem.alias("problem")).filter("problem IS NOT NULL")
