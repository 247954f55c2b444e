"""Exact order statistics by refining counted ranges, so that no task keeps or sorts all values.

A group of bounded size is sorted as it is.  For a larger one, a round takes
splitters from the values between two bounds (an approximate sketch of bounded
size), counts the values at and between splitters, and goes on between the two
that enclose the wanted rank.  Splitters are values of the data, so each round
ends at one or leaves fewer values; counts are exact, so the result is too,
whatever the sketch says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut, removed

#: Values that are sorted in one place; and those of a group that percentile() may hold at once, some 25 MB.
SMALL, DIRECT = 10_000, 250_000
#: Splitters of a round, and the accuracy of the sketch that gives them.
SPLITTERS, ACCURACY = 64, 10_000


def order_statistics(rows: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), small: int | None = None) -> DataFrame:
    """(by, r, value): the r-th smallest x (from 0) for each target (by, r); rows: by, x, without nulls; a saved table."""
    small = SMALL if small is None else small
    key = [*by, "r"]
    with_ = lambda a, b: a.join(b, [*by]) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  # without groups, a few targets
    inside = "(low IS NULL OR x > low) AND (high IS NULL OR x < high)"
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    open_ = cut(with_(targets.select(*key), n).filter("r >= 0 AND r < n").select(*key, F.col("r").alias("k"), none.alias("low"), none.alias("high"), "n"))
    found: list[DataFrame] = []
    while not open_.isEmpty():
        few = with_(rows, open_.filter(F.col("n") <= small)).filter(inside)
        found.append(cut(few.groupBy(*key, "k").agg(F.sort_array(F.collect_list("x")).alias("_x")).select(*key, F.get("_x", F.col("k").cast("int")).alias("value"))))  # of at most small values
        many = cut(open_.filter(F.col("n") > small))
        if many.isEmpty():
            removed(open_, many)
            break
        between = with_(rows, many).filter(inside)
        split = between.groupBy(*key).agg(F.array_distinct(F.percentile_approx("x", [i / SPLITTERS for i in range(SPLITTERS + 1)], ACCURACY)).alias("v"))
        split = cut(many.join(split, key))
        # Cell 2 j lies below the j-th splitter, cell 2 j + 1 is that splitter itself.
        j = F.size(F.filter("v", lambda e: e < F.col("x")))
        cells = with_(rows, split).filter(inside).groupBy(*key, (2 * j + F.array_contains("v", F.col("x")).cast("int")).alias("cell")).agg(F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a few cells
        at = cut(cells.withColumn("before", before).join(split, key).filter("before <= k AND k < before + c"))
        place = F.shiftright("cell", 1)
        found.append(at.filter("cell % 2 = 1").select(*key, F.get("v", place).alias("value")))
        rest = at.filter("cell % 2 = 0").select(*key, (F.col("k") - F.col("before")).alias("k"), F.coalesce(F.get("v", place - 1), "low").alias("low"), F.coalesce(F.get("v", place), "high").alias("high"), F.col("c").alias("n"))
        last, open_ = open_, cut(rest)
        removed(last, many, split)
    return reduce(DataFrame.unionByName, found) if found else cut(targets.limit(0).select(*key, none.alias("value")))


def quantiles(df: DataFrame, value: str | Column, at: list[float], by: tuple[str, ...] = (), small: int | None = None) -> DataFrame:
    """(by, quantiles): for each group the quantiles at the given places, interpolated between neighbours; nulls don't count.

    They are those of percentile(), whose state keeps every distinct value.
    Without groups there is one row; of no values, all are null.
    """
    value = F.col(value) if isinstance(value, str) else value
    names = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(by, names, strict=True)], value.cast("double").alias("x")).filter("x IS NOT NULL")
    direct, small = (DIRECT, SMALL) if small is None else (small, small)
    most = rows.groupBy(*names).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= direct:
        out = rows.groupBy(*names).agg(F.percentile("x", at).alias("quantiles"))
        return out.toDF(*by, "quantiles")
    # Null groups are groups as well; a number stands for each.
    if names:
        ids = cut(rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("g", F.monotonically_increasing_id()))
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names])
        rows = cut(rows.alias("a").join(ids.alias("b"), same).select("b.g", "a.x"))
        own: tuple[str, ...] = ("g",)
    else:
        ids, own = cut(rows.agg(F.count("*").alias("n"))), ()
    q = F.explode(F.array(*map(F.lit, at))).alias("q")
    wanted = ids.select(*own, "n", q).withColumn("p", (F.col("n") - 1) * F.col("q")).withColumn("a", F.floor("p")).withColumn("b", F.ceil("p"))
    targets = wanted.select(*own, F.explode(F.array("a", "b")).alias("r")).distinct()
    got = order_statistics(rows, targets, own, small)
    one, two = (got.select(*own, F.col("r").alias(c), F.col("value").alias(f"v{c}")) for c in "ab")
    both = wanted.join(one, [*own, "a"]).join(two, [*own, "b"])
    between = F.when(F.col("a") == F.col("b"), F.col("va")).otherwise((F.col("b") - F.col("p")) * F.col("va") + (F.col("p") - F.col("a")) * F.col("vb"))
    per = both.groupBy(*own).agg(F.map_from_entries(F.collect_set(F.struct("q", between.alias("v")))).alias("m"))  # as many as were asked for
    listed = F.array(*[F.element_at("m", F.lit(x)) for x in at]).alias("quantiles")
    if not names:
        return per.select(listed)
    return ids.join(per, "g").select(*[F.col(g).alias(c) for g, c in zip(names, by, strict=True)], listed)


def quantile(df: DataFrame, value: str | Column, at: float, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, name): one quantile."""
    return quantiles(df, value, [at], by).select(*by, F.col("quantiles")[0].alias(name))
