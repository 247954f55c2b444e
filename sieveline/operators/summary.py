"""Summaries: sizes of groups, quantiles by stratum, distributions, calibration tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut
from .quantiles import quantile, quantiles
from .ranking import ranked, running_sums


def _sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def _largest_first(sizes: DataFrame) -> DataFrame:
    """Groups of one size are one row with their number, so the running sum is over few rows whatever the groups."""
    same = sizes.groupBy("n").agg(F.count("*").alias("m"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return same.select("n", "m", F.coalesce(F.sum(F.col("n") * F.col("m")).over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("r"))


def _of_top(k: int) -> Column:
    """Members of the k largest groups."""
    return F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("m"), F.lit(k) - F.col("r"))))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Number of groups, largest and its share, five largest, singletons, median, how many cover 90 %, and whether 0.85 isn't exceeded."""
    sizes = _sizes(df, key)
    total = sizes.agg(F.sum("n").alias("total"), F.percentile("n", 0.5).alias("median"))
    rows = _largest_first(sizes).crossJoin(F.broadcast(total))
    # Groups of size n are counted while the running sum, each one added, is below 0.9 of all.
    below = F.greatest(F.lit(0), F.least(F.col("m"), F.ceil((0.9 * F.col("total") - F.col("before")) / F.col("n")) - 1))
    share = F.max("n") / F.first("total")
    return rows.agg(F.sum("m").alias("n_components"), F.max("n").alias("largest"), share.alias("largest_share"), _of_top(5).alias("top5"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("m"))), F.lit(0)).alias("singletons"), F.first("median").alias("median"), (F.sum(below) + 1).cast("bigint").alias("to_cover_90"), (share <= 0.85).alias("balanceable"))


def cluster_summary(df: DataFrame, key: str) -> DataFrame:
    sizes = _sizes(df, key)
    total = sizes.agg(F.sum("n").alias("total"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"))
    rows = _largest_first(sizes).crossJoin(F.broadcast(total))
    return rows.agg(F.sum("m").alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("m"))), F.lit(0)).alias("singletons"), F.max("n").alias("largest"), _of_top(10).alias("top10"), (_of_top(10) / F.first("total")).alias("top10_share"), F.first("median").alias("median"), F.first("mean").alias("mean"))


def scaffold_clusters(df: DataFrame, key: str, empty: str = "group") -> DataFrame:
    """Clusters of equal keys; a null key is alone, an empty one is grouped or alone by policy."""
    own = F.concat(F.lit("~"), F.col(key).cast("string"))
    k = F.coalesce("key", own)
    if empty == "singleton":
        k = F.when(F.col("key") == "", own).otherwise(k)
    ids = ranked(df.select(k.alias("_k")).distinct(), [F.col("_k")], "cluster").withColumn("cluster", F.col("cluster") - 1)
    return df.withColumn("_k", k).join(ids, "_k").select(key, F.col("cluster").cast("bigint").alias("cluster"))


def stratified(df: DataFrame, strata: list[str], value: str, below: float) -> DataFrame:
    """Rows, median and share below a limit by every stratum and over all: grouping sets, one pass."""
    out = cut(df.cube(*strata).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"), F.avg((F.col(value) < below).cast("int")).alias("share_below")))
    # A row once for each set of strata, with nulls for the others, as cube() has them.
    sets = [tuple(i >> len(strata) - 1 - k & 1 for k in range(len(strata))) for i in range(1 << len(strata))]
    dropped = lambda c, off: F.lit(None).cast(df.schema[c].dataType) if off else F.col(c)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("_id"), *[dropped(c, off).alias(c) for c, off in zip(strata, s, strict=True)]) for i, s in enumerate(sets)])).alias("_s")
    median = quantile(df.select(F.col(value).alias("_v"), each).select("_v", "_s.*"), "_v", 0.5, "median", ("_id", *strata))
    same = F.col("a._id") == F.col("b._id")
    for c in strata:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return out.alias("a").join(median.alias("b"), same, "left").select(*[F.col(f"a.`{c}`") for c in strata], "a.n", "b.median", "a.share_below")


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    q = quantiles(df, value, [0.5, 0.95], (by,)).select(F.col(by).alias("_by"), F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("p95"))
    return out.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "median", "p95", "largest")


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, at_most, at_least): shares of rows, from counts per value."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    total = df.agg(F.count(value).alias("total"))
    rows = running_sums(n, [F.col(value)], {"_before": F.col("n")}).withColumn("run", F.col("_before") + F.col("n")).crossJoin(F.broadcast(total))  # one row
    return rows.select(value, (F.col("run") / F.col("total")).alias("at_most"), ((F.col("total") - F.col("run") + F.col("n")) / F.col("total")).alias("at_least"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Bins of a fixed width with their density."""
    total = df.agg(F.count(value).alias("total"))
    bins = df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    return bins.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total") / width).alias("density"))


def log_histogram(df: DataFrame, value: str, per_decade: int = 4) -> DataFrame:
    """(bin, low, n, density) of positive values in bins of equal ratio, so many to a factor of ten; density per unit of the value."""
    rows = df.filter(F.col(value) > 0)
    total = rows.agg(F.count("*").alias("total"))
    at = F.floor(F.round(F.log10(value) * per_decade, 9))
    edge = lambda k: F.pow(F.lit(10.0), (F.col("bin") + k) / per_decade)
    bins = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return bins.select("bin", edge(0).alias("low"), "n", (F.col("n") / F.col("total") / (edge(1) - edge(0))).alias("density"))


def smallest(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n rows with the least values; each task keeps its own n."""
    return df.orderBy(value, tie).limit(n)


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of the columns are numbers: not null, not NaN, not infinite."""
    out = df
    for c in columns:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return out


def shares(df: DataFrame, by: str) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(by).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total")).alias("share"))


def exact_values(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """How many rows lie exactly on each value, compared as 32-bit floats."""
    return df.agg(*[F.count_if(F.col(value).cast("float") == F.lit(x).cast("float")).alias(f"at_{x:g}") for x in at])


def markdown(rows: list, columns: list[str]) -> str:
    """A table; floats with four significant digits, nulls empty."""
    cell = lambda v: "" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])
