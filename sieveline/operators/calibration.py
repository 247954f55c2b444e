"""Out-of-fold calibration, resampled intervals, transfer between eras, and shift of the covariate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import stable_order
from .iterate import cut
from .quantiles import quantiles


def balanced_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups, largest first, each to the fold with the fewest rows; the first of equals.

    Each step depends on all before it, so the groups' sizes stream in order
    through one task in Arrow batches.
    """
    import pyarrow as pa

    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    turn = sizes.repartition(1).sortWithinPartitions(F.desc("n"), group).select(group, "n")

    def deal(batches):
        load = [0] * folds
        for b in batches:
            out = []
            for n in b.column(1).to_pylist():
                k = load.index(min(load))
                load[k] += n
                out.append(k)
            yield pa.record_batch([b.column(0), pa.array(out, pa.int32())], [group, "fold"])

    return turn.mapInArrow(deal, f"`{group}` {rows.schema[group].dataType.simpleString()}, fold int")


def isotonic_predictions(train: DataFrame, rows: DataFrame, x: str, y: str) -> DataFrame:
    """rows with ``predicted``: isotonic regression of y on x over train, linear between its points and flat outside them."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    vectors = VectorAssembler(inputCols=[x], outputCol="_x")
    model = IsotonicRegression(featuresCol="_x", labelCol=y, predictionCol="predicted").fit(vectors.transform(train.select(x, y)))
    return model.transform(vectors.transform(rows)).drop("_x")


def out_of_fold(rows: DataFrame, x: str, y: str, fold: str = "fold") -> DataFrame:
    """rows with predicted (isotonic) and constant (the mean), both learned on the other folds."""
    out = None
    for k in sorted(r[fold] for r in rows.select(fold).distinct().collect()):
        train = rows.filter(F.col(fold) != k)
        own = isotonic_predictions(train, rows.filter(F.col(fold) == k), x, y).crossJoin(F.broadcast(train.agg(F.avg(y).alias("constant"))))  # one row
        out = own if out is None else out.unionByName(own)
    return out


def skill(scored: DataFrame, y: str) -> DataFrame:
    """Errors of the out-of-fold map and of the constant, and the share of the latter's that the map saves."""
    error = lambda p: F.avg(F.abs(F.col(y) - F.col(p)))
    return scored.agg(F.count("*").alias("n"), error("predicted").alias("mae"), error("constant").alias("mae_constant")).withColumn("skill", 1 - F.col("mae") / F.col("mae_constant"))


def retained(full: Column, constant: Column, variant: Column) -> Column:
    """The share of the full map's gain over the constant that a variant keeps, from their errors."""
    return (constant - variant) / (constant - full)


def verdict(share: Column, low: Column) -> Column:
    """robust if the interval's lower end is 0.8 at least, partial if half is retained, else weak."""
    return F.when(low >= 0.8, "robust").when(share >= 0.5, "partial").otherwise("weak")


def poisson_weight(*parts: Column) -> Column:
    """A Poisson(1) number that is a function of the parts alone: the same in any partitioning and engine."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 7), 16, 10).cast("bigint") / float(16**7)
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))


def _rounds(df: DataFrame, key: str, rounds: int) -> DataFrame:
    """Each row once a round, with the weight that the round gives its key."""
    b = F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b")
    return df.select("*", b).withColumn("w", poisson_weight(F.col("b"), F.col(key)))


def _interval(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def bootstrap_ratio(df: DataFrame, key: str, num: str, den: str, by: list[str], rounds: int = 200) -> DataFrame:
    """(by, ratio, low, high): sum(num) / sum(den) by stratum, with a percentile interval from resampling whole keys.

    Rows are summed by key and stratum first, so rounds multiply keys, not rows.
    """
    per = df.groupBy(key, *by).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    seen = per.groupBy(*by).agg((F.sum("_n") / F.sum("_d")).alias("ratio"))
    tried = _rounds(per, key, rounds).groupBy("b", *by).agg((F.sum(F.col("w") * F.col("_n")) / F.nullif(F.sum(F.col("w") * F.col("_d")), F.lit(0))).alias("r"))
    return seen.join(_interval(tried, "r", *by), by) if by else seen.crossJoin(_interval(tried, "r"))  # single rows


def bootstrap_difference(df: DataFrame, key: str, y: str, group: str, rounds: int = 200) -> DataFrame:
    """(difference, low, high, excludes_zero) of the means of group 1 and group 0, keys resampled within each."""
    mean = lambda k, w: F.sum(F.when(F.col(group) == k, w * F.col(y))) / F.nullif(F.sum(F.when(F.col(group) == k, w)), F.lit(0))
    per = df.groupBy(key, group).agg(F.sum(y).alias(y), F.count("*").alias("_c"))
    mean_ = lambda k, w: F.sum(F.when(F.col(group) == k, w * F.col(y))) / F.nullif(F.sum(F.when(F.col(group) == k, w * F.col("_c"))), F.lit(0))
    seen = df.agg((mean(1, F.lit(1)) - mean(0, F.lit(1))).alias("difference"))
    tried = _rounds(per, key, rounds).groupBy("b").agg((mean_(1, F.col("w")) - mean_(0, F.col("w"))).alias("r"))
    return seen.crossJoin(_interval(tried, "r")).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))  # single rows


def transfer(rows: DataFrame, x: str, y: str, before: Column) -> DataFrame:
    """(era, n, mae, mae_constant): the map learned on the rows before, tried on both eras."""
    marked = cut(rows.withColumn("_before", before))
    train = marked.filter("_before")
    scored = isotonic_predictions(train, marked, x, y).crossJoin(F.broadcast(train.agg(F.avg(y).alias("constant"))))  # one row
    return scored.groupBy(F.when(F.col("_before"), "before").otherwise("after").alias("era")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(y) - F.col("predicted"))).alias("mae"), F.avg(F.abs(F.col(y) - F.col("constant"))).alias("mae_constant"))


def accuracy_by_era(scores: DataFrame, arm: str, accuracy: str, before: Column, key: str, rounds: int = 200) -> DataFrame:
    """(arm, n_before, n_after, before, after, difference, low, high): each arm's mean accuracy before and after a date, their difference, and its interval from whole keys drawn with replacement."""
    from .resampling import resampled

    rows = cut(scores.select(F.col(arm).alias("arm"), F.col(key).alias("_k"), F.col(accuracy).cast("double").alias("_a"), F.when(before, "before").otherwise("after").alias("_era")).filter("_a IS NOT NULL"))
    mean = lambda e: F.avg(F.when(F.col("_era") == e, F.col("_a")))
    seen = rows.groupBy("arm").agg(*[F.count_if(F.col("_era") == e).alias(f"n_{e}") for e in ("before", "after")], mean("before").alias("before"), mean("after").alias("after"))
    tried = resampled(rows.withColumn("_n", F.lit(1)), "_k", ["_a", "_n"], ("arm", "_era"), rounds)
    at = lambda e: F.sum(F.when(F.col("_era") == e, F.col("_a"))) / F.nullif(F.sum(F.when(F.col("_era") == e, F.col("_n"))), F.lit(0.0))
    gaps = tried.groupBy("arm", "b").agg((at("after") - at("before")).alias("_d"))
    return seen.withColumn("difference", F.col("after") - F.col("before")).join(_interval(gaps, "_d", "arm"), "arm", "left")


def coverage_by_group(rows: DataFrame, x: str, residual: str, half_width: DataFrame, groups: int = 10) -> DataFrame:
    """(group, n, covered): the share of residuals within the half-width by quantile group of x. half_width: one row."""
    edges = quantiles(rows, x, [i / groups for i in range(1, groups)]).toDF("_e")
    out = rows.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(half_width.toDF("_h")))  # single rows
    return out.groupBy(F.size(F.filter("_e", lambda e: e < F.col(x))).alias("group")).agg(F.count("*").alias("n"), F.avg((F.col(residual) <= F.col("_h")).cast("int")).alias("covered"))


def density_ratio(source: DataFrame, target: DataFrame, x: str, knots: int = 4) -> DataFrame:
    """source with weight: how much likelier x is in target, by logistic regression on a spline basis of x; their mean is 1.

    The basis is x and its excess over each inner quantile of both samples.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    both = source.select(F.col(x).cast("double").alias("x"), F.lit(0.0).alias("t")).unionByName(target.select(F.col(x).cast("double").alias("x"), F.lit(1.0).alias("t")))
    edges = quantiles(both, "x", [i / (knots + 1) for i in range(1, knots + 1)]).first()["quantiles"]
    basis = lambda c: array_to_vector(F.array(c, *[F.greatest(c - e, F.lit(0.0)) for e in edges]))
    model = LogisticRegression(featuresCol="_f", labelCol="t", probabilityCol="_p", regParam=1e-4, maxIter=200).fit(both.withColumn("_f", basis(F.col("x"))))
    p = vector_to_array("_p")
    out = cut(model.transform(source.withColumn("_f", basis(F.col(x).cast("double")))).withColumn("_w", p[1] / p[0]).drop("_f", "_p", "rawPrediction", "prediction"))
    return out.crossJoin(F.broadcast(out.agg(F.avg("_w").alias("_m")))).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")  # one row


def balanced_sample(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """As many rows of label 1 as of label 0: the smaller class whole, of the larger the first by a stable order."""
    n = df.agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("n")).first()["n"]
    turn = [stable_order(F.col(key), seed), F.col(key)]
    return df.filter(F.col(label) == 0).orderBy(*turn).limit(n).unionByName(df.filter(F.col(label) == 1).orderBy(*turn).limit(n))


def binomial_tail(hits: int, n: int) -> float:
    """The probability of at least so many heads in n tosses of a fair coin."""
    if hits <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(hits, n + 1)]
    most = max(log)
    return min(1.0, math.exp(most) * math.fsum(math.exp(v - most) for v in log))
