"""Distribution shift between folds, rank statistics and calibration."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dot, norm, stable_fold, stable_order
from .blocks import in_rounds
from .calibration import balanced_sample, binomial_tail, poisson_weight
from .iterate import cut
from .quantiles import order_statistics, quantile, quantiles
from .ranking import ranked, running_sums


def average_rank(x: str, *by: str) -> Column:
    """Ranks with ties at their mean, within groups."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(x))
    return rank + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def value_ranks(df: DataFrame, x: str) -> DataFrame:
    """(x, rank): the mean rank of each distinct value, from counts per value rather than a sort of all rows."""
    n = df.groupBy(x).agg(F.count("*").alias("n"))
    return running_sums(n, [F.col(x)], {"_before": F.col("n")}).select(x, (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The exact area under the ROC curve by the rank sum."""
    r = df.join(value_ranks(df, score), score)
    pos, neg = F.sum(label), F.sum(1 - F.col(label))
    return r.agg(((F.sum(F.col("rank") * F.col(label)) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    r = df.join(value_ranks(df, x).withColumnRenamed("rank", "rx"), x).join(value_ranks(df, y).withColumnRenamed("rank", "ry"), y)
    return r.agg(F.corr("rx", "ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b in n log n rows.

    Two values of y differ first at some bit of their ranks.  For each bit,
    rows that agree on the bits above it are gone through in the order of x:
    a one after a zero is a pair in order, a zero after a one is one out of
    order.  Both are running sums over ranges, so no group is in one task.
    """
    n = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    codes = cut(ranked(n.select(y).distinct(), [F.col(y)], "_r"))
    bits = max(1, int(codes.count()).bit_length())
    rows = n.join(codes, y).select(x, "n", "_r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_bit"))
    one = F.expr("shiftright(_r, _bit) & 1") == 1
    cells = rows.groupBy("_bit", F.expr("shiftright(_r, _bit + 1)").alias("_above"), x).agg(F.sum(F.when(one, F.col("n")).otherwise(0)).cast("double").alias("_ones"), F.sum(F.when(one, 0).otherwise(F.col("n"))).cast("double").alias("_zeros"))
    run = running_sums(cells, [F.col("_bit"), F.col("_above"), F.col(x)], {"_b0": F.col("_zeros"), "_b1": F.col("_ones")})
    per = run.groupBy("_bit", "_above").agg((F.sum(F.col("_ones") * F.col("_b0")) - F.min("_b0") * F.sum("_ones") - F.sum(F.col("_zeros") * F.col("_b1")) + F.min("_b1") * F.sum("_zeros")).alias("_s"))
    s = per.agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("s"))
    total = n.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("t"))
    ties = [n.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t{i}")) for i, c in enumerate((x, y))]
    out = s.crossJoin(total).crossJoin(ties[0]).crossJoin(ties[1])  # single rows
    return out.select((F.col("s") / F.sqrt((F.col("t") - F.col("t0")) * (F.col("t") - F.col("t1")))).alias("tau"))


def mmd2(sample: DataFrame, label: str, vector: str) -> DataFrame:
    """Unbiased squared MMD with the cosine kernel between label 1 and 0.

    The kernel is an inner product of unit vectors, so sums over all pairs are
    squared norms of sums: linear in the rows, no pairs.
    """
    unit = F.transform(vector, lambda v: v.cast("double") / F.col("_norm"))
    rows = sample.withColumn("_norm", norm(F.col(vector))).select(label, F.posexplode(unit).alias("i", "u"))
    sums = rows.groupBy("i").agg(*[F.sum(F.when(F.col(label) == k, F.col("u")).otherwise(0.0)).alias(f"s{k}") for k in (0, 1)])
    n = sample.agg(*[F.count_if(F.col(label) == k).alias(f"n{k}") for k in (0, 1)])
    t = sums.agg(F.sum(F.col("s0") ** 2).alias("k0"), F.sum(F.col("s1") ** 2).alias("k1"), F.sum(F.col("s0") * F.col("s1")).alias("k")).crossJoin(n)
    own = lambda k: (F.col(f"k{k}") - F.col(f"n{k}")) / (F.col(f"n{k}") * (F.col(f"n{k}") - 1))
    return t.select((own(0) + own(1) - 2 * F.col("k") / (F.col("n0") * F.col("n1"))).alias("mmd2"))


def mmd2_tanimoto(features: DataFrame, label: str, block: int = 4096, columns: int = 2048) -> DataFrame:
    """Unbiased squared MMD with the Tanimoto kernel between label 1 and 0 of sets (id, label, bit).

    It is a sum over all pairs of sets, so its work grows with their square.
    Sets are dealt to blocks of some ``block``; each two blocks meet in one
    task, which counts what their sets share by products of 0/1 matrices, so
    many columns at once, and passes on three sums.  No pair is a row.  Blocks
    meet in rounds of bounded bytes, each of which is saved.
    """
    import numpy as np
    import pyarrow as pa

    on = features.select("id", F.col(label).alias("_y"), "bit").distinct()
    sets = cut(on.groupBy("id", "_y").agg(F.collect_list("bit").alias("_bits")), "sets")  # a set's own
    size = sets.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_bits")), F.lit(0)).alias("bits"), *[F.count_if(F.col("_y") == v).alias(f"n{v}") for v in (0, 1)])
    n = cut(size, "size")
    total = n.first()
    blocks = max(1, -(-total["n"] // block))
    pairs = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    each = sets.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("k"), F.col("_y").cast("int").alias("y"), "_bits")

    def summed(table: pa.Table) -> pa.Table:
        k, y, lists = table.column("k").to_numpy(), table.column("y").to_numpy(), table.column("_bits").combine_chunks()
        twice = table.column("a")[0] != table.column("b")[0]
        count = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(k)), count)
        column = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        at = [np.flatnonzero(k == v) for v in (table.column("a")[0].as_py(), table.column("b")[0].as_py())]
        shared = np.zeros((len(at[0]), len(at[1])), np.float32)  # whole numbers below 2 ** 24
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
            lo, hi = np.searchsorted(column, [first, first + columns])
            x = np.zeros((len(k), columns), np.float32)
            x[row[lo:hi], column[lo:hi] - first] = 1
            shared += x[at[0]] @ x[at[1]].T
        sums = np.zeros(3)  # pairs within label 0, within label 1, of both
        for first in range(0, len(at[0]), 512):
            i = at[0][first : first + 512]
            c = shared[first : first + 512].astype(float)
            value = c / (count[i][:, None] + count[at[1]][None] - c)
            if not twice:
                value[np.arange(len(i)), np.arange(first, first + len(i))] = 0
            for v in (0, 1):
                mine = value[y[i] == v]
                sums[v] += mine[:, y[at[1]] == v].sum()
                sums[2] += mine[:, y[at[1]] == 1 - v].sum()
        # Within a block each pair was met from both sides.
        own, cross = (2, 1) if twice else (1, 0.5)
        return pa.table({"k0": [sums[0] * own], "k1": [sums[1] * own], "k": [sums[2] * cross]})

    of_block = -(-8 * total["bits"] // blocks)
    rounds = in_rounds([of_block * (1 + (a != b)) for a, b in pairs])
    parts = []
    for some in rounds:
        meets = sets.sparkSession.createDataFrame([(k, *pairs[p]) for p in some for k in sorted(set(pairs[p]))], "k int, a int, b int")
        part = each.join(F.broadcast(meets), "k").select("a", "b", "k", "y", "_bits").groupBy("a", "b").applyInArrow(summed, "k0 double, k1 double, k double")
        parts.append(cut(part, "sums") if len(rounds) > 1 else part)
    parts = reduce(DataFrame.unionByName, parts)
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("k0", "k1", "k")]).crossJoin(F.broadcast(n))  # single rows
    return sums.select((F.col("k0") / (F.col("n0") * (F.col("n0") - 1)) + F.col("k1") / (F.col("n1") * (F.col("n1") - 1)) - 2 * F.col("k") / (F.col("n0") * F.col("n1"))).alias("mmd2"))


def _shuffled(at, n: int, p: int):
    """Where the p-th permutation of 0 .. n - 1 sends each place: a Feistel network on the next power of four, walked until it is inside."""
    import numpy as np

    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    mixed = lambda v, r: ((v + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((p * 0xC2B2AE3D27D4EB4F + r) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - half)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            v = out[todo]
            left, right = v >> np.uint64(half), v & low
            for r in range(6):
                left, right = right, left ^ mixed(right, r)
            out[todo] = left << np.uint64(half) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mmd_permutation(sample: DataFrame, key: str, label: str, vector: str, permutations: int = 200) -> DataFrame:
    """mmd2 with the p value of a permutation null.

    Rows are numbered in the order of the key; a permutation is a function of
    a row's number, so each task adds up its own rows' unit vectors by
    permutation, and only permutations x dimensions sums are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    rows = cut(ranked(sample.select(key, F.col(label).cast("int").alias("y"), F.transform(vector, lambda v: v.cast("double")).alias("v")), [F.col(key)], "r"))
    size = rows.agg(F.sum("y").alias("n1"), F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n1, n, dim = size["n1"] or 0, size["n"], size["dim"] or 0

    def run(batches):
        ones, all_ = np.zeros((permutations + 1, dim)), np.zeros(dim)
        for b in batches:
            if b.num_rows:
                u = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
                at = b.column(1).to_numpy() - 1
                w = np.stack([b.column(0).to_numpy() == 1] + [_shuffled(at, n, p) < n1 for p in range(1, permutations + 1)]).astype(float)
                ones += w @ u
                all_ += u.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(permutations + 1)), pa.array(list(ones), pa.list_(pa.float64())), pa.array([all_] * (permutations + 1), pa.list_(pa.float64()))], ["b", "one", "every"])

    parts = rows.select("y", "r", "v").mapInArrow(run, "b bigint, one array<double>, every array<double>")
    sums = parts.select("b", F.posexplode(F.arrays_zip("one", "every")).alias("i", "z")).groupBy("b", "i").agg(F.sum("z.one").alias("s1"), F.sum("z.every").alias("s"))
    s0 = F.col("s") - F.col("s1")
    t = sums.groupBy("b").agg(F.sum(F.col("s1") ** 2).alias("k1"), F.sum(s0**2).alias("k0"), F.sum(s0 * F.col("s1")).alias("k"))
    n0 = n - n1
    value = (F.col("k1") - n1) / float(max(1, n1 * (n1 - 1))) + (F.col("k0") - n0) / float(max(1, n0 * (n0 - 1))) - 2 * F.col("k") / float(max(1, n0 * n1))
    m = cut(t.select("b", value.alias("m")))
    seen = m.filter("b = 0").select(F.col("m").alias("mmd2"))
    return m.filter("b > 0").crossJoin(F.broadcast(seen)).groupBy("mmd2").agg(((F.count_if(F.col("m") >= F.col("mmd2") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))  # one row


def _held_out_scores(df: DataFrame, features: str, label: str, key: str, folds: int, standardise: bool) -> DataFrame:
    """(label, score) of cross-fitted logistic regression, folds dealt in turn within each class by a stable order."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    turn = F.row_number().over(Window.partitionBy("label").orderBy(stable_order(F.col(key), "c2st"), key))  # a bounded sample
    rows = df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("features"))
    rows = cut(rows.withColumn("fold", turn % folds))
    out = None
    for k in range(folds):
        train = rows.filter(F.col("fold") != k)
        n = train.count()
        model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=standardise, maxIter=200).fit(train)
        part = model.transform(rows.filter(F.col("fold") == k)).select("label", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return cut(out)


def classifier_test(df: DataFrame, features: str, label: str, key: str, folds: int = 5) -> DataFrame:
    """Classifier two-sample test on as many rows of either class: exact AUC and accuracy of held-out scores, rows per class, and the one-sided binomial p value of the accuracy."""
    both = balanced_sample(df, label, key, "c2st")
    scored = _held_out_scores(both, features, label, key, folds, standardise=False)
    hits = scored.agg(F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1)).alias("hits"), F.count("*").alias("n")).first()
    p = binomial_tail(hits["hits"], hits["n"])
    out = auc(scored, "score", "label")
    return out.select("auc", F.lit(hits["n"]).cast("bigint").alias("n"), F.lit(hits["hits"] / max(1, hits["n"])).alias("accuracy"), F.lit(hits["n"] // 2).cast("bigint").alias("n_per_class"), F.lit(p).alias("p"))


def classifier_with_baseline(df: DataFrame, vector: str, label: str, key: str, folds: int = 5, least: int = 20) -> DataFrame:
    """(n_per_class, auc, accuracy, auc_baseline): the test on unit vectors, standardised, and on the first principal component of the vectors as they are.

    The component stands for what mean-pooled vectors tell of a sequence's
    length.  With fewer than ``least`` rows of a class all figures are null.
    """
    n = df.agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("n")).first()["n"]
    if n < least:
        return df.sparkSession.createDataFrame([(n, None, None, None)], "n_per_class bigint, auc double, accuracy double, auc_baseline double")
    pc = first_component(df, vector, key).select(key, F.array("pc1").alias("_pc"))
    unit = F.transform(vector, lambda v: v.cast("double") / norm(F.col(vector)))
    both = balanced_sample(df.select(key, label, unit.alias("_unit")).join(pc, key), label, key, "c2st")
    full, base = (_held_out_scores(both, c, label, key, folds, standardise=True) for c in ("_unit", "_pc"))
    right = F.avg(((F.col("score") > 0.5) == (F.col("label") == 1)).cast("int"))
    one = auc(full, "score", "label").crossJoin(full.agg(right.alias("accuracy"))).crossJoin(auc(base, "score", "label").withColumnRenamed("auc", "auc_baseline"))  # single rows
    return one.select(F.lit(n).cast("bigint").alias("n_per_class"), "auc", "accuracy", "auc_baseline")


def first_component(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Projection on the first principal component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("v"))
    return PCA(k=1, inputCol="v", outputCol="pc").fit(rows).transform(rows).select(key, vector_to_array("pc")[0].alias("pc1"))


# Calibration


def half_widths(df: DataFrame, residual: str, coverage: float = 0.9) -> DataFrame:
    """Conformal half-width by two formulas: the interpolated quantile, and the ceil((n + 1) * coverage)-th residual."""
    rows = df.select(F.col(residual).cast("double").alias("x")).filter("x IS NOT NULL")
    n = rows.count()
    if not n:
        return df.select(F.lit(None).cast("double").alias("interpolated"), F.lit(None).cast("double").alias("order_statistic")).limit(0)
    at = min(math.ceil((n + 1) * coverage), n) - 1
    one = order_statistics(rows, df.sparkSession.range(1).select(F.lit(at).cast("long").alias("r")))
    return quantile(df, residual, coverage, "interpolated").crossJoin(one.select(F.col("value").alias("order_statistic")))  # single rows


def baselines(df: DataFrame, x: str, y: str, key: str, folds: int = 5) -> DataFrame:
    """Cross-validated mean absolute error of the mean, of a line, and of x itself."""
    rows = df.withColumn("fold", stable_fold(F.col(key), "cv", folds))
    k = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("k")
    fit = rows.select("*", k).filter("fold <> k").groupBy("k").agg(F.avg(y).alias("mean"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    scored = rows.join(F.broadcast(fit), F.col("fold") == F.col("k"))  # a row for each fold
    return scored.agg(F.avg(F.abs(F.col(y) - F.col("mean"))).alias("mae_constant"), F.avg(F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))).alias("mae_line"), F.avg(F.abs(F.col(y) - F.col(x))).alias("mae_raw"))


def fixed_bins(df: DataFrame, p: str, y: str, bins: int, least: int) -> DataFrame:
    """Mean prediction and outcome in equal bins of [0, 1] that have more than ``least`` rows."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed")).filter(F.col("n") > least)


def quantile_bins(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Mean, spread and gap in bins between distinct quantiles of p, closed on the right."""
    edges = quantiles(df, p, [i / bins for i in range(bins + 1)]).select(F.array_distinct("quantiles").alias("edges"))
    b = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(p))), F.lit(1))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("bin", b)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"), (1.96 * F.stddev(y) / F.sqrt(F.count("*"))).alias("half_width"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))


def weighted_quantile(df: DataFrame, x: str, weight: str, q: float) -> DataFrame:
    """The least x at which the running weight reaches q of all; and Kish's effective sample size."""
    per = df.groupBy(x).agg(F.sum(weight).alias("w"))
    total = df.agg(F.sum(weight).alias("all"), (F.sum(weight) ** 2 / F.sum(F.col(weight) ** 2)).alias("effective"))
    rows = running_sums(per, [F.col(x)], {"_before": F.col("w")}).withColumn("run", F.col("_before") + F.col("w")).crossJoin(F.broadcast(total))  # one row
    return rows.groupBy("effective").agg(F.min(F.when(F.col("run") >= q * F.col("all"), F.col(x))).alias("quantile"))


def bootstrap_mean(df: DataFrame, y: str, key: str, rounds: int = 200) -> DataFrame:
    """Percentile interval of a mean by Poisson(1) weights from a stable hash; one aggregation for all rounds."""
    rows = df.select(y, key, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b")).withColumn("w", poisson_weight(F.col("b"), F.col(key)))
    means = rows.groupBy("b").agg((F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def cosine(a: str, b: str) -> Column:
    return dot(F.col(a), F.col(b)) / (norm(F.col(a)) * norm(F.col(b)))
