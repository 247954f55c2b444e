"""How far test lies from train, for every split of a sweep: one row for each tag.

Samples, permutation nulls, classifiers and neighbours of all tags are worked
out together: the tag is a key of each step, never a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stable_order
from .calibration import binomial_tail
from .fits import grouped_logistic
from .iterate import cut
from .kernels import kernel_null, numbered, tanimoto
from .packed import Packed, fold_sizes, nearest
from .packed import sampled_sides as packed_sides
from .quantiles import quantile
from .ranking import running_sums


def sampled_sides(folds: DataFrame, most: int = 1500, by: str = "tag", key: str = "system") -> DataFrame:
    """folds' rows of train (y = 0) and test (y = 1), as many of each side of a tag, at most so many, by a stable order; turn counts them from 1."""
    sides = folds.filter(F.col("fold").isin("train", "test")).withColumn("y", (F.col("fold") == "test").cast("int"))
    order = [stable_order(F.col(key), F.concat(F.col(by), F.lit("|shift"))), F.col(key)]
    # Tasks keep the first rows of each side before any are gathered.
    first = cut(sides.withColumn("turn", F.row_number().over(Window.partitionBy(by, "y").orderBy(*order))).filter(F.col("turn") <= most))
    n = first.groupBy(by).agg(F.least(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).alias("_m"))
    return first.join(F.broadcast(n), by).filter(F.col("turn") <= F.col("_m")).drop("_m")  # a row for each tag


def grouped_auc(scored: DataFrame, score: str, label: str, by: str = "tag") -> DataFrame:
    """(by, auc): the exact area under the ROC curve of each group, by rank sums from counts of each score."""
    per = scored.groupBy(by, score).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    run = running_sums(per, [F.col(by), F.col(score)], {"_before": F.col("n")})
    start = run.groupBy(by).agg(F.min("_before").alias("_start"))
    rank = F.col("_before") - F.col("_start") + (F.col("n") + 1) / 2
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return run.join(F.broadcast(start), by).groupBy(by).agg(((F.sum(rank * F.col("p")) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"))  # a row for each group


def _logit(w: Column, v: Column) -> Column:
    products = F.zip_with(F.slice(w, 1, F.size(v)), v, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x) + F.element_at(w, -1)


def classifier_rows(sample: DataFrame, vector: str, folds: int = 5, least: int = 2, by: str = "tag") -> DataFrame:
    """(by, c2st_n_per_class, c2st_auc, c2st_acc, c2st_p): the classifier two-sample test of every tag, all models fitted together.

    sample: rows of sampled_sides with a vector.  Folds are dealt in turn within
    each side.  With fewer than ``least`` rows a fold and class, figures are null.
    """
    rows = cut(sample.select(by, "y", F.pmod("turn", F.lit(folds)).cast("int").alias("_f"), F.transform(vector, lambda v: v.cast("double")).alias("_v")))
    n = rows.groupBy(by).agg(F.count_if(F.col("y") == 1).cast("long").alias("c2st_n_per_class"))
    fit = grouped_logistic(rows.join(F.broadcast(n.filter(F.col("c2st_n_per_class") >= least * folds)), by), by, "y", "_v", "_f", folds)
    z = _logit(F.col("w"), F.col("_v"))
    scored = cut(rows.join(fit.withColumnRenamed("fold", "_f"), [by, "_f"]).select(by, "y", (1 / (1 + F.exp(-z))).alias("score")))
    hits = scored.groupBy(by).agg(F.count_if((F.col("score") >= 0.5) == (F.col("y") == 1)).alias("hits"), F.count("*").alias("rows"))
    tail = F.udf(lambda hits, n: binomial_tail(hits, n), "double")  # once a tag
    acc = hits.select(by, (F.col("hits") / F.col("rows")).alias("c2st_acc"), tail("hits", "rows").alias("c2st_p"))
    return n.join(grouped_auc(scored, "score", "y", by).withColumnRenamed("auc", "c2st_auc"), by, "left").join(acc, by, "left")


def neighbour_rows(folds: DataFrame, pairs: DataFrame, entity: str, name: str, at: float, by: str = "tag") -> DataFrame:
    """(by, n_test_<name>s, n_train_<name>s, max, mean and p95 of the similarity of a tag's test entities to its nearest train entity, share of at least ``at``).

    pairs: i, j, sim, each unordered pair once, all that are above 0 (or above a
    floor: what is below counts as 0, and how many do is given).  An entity of
    test that is in train as well is at 1.
    """
    seen = cut(folds.filter(F.col("fold").isin("train", "test")).groupBy(by, F.col(entity).alias("i")).agg(F.bool_or(F.col("fold") == "train").alias("train"), F.bool_or(F.col("fold") == "test").alias("test")))
    both = pairs.select("i", "j", F.col("sim").cast("double").alias("sim")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sim").cast("double").alias("sim")))
    test = seen.filter("test").select(by, "i", F.when(F.col("train"), 1.0).alias("own"))
    near = test.filter("own IS NULL").select(by, "i").join(both, "i").join(seen.filter("train").select(by, F.col("i").alias("j")), [by, "j"]).groupBy(by, "i").agg(F.max("sim").alias("near"))
    best = test.join(near, [by, "i"], "left").select(by, F.coalesce("own", "near", F.lit(0.0)).alias("near"), (F.col("own").isNull() & F.col("near").isNull()).alias("none"))
    return neighbour_figures(best, seen.filter("train").groupBy(by).agg(F.count("*").alias("n")), name, at, by)


def neighbour_figures(best: DataFrame, train: DataFrame, name: str, at: float, by: str = "tag") -> DataFrame:
    """neighbour_rows from the nearest of each test entity (by, near, none: below the floor) and how many entities train has (by, n)."""
    best = cut(best)
    out = best.groupBy(by).agg(F.count("*").alias(f"n_test_{name}s"), F.max("near").alias(f"max_{name}_nn"), F.avg("near").alias(f"mean_{name}_nn"), F.avg((F.col("near") >= at).cast("int")).alias(f"frac_test_{name}s_nn_ge_{at}"), F.count_if("none").alias(f"n_{name}_nn_below_floor"))
    n = train.select(by, F.col("n").alias(f"n_train_{name}s"))
    return out.join(n, by).join(quantile(best, "near", 0.95, f"p95_{name}_nn", (by,)), by)


def shift_rows(folds: DataFrame, vectors: DataFrame, ligand_pairs: DataFrame, protein_pairs: dict[str, DataFrame], most: int = 1500, permutations: int = 200, parts: int = 5, kernel=tanimoto) -> DataFrame:
    """One row for each tag of a sweep: whether it can be measured, MMD with its p value, the classifier test, and what the nearest train entities are like.

    folds: tag, system, protein, ligand, fold.  vectors: ligand, v (marks).
    ligand_pairs: i, j, sim.  protein_pairs: the same for each definition of
    identity.  A tag without train or test rows isn't measurable, its figures null.
    """
    tags = folds.groupBy("tag").agg((F.count_if(F.col("fold") == "train") > 0).alias("_a"), (F.count_if(F.col("fold") == "test") > 0).alias("_b")).select("tag", (F.col("_a") & F.col("_b")).alias("measurable"))
    rows = [
        neighbour_rows(folds, ligand_pairs, "ligand", "ligand", 0.4),
        *[neighbour_rows(folds, p, "protein", f"protein_{name}", 0.3) for name, p in protein_pairs.items()],
    ]
    return _shift_rows(tags, sampled_sides(folds, most), rows, vectors, permutations, parts, kernel)


def _shift_rows(tags: DataFrame, sides: DataFrame, neighbours: list[DataFrame], vectors: DataFrame, permutations: int, parts: int, kernel) -> DataFrame:
    sample = cut(sides.join(vectors.select("ligand", "v"), "ligand").select("tag", "system", "y", "turn", "v"))
    null = kernel_null(numbered(sample, "y", "v", "system", ("tag",)), kernel, ("tag",), permutations)
    rows = [null.select("tag", "mmd2", F.col("p").alias("mmd_p"), F.col("n1").alias("mmd_n_per_side")), classifier_rows(sample, "v", parts), *neighbours]
    return cut(reduce(lambda a, b: a.join(b, "tag", "left"), rows, tags))


def packed_shift_rows(own: Packed, vectors: DataFrame, ligand_pairs: DataFrame, protein_pairs: dict[str, DataFrame], most: int = 1500, permutations: int = 200, parts: int = 5, kernel=tanimoto) -> DataFrame:
    """shift_rows of cold splits as words, without a row for each system and tag."""
    folds = cut(own.folds())
    has = lambda bit: F.count_if(F.col("m") == bit) > 0
    tags = own.tagged(fold_sizes(own, folds).groupBy("slot").agg((has(1) & has(4)).alias("measurable")))
    rows = [
        neighbour_figures(*nearest(own, folds, ligand_pairs, "ligand"), "ligand", 0.4),
        *[neighbour_figures(*nearest(own, folds, p, "protein"), f"protein_{name}", 0.3) for name, p in protein_pairs.items()],
    ]
    return _shift_rows(tags, packed_sides(own, folds, most), rows, vectors, permutations, parts, kernel)
