"""How far annotators agree: Jaccard indices, coverage, cohorts, and reports on them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import band, ratio
from .ranking import ranked


def presence(sets: DataFrame, arms: list[str]) -> DataFrame:
    """A boolean column for each arm per (system, res_row): a pivot, where outer joins would need one pass each."""
    return sets.groupBy("system", "res_row").agg(*[F.max((F.col("arm") == a).cast("int")).alias(a) for a in arms])


def _jaccard(a: str, b: str, empty: float | None) -> Column:
    return ratio(F.sum(F.col(a) * F.col(b)), F.sum(F.greatest(a, b)), empty)


def jaccard_pairs(sets: DataFrame, arms: list[str], empty: float | None = None) -> DataFrame:
    """For each system, the Jaccard index of every pair of arms, all in one aggregation; undefined ones are null or ``empty``."""
    return presence(sets, arms).groupBy("system").agg(*[_jaccard(a, b, empty).alias(f"j_{a}_{b}") for a, b in combinations(arms, 2)])


def agreement_accuracy(sets: DataFrame, arms: list[str], truth: str, cohort: str = "all_nonempty") -> DataFrame:
    """Mean pairwise Jaccard of the arms, and their mean Jaccard against the truth.

    cohort: all_nonempty keeps systems for which each arm and the truth assert something, any_nonempty all.
    """
    flat = presence(sets, [*arms, truth]).groupBy("system").agg(
        *[_jaccard(a, b, None).alias(f"p{i}") for i, (a, b) in enumerate(combinations(arms, 2))],
        *[_jaccard(a, truth, None).alias(f"t{i}") for i, a in enumerate(arms)],
        *[F.max(a).alias(f"has_{a}") for a in [*arms, truth]],
    )
    if cohort == "all_nonempty":
        for a in [*arms, truth]:
            flat = flat.filter(F.col(f"has_{a}") == 1)
    n = len(list(combinations(arms, 2)))
    mean = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    return flat.select("system", mean([f"p{i}" for i in range(n)]).alias("agreement"), mean([f"t{i}" for i in range(len(arms))]).alias("accuracy"))


def contact_similarity(contacts: DataFrame, a: str, b: str, wide: float, narrow: float) -> DataFrame:
    """(system, j_wide, j_narrow, mean_gap): how alike two arms' contacts are within two cut-offs.

    Systems for which neither arm has a contact within the wide cut-off are
    left out; without one within the narrow cut-off the index is 0.  mean_gap
    is the mean absolute difference of least distances on shared residues.
    """
    near = contacts.filter(F.col("arm").isin(a, b) & (F.col("d_min") <= wide))
    flat = near.groupBy("system", "res_row").agg(*[F.min(F.when(F.col("arm") == x, F.col("d_min"))).alias(n) for x, n in ((a, "_a"), (b, "_b"))])
    both, one = F.col("_a").isNotNull() & F.col("_b").isNotNull(), lambda c: F.coalesce(F.col(c) <= narrow, F.lit(False))
    inner = ratio(F.count_if(one("_a") & one("_b")), F.count_if(one("_a") | one("_b")), 0.0)
    return flat.groupBy("system").agg((F.count_if(both) / F.count("*")).alias("j_wide"), inner.alias("j_narrow"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_gap"))


def coverage(sets: DataFrame, arms: list[str]) -> DataFrame:
    """How many systems each combination of arms covers: a bit mask per system, then a count per mask."""
    masks = sets.filter(F.col("arm").isin(arms)).groupBy("system").agg(sum((F.max(F.when(F.col("arm") == a, 1 << i).otherwise(0)) for i, a in enumerate(arms[1:], 1)), F.max(F.when(F.col("arm") == arms[0], 1).otherwise(0))).alias("mask"))
    return masks.groupBy("mask").agg(F.count("*").alias("n_systems"))


def covered_by_all(sets: DataFrame, arms: list[str]) -> DataFrame:
    return sets.filter(F.col("arm").isin(arms)).groupBy("system").agg(F.count_distinct("arm").alias("n")).filter(F.col("n") == len(arms)).select("system")


def cohort_chain(sets: DataFrame, arms: list[str], truth: str) -> DataFrame:
    """Sizes of the steps from all systems to those with every arm and the truth."""
    per = sets.groupBy("system").agg(F.count_distinct(F.when(F.col("arm").isin(arms), F.col("arm"))).alias("n"), F.max((F.col("arm") == truth).cast("int")).alias("t"))
    return per.agg(
        F.count("*").alias("any_arm"), F.count_if(F.col("n") == len(arms)).alias("core"), F.count_if(F.col("t") == 1).alias("annotated"),
        F.count_if((F.col("n") == len(arms)) & (F.col("t") == 1)).alias("core_annotated"), F.count_if((F.col("n") < len(arms)) & (F.col("t") == 1)).alias("annotated_only"),
    )


def filter_table(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold on the agreement, how many systems are kept and how accurate they are."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    total = F.count("*")
    kept = F.col("agreement") >= F.col("threshold")
    return scores.select("*", at).groupBy("threshold").agg(F.count_if(kept).alias("n_kept"), F.avg(F.when(kept, F.col("accuracy"))).alias("mean_accuracy"), (F.count_if(kept) / total * 100).alias("percent_kept"))


def enrichment(scores: DataFrame, fractions: list[float]) -> DataFrame:
    """Mean accuracy of the top fraction by agreement over the mean of all; ties in order of the system."""
    n = scores.agg(F.count("*").alias("n"))
    rows = ranked(scores, [F.desc("agreement"), F.col("system")], "r").crossJoin(F.broadcast(n))  # one row
    at = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    top = F.col("r") <= F.greatest(F.floor(F.col("fraction") * F.col("n")), F.lit(1))
    return rows.select("*", at).groupBy("fraction").agg(F.count_if(top).alias("n_top"), (F.avg(F.when(top, F.col("accuracy"))) / F.avg("accuracy")).alias("enrichment"))


def offset_bands(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    return values.groupBy(band(F.col(column), edges).alias("band")).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
