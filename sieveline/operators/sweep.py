"""All splits of a sweep at once: families x protein thresholds x ligand variants x seeds.

A tag is one split.  Clusters are read once, systems are dealt to contexts (a
threshold and a variant) and contexts to tags, and every step of a family runs
over all its tags in one plan: partitions stream tag by tag through grouped
Arrow iterators, rounds of joins carry the tag in their keys.  So the number of
jobs depends on the families, not on the tags, and every tag has the folds that
a call for it alone gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import cut
from .splits import ASSIGNERS, CONTRACTS, FOLDS, FRACTIONS, cluster_components, component_block, mask

CONTEXT = ("protein_threshold", "ligand_variant")
DESCRIPTIONS = {
    "C1": "random, both clusters in train", "C2p": "cold proteins, known ligands", "C2l": "cold ligands, known proteins",
    "C3": "both cold, blocks", "C3comp": "both cold, whole components",
}
#: A largest component above this share can't be balanced with the other folds.
BALANCEABLE = 0.85


def tag_name(family: str, threshold: str, variant: str, seed: int) -> str:
    return f"{family}__p{threshold}__{variant}__seed{seed}"


def tags(spark: SparkSession, families, thresholds, variants, seeds) -> DataFrame:
    """(tag, family, protein_threshold, ligand_variant, seed): a row for each split of the sweep."""
    unknown = set(families) - set(ASSIGNERS)
    if unknown:
        raise ValueError(f"unknown families {sorted(unknown)}; there are {sorted(ASSIGNERS)}")
    rows = [(tag_name(f, p, v, s), f, p, v, s) for p in thresholds for v in variants for f in families for s in seeds]
    return spark.createDataFrame(rows, "tag string, family string, protein_threshold string, ligand_variant string, seed int")


def contexts(entities: DataFrame, proteins: DataFrame, ligands: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Systems in every context, with their clusters: the context, system, protein, ligand, pc, lc and component; a saved table.

    entities: system, protein, ligand; proteins: protein_threshold, protein, pc;
    ligands: ligand_variant, ligand, lc.  wanted: the contexts, all by default.
    A system whose entities a clustering lacks, or has twice, is an error.
    """
    if wanted is None:
        wanted = proteins.select("protein_threshold").distinct().crossJoin(F.broadcast(ligands.select("ligand_variant").distinct()))  # settings, not rows
    wanted = wanted.select(*CONTEXT).distinct()
    base = entities.select("system", "protein", "ligand").crossJoin(F.broadcast(wanted))
    rows = base.join(proteins, ["protein_threshold", "protein"], "left").join(ligands, ["ligand_variant", "ligand"], "left")
    rows = cut(rows.select(*CONTEXT, "system", "protein", "ligand", "pc", "lc"))
    sizes = rows.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.count_if(F.col("pc").isNull()).alias("no_pc"), F.count_if(F.col("lc").isNull()).alias("no_lc"))
    n = entities.count()
    bad = sizes.filter((F.col("n") != n) | (F.col("no_pc") > 0) | (F.col("no_lc") > 0)).first()
    if bad:
        raise ValueError(f"clusterings don't map every system once: {bad.asDict()}, {n} systems")
    return cut(rows.join(cluster_components(rows, CONTEXT), [*CONTEXT, "pc"]).select(*CONTEXT, "system", "protein", "ligand", "pc", "lc", "component"))


def sweep(audit: DataFrame, wanted: DataFrame, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """(tag, system, protein, ligand, pc, lc, fold) for all wanted tags over the contexts (audit); a saved table."""
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"fractions of folds must sum to 1: {fractions}")
    parts = []
    for family in sorted({r["family"] for r in wanted.select("family").distinct().collect()}):
        own = F.broadcast(wanted.filter(F.col("family") == family).select("tag", *CONTEXT))  # settings, not rows
        context = audit.join(own, [*CONTEXT]).select("tag", "system", "protein", "ligand", "pc", "lc", "component")
        how = {"fractions": fractions, "by": ("tag",)}
        if family == "C3comp":
            rows = component_block(context.drop("component"), F.col("tag"), components=context.select("tag", "pc", "component").distinct(), **how)
        else:
            rows = ASSIGNERS[family](context.drop("component"), F.col("tag"), **how)
        parts.append(rows.select("tag", "system", "protein", "ligand", "pc", "lc", "fold"))
    return cut(reduce(DataFrame.unionByName, parts))


def contract_breaches(folds: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tag, problem): folds that aren't known, tags without a test fold, and clusters that are where the family's contract forbids."""
    family = wanted.select("tag", "family")
    sizes = folds.groupBy("tag").agg(F.count_if(~F.coalesce(F.col("fold").isin(*FOLDS, "excluded"), F.lit(False))).alias("unknown"), F.count_if(F.col("fold") == "test").alias("n_test"))
    problems = [
        family.join(sizes, "tag", "left").filter("unknown > 0").select("tag", F.lit("unknown folds").alias("problem")),
        family.join(sizes, "tag", "left").filter("coalesce(n_test, 0) = 0").select("tag", F.lit("no test fold").alias("problem")),
    ]
    for axis in ("pc", "lc"):
        per = folds.filter("fold <> 'excluded'").groupBy("tag", axis).agg(mask().alias("m"))
        per = per.groupBy("tag").agg(F.count_if(F.bit_count("m") > 1).alias("shared"), F.count_if((F.col("m").bitwiseAND(6) != 0) & (F.col("m").bitwiseAND(1) == 0)).alias("uncovered")).join(family, "tag")
        for kind, of, name in (("shared", 0, "clusters in several folds"), ("uncovered", 1, "clusters that train lacks")):
            bound = [f for f, c in CONTRACTS.items() if axis in c[of]]
            problems.append(per.filter((F.col(kind) > 0) & F.col("family").isin(bound)).select("tag", F.concat_ws(" ", F.lit(axis), F.lit(name)).alias("problem")))
    return reduce(DataFrame.unionByName, problems)


def component_stats(audit: DataFrame) -> DataFrame:
    """For each context, figures of its components: how many, the largest and its share, and whether folds can be balanced at all."""
    per = audit.groupBy(*CONTEXT, "component").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return per.groupBy(*CONTEXT).agg(F.count("*").alias("n_components"), share.alias("largest_component_fraction"), F.count_if(F.col("n") == 1).alias("singleton_components"), (share <= BALANCEABLE).alias("balanceable"))


def split_index(folds: DataFrame, wanted: DataFrame, audit: DataFrame) -> DataFrame:
    """One row for each tag: its settings, sizes of folds, clusters of train and test, test systems whose very entities train has, and its context's components."""
    at = lambda f, c: F.count_distinct(F.when(F.col("fold") == f, F.col(c)))
    n = folds.groupBy("tag").agg(F.count("*").alias("n_systems"), *[F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in (*FOLDS, "excluded")])
    # Clusters and entities are reduced to one row each before they are counted.
    for axis, name in (("pc", "protein_clusters"), ("lc", "ligand_clusters")):
        per = folds.groupBy("tag", axis).agg(mask().alias("m")).groupBy("tag").agg(*[F.count_if(F.col("m").bitwiseAND(bit) != 0).alias(f"n_{f}_{name}") for f, bit in (("train", 1), ("test", 4))])
        n = n.join(per, "tag")
    for c in ("protein", "ligand"):
        per = folds.groupBy("tag", c).agg(mask().alias("m"), F.count_if(F.col("fold") == "test").alias("n"))
        seen = F.sum(F.when(F.col("m").bitwiseAND(1) != 0, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))
        n = n.join(per.groupBy("tag").agg(seen.alias(f"test_frac_exact_{c}_seen")), "tag")
    describe = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    return wanted.withColumn("family_desc", describe[F.col("family")]).join(n, "tag").join(component_stats(audit).select(*CONTEXT, "n_components", "largest_component_fraction"), [*CONTEXT])


def write_sweep(folds: DataFrame, wanted: DataFrame, audit: DataFrame, path: str) -> None:
    """Check every tag's contract, then write folds (partitioned by tag), audit and index under the path."""
    bad = contract_breaches(folds, wanted).orderBy("tag", "problem").limit(20).collect()
    if bad:
        raise ValueError("splits leak: " + "; ".join(f"{r['tag']}: {r['problem']}" for r in bad))
    folds.select("tag", "system", "fold").repartition("tag").write.partitionBy("tag").mode("overwrite").parquet(f"{path}/folds")
    audit.write.mode("overwrite").parquet(f"{path}/audit")
    split_index(folds, wanted, audit).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # a row for each tag


def read_sweep(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds, audit and index as they were written; the tag is a string even if all of them look like numbers."""
    folds = spark.read.schema("system " + spark.read.parquet(f"{path}/audit").schema["system"].dataType.simpleString() + ", fold string, tag string").parquet(f"{path}/folds")
    return folds, spark.read.parquet(f"{path}/audit"), spark.read.parquet(f"{path}/index")


def validate_sweep(folds: DataFrame, audit: DataFrame, index: DataFrame) -> DataFrame:
    """(tag, problem) for what was written: systems lost, strange or repeated, contracts broken, sizes that aren't the index's; no row if all is well."""
    tagged = index.select("tag", "family", *CONTEXT)
    due = audit.join(F.broadcast(tagged.select("tag", *CONTEXT)), [*CONTEXT]).select("tag", "system", "protein", "ligand", "pc", "lc")
    both = due.withColumn("_due", F.lit(1)).join(folds.select("tag", "system", "fold", F.lit(1).alias("_got")), ["tag", "system"], "full")
    both = cut(both)
    per = both.groupBy("tag").agg(F.count_if(F.col("_got").isNull()).alias("lost"), F.count_if(F.col("_due").isNull()).alias("strange"), *[F.count_if((F.col("fold") == f) & F.col("_due").isNotNull()).alias(f"got_{f}") for f in (*FOLDS, "excluded")])
    again = folds.groupBy("tag", "system").count().filter("count > 1").select("tag").distinct()
    sizes = per.join(index, "tag")
    found = [
        per.filter("lost > 0").select("tag", F.lit("systems lost").alias("problem")),
        per.filter("strange > 0").select("tag", F.lit("systems that the audit lacks").alias("problem")),
        again.select("tag", F.lit("systems repeated").alias("problem")),
        *[sizes.filter(F.col(f"got_{f}") != F.col(f"n_{f}")).select("tag", F.lit(f"n_{f} isn't the index's").alias("problem")) for f in (*FOLDS, "excluded")],
        contract_breaches(both.filter("_due IS NOT NULL AND _got IS NOT NULL"), tagged),
    ]
    return reduce(DataFrame.unionByName, found)


def summary(index: DataFrame, test_fraction: float = FRACTIONS[2]) -> DataFrame:
    """For each family, over its tags: how many, mean and least test size as a share, mean share of excluded systems, tags with under half the test fraction."""
    share = F.col("n_test") / F.col("n_systems")
    return index.groupBy("family").agg(F.count("*").alias("tags"), F.avg(share).alias("mean_test_share"), F.min(share).alias("least_test_share"), F.avg(F.col("n_excluded") / F.col("n_systems")).alias("mean_excluded_share"), F.count_if(share < 0.5 * test_fraction).alias("underpowered"))


def seed_pivot(index: DataFrame) -> DataFrame:
    """For each family and ligand variant, over thresholds and seeds: mean sizes of the folds, the test fold's share and the share of systems that are kept."""
    kept = 1 - F.col("n_excluded") / F.col("n_systems")
    return index.groupBy("family", "ligand_variant").agg(F.count("*").alias("tags"), *[F.avg(f"n_{f}").alias(f"mean_{f}") for f in (*FOLDS, "excluded")], F.avg(F.col("n_test") / F.col("n_systems")).alias("test_share"), F.avg(kept).alias("retained_share"))
