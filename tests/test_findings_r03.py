"""What the findings of round 3 name: each test failed before its change."""

import random

import pytest

from pyspark.sql import functions as F

from sieveline.operators import packed, sweep, sweep_shift
from sieveline.operators import shift as M
from sieveline.plans.registry import QUERIES


def test_tanimoto_mmd_in_blocks(spark):
    """the sum over all pairs, worked out block by block without a row for each bit that a pair shares."""
    rng = random.Random(3)
    sets = {i: (rng.randrange(2), {rng.randrange(30) for _ in range(rng.randrange(1, 12))}) for i in range(50)}
    sim = lambda a, b: len(a & b) / len(a | b)
    part = lambda v: [s for y, s in sets.values() if y == v]
    mean = lambda v: sum(sim(a, b) for i, a in enumerate(part(v)) for j, b in enumerate(part(v)) if i != j) / (len(part(v)) * (len(part(v)) - 1))
    want = mean(0) + mean(1) - 2 * sum(sim(a, b) for a in part(0) for b in part(1)) / (len(part(0)) * len(part(1)))
    rows = spark.createDataFrame([(i, y, b) for i, (y, s) in sets.items() for b in s], "id long, y int, bit long")
    for block, columns in ((7, 4), (1000, 2048)):
        got = M.mmd2_tanimoto(rows.unionByName(rows), "y", block, columns)
        assert got.first()["mmd2"] == pytest.approx(want, abs=1e-12)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_file_checks_are_all_there(spark, sf):
    """codec and local paths in footers are checked with the other files' checks."""
    assert {r["check"]: r["passed"] for r in QUERIES["dq_files"](spark, sf).collect()} == {f"q{c}": True for c in ("01_inventory", "02_row_totals", "04_one_codec", "05_declared_types", "11_no_paths_in_footers")}


def test_field_and_split_checks_are_all_there(spark, sf):
    """summaries and families are checked with the fields and splits again."""
    got = {r["check"]: r["passed"] for r in QUERIES["dq_fields_and_splits"](spark, sf).collect()}
    assert len(got) == 7 and got["q49_summaries"] and got["q50_families"]


# The sweep.


@pytest.fixture(scope="module")
def clustered(spark):
    """Systems in many small components, clusterings of both entities, and the cold splits of two seeds."""
    rng = random.Random(9)
    e = sorted({(100 * k + rng.randrange(4), 1000 * k + rng.randrange(5)) for k in range(40) for _ in range(rng.randrange(1, 9))})
    entities = spark.createDataFrame([(p * 10**6 + q, p, q) for p, q in e], "system long, protein long, ligand long")
    proteins = spark.createDataFrame([(t, p, str(p // n)) for p in {x[0] for x in e} for t, n in (("0.30", 1), ("0.50", 150))], "protein_threshold string, protein long, pc string")
    ligands = spark.createDataFrame([(v, q, str(q // n)) for q in {x[1] for x in e} for v, n in (("a", 1), ("b", 3), ("c", 2500))], "ligand_variant string, ligand long, lc string")
    wanted = sweep.tags(spark, packed.FAMILIES, ["0.30", "0.50"], ["a", "b", "c"], [0, 1])
    known = packed.entities(entities, proteins, ligands, wanted)
    audit = sweep.contexts(entities, proteins, ligands, wanted)
    return entities, proteins, ligands, wanted, known, packed.packed(known, wanted), audit, sweep.sweep(audit, wanted)


def same(a, b):
    at = sorted(a.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(cell(v) for v in r) for r in df.select([F.col(f"`{c}`") for c in at]).collect()), key=str)
    assert at == sorted(b.columns) and rows(a) == rows(b)


def test_components_by_entities(clustered):
    """F8: components and their figures, without a row for each system and context."""
    *_, known, _, audit, _ = clustered
    same(known.components, audit.select("protein_threshold", "ligand_variant", "pc", "component").distinct())
    same(packed.component_stats(known), sweep.component_stats(audit))


def test_entities_must_be_clustered_once(spark, clustered):
    """F8: as contexts() does, an entity that a clustering lacks, or has twice, is an error."""
    entities, proteins, ligands, wanted, *_ = clustered
    with pytest.raises(ValueError, match="no_pc"):
        packed.entities(entities, proteins.filter("protein <> 0 OR protein_threshold = '0.50'"), ligands, wanted)
    with pytest.raises(ValueError, match="no_lc"):
        packed.entities(entities, proteins, ligands.unionByName(ligands.limit(1)), wanted)


def test_folds_follow_from_entities(clustered):
    """48 tags in three words of each entity give the folds of the sweep."""
    *_, own, _, folds = clustered
    got = own.each_slot(own.folds(), "system", packed.fold_name(own.bits(F.col("slot"))).alias("fold"))
    assert own.words == 3
    same(own.tagged(got), folds.select("tag", "system", "fold"))


def test_sweep_of_large_keys(spark, sf, tmp_path):
    """the square of a system's number overflowed from 3,037 suppliers on."""
    for t in ("lineitem", "supplier", "part"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        for c in ("l_suppkey", "s_suppkey"):
            df = df.withColumn(c, F.col(c) + 4_000_000) if c in df.columns else df
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    rows = QUERIES["split_sweep"](spark, str(tmp_path)).collect()
    want = spark.read.parquet(f"{tmp_path}/lineitem.parquet").select((F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("s")).distinct().collect()
    for tag in {r["tag"] for r in rows}:
        own = [r for r in rows if r["tag"] == tag]
        assert sum(r["squares"] for r in own) == sum(r["s"] ** 2 % 1000003 for r in want) and sum(r["n"] for r in own) == len(want)


def test_index_of_words(clustered):
    """the index, from which summary and pivot are made."""
    *_, wanted, _, own, audit, folds = clustered
    same(packed.split_index(own, wanted), sweep.split_index(folds, wanted, audit))


def test_breaches_of_words(clustered):
    """F16: tags without a test fold and clusters where they must not be."""
    *_, wanted, _, own, _, folds = clustered
    got = packed.contract_breaches(own)
    assert not got.isEmpty()
    same(got, sweep.contract_breaches(folds, wanted))


def test_checks_of_words(clustered):
    """a cluster of C3comp or C2p is in one fold; one of C2l may be in several."""
    *_, own, _, folds = clustered
    got = packed.clusters_in_folds(own, own.folds(), "protein").filter(F.bit_count("m") > 1)
    want = folds.filter("fold <> 'excluded'").groupBy("tag", "pc").agg(F.count_distinct("fold").alias("n")).filter("n > 1")
    same(own.tagged(got.groupBy("slot").count()), want.groupBy("tag").count())


def test_neighbours_of_words(spark, clustered):
    """nearest train entities, pair by pair."""
    *_, own, _, folds = clustered
    pairs = spark.createDataFrame([(i, i + g, 1 / (1 + g)) for i in range(4000) for g in (1, 2)], "i long, j long, sim double")
    for axis in ("protein", "ligand"):
        same(sweep_shift.neighbour_figures(*packed.nearest(own, own.folds(), pairs, axis), axis, 0.4), sweep_shift.neighbour_rows(folds, pairs, axis, axis, 0.4))


@pytest.mark.parametrize("most", [3, 40])
def test_samples_of_words(clustered, most):
    """the first of each side, though only those below a bound are gathered."""
    *_, own, _, folds = clustered
    same(packed.sampled_sides(own, own.folds(), most), sweep_shift.sampled_sides(folds, most).select("tag", "system", "ligand", "y", "turn"))


def test_shift_of_words(spark, clustered):
    """the whole shift row."""
    *_, own, _, folds = clustered
    some = folds.filter("tag LIKE '%seed0'")
    vectors = folds.select("ligand").distinct().select("ligand", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: ((F.col("ligand") + x) % 3 == 0).cast("double")).alias("v"))
    pairs = spark.createDataFrame([(i, i + 1, 0.5) for i in range(4000)], "i long, j long, sim double")
    got = sweep_shift.packed_shift_rows(own, vectors, pairs, {"near": pairs}, most=12, permutations=5, parts=3)
    same(got.filter("tag LIKE '%seed0'"), sweep_shift.shift_rows(some, vectors, pairs, {"near": pairs}, most=12, permutations=5, parts=3))


def test_contract_reads_a_saved_split(spark, sf):
    """the split was worked out anew for each of the contract's six readings."""
    assert "lineitem" not in QUERIES["leakage_contract"](spark, sf)._jdf.queryExecution().executedPlan().toString()
