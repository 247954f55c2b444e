"""Operators against plain Python, and the errors they promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import exprs as X
from sieveline.operators import checks, entities, iterate, shift, similarity, splits, summary, worklog
from sieveline.sources import formats


def test_half_grid(spark):
    values = [0.0, 4.001, 15.0, 1e-6, 6e-8] + np.random.default_rng(1).uniform(0, 40, 500).tolist()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(X.half_grid(F.col("x"))).collect()]
    assert got == [float(np.float16(v)) for v in values]


def test_quantise_clips_and_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.005,), (0.015,), (1e6,), (-1e6,)], "x double").select(X.quantise(F.col("x"), F.lit(0.0)))
    assert [r[0] for r in df.collect()] == [0, 2, 32767, -32768]


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_are_sequential_butina(spark, seed):
    rng = random.Random(seed)
    n, pairs = 60, set()
    for _ in range(110):
        i, j = sorted(rng.sample(range(n), 2))
        pairs.add((i, j))
    near = {i: {j for a, b in pairs for j in ((b,) if a == i else (a,) if b == i else ())} for i in range(n)}
    leader: dict[int, int] = {}
    for i in sorted(range(n), key=lambda i: (-len(near[i]), -i)):
        if i not in leader:
            for j in {i} | {j for j in near[i] if j not in leader}:
                leader[j] = i
    got = iterate.leader_clusters(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(pairs), "i long, j long"))
    assert {r["node"]: r["leader"] for r in got.collect()} == leader


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in iterate.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_tanimoto_pairs(spark):
    rng = random.Random(2)
    base = [rng.sample(range(4000), 30) for _ in range(12)]
    sets = [{x if rng.random() > 0.2 else rng.randrange(4000) for x in base[i % 12]} for i in range(60)]
    bits = [{x % 2048 for x in s} for s in sets]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.float32(len(bits[i] & bits[j]) / len(bits[i] | bits[j])) >= np.float32(0.3)}
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id long, feature long")
    assert {(r["i"], r["j"]) for r in similarity.pairs_above(df, 0.3).collect()} == want


def test_splits_keep_their_contracts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randrange(40), rng.randrange(40)) for k in range(400)]
    ctx = spark.createDataFrame([(k, p, q, p, q) for k, p, q in rows], "system long, protein long, ligand long, pc long, lc long")
    for family, assign in splits.ASSIGNERS.items():
        if family != "C3comp":  # one component here
            splits.require_contract(assign(ctx, "s"), family)
    splits.write(splits.ASSIGNERS["C2p"](ctx, "s"), "C2p", str(tmp_path / "split"))
    leaky = ctx.withColumn("fold", F.when(F.col("system") % 2 == 0, "train").otherwise("test"))
    with pytest.raises(ValueError, match="leaks"):
        splits.require_contract(leaky, "C2p")


def test_mmd_is_calibrated_on_a_true_null(spark):
    rng = np.random.default_rng(0)
    p = []
    for _ in range(5):
        rows = [(i, int(i % 2), rng.standard_normal(8).tolist()) for i in range(80)]
        p.append(shift.mmd_permutation(spark.createDataFrame(rows, "k long, y int, v array<double>"), "k", "y", "v", 40).first()["p"])
    assert np.mean(p) > 0.1


def test_entities(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception, match="key repeats"):
        entities.one_to_one(a, a.select("k").distinct(), "k").collect()
    with pytest.raises(Exception, match="unmapped"):
        entities.mapped(spark.range(3).withColumnRenamed("id", "k"), a.limit(1).withColumn("v", F.lit("z")), "k", "v").collect()
    with pytest.raises(entities.JoinError):
        entities.require_agreement(a.withColumn("w", F.lit("x")), [("v", "v", "w")])


def test_checks_fail_on_bad_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k long, v string")
    got = {r["check"]: r["passed"] for r in checks.suite([checks.unique_check("u", df, ["k"]), checks.vocabulary_check("v", df, "v", ["a"]), checks.constant_check("c", df, "v")]).collect()}
    assert got == {"u": False, "v": False, "c": True}


def test_text_formats(spark):
    fa = spark.createDataFrame([(">a one\nMK V\nL\n>b\n\nGG\n",)], "value string")
    assert [(r["name"], r["sequence"]) for r in formats.fasta(fa).collect()] == [("a", "MKVL"), ("b", "GG")]
    pdb = ["ATOM      1  CA AALA A  12      11.104   6.134  -6.504  1.00  0.00           C", "ATOM      2  CA BALA A  12      11.104   6.134  -6.504  1.00  0.00           C", "ATOM      3  H   ALA A  12      11.104   6.134  -6.504  1.00  0.00           H", "HETATM    4  O   HOH A  99       1.000   2.000   3.000  1.00  0.00           O"]
    atoms = formats.pdb_atoms(spark.createDataFrame([(x,) for x in pdb], "value string")).collect()
    assert [(r["name"], r["residue"], r["number"], r["x"], r["element"]) for r in atoms] == [("CA", "ALA", 12, 11.104, "C")]
    sdf = "m\n\n\n  2  0\n    1.0000    2.0000    3.0000 C   0\n    4.0000    5.0000    6.0000 H   0\nM  END\n>  <minimizedAffinity>\n-7.5\n\n$$$$\n"
    mols = formats.sdf_atoms(spark.createDataFrame([(sdf,)], "value string")).collect()
    assert [(r["element"], r["y"], r["affinity"]) for r in mols] == [("C", 2.0, -7.5)]
    cif = "data_x\nloop_\n_atom_site.id\n_atom_site.label_atom_id\n1 CA\n2 'C B'\n#\n"
    assert [r["atom"] for r in formats.mmcif_atoms(spark.createDataFrame([(cif,)], "value string")).collect()] == [{"id": "1", "label_atom_id": "CA"}, {"id": "2", "label_atom_id": "C B"}]


def test_work_log_and_report(spark):
    log = spark.createDataFrame([("Sleeping for 30s. Reason: queue",), ("Sleeping for 5s. Reason: throttle",), ("ok",)], "m string")
    assert {r["reason"]: r["seconds"] for r in worklog.messages(log, "m").collect()} == {"queue": 30, "throttle": 5}
    assert summary.markdown([{"a": 1.23456, "b": None}], ["a", "b"]).splitlines()[-1] == "| 1.235 |  |"


def test_streams(spark, tmp_path):
    from sieveline.streaming import worklog as live

    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, id % 5 AS job, IF(id % 2 = 0, 'error', 'ok') AS status FROM range(60)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, job long, status string").parquet(src)
    q = live.refusals(stream, "ts", "error").writeStream.format("memory").queryName("refusals").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("refusals").agg(F.max("n")).first()[0] == 5
    q = live.upserts(stream, "job", "ts", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
