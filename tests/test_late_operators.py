"""Shells by cells, motions, consistency of sources, remapping by name, eras, and job inputs that are written and read again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import calibration, contacts, entities, reliability
from sieveline.sources import structures


def test_shell_by_cells(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-40, 40, (300, 3)), rng.uniform(-10, 10, (20, 3))
    atoms = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(a)], "system int, atom_id int, x double, y double, z double")
    ligand = spark.createDataFrame([(1, *map(float, p)) for p in b] + [(2, 0.0, 0.0, 0.0)], "system int, x double, y double, z double")
    near = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1)
    got = {r["atom_id"]: r["d_min"] for r in contacts.shell_atoms(atoms, ligand, 9.0).collect()}
    assert got == {i: pytest.approx(d) for i, d in enumerate(near) if d <= 9}


def test_superpositions_give_the_motion(spark):
    rng = np.random.default_rng(2)
    rows, kept = [], {}
    for k in range(6):
        a = rng.standard_normal((12, 3))
        q = np.linalg.qr(rng.standard_normal((3, 3)))[0]
        q[:, 0] *= np.sign(np.linalg.det(q)) * (-1 if k == 5 else 1)  # the last is a reflection, which no motion undoes
        b = a @ q.T + rng.standard_normal(3) * 9 + rng.standard_normal((12, 3)) * 0.1 * (k % 2)
        kept[k] = (a, b, q)
        rows += [(k, *map(float, p), *map(float, r)) for p, r in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "system int, ax double, ay double, az double, bx double, by double, bz double")
    for r in reliability.superpositions(df).collect():
        a, b, q = kept[r["system"]]
        m = np.array(r["rotation"]).reshape(3, 3)
        assert np.linalg.det(m) == pytest.approx(1) and np.allclose(m @ m.T, np.eye(3))
        moved = a @ m.T + np.array(r["shift"])
        assert np.sqrt(((moved - b) ** 2).sum(1).mean()) == pytest.approx(r["rmsd"], abs=1e-6)
        if r["system"] in (0, 2, 4):
            assert np.allclose(m, q) and r["rmsd"] < 1e-6
        assert r["rmsd"] < 0.3 or r["system"] == 5


def test_three_sources_must_agree(spark):
    base = spark.createDataFrame([(1, "P1", "L1"), (2, "P2", None), (3, "P1", "L3")], "system int, protein string, ligand string")
    one, two = base.drop("ligand"), base.drop("protein").filter("system < 3")
    three = base.withColumn("ligand", F.when(F.col("system") == 3, "LX").otherwise(F.col("ligand")))
    sources = {"one": one, "two": two, "three": three}
    got = {(r["source"], r["column"]): (r["rows"], r["known"], r["agree"]) for r in entities.consistency_report(base, "system", sources, ["protein", "ligand"]).collect()}
    assert got == {("one", "protein"): (3, 3, 3), ("two", "ligand"): (3, 2, 2), ("three", "protein"): (3, 3, 3), ("three", "ligand"): (3, 3, 2)}
    with pytest.raises(entities.JoinError, match="three"):
        entities.require_consistency(base, "system", sources, ["protein", "ligand"], complete=False)
    with pytest.raises(entities.JoinError, match="two"):
        entities.require_consistency(base, "system", {"one": one, "two": two}, ["protein", "ligand"])
    assert entities.require_consistency(base, "system", {"one": one, "two": two}, ["protein", "ligand"], complete=False).count() == 2
    with pytest.raises(entities.JoinError, match="twice"):
        entities.consistency_report(base, "system", {"one": one.unionByName(one)}, ["protein"])


def test_chains_are_told_by_their_names(spark):
    kind = "system string, chain string, sequence string"
    d = spark.createDataFrame([(s, c, q) for s in "abcdef" for c, q in (("A", "MKV"), ("B", "GG"))], kind)
    p = [("a", "A", "MKV"), ("a", "B", "GG"), ("b", "A", "MKV"), ("b", "C", "GG"), ("c", "A", "MKV"), ("c", "B", "GG"), ("c", "B", "GG"), ("d", "A", "MK"), ("d", "B", "GG"), ("e", "A", "MKL"), ("e", "B", "GG"), ("f", "A", "MKV")]
    got = {tuple(r) for r in entities.remap_problems(spark.createDataFrame(p, kind), d).collect()}
    assert got == {("b", "C", "unknown"), ("b", "B", "lacking"), ("c", "B", "repeated"), ("d", "A", "length"), ("e", "A", "sequence"), ("f", "B", "lacking")}


def test_accuracy_by_era(spark):
    rng = random.Random(3)
    rows = [(k, arm, rng.random() + (0.3 if arm == "x" and k % 2 else 0), k % 2) for k in range(200) for arm in "xy"]
    df = spark.createDataFrame(rows, "k int, arm string, acc double, late int")
    got = {r["arm"]: r for r in calibration.accuracy_by_era(df, "arm", "acc", F.col("late") == 0, "k", 200).collect()}
    for arm in "xy":
        mean = lambda late: np.mean([a for _, g, a, e in rows if g == arm and e == late])  # noqa: B023, E731
        r = got[arm]
        assert (r["n_before"], r["n_after"]) == (100, 100) and r["difference"] == pytest.approx(mean(1) - mean(0))
        assert r["low"] < r["difference"] < r["high"]
    assert got["x"]["low"] > 0.1 and got["y"]["low"] < 0 < got["y"]["high"]


def test_job_inputs_are_written_and_read_again(spark, tmp_path):
    rows = [("j1", "A", "protein", "MKV", "a.a3m"), ("j1", "B", "protein", "MKV", None), ("j1", "C", "ligand", 'C(=O)"O\\#', None), ("j1", "D", "dna", "ACGT", None), ("2", "A", "protein", "GG", None)]
    chains = spark.createDataFrame(rows, "job string, chain string, kind string, sequence string, msa string")
    texts = structures.job_texts(chains, "job")
    structures.write_texts(texts, "job", str(tmp_path / "out"))
    back = structures.read_texts(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in texts.collect()}
    got = {(r["key"], r["entity"], r["kind"], r["sequence"], r["chains"], r["has_msa"]) for r in structures.job_entities(back, "key").collect()}
    assert got == {("j1", 0, "protein", "MKV", 2, True), ("j1", 1, "ligand", 'C(=O)"O\\#', 1, False), ("j1", 2, "dna", "ACGT", 1, False), ("2", 0, "protein", "GG", 1, False)}
    assert len(list((tmp_path / "out").glob("key=*"))) == 2
