"""Operators whose rule is sequential or numerical, against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sieveline.operators import calibration, ranking, reliability, reports, shift, similarity, splits, store
from sieveline.sources import structures


def walk(rows, order, n_test, n_val):
    """One system after another leaves train, unless it is the last of a cluster there."""
    p, q = {}, {}
    for _, a, b in rows:
        p[a], q[b] = p.get(a, 0) + 1, q.get(b, 0) + 1
    by, fold = {k: (a, b) for k, a, b in rows}, {k: "train" for k, _, _ in rows}
    for r, k in enumerate(order[: n_test + n_val]):
        a, b = by[k]
        if p[a] > 1 and q[b] > 1:
            fold[k] = "test" if r < n_test else "val"
            p[a], q[b] = p[a] - 1, q[b] - 1
    return fold


@pytest.mark.parametrize("clusters,fractions", [(60, (0.1, 0.4, 0.5)), (25, (0.0, 0.5, 0.5)), (300, (0.2, 0.3, 0.5))])
def test_covered_split_is_the_walk(spark, clusters, fractions):
    import hashlib

    rng = random.Random(clusters)
    rows = [(k, rng.randrange(clusters), rng.randrange(clusters)) for k in range(150)]
    order = sorted((k for k, _, _ in rows), key=lambda k: hashlib.md5(f"s|{k}".encode()).hexdigest())
    ctx = spark.createDataFrame(rows, "system long, pc long, lc long")
    got = {r["system"]: r["fold"] for r in splits.random_covered(ctx, "s", fractions).collect()}
    assert got == walk(rows, order, round(fractions[2] * 150), round(fractions[1] * 150))


def test_greedy_partition(spark):
    rng = random.Random(5)
    sizes = {k: rng.randrange(1, 30) for k in range(60)}
    got = {r["k"]: r["fold"] for r in splits.greedy_partition(spark.createDataFrame(list(sizes.items()), "k long, n long"), "k", "s").collect()}
    total = sum(sizes.values())
    per = {f: sum(n for k, n in sizes.items() if got[k] == f) for f in splits.FOLDS}
    assert all(abs(per[f] / total - x) < 0.03 for f, x in zip(splits.FOLDS, splits.FRACTIONS, strict=True))
    assert splits.axis_fractions() == pytest.approx((0.5857864, 0.2071068, 0.2071068))


def test_written_split_is_checked(spark, tmp_path):
    rows = [(k, k % 30, k % 20) for k in range(600)]
    ctx = spark.createDataFrame(rows, "system long, pc long, lc long")
    back = splits.write(splits.ASSIGNERS["C2p"](ctx, "s"), "C2p", str(tmp_path / "s"))
    assert back.count() == 600
    twice = splits.ASSIGNERS["C2p"](ctx, "s").filter("fold <> 'excluded'")
    with pytest.raises(ValueError, match="repeated"):
        splits.write(twice.unionByName(twice.limit(1)), "C2p", str(tmp_path / "t"))


def test_fixed_dates_and_undated_rows(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2021-01-12"), (3, "2022-06-30"), (4, None)], "k long, d string")
    got = {r["k"]: r["fold"] for r in splits.temporal(df, "d", "2021-01-12", "2022-06-30").collect()}
    assert got == {1: "train", 2: "val", 3: "test", 4: "excluded"}
    with pytest.raises(ValueError, match="after test"):
        splits.temporal(df, "d", "2022-01-01", "2021-01-01")


def test_ranks_and_running_sums(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(40), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, x long, v long").repartition(7)
    order = [F.desc("x"), F.col("k")]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r["k"]: r["rank"] for r in ranking.ranked(df, order).collect()} == {r[0]: i for i, r in enumerate(want, 1)}
    total, sums = 0, {}
    for r in want:
        sums[r[0]] = total
        total += r[2]
    assert {r["k"]: r["s"] for r in ranking.running_sums(df, order, {"s": F.col("v")}).collect()} == sums


def test_kendall_on_ties_and_continuous_values(spark):
    rng = random.Random(7)
    for grid in (5, 10**6):
        pts = [(rng.randrange(grid), rng.randrange(grid)) for _ in range(150)]
        s = sum(((a > c) - (a < c)) * ((b > d) - (b < d)) for i, (a, b) in enumerate(pts) for c, d in pts[:i])
        t = len(pts) * (len(pts) - 1) / 2
        tied = [sum(v * (v - 1) / 2 for v in np.unique([p[k] for p in pts], return_counts=True)[1]) for k in (0, 1)]
        want = s / math.sqrt((t - tied[0]) * (t - tied[1]))
        got = shift.kendall(spark.createDataFrame(pts, "x long, y long"), "x", "y").first()["tau"]
        assert got == pytest.approx(want)


def pava(x, y):
    """Pooled means of y in the order of x."""
    blocks = []
    for a in sorted(set(x)):
        own = [v for u, v in zip(x, y, strict=True) if u == a]
        blocks.append([sum(own), len(own), [a]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {a: s / n for s, n, xs in blocks for a in xs}


def test_isotonic_is_pooled_means(spark):
    rng = random.Random(8)
    x = [rng.randrange(30) / 10 for _ in range(80)]
    y = [a + rng.gauss(0, 1) for a in x]
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double")
    fit = pava(x, y)
    for r in calibration.isotonic_predictions(df, df, "x", "y").collect():
        assert r["predicted"] == pytest.approx(fit[r["x"]])


def test_grouped_folds_are_disjoint_and_balanced(spark):
    rng = random.Random(9)
    rows = [(g,) for g in range(30) for _ in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(rows, "g long")
    folds = calibration.balanced_folds(df, "g", 5)
    assert folds.count() == folds.select("g").distinct().count() == 30
    load = [r["n"] for r in df.join(folds, "g").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(load) - min(load) < 20


def test_density_ratio_finds_the_shift(spark):
    rng = np.random.default_rng(10)
    source = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 800)], "x double")
    target = spark.createDataFrame([(float(v),) for v in rng.normal(1, 1, 800)], "x double")
    w = calibration.density_ratio(source, target, "x").toPandas()
    assert w["weight"].mean() == pytest.approx(1) and abs(np.average(w["x"], weights=w["weight"]) - 1) < 0.2


def test_permutations_are_permutations():
    for n in (1, 2, 7, 64, 1000):
        got = shift._shuffled(np.arange(n), n, 3)
        assert sorted(got.tolist()) == list(range(n))
    assert (shift._shuffled(np.arange(100), 100, 1) != shift._shuffled(np.arange(100), 100, 2)).any()


def test_binomial_tail():
    assert calibration.binomial_tail(0, 9) == 1 and calibration.binomial_tail(9, 9) == pytest.approx(2**-9)
    assert calibration.binomial_tail(60, 100) == pytest.approx(sum(math.comb(100, k) for k in range(60, 101)) / 2**100)


def test_classifier_tells_samples_apart_or_not(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 2, (rng.standard_normal(6) + (i % 2) * 2).tolist()) for i in range(160)] + [(1000 + i, 1, [9.0] * 6) for i in range(40)]
    r = shift.classifier_test(spark.createDataFrame(rows, "k long, y int, v array<double>"), "v", "y", "k").first()
    assert r["auc"] > 0.95 and r["p"] < 1e-6 and r["n_per_class"] == 80 and r["n"] == 160
    null = [(i, i % 2, rng.standard_normal(6).tolist()) for i in range(160)]
    df = spark.createDataFrame(null, "k long, y int, v array<double>")
    assert shift.classifier_test(df, "v", "y", "k").first()["p"] > 0.01
    assert shift.classifier_with_baseline(df.limit(20), "v", "y", "k").first()["auc"] is None


def test_first_component(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 5)) * [5, 2, 1, 1, 1]
    got = shift.first_component(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), "v", "k").toPandas().sort_values("k")["pc1"].to_numpy()
    want = x @ np.linalg.svd(x - x.mean(0))[2][0]
    assert np.allclose(got, want) or np.allclose(got, -want)


def test_superposition_is_the_least_distance(spark):
    rng = np.random.default_rng(13)
    a = rng.standard_normal((12, 3))
    b = a @ np.linalg.qr(rng.standard_normal((3, 3)))[0] + rng.standard_normal((12, 3)) * 0.1 + 4
    x, y = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(x.T @ y)
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    want = math.sqrt((((x @ turn) - y) ** 2).sum() / 12)
    got = reliability.superposed(spark.createDataFrame([(1, *p.tolist(), *q.tolist()) for p, q in zip(a, b, strict=True)], "system long, ax double, ay double, az double, bx double, by double, bz double")).first()
    assert got["rmsd"] == pytest.approx(want)


def test_nearest_in_train_falls_back(spark):
    rng = random.Random(14)
    sets = [{rng.randrange(40) for _ in range(8)} for _ in range(40)]
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id long, feature long")
    folds = spark.createDataFrame([(i, "test" if i % 2 else "train") for i in range(41)], "node long, fold string")
    pairs = similarity.pairs_above(df, 0.3)
    got = {r["node"]: (r["nearest"], r["fell_back"]) for r in similarity.nearest_train_exact(df, folds, similarity.top_neighbours(pairs, 1)).collect()}
    sim = lambda a, b: np.float32(len(a & b) / len(a | b))
    for i in range(1, 41, 2):
        assert got[i][0] == max(sim(sets[i], sets[j]) for j in range(0, 40, 2))
    assert {f for _, f in got.values()} == {True, False}


def atom(serial, name, residue, chain, number, x, element, record="ATOM", alt=" "):
    return f"{record:<6}{serial:>5} {name:<4}{alt}{residue:>3} {chain}{number:>4}    {x:8.3f}{0.0:8.3f}{0.0:8.3f}  1.00  0.00          {element:>2}"


def test_pdb_residues_and_ligand(spark):
    lines = [
        atom(1, " N", "ALA", "A", 5, 1, "N"), atom(2, " CA", "ALA", "A", 5, 2, "C"), atom(3, " CB", "ALA", "A", 5, 3, "C", alt="B"), atom(4, " H", "ALA", "A", 5, 4, "H"),
        atom(5, " N", "GLY", "A", 2, 5, "N"), atom(6, " O", "GLY", "A", 2, 6, ""), atom(7, " C1", "LIG", "B", 1, 7, "", record="HETATM"), atom(8, " H1", "LIG", "B", 1, 8, "H", record="HETATM"),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    got = [(r["res_row"], r["number"], r["residue"], r["anchor"]["x"], r["n_heavy"]) for r in structures.pdb_residues(df).orderBy("res_row").collect()]
    assert got == [(0, "5", "ALA", 2.0, 2), (1, "2", "GLY", 5.0, 2)]
    assert [(r["element"], r["x"]) for r in structures.pdb_ligand(df).collect()] == [("C", 7.0)]


def test_mmcif_residues(spark):
    items = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    rows = ["ATOM 1 N N ALA A 1 0 0 0 1", "ATOM 2 C CA ALA A 1 1 0 0 1", "ATOM 3 C C ALA A 1 2 0 0 1", "ATOM 4 C CB ALA A 1 3 3 0 1", "ATOM 5 H HA ALA A 1 9 9 9 1", "ATOM 6 C CA GLY A 2 4 0 0 1", "ATOM 7 N N GLY A 2 6 0 0 1",
            "HETATM 8 CA CA CA B 1 7 0 0 1", "ATOM 9 N N SER A 3 8 0 0 1", "HETATM 10 C C1 LIG C 1 1 1 1 1", "HETATM 11 C C1 LIG D 1 2 2 2 1", "ATOM 12 C CA ALA A 9 1 0 0 2"]
    text = "data_x\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in items) + "\n".join(rows) + "\n#\n"
    from sieveline.sources import formats

    atoms = structures.mmcif_table(formats.mmcif_atoms(spark.createDataFrame([(text,)], "value string"))).withColumn("system", F.lit("s"))
    got = structures.residues(atoms, ["system"]).orderBy("res_row").collect()
    assert [(r["res_row"], r["residue"], r["ca"]["x"], r["sc"]["x"], r["sc_valid"], r["pep"]["x"]) for r in got] == [(0, "ALA", 1.0, 3.0, True, 2.0), (1, "GLY", 4.0, 5.0, False, 4.0)]
    assert [(r["chain"], r["x"]) for r in structures.first_ligand(atoms, ["system"], ["LIG"]).collect()] == [("C", 1.0)]


def test_footers(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2]}), tmp_path / "x.parquet", compression="zstd")
    (tmp_path / "y").mkdir()
    pq.write_table(pa.table({"b": [1]}).replace_schema_metadata({"made": "/home/me"}), tmp_path / "y" / "z.parquet", compression="snappy")
    got = {r["path"].rsplit("/", 1)[1]: (r["rows"], r["codec"], r["columns"], "/home/me" in r["keys"]) for r in structures.footers(spark, str(tmp_path)).collect()}
    assert got == {"x.parquet": (2, "ZSTD", ["a"], False), "z.parquet": (1, "SNAPPY", ["b"], True)}


def test_job_entities(spark):
    pytest.importorskip("yaml")
    text = "sequences:\n- protein: {id: A, sequence: MK}\n- ligand: {id: L, smiles: CC}\n- protein: {id: [B, C], sequence: MK}\n- protein: {id: D, sequence: GG, msa: empty}\n"
    got = [(r["entity"], r["kind"], r["sequence"], r["chains"], r["has_msa"]) for r in structures.job_entities(spark.createDataFrame([("j", text)], "job string, value string"), "job").orderBy("entity").collect()]
    assert got == [(0, "protein", "MK", 3, False), (1, "ligand", "CC", 1, False), (2, "protein", "GG", 1, True)]


def test_poses_and_symmetry(spark):
    poses = spark.createDataFrame([(1, 0, float("nan")), (1, 1, -5.0), (1, 2, -7.0), (2, 0, None), (2, 1, float("nan"))], "s long, p long, score double")
    assert {r["s"]: r["p"] for r in store.best_pose(poses, ["s"], "score", "p").collect()} == {1: 2, 2: 0}
    rng = np.random.default_rng(15)
    anchor = rng.standard_normal((5, 3))
    cands = [anchor[::-1] + 3, anchor + 7 + rng.standard_normal((5, 3)) * 0.01, rng.standard_normal((5, 3))]
    rows = [(1, c, i, *p.tolist()) for c, x in enumerate(cands) for i, p in enumerate(x)]
    got = store.best_order(spark.createDataFrame(rows, "s long, candidate long, atom long, x double, y double, z double"), spark.createDataFrame([(1, i, *p.tolist()) for i, p in enumerate(anchor)], "s long, atom long, x double, y double, z double"), ["s"]).first()
    d = (cands[1] - cands[1].mean(0)) - (anchor - anchor.mean(0))
    assert got["candidate"] == 1 and got["score"] == pytest.approx((d * d).sum(1).mean(), abs=1e-8)


def test_reports():
    assert reports.latex_table([{"a": 12345, "b": 0.5, "c": None, "d": "x_y"}], ["a", "b", "c", "d"]).splitlines()[4] == r"12{,}345 & 0.500 & -- & x\_y \\"
    assert reports.replaced_block("a\n<!-- t:begin -->\nold\n<!-- t:end -->\nb", "t", "new") == "a\n<!-- t:begin -->\nnew\n<!-- t:end -->\nb"
    with pytest.raises(ValueError, match="no block"):
        reports.replaced_block("a", "t", "b")
    assert reports.pending("one\ntwo TBD\n???") == [(2, "TBD"), (3, "???")]


def test_dictionary(spark):
    assert "| k | bigint | yes | the key |" in reports.dictionary({"t": spark.createDataFrame([], "k long").schema}, {("t", "k"): "the key"})


def test_command_line(spark, sf, tmp_path, capsys):
    from sieveline.__main__ import main

    main(["list"])
    assert "support_gradient" in capsys.readouterr().out.split()
    main(["run", "value_shares", sf, "--out", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    spark.createDataFrame([(k, k % 30, k % 20) for k in range(600)], "system long, pc long, lc long").write.parquet(str(tmp_path / "c"))
    main(["split", "C2l", str(tmp_path / "c"), str(tmp_path / "s"), "--seed", "7", "--fractions", "0.6,0.2,0.2"], spark)
    assert {r["fold"] for r in spark.read.parquet(str(tmp_path / "s")).select("fold").distinct().collect()} >= {"train", "test"}
    spark.createDataFrame([(i, x) for i in range(6) for x in range(i % 2 * 9, i % 2 * 9 + 5)], "id long, feature long").write.parquet(str(tmp_path / "f"))
    main(["cluster", str(tmp_path / "f"), str(tmp_path / "k"), "--floor", "0.5"], spark)
    assert spark.read.parquet(str(tmp_path / "k")).select("cluster").distinct().count() == 2
    main(["neighbours", str(tmp_path / "f"), str(tmp_path / "n"), "--top", "1"], spark)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 6
    main(["dictionary", str(tmp_path / "f")], spark)
    assert "| feature | bigint |" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["split", "C9", str(tmp_path / "c"), str(tmp_path / "x")], spark)


def test_filters_and_columns_reach_the_scan(spark, sf):
    """Selections are read by the scan: pushed filters, and no column that isn't asked for."""
    from sieveline.operators import selection
    from sieveline.plans.fixtures import table
    from sieveline.plans.registry import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = plan(selection.qualified(table(spark, sf, "customer"), [F.col("c_acctbal") > 0, F.col("c_nationkey") != 3]).select("c_custkey"))
    assert "GreaterThan(c_acctbal,0.0)" in got and "c_name" not in got
    assert "ReadSchema: struct<text:string>" not in plan(QUERIES["value_shares"](spark, sf)) and "struct<lang:string>" in plan(QUERIES["value_shares"](spark, sf))
    semi = table(spark, sf, "lineitem").join(table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS l_orderkey"), "l_orderkey", "left_semi").select("l_quantity")
    assert "EqualTo(o_orderstatus,F)" in plan(semi) and "struct<l_orderkey:bigint,l_quantity:double>" in plan(semi)
