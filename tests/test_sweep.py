"""Splits of a sweep, shift between their folds, kernels, grouped fits and order statistics, held against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import calibration, fits, kernels, quantiles, shift, splits, sweep, sweep_shift


@pytest.fixture(scope="module")
def parts(spark):
    """Systems in many small components, and clusterings of both entities."""
    rng = random.Random(5)
    e = [(k * 10 + x, 100 * k + rng.randrange(4), f"l{k}_{rng.randrange(5)}") for k in range(60) for x in range(rng.randrange(1, 9))]
    entities = spark.createDataFrame(e, "system long, protein long, ligand string")
    proteins = spark.createDataFrame([(t, p, str(p // n)) for p in {x[1] for x in e} for t, n in (("0.30", 1), ("0.50", 2))], "protein_threshold string, protein long, pc string")
    ligands = spark.createDataFrame([(v, x, x if v == "a" else x[:-1]) for x in {y[2] for y in e} for v in "ab"], "ligand_variant string, ligand string, lc string")
    wanted = sweep.tags(spark, list(splits.ASSIGNERS), ["0.30", "0.50"], ["a", "b"], [0, 1])
    audit = sweep.contexts(entities, proteins, ligands, wanted)
    return entities, proteins, ligands, wanted, audit, sweep.sweep(audit, wanted)


def test_every_tag_is_the_single_call(spark, parts):
    *_, wanted, audit, folds = parts
    got = {}
    for r in folds.collect():
        got.setdefault(r["tag"], {})[r["system"]] = r["fold"]
    assert len(got) == 40
    for r in wanted.collect():
        own = audit.filter((F.col("protein_threshold") == r["protein_threshold"]) & (F.col("ligand_variant") == r["ligand_variant"])).select("system", "pc", "lc")
        alone = splits.ASSIGNERS[r["family"]](own, r["tag"])
        assert {x["system"]: x["fold"] for x in alone.collect()} == got[r["tag"]], r["tag"]


def test_components_are_those_of_the_graph(parts):
    audit = parts[4]
    rows = audit.collect()
    assert len({(r["protein_threshold"], r["ligand_variant"], r["system"]) for r in rows}) == len(rows)
    name = {}
    for r in rows:
        for node in (("p", r["pc"]), ("l", r["lc"])):
            key = (r["protein_threshold"], r["ligand_variant"], *node)
            assert name.setdefault(key, r["component"]) == r["component"]  # both clusters of a system are in its component


def test_write_read_and_validate(spark, parts, tmp_path):
    *_, wanted, audit, folds = parts
    wanted, folds = wanted.filter("ligand_variant = 'a'"), folds.filter("tag LIKE '%\\_\\_a\\_\\_%'")
    with pytest.raises(ValueError, match="no test fold"):  # ligands merged so far that a cold ligand's protein is never known
        sweep.write_sweep(parts[5], parts[3], audit, str(tmp_path))
    sweep.write_sweep(folds, wanted, audit, str(tmp_path))
    back, aud, index = sweep.read_sweep(spark, str(tmp_path))
    assert sweep.validate_sweep(back, aud, index).isEmpty() and index.count() == 20 and back.count() == folds.count()
    tag = "C2p__p0.30__a__seed0"
    one = back.filter(F.col("tag") == tag)
    system = one.filter("fold = 'test'").first()["system"]
    train = one.filter("fold = 'train'").first()["system"]
    mine = (F.col("tag") == tag) & (F.col("system") == system)
    problems = lambda df: {(r["tag"], r["problem"]) for r in sweep.validate_sweep(df, aud, index).collect()}
    assert problems(back.filter(~mine)) == {(tag, "systems lost"), (tag, "n_test isn't the index's")} | ({(tag, "no test fold")} if one.filter("fold = 'test'").count() == 1 else set())
    assert (tag, "systems repeated") in problems(back.unionByName(back.filter(mine)))
    assert (tag, "systems that the audit lacks") in problems(back.unionByName(back.filter(mine).withColumn("system", F.lit(-1).cast("long"))))
    assert (tag, "unknown folds") in problems(back.withColumn("fold", F.when(mine, "tset").otherwise(F.col("fold"))))
    pc = aud.filter((F.col("system") == train) & (F.col("protein_threshold") == "0.30") & (F.col("ligand_variant") == "a")).first()["pc"]
    same = [r["system"] for r in aud.filter((F.col("pc") == pc) & (F.col("protein_threshold") == "0.30") & (F.col("ligand_variant") == "a")).collect()]
    if len(same) > 1:
        moved = back.withColumn("fold", F.when((F.col("tag") == tag) & (F.col("system") == train), "val").otherwise(F.col("fold")))
        assert (tag, "pc clusters in several folds") in problems(moved)
    leak = folds.withColumn("fold", F.when(F.col("tag") == tag, F.when(F.col("system") % 2 == 0, "train").otherwise("test")).otherwise(F.col("fold")))
    with pytest.raises(ValueError, match="pc clusters in several folds"):
        sweep.write_sweep(leak, wanted, audit, str(tmp_path / "no"))


def test_contexts_must_map_every_system(spark, parts):
    entities, proteins, ligands, *_ = parts
    some = proteins.first()["protein"]
    with pytest.raises(ValueError, match="no_pc"):
        sweep.contexts(entities, proteins.filter(F.col("protein") != some), ligands)
    with pytest.raises(ValueError):
        sweep.contexts(entities, proteins.unionByName(proteins.filter(F.col("protein") == some)), ligands)
    with pytest.raises(ValueError, match="sum to 1"):
        sweep.sweep(parts[4], parts[3], (0.8, 0.1, 0.2))


# Order statistics


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_quantiles_in_rounds(spark, monkeypatch, by):
    monkeypatch.setattr(quantiles, "SPLITTERS", 4)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal(300), np.zeros(400), np.ones(200), [1e300, -1e300, 5e-324], np.full(50, 7.0)])
    rows = [(float(v), None if i % 7 == 0 else i % 3, "k" if i % 2 else None) for i, v in enumerate(x)] + [(None, 1, "k")]
    df = spark.createDataFrame(rows, "x double, g int, h string").repartition(5)
    at = [0.0, 0.1, 0.5, 0.75, 0.9, 1.0]
    want = {tuple(r[c] for c in by): r["q"] for r in df.groupBy(*by).agg(F.percentile("x", at).alias("q")).collect()}
    for small in (0, 3, 40):
        got = {tuple(r[c] for c in by): r["quantiles"] for r in quantiles.quantiles(df, "x", at, by, small=small).collect()}
        assert got == want


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "x double, g int")
    assert quantiles.quantiles(df, "x", [0.5]).first()["quantiles"] in (None, [None])
    assert quantiles.quantiles(df, "x", [0.5], ("g",)).count() == 0


# Kernels


def plain_mmd2(k, y):
    a, b = np.flatnonzero(y), np.flatnonzero(1 - y)
    own = lambda i: (k[np.ix_(i, i)].sum() - k[i, i].sum()) / (len(i) * (len(i) - 1))
    return own(a) + own(b) - 2 * k[np.ix_(a, b)].mean()


@pytest.mark.parametrize("kind", ["tanimoto", "rbf"])
def test_kernel_null_in_blocks(spark, kind):
    rng = np.random.default_rng(3)
    data = {}
    for g, n in (("a", 37), ("b", 20), ("c", 3)):
        v = (rng.random((n, 12)) < 0.4).astype(float) if kind == "tanimoto" else rng.standard_normal((n, 4))
        data[g] = (v, (np.arange(n) % 3 == 0).astype(int))
    df = spark.createDataFrame([(g, i, int(y[i]), v[i].tolist()) for g, (v, y) in data.items() for i in range(len(y))], "g string, i long, y int, v array<double>")
    kernel = kernels.tanimoto if kind == "tanimoto" else kernels.rbf(0.3)
    got = {r["g"]: r for r in kernels.kernel_null(kernels.numbered(df, "y", "v", "i", ("g",)), kernel, ("g",), 50, block=8).collect()}
    for g, (v, y) in data.items():
        n, n1 = len(y), int(y.sum())
        if kind == "tanimoto":
            k = np.array([[sum(p * q) / max(1, sum(np.maximum(p, q))) for q in v] for p in v])
        else:
            k = np.exp(-0.3 * ((v[:, None] - v[None]) ** 2).sum(-1))
        if n1 < 2:
            assert got[g]["mmd2"] is None and got[g]["p"] is None
            continue
        seen = plain_mmd2(k, y)
        null = [plain_mmd2(k, (shift._shuffled(np.arange(n), n, p) < n1).astype(int)) for p in range(1, 51)]
        assert got[g]["mmd2"] == pytest.approx(seen, abs=1e-12) and (got[g]["n0"], got[g]["n1"]) == (n - n1, n1)
        assert got[g]["p"] == pytest.approx((sum(m >= seen - 1e-12 for m in null) + 1) / 51)


def test_median_distance_by_counting(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((30, 3)), np.ones((12, 3)), rng.standard_normal((10, 3)) * 1e6])
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "i long, y int, v array<double>")
    d = sorted(((v[i] - v[j]) ** 2).sum() for i in range(len(v)) for j in range(i))
    got = kernels.median_squared_distance(kernels.numbered(df, "y", "v", "i"), block=9, cells=8)
    assert got == pytest.approx(d[(len(d) - 1) // 2], rel=1e-6)
    assert kernels.median_squared_distance(kernels.numbered(df.limit(1), "y", "v", "i")) is None


def test_permutation_null_is_calibrated(spark):
    """Forty trials of one distribution: p values are spread out, few are small."""
    rng = np.random.default_rng(11)
    rows = [(t, i, i % 2, (rng.random(16) < 0.3).astype(float).tolist()) for t in range(40) for i in range(60)]
    df = spark.createDataFrame(rows, "t long, i long, y int, v array<double>")
    p = [r["p"] for r in kernels.kernel_null(kernels.numbered(df, "y", "v", "i", ("t",)), kernels.tanimoto, ("t",), 100).collect()]
    assert len(p) == 40 and 0.3 <= np.mean(p) <= 0.7 and np.mean(np.array(p) < 0.05) <= 0.25


# Grouped fits


def plain_logistic(x, y, penalty):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, penalty), 0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


@pytest.mark.parametrize("turn", [10**6, 10])
def test_grouped_fits(spark, monkeypatch, turn):
    monkeypatch.setattr(fits, "COEFFICIENTS", turn)
    rng = np.random.default_rng(4)
    data = {}
    for g in range(5):
        x = rng.standard_normal((80, 3)) * (1 + g)
        y = (x @ [1, -2, 0.5] + rng.standard_normal(80) * (0 if g == 4 else 2) > 0.3).astype(int)
        data[g] = (x, y if g != 3 else np.ones(80, int), rng.integers(0, 3, 80))
    df = spark.createDataFrame([(g, int(f), int(b), a.tolist()) for g, (x, y, fs) in data.items() for a, b, f in zip(x, y, fs, strict=True)], "g int, f int, y int, v array<double>").repartition(3)
    got = {(r["g"], r["fold"]): r["w"] for r in fits.grouped_logistic(df, "g", "y", "v", "f", 3).collect()}
    assert len(got) == 15 and all(got[3, f] is None for f in range(3))
    for (g, f), w in got.items():
        if g != 3:
            x, y, fs = data[g]
            assert np.allclose(w, plain_logistic(x[fs != f], y[fs != f], 1.0), rtol=1e-6, atol=1e-8)


# Shift rows


def test_shift_rows(spark, parts):
    folds = parts[5].filter(F.col("tag").isin("C1__p0.30__a__seed0", "C2l__p0.30__b__seed1", "C3__p0.50__a__seed0", "C3comp__p0.30__a__seed0"))
    rng = np.random.default_rng(6)
    ligands = sorted(r["ligand"] for r in folds.select("ligand").distinct().collect())
    marks = {x: (rng.random(10) < 0.35).astype(float) for x in ligands}
    vectors = spark.createDataFrame([(x, v.tolist()) for x, v in marks.items()], "ligand string, v array<double>")
    sim = lambda a, b: float((a * b).sum() / max(1, np.maximum(a, b).sum()))
    pairs = [(a, b, sim(marks[a], marks[b])) for i, b in enumerate(ligands) for a in ligands[:i]]
    ligand_pairs = spark.createDataFrame([p for p in pairs if p[2] > 0], "i string, j string, sim double")
    proteins = sorted(r["protein"] for r in folds.select("protein").distinct().collect())
    same = {(a, b): 1 / (1 + abs(a - b)) for i, b in enumerate(proteins) for a in proteins[:i] if a // 300 == b // 300}
    protein_pairs = spark.createDataFrame([(a, b, s) for (a, b), s in same.items()], "i long, j long, sim double")
    got = {r["tag"]: r for r in sweep_shift.shift_rows(folds, vectors, ligand_pairs, {"near": protein_pairs}, most=12, permutations=30, parts=3).collect()}
    rows = folds.collect()
    both = {**{(a, b): s for a, b, s in pairs}, **{(b, a): s for a, b, s in pairs}}
    psim = {**same, **{(b, a): s for (a, b), s in same.items()}}
    for tag, r in got.items():
        side = {f: sorted((__import__("hashlib").md5(f"{tag}|shift|{x['system']}".encode()).hexdigest(), x["system"], x["ligand"]) for x in rows if x["tag"] == tag and x["fold"] == f)[:12] for f in ("train", "test")}
        m = min(map(len, side.values()))
        assert r["measurable"] == (m > 0)
        if not m:
            assert r["mmd2"] is None and r["c2st_auc"] is None and r["max_ligand_nn"] is None
            continue
        sample = sorted((s, f == "test", lig, t) for f in side for t, (_, s, lig) in enumerate(side[f][:m], 1))
        y = np.array([int(q[1]) for q in sample])
        v = np.array([marks[q[2]] for q in sample])
        k = np.array([[sim(a, b) for b in v] for a in v])
        assert r["mmd_n_per_side"] == m and r["mmd2"] == pytest.approx(plain_mmd2(k, y), abs=1e-12)
        if m >= 6:
            fold = np.array([q[3] % 3 for q in sample])
            score = np.zeros(len(y))
            for f in range(3):
                w = plain_logistic(v[fold != f], y[fold != f], 1.0)
                score[fold == f] = 1 / (1 + np.exp(-(v[fold == f] @ w[:-1] + w[-1])))
            wins = np.mean([(a > b) + 0.5 * (a == b) for a in score[y == 1].round(12) for b in score[y == 0].round(12)])
            assert r["c2st_auc"] == pytest.approx(wins, abs=1e-9) or abs(r["c2st_auc"] - wins) <= 2 / m**2  # equal sets may tie or not, by rounding
            hits = int(((score >= 0.5) == (y == 1)).sum())
            assert r["c2st_acc"] == pytest.approx(hits / len(y)) and r["c2st_p"] == pytest.approx(calibration.binomial_tail(hits, len(y)))
        for entity, name, sims, at in (("ligand", "ligand", both, 0.4), ("protein", "protein_near", psim, 0.3)):
            tr, te = ({x[entity] for x in rows if x["tag"] == tag and x["fold"] == f} for f in ("train", "test"))
            near = [1.0 if a in tr else max([sims.get((a, b), 0.0) for b in tr], default=0.0) for a in te]
            assert r[f"n_test_{name}s"] == len(te) and r[f"n_train_{name}s"] == len(tr)
            assert r[f"max_{name}_nn"] == pytest.approx(max(near)) and r[f"mean_{name}_nn"] == pytest.approx(np.mean(near)) and r[f"p95_{name}_nn"] == pytest.approx(np.percentile(near, 95))
            assert r[f"frac_test_{name}s_nn_ge_{at}"] == pytest.approx(np.mean(np.array(near) >= at))
    assert math.isfinite(got["C1__p0.30__a__seed0"]["c2st_auc"])


def test_command_line(spark, parts, tmp_path):
    from sieveline.__main__ import main

    entities, proteins, ligands, *_ = parts
    at = lambda x: str(tmp_path / x)
    for name, df in (("e", entities), ("p", proteins), ("l", ligands)):
        df.write.parquet(at(name))
    main(["sweep", at("e"), at("p"), at("l"), at("s"), "--families", "C2p", "C3", "--ligand-variants", "a", "--seeds", "3"], spark)
    main(["validate", at("s")], spark)
    names = entities.select("ligand").distinct()
    names.select("ligand", F.array(F.lit(1.0), (F.crc32(F.col("ligand").cast("binary")) % 2).cast("double")).alias("v")).write.parquet(at("v"))
    spark.createDataFrame([], "i string, j string, sim double").write.parquet(at("lp"))
    spark.createDataFrame([], "i long, j long, sim double").write.parquet(at("pp"))
    main(["shift", at("s"), at("v"), at("lp"), at("pp"), at("r"), "--n-sample", "20", "--n-perm", "10"], spark)
    assert spark.read.parquet(at("r")).filter("measurable AND mmd_p > 0").count() == 4
    spark.createDataFrame([(1, "aaaaa"), (2, "aaaab"), (3, "zzzzz")], "id long, s string").write.parquet(at("q"))
    main(["sequences", at("q"), at("c"), "--identity", "0.8"], spark)
    assert {(r["id"], r["representative"]) for r in spark.read.parquet(at("c")).collect()} == {(1, 1), (2, 1), (3, 3)}
    folds = spark.read.parquet(at("s") + "/folds")
    folds.limit(1).select("system", "fold", "tag").write.partitionBy("tag").mode("append").parquet(at("s") + "/folds")
    with pytest.raises(SystemExit, match="repeated"):
        main(["validate", at("s")], spark)


def test_manifest_command(spark, tmp_path):
    import hashlib

    from sieveline.__main__ import main

    (tmp_path / "d").mkdir()
    for n in "ab":
        (tmp_path / "d" / n).write_text(n * 3)
    lines = [f"{hashlib.sha256((n * 3).encode()).hexdigest()}  {n}" for n in "ab"]
    (tmp_path / "m").write_text("\n".join(lines))
    main(["manifest", str(tmp_path / "d"), str(tmp_path / "m")], spark)
    (tmp_path / "d" / "a").write_text("other")
    (tmp_path / "d" / "c").write_text("new")
    with pytest.raises(SystemExit, match="a: differs\nc: unlisted"):
        main(["manifest", str(tmp_path / "d"), str(tmp_path / "m")], spark)
