"""What the findings of round 3 on pairs name: each test failed before its change."""

import math
import random
import re

import numpy as np
import pytest

from sieveline.operators import blocks, contacts, matching, similarity


def test_sets_meet_in_blocks(spark, monkeypatch):
    """pairs of sets of all sizes over many blocks, by members rare and common, without a row for a shared member."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 400)
    monkeypatch.setattr(blocks, "AT_ONCE", 64)
    rng = random.Random(5)
    base = [set(rng.sample(range(200_000), rng.choice([1, 2, 5, 40, 90]))) for _ in range(25)]
    sets = [{x for x in rng.choice(base) if rng.random() < 0.8} | {7, rng.randrange(200_000)} for _ in range(150)]
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s] * 2, "id long, feature long")
    sim = lambda a, b: np.float32(len(a & b) / len(a | b))
    for floor in (0.3, 0.75):
        got = similarity.pairs_above(df, floor, 1 << 20)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(i, j, s) for i in range(150) for j in range(i + 1, 150) if (s := sim(sets[i], sets[j])) >= np.float32(floor)]


def test_nearest_sets_meet_in_blocks(spark, monkeypatch):
    """the most similar set of all blocks, the least id of equals, whether members are counted by lists or by matrices."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 600)
    monkeypatch.setattr(blocks, "CELLS", 50)
    rng = random.Random(6)
    sets = [{rng.randrange(60) if rng.random() < 0.5 else rng.randrange(10**6) for _ in range(rng.randrange(1, 30))} for _ in range(120)]
    asked = [{rng.randrange(60) for _ in range(6)} for _ in range(30)] + [{10**6 - 1 - k for k in range(3)}]
    frame = lambda rows: spark.createDataFrame([(i, x) for i, s in enumerate(rows) for x in s], "id long, feature long")
    got = {r["id"]: (r["j"], r["sim"]) for r in similarity.cross_nearest(frame(asked), frame(sets), 1 << 20).collect()}
    sim = lambda a, b: np.float32(len(a & b) / len(a | b))
    for i, a in enumerate(asked):
        best = max(sim(a, s) for s in sets)
        assert got[i] == ((min(j for j, s in enumerate(sets) if sim(a, s) == best), best) if best else (None, 0.0))


def test_distance_join_has_no_key_of_a_whole_system(spark):
    """atoms meet in columns, with the distances of all pairs of a system; an anchor may lie elsewhere."""
    rng = random.Random(28)
    point = lambda: [rng.uniform(-9, 9) for _ in range(3)]
    atoms = [(s, r, r % 4 > 0 and k == 0, *point()) for s in range(2) for r in range(20) for k in range(3)]
    drug = [(s, i, *point()) for s in range(2) for i in range(25)]
    residues = spark.createDataFrame(atoms, "system int, res_row int, is_anchor boolean, x double, y double, z double")
    got = contacts.distance_join(residues, spark.createDataFrame(drug, "system int, atom_idx int, x double, y double, z double"), 3.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join [system#" in plan and not re.search(r"Join \[system#\d+\]", plan)
    want = {}
    for s, r, anchor, *p in atoms:
        for t, i, *q in drug:
            if s == t:
                at = want.setdefault((s, r, i), [9e9, None])
                at[0] = min(at[0], math.dist(p, q))
                at[1] = math.dist(p, q) if anchor else at[1]
    want = {k: v for k, v in want.items() if v[0] <= 3}
    rows = {(x["system"], x["res_row"], x["atom_idx"]): (x["d_min"], x["d_anchor"]) for x in got.collect()}
    assert rows.keys() == want.keys() and any(v[1] is not None and v[1] > 9 for v in want.values())
    for k, (low, anchor) in rows.items():
        assert low == pytest.approx(want[k][0]) and (anchor is None if want[k][1] is None else anchor == pytest.approx(want[k][1]))


def test_graphs_are_refined_where_they_meet(spark, monkeypatch):
    """matches of graphs without a round of joins for colours, with forms remembered and forgotten."""
    monkeypatch.setattr(matching, "colours", lambda *a, **k: pytest.fail("rounds of joins"))
    monkeypatch.setattr(matching, "FORMS", 2)
    nodes = [(g, i, x) for g, word in (("a", "CCO"), ("b", "OCC"), ("c", "CCC"), ("d", "CCCC")) for i, x in enumerate(word)]
    edges = [(g, i, i + 1, "1") for g, n in (("a", 2), ("b", 2), ("c", 2), ("d", 3)) for i in range(n)]
    pairs = [("a", "b"), ("c", "c"), ("a", "c"), ("c", "d"), ("d", "d"), ("a", "?")]
    frame = spark.createDataFrame
    got = matching.matches(frame(nodes, "graph string, node long, label string"), frame(edges, "graph string, a long, b long, label string"), frame(pairs, "ref string, pose string"))
    assert {(r["ref"], r["pose"]): (r["status"], r["maps"]) for r in got.collect()} == {
        ("a", "b"): ("matched", [[2, 1, 0]]), ("c", "c"): ("matched", [[0, 1, 2], [2, 1, 0]]), ("a", "c"): ("none", []), ("c", "d"): ("sizes_differ", []),
        ("d", "d"): ("matched", [[0, 1, 2, 3], [3, 2, 1, 0]]), ("a", "?"): ("sizes_differ", []),
    }
