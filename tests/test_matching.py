"""Graph matching against permutations tried one by one."""

import itertools
import random

import numpy as np
import pytest

from sieveline.operators import matching


def frames(spark, graphs):
    nodes = [(g, v, x) for g, (labels, _) in graphs.items() for v, x in labels.items()]
    edges = [(g, a, b, x) for g, (_, es) in graphs.items() for (a, b), x in es.items()]
    return spark.createDataFrame(nodes, "graph string, node long, label string"), spark.createDataFrame(edges, "graph string, a long, b long, label string")


def brute(one, two):
    """All maps of two's nodes, in order, to one's, in lexicographic order."""
    (l1, e1), (l2, e2) = one, two
    if len(l1) != len(l2):
        return None
    near = lambda es: {frozenset(k): v for k, v in es.items()}
    a, b, names = near(e1), near(e2), sorted(l2)
    out = []
    for p in itertools.permutations(sorted(l1)):
        m = dict(zip(names, p, strict=True))
        if all(l1[m[v]] == l2[v] for v in names) and len(a) == len(b) and all(a.get(frozenset(m[v] for v in k)) == x for k, x in b.items()):
            out.append(list(p))
    return out


def graph(rng, n, labels="CN", bonds="12", p=0.4):
    return {i * 3: rng.choice(labels) for i in range(n)}, {(i * 3, j * 3): rng.choice(bonds) for j in range(n) for i in range(j) if rng.random() < p}


def renamed(rng, g):
    labels, es = g
    to = dict(zip(labels, rng.sample(range(50), len(labels)), strict=True))
    return {to[v]: x for v, x in labels.items()}, {tuple(rng.sample((to[a], to[b]), 2)): x for (a, b), x in es.items()}


def test_matches_are_all_permutations_that_fit(spark):
    rng = random.Random(2)
    graphs, pairs = {}, []
    for k in range(40):
        g = graph(rng, rng.randrange(1, 7), "CN"[: 1 + k % 2], "12"[: 1 + k % 3 // 2], rng.choice([0.2, 0.5, 0.9]))
        graphs[f"r{k}"] = g
        graphs[f"p{k}"] = renamed(rng, g) if k % 4 else graph(rng, len(g[0]))
        pairs.append((f"r{k}", f"p{k}"))
    ring = lambda n, off=0: {(off + i, off + (i + 1) % n): "1" for i in range(n)}
    graphs["six"] = ({i: "C" for i in range(6)}, ring(6))
    graphs["threes"] = ({i: "C" for i in range(6)}, ring(3) | ring(3, 3))  # no round tells it from the ring of six
    graphs["five"] = ({i: "C" for i in range(5)}, ring(5))
    pairs += [("six", "threes"), ("six", "six"), ("threes", "threes"), ("six", "five"), ("six", "absent")]
    nodes, edges = frames(spark, graphs)
    got = {(r["ref"], r["pose"]): r for r in matching.matches(nodes, edges, spark.createDataFrame(pairs, "ref string, pose string"), most=1000).collect()}
    assert len(got) == len(pairs)
    for r, p in pairs:
        want = brute(graphs[r], graphs[p]) if p in graphs else None
        x = got[r, p]
        if want is None:
            assert x["status"] == "sizes_differ"
        else:
            assert x["maps"] == want and x["n_matches"] == len(want) and x["ambiguous"] == (len(want) > 1) and x["status"] == ("matched" if want else "none")
    assert got["six", "threes"]["status"] == "none" and got["six", "six"]["n_matches"] == 12
    few = {r["ref"]: r for r in matching.matches(nodes, edges, spark.createDataFrame([("six", "six")], "ref string, pose string"), most=5).collect()}
    assert few["six"]["maps"] == brute(graphs["six"], graphs["six"])[:5]
    cut = matching.matches(nodes, edges, spark.createDataFrame([("six", "threes")], "ref string, pose string"), steps=3).first()
    assert cut["status"] == "undecided"


def test_skeletons_match_where_bonds_differ(spark):
    graphs = {"a": ({0: "C", 1: "C", 2: "O"}, {(0, 1): "2", (1, 2): "1"}), "b": ({0: "C", 1: "C", 2: "O"}, {(0, 1): "1", (1, 2): "1"}), "c": ({0: "C", 1: "O", 2: "O"}, {(0, 1): "1", (1, 2): "1"})}
    nodes, edges = frames(spark, graphs)
    got = {(r["ref"], r["pose"]): (r["status"], r["skeleton"], r["maps"]) for r in matching.matches_or_skeleton(nodes, edges, spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "c")], "ref string, pose string")).collect()}
    assert got == {("a", "a"): ("matched", False, [[0, 1, 2]]), ("a", "b"): ("matched", True, [[0, 1, 2]]), ("a", "c"): ("none", True, [])}


def test_colours_are_stable_and_told_apart(spark):
    star = ({i: "C" for i in range(5)}, {(0, i): "1" for i in range(1, 5)})
    path = ({i: "C" for i in range(5)}, {(i, i + 1): "1" for i in range(4)})
    nodes, edges = frames(spark, {"s": star, "p": path, "q": path, "lone": ({7: None}, {})})
    got = {(r["graph"], r["node"]): r["colour"] for r in matching.colours(nodes, edges).collect()}
    classes = lambda g, n: [[i for i in range(n) if got[g, i] == c] for c in dict.fromkeys(got[g, i] for i in range(n))]
    assert classes("s", 5) == [[0], [1, 2, 3, 4]] and classes("p", 5) == [[0, 4], [1, 3], [2]]
    assert all(got["p", i] == got["q", i] for i in range(5)) and ("lone", 7) in got


def test_errors_that_symmetry_explains(spark):
    """Stored distances of exchanged equivalent atoms are explained; a shifted atom isn't."""
    rng = np.random.default_rng(1)
    ring = ({i: "C" for i in range(4)} | {9: "O"}, {(0, 1): "1", (1, 2): "1", (2, 3): "1", (0, 3): "1", (0, 9): "1"})
    names = ["as_is", "swapped", "shifted", "both"]
    nodes, edges = frames(spark, dict.fromkeys(names, ring))
    xyz = {v: rng.standard_normal(3) * 5 for v in ring[0]}
    swap = {0: 0, 1: 3, 2: 2, 3: 1, 9: 9}
    atoms, rows = [], []
    for g in names:
        atoms += [(g, v, *map(float, x)) for v, x in xyz.items()]
        for v in ring[0]:
            at = xyz[swap[v] if g in ("swapped", "both") else v]
            for p in rng.standard_normal((3, 3)) * 9:
                rows.append((g, v, *map(float, p), float(np.linalg.norm(at - p)) + (0.5 if g in ("shifted", "both") and v == 2 else 0.0)))
    a = spark.createDataFrame(atoms, "graph string, node long, x double, y double, z double")
    r = spark.createDataFrame(rows, "graph string, node long, px double, py double, pz double, stored double")
    got = {x["graph"]: x for x in matching.explained_by_symmetry(r, a, matching.automorphisms(nodes, edges)).collect()}
    assert {g: (x["n_auto"], x["explained"]) for g, x in got.items()} == {"as_is": (2, False), "swapped": (2, True), "shifted": (2, False), "both": (2, False)}
    assert got["as_is"]["mean_error"] < 1e-9 and got["swapped"]["mean_error"] > 0.01 and got["swapped"]["best_error"] < 1e-9
    assert got["both"]["best_error"] == pytest.approx(0.1) and got["shifted"]["mean_error"] == pytest.approx(0.1)
