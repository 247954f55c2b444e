"""Findings of the third round, taken up again: pairs of sequences, and covered random splits of a sweep."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import entities, iterate, ranking, sequences, splits
from sieveline.plans import selection_queries, split_queries
from test_sequences import edits


def test_clusters_of_alike_sequences_save_no_row_for_each_pair(spark, monkeypatch):
    # all pairs of the sequences that share a host were candidates, and saved.
    saved = []

    def cut(df, *what, **options):
        out = real(df, *what, **options)
        saved.append(out.count())
        return out

    real = iterate.cut
    for module in (iterate, sequences):
        monkeypatch.setattr(module, "cut", cut)
    rows = spark.range(3000).selectExpr("id", "concat('https://blog.example.org/en/', lpad(id % 2990, 6, '0'), '.html') AS s")
    clusters = sequences.sequence_clusters(rows, 0.8)
    assert {(r["representative"], r["cluster"]) for r in clusters.collect()} == {(0, 0)} and clusters.count() == 3000
    assert max(saved) <= 1024 * 1023  # pairs of the first round, in both directions
    saved.clear()
    assert sequences.alike(rows.limit(500), 0.8).count() == 500 * 499 // 2 and not saved


@pytest.mark.parametrize("identity", [0.6, 0.9])
def test_long_sequences_are_measured_over_several_words(spark, identity):
    rng = random.Random(9)
    base = ["".join(rng.choice("acgt") for _ in range(n)) for n in (63, 64, 65, 128, 129, 200)]
    rows = [*enumerate(base), *((10 + i, "".join(c if rng.random() < 0.9 else rng.choice(["", c + "g", "t"]) for c in rng.choice(base))) for i in range(30))]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {(r["i"], r["j"]): r["distance"] for r in sequences.alike(df, identity).collect()}
    both = {(i, j): (edits(a, b), max(len(a), len(b))) for i, a in rows for j, b in rows if i < j}
    assert got == {p: d for p, (d, n) in both.items() if d <= int((1 - identity) * n + 1e-9)} and got


def test_covered_random_sweep_keeps_no_row_for_each_system_and_tag(spark, monkeypatch):
    # every system was ranked, moved and saved once for each tag.
    rng = random.Random(5)
    rows = [(i, rng.randrange(160), rng.randrange(300), rng.randrange(6)) for i in range(400)]
    df = spark.createDataFrame(rows, "system long, a long, b long, c long").repartition(3)
    tags = [(f"t{i}", "ab"[i % 2], "bc"[i // 2 % 2]) for i in range(8)]
    context = None
    for t, p, q in tags:
        one = df.select(F.lit(t).alias("tag"), "system", F.col(p).alias("pc"), F.col(q).alias("lc"))
        context = one if context is None else context.unionByName(one)
    for fractions in ((0.8, 0.1, 0.1), (0.2, 0.5, 0.3), (1.0, 0.0, 0.0), (0.0, 0.3, 0.7)):
        want = {(r["tag"], r["system"]): r["fold"] for r in splits.random_covered(context, F.col("tag"), fractions, by=("tag",)).collect()}
        assert {(r["tag"], r["system"]): r["fold"] for r in splits.random_covered_tags(df, tags, fractions).collect()} == want and len(want) == 8 * 400
    saved = []

    def cut(df, *what):
        out = real(df, *what)
        saved.append(out.count())
        return out

    real = splits.cut
    monkeypatch.setattr(splits, "cut", cut)
    monkeypatch.setattr(ranking, "cut", cut)
    assert split_queries.sweep_random_covered(spark, "/root/testdata/sf0.001").count() == 12 * 1500
    assert max(saved) <= 1500 * 2
    assert splits.random_covered_tags(df.limit(0), tags).count() == 0


@pytest.mark.parametrize("name", ["set_difference", "chain_remap"])
def test_tasks_follow_the_rows(spark, sf, monkeypatch, name):
    # A fixed number of tasks shared all rows, so the memory of each grew with the table.
    query = getattr(selection_queries, name)
    want = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr(iterate, "TASK_ROWS", 500, raising=False)
    rows = query(spark, sf)
    assert rows.rdd.getNumPartitions() >= 2 * spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500
    assert sorted(map(tuple, rows.collect())) == want


def test_difference_is_that_of_sets(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, None), (2, 2.0), (None, None), (None, 3.0), (3, float("nan"))], "k long, q double")
    right = spark.createDataFrame([(2, 2.0), (None, None), (9, 9.0), (3, float("nan"))], "k long, q double")
    text = lambda df: sorted(map(str, df.collect()))
    assert text(entities.difference(left, right, "k", 3)) == text(left.subtract(right)) and entities.difference(left, left, "k", 3).count() == 0
