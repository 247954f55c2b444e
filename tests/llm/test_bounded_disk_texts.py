"""What the findings of round 4 say of disk, for texts: each test failed before its change."""

import random

from sieveline.llm import minhash, suffixes
from sieveline.operators import iterate


def _shuffles(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def _texts(spark, n=120):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(15)]
    return spark.createDataFrame([(i, " ".join(w if rng.random() < 0.98 else "x" for w in rng.choice(base))) for i in range(n)], "doc_id long, text string")


def test_a_saved_table_leaves_no_shuffle(spark):
    """shuffles of all steps lay on disk until the JVM came to collect them."""
    before = _shuffles(spark)
    out = iterate.cut(spark.range(1000).selectExpr("id % 7 AS k").repartition(5).groupBy("k").count())
    assert _shuffles(spark) <= before and out.count() == 7
    assert spark.conf.get(iterate.CLEANUP, "false") == "false"


def test_bands_go_some_after_others(spark, monkeypatch):
    """bands of all documents were shuffled at once."""
    docs = _texts(spark)
    rows = lambda: sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    want, saved = rows(), []
    assert len({r[3] for r in want}) < 120
    real = minhash.saved
    monkeypatch.setattr(minhash, "saved", lambda df, what: saved.append(what) or real(df, what))
    monkeypatch.setattr(minhash, "BAND_ROWS", 1000, raising=False)
    assert rows() == want
    assert saved.count("pairs") > 5


def test_fragments_are_cut_in_rounds(spark, monkeypatch):
    """fragments of all anchors, which grow faster than the texts, were on disk at once."""
    docs = _texts(spark, 60)
    for wide in (None, 1):
        rows = lambda: sorted(map(tuple, suffixes.suffix_dedup(docs, texts=False, wide=wide).collect()))  # noqa: E731, B023
        want, saved = rows(), []
        assert sum(r[2] for r in want) > 0
        real = suffixes.saved
        monkeypatch.setattr(suffixes, "saved", lambda df, what, real=real, saved=saved: saved.append(what) or real(df, what))
        monkeypatch.setattr(suffixes, "ROUND_BYTES", 5_000 if wide is None else 50_000, raising=False)
        assert rows() == want
        assert saved.count("fragments") > 1
        monkeypatch.undo()
