"""What the findings of round 3 name: each test failed before its change."""

from pyspark.sql import functions as F

from sieveline.llm import _common, minhash, sstable, suffixes
from sieveline.llm.queries import vocabulary


def test_token_ids_shuffle_their_texts_once(spark, tmp_path):
    """Texts are made once to find the ranges and once to be dealt out; the shuffle doesn't run a second time."""
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"text {i}"

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.udf(text)("id").alias("text"))
    manifest = sstable.write_token_ids(docs, vocabulary("byte_bpe_50k.json"), folder=f"file://{tmp_path}/ids")
    assert sstable.read_token_ids(manifest).count() == 200
    assert made.value <= 400


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_candidates_leave_texts_where_they_are(spark, docs, monkeypatch):
    """Candidates beyond what is broadcast go in slices: same rows, and no shuffle of the texts."""
    rows = lambda df: sorted(map(str, df.collect()))
    near, cut = (lambda: minhash.near_duplicates(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), 2).drop("k")), (lambda: suffixes.suffix_dedup(docs))
    want = rows(near()), rows(cut())
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 2)  # five slices of nine rows
    assert (rows(near()), rows(cut())) == want
    ids = _common.saved(spark.range(9).select(F.col("id").alias("doc_id")), "ids")
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for how, n in (("inner", 9), ("left_semi", 9), ("left_anti", 31)):
        parts = _common.in_slices(texts, ids, ["doc_id"], how)
        assert len(parts) == 5 and _common.together(parts).count() == n
        assert all("BroadcastHashJoin" in _plan(p) and "hashpartitioning" not in _plan(p) for p in parts)
