"""The exact bootstrap against counts worked out key by key, and the work queue on a stream against its batch form."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import resampling, worklog
from sieveline.streaming import queue


@pytest.mark.parametrize("n", [1, 5, 16, 17, 100, 1000])
def test_each_round_draws_as_many_keys_as_there_are(n):
    counts = np.array([np.concatenate([resampling.leaf_counts(n, 3, b, leaf, 16) for leaf in range(-(-n // 16))]) for b in range(300)])
    assert counts.shape == (300, n) and (counts.sum(axis=1) == n).all()
    if n >= 16:
        assert abs(counts.var() - (1 - 1 / n)) < 0.1 and (abs(counts.mean(axis=0) - 1) < 0.35).all()
        # Counts of two keys are as correlated as those of a multinomial: -1 / (n - 1).
        assert abs(np.corrcoef(counts[:, 0], counts[:, -1])[0, 1]) < 0.2


def test_sums_are_those_of_the_counts_in_any_partitioning(spark):
    rng = random.Random(1)
    rows = [(f"k{k:03}", rng.choice("xyz"), rng.random(), float(rng.randrange(1, 5))) for k in range(90) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "k string, g string, a double, b_ double")
    keys = sorted({r[0] for r in rows})
    want = {}
    for b in range(1, 41):
        w = dict(zip(keys, np.concatenate([resampling.leaf_counts(90, 7, b, leaf, 16) for leaf in range(6)]).tolist(), strict=True))
        for k, g, x, y in rows:
            s = want.setdefault((g, b), [0.0, 0.0])
            s[0] += w[k] * x
            s[1] += w[k] * y
    for parts in (1, 7):
        got = {(r["g"], r["b"]): (r["a"], r["b_"]) for r in resampling.resampled(df.repartition(parts), "k", ["a", "b_"], ("g",), 40, 7, block=16).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    # A round's keys are the same for all strata.
    w = {b: dict(zip(keys, resampling.leaf_counts(90, 7, b, 0).tolist(), strict=True)) for b in range(1, 41)}
    of = lambda b, g, c: sum(w[b][r[0]] * r[c] for r in rows if r[1] in g)
    one = resampling.clustered_ratio(df, "k", "a", "b_", (), 40, 7).first()
    ratios = [of(b, "xyz", 2) / of(b, "xyz", 3) for b in w]
    assert (one["low"], one["high"]) == pytest.approx(tuple(np.percentile(ratios, [2.5, 97.5]))) and one["ratio"] == pytest.approx(sum(r[2] for r in rows) / sum(r[3] for r in rows))
    two = resampling.clustered_difference(df, "k", "a", "b_", "g", "x", "y", 40, 7).first()
    low, high = np.percentile([of(b, "x", 2) / of(b, "x", 3) - of(b, "y", 2) / of(b, "y", 3) for b in w], [2.5, 97.5])
    assert (two["low"], two["high"]) == pytest.approx((low, high)) and two["excludes_zero"] == (low > 0 or high < 0)


def test_a_replayed_log_gives_the_batch_states(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    log = [{"job": f"j{rng.randrange(40)}", "time": (start + dt.timedelta(seconds=30 * i + rng.randrange(90))).isoformat(), "n": i, "status": rng.choice(["ok", "error", "timeout", "refused", "error"])} for i in range(150)]
    log.append({"job": "last", "time": "2024-01-01T03:00:00", "n": 150, "status": "ok"})  # carries the watermark on
    log.append({"job": "last", "time": "2024-01-01T03:00:01", "n": 151, "status": "ok"})
    (tmp_path / "in").mkdir()
    for i in range(0, len(log), 19):
        (tmp_path / "in" / f"{i:04}.json").write_text("\n".join(map(json.dumps, log[i : i + 19])))
        os.utime(tmp_path / "in" / f"{i:04}.json", (1_700_000_000 + i,) * 2)  # files come in by age
    kind = "job string, time timestamp, n long, status string"
    settings = {"key": "job", "time": "time", "tie": "n", "first": 120, "most": 3}
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = queue.replayed(stream, str(tmp_path / "out"), **settings)
    latest = worklog.latest(spark.read.schema(kind).json(str(tmp_path / "in")), "job", "time", "n")
    batch = {r["job"]: r for r in latest.collect()}
    last = {r["job"]: r for r in rows.filter("kind = 'state'").orderBy("attempts").collect()}
    assert {j: (r["status"], r["attempts"], r["at"]) for j, r in last.items()} == {j: (r["status"], r["attempts"], r["at"]) for j, r in batch.items()}
    due = {(r["job"], r["attempts"]) for r in worklog.due(latest, "2024-01-01 02:55:00", first=120, most=3).collect()}
    assert due and {(r["job"], r["attempts"]) for r in rows.filter("kind = 'due'").collect() if batch[r["job"]]["attempts"] == r["attempts"]} == due
    assert {r["job"] for r in rows.filter("kind = 'given_up'").collect()} >= {j for j, r in batch.items() if r["status"] in worklog.RETRY and r["attempts"] >= 3}
    # Run again, nothing is new.
    assert queue.replayed(stream, str(tmp_path / "out"), **settings).count() == rows.count()
    more = {"job": "j1", "time": "2024-01-01T04:00:00", "n": 152, "status": "ok"}
    (tmp_path / "in" / "9999.json").write_text(json.dumps(more))
    again = queue.replayed(stream, str(tmp_path / "out"), **settings)
    assert again.filter((F.col("job") == "j1") & (F.col("kind") == "state")).agg(F.max("attempts")).first()[0] == batch["j1"]["attempts"] + 1
