import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import ranking, suffixes, whitening

# Suffix dedup


def brute_suffixes(rows, n):
    """One result a row: what its text loses to rows of smaller ids."""
    where = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for x in range(len(b) - n + 1):
                where.setdefault(b[x : x + n], []).append(i)
    least = {w: min(v) for w, v in where.items()}
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for x in range(len(b) - n + 1):
            if i is not None and least[b[x : x + n]] < i:
                gone[x : x + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (x == 0 or not gone[x - 1]) for x, g in enumerate(gone))
        out.append((i if i is not None else -1, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def repetitive(seed):
    rng = np.random.default_rng(seed)
    pieces = ["".join(rng.choice(list("abé \n"), int(rng.integers(5, 90)))) for _ in range(25)] + ["=" * 300, "ab" * 120, "\x00" * 70]
    return [(int(i), "".join(pieces[p] for p in rng.integers(0, len(pieces), int(rng.integers(0, 9))))) for i in rng.permutation(60)]


@pytest.mark.parametrize("wide", [None, 0, 1])
def test_suffix_dedup(spark, wide):
    rows = repetitive(wide or 7) + [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 50), (104, "x" * 51)]
    df = spark.createDataFrame([(i, t, "x", 1, b"b") for i, t in rows], "doc_id long, text string, k string, h int, bytes binary").repartition(5)
    assert found(suffixes.suffix_dedup(df, 50, wide=wide)) == brute_suffixes(rows, 50)


@pytest.mark.parametrize(("slice_", "sorted_", "seed"), [(64, 1, 1), (97, 50, 2), (300, 1000, 3)])
def test_suffix_dedup_in_small_pieces(monkeypatch, slice_, sorted_, seed):
    """The same steps in this process, where pieces of texts and shards can be made small."""
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    monkeypatch.setattr(suffixes, "SORTED", sorted_)
    rows = repetitive(seed)
    docs = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["id", "h", "text"])
    packed = pa.Table.from_batches(suffixes._packed(50, 3, b"0" * 16)([docs])).sort_by("bucket")
    found = [r for b in suffixes._compared(50, 10**6)(packed.to_batches(max_chunksize=4)) for r in b.to_pylist()]
    spans = [(r["id"], r["lo"], r["lo"] + r["count"] + 49) for r in found if r["anchor"] is None]
    firsts = [[{"anchor": r["anchor"], "lo": r["lo"], "count": r["count"], "wide": False} for r in found if r["id"] == i and r["anchor"] is not None] for i, _ in rows]
    cut = pa.Table.from_batches(suffixes._fragments(50)([docs.append_column("firsts", pa.array(firsts))])).sort_by("anchor")
    shard = cut.add_column(0, "shard", pa.array([0] * len(cut)))
    spans += [(r["id"], r["start"], r["stop"]) for b in suffixes._covered(50, 12345)(shard.to_batches(max_chunksize=3)) for r in b.to_pylist()]
    for i, n, gone, _, digest in brute_suffixes(rows, 50):
        raw = dict(rows)[i].encode()
        cover = {x for j, a, z in spans if j == i for x in range(a, z)}
        assert (len(raw), len(cover)) == (n, gone) and hashlib.sha256(bytes(c for x, c in enumerate(raw) if x not in cover)).hexdigest() == digest


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    one, two = "the quick brown fox jumps over the lazy dog again and again ", "pack my box with five dozen liquor jugs, said the man in the hat "
    rows = [(5, one * 2), (5, one * 2), (5, one + two), (3, two), (None, one), (None, two), (9, one + "z" + two), (9, one), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffixes.suffix_dedup(df)) == brute_suffixes(rows, 50)
    kept = {bytes(r["kept_bytes"]) for r in suffixes.suffix_dedup(df).filter("doc_id = 9").collect()}
    assert kept == {b"z", b""}
    assert suffixes.suffix_dedup(df.limit(0)).count() == 0


def test_suffix_sort(monkeypatch):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 3000), np.full(200, 97), np.tile([97, 98, 98], 100)]).astype(np.uint8)
    at = np.arange(len(data) - 50 + 1)
    raw = data.tobytes()
    want = sorted(raw[i : i + 50] for i in at)
    for base in (12345, 1):  # a base of 1 makes hashes of permuted bytes agree, so the bytes must decide
        order, new = suffixes.Suffixes(data, 50, base).groups(at)
        assert [raw[i : i + 50] for i in order] == want
        assert new.tolist() == [x == 0 or want[x] != want[x - 1] for x in range(len(want))]


@pytest.mark.parametrize("slice_", [64, 97, 500, 1 << 19])
def test_segments_cover_each_window_once(monkeypatch, slice_):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    texts = ["a" * 500, "", "short", "".join(chr(97 + i * i % 26) for i in range(700)), "é" * 60]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = [(int(t), int(lo) + x) for text, los, counts, *_ in suffixes.segments(np.frombuffer(b"".join(raw), np.uint8), offs, 50, b"0" * 16) for t, lo, c in zip(text, los, counts, strict=True) for x in range(c)]
    assert sorted(got) == [(t, x) for t, b in enumerate(raw) for x in range(len(b) - 49)]


# Ranked search


def brute_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0))
        out += [(-1 if i is None else i, r + 1, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize(("docs_", "first", "together"), [(64, 4, 64), (3, 1, 2), (1, 2, 1)])
def test_ranked_search(spark, monkeypatch, docs_, first, together):
    for name, v in (("BLOCK_DOCS", docs_), ("FIRST", first), ("TOGETHER", together)):
        monkeypatch.setattr(ranking, name, v)
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "abÉé9" for b in ("X", "y", "ñ", "0", "中")]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(150)] + [(200, None), (201, ""), (202, "-- !!"), (None, text(5)), (7, "ay"), (7, "ay"), (203, text(6000))]
    items = [(i, text(int(rng.integers(0, 9)))) for i in range(12)] + [(50, None), (51, "nowhere"), (None, "ay bx"), (3, "9y 90")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, block int").repartition(3)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, query int")
    got = sorted(((-1 if r["item_id"] is None else r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.ranked_search(df, q, 10).collect()), key=lambda r: r[:2])
    assert got == brute_ranks(docs, items, 10)


def test_ranked_search_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert ranking.ranked_search(df.limit(0), q).count() == 0 and ranking.ranked_search(df, q.limit(0)).count() == 0
    assert ranking.ranked_search(df.filter("doc_id = 2"), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 10)
    asked = []
    scores = ranking._scores

    def noted(*a):
        asked.append(a)
        return scores(*a)

    monkeypatch.setattr(ranking, "_scores", noted)
    df = spark.createDataFrame([(i, "rare gem" if i < 20 else "gem dust " * 3) for i in range(400)], "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "rare gem")], "item_id long, text string")
    assert [r["doc_id"] for r in ranking.ranked_search(df, q).orderBy("rank").collect()] == list(range(10))
    assert len(asked) == 1  # one round: bounds of the others are below the tenth score


# Whitening


def brute_whitened(rows, k=32):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    z = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    return good, dev, z, e[::-1][:k], u[:, ::-1][:, :k]


def check_whitened(spark, rows, k=32):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, n int, whitened double").repartition(3)
    got = whitening.whiten(df, k).collect()
    good, dev, z, e, u = brute_whitened(rows, k)
    assert len(got) == len(good) * len(e) and {r["n"] for r in got} == {len(good)}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert Counter({key: len(v) for key, v in by.items()}) == Counter({key: c * len(e) for key, c in Counter((i, d) for (i, _), d in zip(good, dev, strict=True)).items()})
    total = float((z * z).sum() / len(good))
    for c in range(len(e)):
        ours = {(r["vec_id"], r["deviation"]): r["whitened"] for r in got if r["component"] == c + 1}
        theirs = z @ u[:, c] / math.sqrt(e[c]) if e[c] > 1e-12 * e[0] else z[:, 0] * 0
        mine = np.array([ours[i, d] for (i, _), d in zip(good, dev, strict=True)])
        assert min(abs(mine - theirs).max(), abs(mine + theirs).max()) < 1e-8
        assert all(abs(r["explained"] - e[c] / total) <= 1e-10 for r in got if r["component"] == c + 1)
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(40) * np.linspace(3, 0.2, 40) @ np.linalg.qr(rng.standard_normal((40, 40)))[0] + 5).tolist()) for i in range(200)]
    check_whitened(spark, rows + [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (0, rows[0][1]), (904, [1.0, 2.0]), (905, [])])
    check_whitened(spark, rows[:50], 3)


def test_whitening_without_variance(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    flat = whitening.whiten(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat} == {(i, c, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    line = whitening.whiten(df([(1, [0.0, 7.0]), (2, [1.0, 7.0])])).collect()
    assert sorted((r["component"], round(abs(r["whitened"]), 9)) for r in line) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0)]
    assert whitening.whiten(df([(1, None)])).count() == 0 and whitening.whiten(df([(1, [])])).count() == 0
    wide = whitening.whiten(df([(1, [1e300]), (2, [-1e300]), (None, [0.0])])).collect()
    assert len(wide) == 3 and max(r["deviation"] for r in wide) == (1 << 63) - 1


def test_range_finder_ends_early_or_expands(spark):
    rng = np.random.default_rng(4)
    low = rng.standard_normal((300, 3)) @ rng.standard_normal((3, 60)) * 4
    for x, expanded in ((np.repeat(np.round(low[:, :6]), 10, axis=1), False), (rng.standard_normal((300, 60)), True)):
        df = spark.createDataFrame([(x_.tolist(),) for x_ in x], "v array<double>")
        centre = whitening._centre(df)
        e, u, trace, whole = whitening.principal(df, centre, 6)
        assert whole == expanded
        z = np.floor(x * 64) - np.floor(x * 64).mean(axis=0)
        v = z.T @ z / len(z)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:6], rtol=1e-9, atol=1e-9 * e[0]) and np.isclose(trace, np.trace(v))
        assert np.abs(v @ u - u * e).max() <= 1e-9 * e[0]
