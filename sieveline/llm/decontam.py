"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Words are runs of letters and digits; in scripts that are written without
   spaces (``UNSPACED``) each character is a word of its own.  All n-grams of
   words of an item are its seeds, common ones too: how often
   words stand in the corpus decides nothing, so a passage that leaked into a
   third of all documents keeps its seeds, and so does every edited copy that
   has ``N`` words of the item in a row.  An item of fewer words has its whole
   sequence of words as its seed.
2. Seeds meet the n-grams of each document in a table that is broadcast.  Its
   size is bounded: a benchmark of more than ``BLOCK_BYTES`` bytes of text is
   taken in blocks, each against all documents.  Words are told apart by their
   bytes: a hash only finds a word of the benchmark, and its bytes are compared.
3. Around the seeds an item shares with a document, the words of both are
   aligned (match +2, mismatch and gap -1, local), many pairs at once.  The
   score is that of the best alignment over that of the whole item with
   itself, so edited and paraphrased copies score near the share of words they
   keep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches, text_hash
from ._text import ALNUM, LOWER, slices, text_buffers, word_hashes, words

N = 3
#: Code points of scripts written without spaces: Thai to Lao, Tibetan, Myanmar, Khmer, Tai scripts, kana and Han; and what parts words among them.
UNSPACED = ((0x0E01, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
PARTING = ((0x0E4F, 0x0E4F), (0x0E5A, 0x0E5B), (0x0F0B, 0x0F14), (0x104A, 0x104F), (0x17D4, 0x17DA), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303D), (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Bytes of text of a benchmark block; an item is in one block.
BLOCK_BYTES = 6 << 20
MATCH, MISS, GAP = 2, -1, -1
#: Cells of the alignments taken at once, and the windows gathered before they are aligned.
CELLS, WINDOWS = 200_000, 20_000


def _among(points: np.ndarray, ranges: tuple) -> np.ndarray:
    edges = np.array(sorted(x for a, b in ranges for x in (a, b + 1)))
    return np.searchsorted(edges, points, "right") % 2 == 1


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() of texts in lower case; characters of unspaced scripts are words of their own, and their punctuation parts words."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return words(data, offs, ALNUM)
    size = np.where(data[lead] >= 0xF0, 4, 3)
    lead, size = lead[lead + size <= len(data)], size[lead + size <= len(data)]
    byte = [data[lead + x].astype(np.int64) & 0x3F for x in (1, 2)]
    last = data[lead + size - 1].astype(np.int64) & 0x3F
    head = data[lead].astype(np.int64)
    points = np.where(size == 3, (head & 0x0F) << 12 | byte[0] << 6 | byte[1], (head & 0x07) << 18 | byte[0] << 12 | byte[1] << 6 | last)
    parting = _among(points, PARTING)
    alone = _among(points, UNSPACED) & ~parting
    data = data.copy()
    for x in range(3):
        data[lead[parting] + x] = 0x20
    return words(data, offs, ALNUM, np.concatenate([lead[alone], lead[alone] + size[alone]]))


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The best local alignment score of each two sequences of codes (linear gaps); a code below 0 equals nothing."""
    out = np.zeros(len(pairs), np.int32)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    k = 0
    while k < len(order):
        m, least = k + 1, len(pairs[order[k]][1])
        while m < len(order) and (w := len(pairs[order[m]][1])) <= least + least // 4 + 8 and w * (m + 1 - k) <= CELLS:
            m += 1
        own = order[k:m]
        width = len(pairs[own[-1]][1])
        # What fills up a shorter sequence equals nothing, so it adds to no score.
        a = np.full((max(len(pairs[i][0]) for i in own), len(own)), -2, np.int32)
        b = np.full((len(own), width), -1, np.int32)
        for c, i in enumerate(own):
            a[: len(pairs[i][0]), c] = pairs[i][0]
            b[c, : len(pairs[i][1])] = pairs[i][1]
        ramp = np.arange(width + 1, dtype=np.int32) * -GAP
        h = np.zeros((len(own), width + 1), np.int32)
        best = np.zeros(len(own), np.int32)
        for x in a:
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(b == x[:, None], np.int32(MATCH), np.int32(MISS)), h[:, 1:] + np.int32(GAP))
            np.maximum(new, 0, out=new)
            h = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along b
            np.maximum(best, h.max(axis=1), out=best)
        out[own] = best
        k = m
    return out


def align(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two sequences of words."""
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(align_all([(codes[: len(a)], codes[len(a) :])])[0])


class Items:
    """A block of benchmark items as codes of words: equal codes where and only where the bytes are equal."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids, self.codes = [], []
        self.code: dict[bytes, int] = {}
        for i, t in zip(ids, texts, strict=True):
            data = LOWER[np.frombuffer((t or "").encode(), np.uint8)]
            s, e, _ = tokens(data, np.array([0, len(data)]))
            if len(s):
                raw = data.tobytes()
                self.ids.append(i)
                self.codes.append(np.array([self.code.setdefault(raw[x:y], len(self.code)) for x, y in zip(s.tolist(), e.tolist(), strict=True)], np.int64))
        size = np.array([len(w) for w in self.code], np.int64)
        self.data = np.frombuffer(b"".join(self.code), np.uint8)
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.hashes, self.first = np.unique(word_hashes(self.data, self.start, self.stop), return_index=True)

    def seeds(self, n: int) -> None:
        """All seeds: n-grams in order, and for each the items that have it."""
        if n * len(self.code) ** n >= 1 << 64:  # not with N words from a block of BLOCK_BYTES
            raise ValueError(f"{n}-grams of {len(self.code)} words don't fit 64 bits")
        self.sizes = sorted({min(n, len(w)) for w in self.codes})
        found = sorted({(int(g), item) for item, w in enumerate(self.codes) for g in self.grams(w, min(n, len(w)))[0]})
        self.at = np.array([f[1] for f in found], np.int32)
        self.keys, self.owners = np.unique(np.array([f[0] for f in found], np.uint64), return_index=True)
        self.owners = np.append(self.owners, len(found))

    def grams(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs of n words that have codes, as numbers that differ where the words do, also for other n; and where they begin."""
        at = np.flatnonzero(codes >= 0)
        at = at[at + n <= len(codes)]
        key = np.full(len(at), n - 1, np.uint64)
        size = np.uint64(len(self.code))
        for j in range(n):
            c = codes[at + j]
            at, key, c = (x[c >= 0] for x in (at, key, c))
            key = key * size + c.astype(np.uint64)
        return key, at

    def coded(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The codes of words; -1 for words that no item has.  A hash finds a code, and the bytes decide."""
        out = np.full(len(s), -1, np.int64)
        if not self.code:
            return out
        wh = word_hashes(data, s, e)
        place = np.minimum(np.searchsorted(self.hashes, wh), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == wh)
        if not len(hit):
            return out
        code = self.first[place[hit]]
        size = e[hit] - s[hit]
        same = size == self.stop[code] - self.start[code]
        h, c, size = hit[same], code[same], size[same]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        unlike = data[np.repeat(s[h], size) + step] != self.data[np.repeat(self.start[c], size) + step]
        bad = np.zeros(len(h), bool)
        bad[np.repeat(np.arange(len(h)), size)[unlike]] = True
        out[h[~bad]] = c[~bad]
        # Words that share a hash but not their bytes are looked up by those.
        for x in [*hit[~same].tolist(), *h[bad].tolist()]:
            out[x] = self.code.get(data[s[x] : e[x]].tobytes(), -1)
        return out


def _score(items_, n: int):
    def run(batches):
        items = items_.value
        for b in batches:
            rows: list[tuple[int, int, float]] = []
            data, offs = text_buffers(b.column(1))
            for i, j in slices(offs):
                part, o = LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
                s, e, doc = tokens(part, o)
                if not len(s) or not len(items.keys):
                    continue
                codes = items.coded(part, s, e)
                hits = []
                for size in items.sizes:
                    grams, where = items.grams(codes, size)
                    at = np.minimum(np.searchsorted(items.keys, grams), len(items.keys) - 1)
                    found = np.flatnonzero((items.keys[at] == grams) & (doc[where] == doc[where + size - 1]))
                    hits += zip(where[found].tolist(), at[found].tolist(), strict=True)
                if not hits:
                    continue
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                near: dict[tuple[int, int], list[int]] = {}
                for h, seed in hits:
                    for item in items.at[items.owners[seed] : items.owners[seed + 1]].tolist():
                        near.setdefault((int(doc[h]), item), []).append(h)
                best: dict[tuple[int, int], int] = dict.fromkeys(near, 0)
                owners: list[tuple[int, int]] = []
                pairs: list[tuple[np.ndarray, np.ndarray]] = []

                def done(best=best, owners=owners, pairs=pairs):
                    for owner, x in zip(owners, align_all(pairs).tolist(), strict=True):
                        best[owner] = max(best[owner], x)
                    owners.clear(), pairs.clear()

                for (d, item), places in near.items():
                    w = items.codes[item]
                    reach = len(w) + len(w) // 4 + n
                    k = 0
                    while k < len(places):  # one window for each stretch of seeds
                        m = k
                        while m + 1 < len(places) and places[m + 1] - places[m] <= reach:
                            m += 1
                        owners.append((d, item))
                        pairs.append((w, codes[max(places[k] - reach, bounds[d]) : min(places[m] + reach, bounds[d + 1])]))
                        k = m + 1
                    if len(pairs) >= WINDOWS:
                        done()
                done()
                rows += [(i + d, item, x / (MATCH * len(items.codes[item]))) for (d, item), x in best.items()]
            if rows:
                yield pa.record_batch([b.column(0).take(pa.array([r[0] for r in rows])), b.column(2).take(pa.array([r[0] for r in rows])), pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], ["doc_id", "h", "item_id", "score"])

    return run


def overlaps(documents: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, h, item_id, score) for the documents and items that share a seed; h tells apart texts that share a doc_id."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = in_batches(docs).withColumn("h", text_hash(F.col("text")))
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = bench.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1  # twice as many, since hashing doesn't deal them evenly
    out = None
    for k in range(blocks):
        rows = (bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        items.seeds(n)
        found = docs.select("doc_id", "text", "h").mapInArrow(_score(sc.broadcast(items), n), "doc_id bigint, h bigint, item_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, with_hash: bool = False) -> DataFrame:
    """doc_id, contaminated, n_items, item_id and score for every document; h, the hash of its text, if asked for.

    Takes doc_id and text of documents, item_id and text of benchmark, whatever
    else there is.  score is the best over all items, 0 if no seed is shared,
    item_id its item (the smallest on a tie, null without one), n_items how
    many items reach the threshold.  Null and empty texts, and items without a
    word, match nothing; an item shorter than N words has its whole sequence of
    words as its seed.
    """
    found = overlaps(documents, benchmark).groupBy("doc_id", "h").agg(
        F.max("score").alias("score"), F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"),
        F.count_distinct(F.when(F.col("score") >= threshold, F.col("item_id"))).alias("n_items"),
    )
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(F.col("text").cast("string")).alias("h"))
    out = docs.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.h = f.h"), "left")
    score = F.coalesce("f.score", F.lit(0.0))
    return out.select(F.col("d.doc_id").alias("doc_id"), (score >= threshold).alias("contaminated"), F.coalesce("f.n_items", F.lit(0)).alias("n_items"), F.col("f.item_id").alias("item_id"), score.alias("score"), *[F.col("d.h").alias("h")] * with_hash)
