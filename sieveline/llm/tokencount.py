"""Token counts: map-side two-tier lookup.

A text's pre-tokens are looked up in a table of the corpus' frequent ones,
which holds the pre-tokens, their hashes and lengths and is broadcast; its size
is bounded by ``FREQUENT`` and ``LONGEST``.  What it lacks goes through a cache
in each worker, and only what that lacks is encoded.  A hit by hash counts only
if the code points are the same.  The texts' pre-tokens are never shuffled: to
find the frequent ones, each task counts those of its own rows, and its
``PER_TASK`` most frequent are added up, over all rows of the corpus.  The
table decides how fast counts are found, never what they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches
from ._pretok import byte_level_starts, distinct, library_ids, pretoken_hashes, same_spans, strings_of, text_slices, tokenizer, worker_memo

#: Pre-tokens in the broadcast table; those that one task proposes; and code points of the longest of them.
FREQUENT, PER_TASK, LONGEST = 32_768, 4_096, 32
#: Different pre-tokens that a task counts at once.
COUNTED = 400_000


def _frequent(batches):
    keys, counts, strings = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
    for b in batches:
        for _, _, _, _, points, at, unsure in text_slices(b.column(0)):
            if unsure.any():  # these texts are left to the library as a whole anyway
                points = points[np.repeat(~unsure, np.diff(at))]
                at = np.concatenate([[0], np.cumsum(np.where(unsure, 0, np.diff(at)))])
            starts = byte_level_starts(points, at)
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(points))
            k, where, inverse = distinct(points, starts, ends)
            n = np.bincount(inverse)
            place = np.searchsorted(keys, k)
            inside = place < len(keys)
            known = np.zeros(len(k), bool)
            known[inside] = keys[place[inside]] == k[inside]
            counts[place[known]] += n[known]
            new = ~known
            if new.any():
                s = np.array(strings_of(points, starts[where[new]], ends[where[new]]), object)
                at_ = np.searchsorted(keys, k[new])
                keys, counts, strings = np.insert(keys, at_, k[new]), np.insert(counts, at_, n[new]), np.insert(strings, at_, s)
            if len(keys) > COUNTED:  # the rarest half goes; what is frequent stays
                stay = np.sort(np.argpartition(-counts, COUNTED // 2)[: COUNTED // 2])
                keys, counts, strings = keys[stay], counts[stay], strings[stay]
    short = np.array([len(s) <= LONGEST for s in strings], bool)
    counts, strings = counts[short], strings[short]
    top = np.argsort(-counts, kind="stable")[:PER_TASK]
    yield pa.record_batch([pa.array(strings[top].tolist(), pa.string()), pa.array(counts[top])], ["pretoken", "n"])


class Table:
    """Frequent pre-tokens in the order of their hashes, with the number of tokens of each."""

    def __init__(self, strings: list[str], sizes: list[int]) -> None:
        flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
        starts = ends - np.array([len(s) for s in strings], np.int64)
        keys, where = np.unique(pretoken_hashes(flat, starts, ends), return_index=True)  # of two that share a hash, one stays
        self.keys, self.points, self.starts, self.ends, self.sizes = keys, flat, starts[where], ends[where], np.array(sizes, np.int64)[where]

    def look(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pre-token is here, and the tokens of those that are."""
        hit = np.zeros(len(keys), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            at = np.flatnonzero(self.keys[place] == keys)
            hit[at] = same_spans(points, starts[at], ends[at], self.points, self.starts[place[at]], self.ends[place[at]])
            return hit, self.sizes[place[hit]]
        return hit, np.zeros(0, np.int64)


def frequent_lengths(documents: DataFrame, path: str) -> Table:
    """The frequent pre-tokens of byte-level texts and their token counts."""
    rows = in_batches(documents.select(F.col("text").cast("string").alias("text"))).mapInArrow(_frequent, "pretoken string, n bigint")
    top = rows.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(FREQUENT).collect()
    strings = [r["pretoken"] for r in top]
    return Table(strings, [len(x) for x in library_ids(path)(strings)] if strings else [])


def _count(path: str, table):
    def run(batches):
        frequent = table.value
        memo = worker_memo(path)
        for b in batches:
            n_bytes = np.zeros(b.num_rows, np.int64)
            n_tokens = np.zeros(b.num_rows, np.int64)
            for i, j, _, o, points, at, unsure in text_slices(b.column(1)):
                n_bytes[i:j] = np.diff(o)
                if unsure.any():
                    for d in np.flatnonzero(unsure):
                        n_tokens[i + d] = len(tokenizer(path).encode(b.column(1)[i + int(d)].as_py(), add_special_tokens=False).ids)
                    keep = np.repeat(~unsure, np.diff(at))
                    points = points[keep]
                    at = np.concatenate([[0], np.cumsum(np.where(unsure, 0, np.diff(at)))])
                starts = byte_level_starts(points, at)
                if not len(starts):
                    continue
                ends = np.append(starts[1:], len(points))
                keys, where, inverse = distinct(points, starts, ends)
                s, e = starts[where], ends[where]
                size = np.zeros(len(keys), np.int64)
                hit, size_ = frequent.look(keys, points, s, e)
                size[hit] = size_
                miss = ~hit
                _, size[miss] = memo.look_distinct(keys[miss], points, s[miss], e[miss])
                total = np.concatenate([[0], np.cumsum(size[inverse])])
                bound = np.searchsorted(starts, at)
                n_tokens[i:j] += total[bound[1:]] - total[bound[:-1]]
            yield pa.record_batch([b.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Count the tokens of every text as the tokenizers library does with a byte-level file, no tokens added.

    Takes columns doc_id and text, whatever else there is; returns doc_id,
    n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each
    row.  A null text counts as empty: 0 bytes and tokens.  A special token's
    string inside a text is that token, as by the library's default.
    """
    table = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, path))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_count(path, table), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
