"""Ranked lexical search by block-max pruning.

1. Index.  Documents, in the order in which they are stored, are cut to blocks
   of bounded size.  A block keeps its distinct terms once, and for each
   document which of them it holds how often: a forward index.  Terms are
   compared as strings (by Arrow's dictionary encoding), never by hash.
2. Maxima.  With the collection's counts known, a term's impact in a document
   is an integer; a block keeps the largest of each term.
3. Search.  The bound of a block for a query is the sum of its terms' weights
   times their maxima: no document in it scores higher.  Each query's blocks
   are scored from the highest bound down, a few, then eight times as many,
   and so on, until the next bound is below the query's k-th score so far.
   Blocks never reached hold no result, so the ranking is exact.

Blocks, terms and queries meet in joins; nothing is broadcast that grows with
documents or queries, and a query's best are cut to k wherever rows are
gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import in_batches, removed, saved
from ._text import ALNUM, LOWER, text_buffers, words

#: Bytes of text, and documents, of a block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 1 << 17, 64
#: Of the saved index: a row group is what a task that reads it holds at once, up to 4,096 rows, and a row is hundreds of kilobytes here.
GROUPS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "10"}
#: Blocks scored for a query in the first round, and by how much each round has more.
FIRST, MORE = 4, 8
#: Queries that go to a block together.
TOGETHER = 64

SCALE = 1_000_000_000


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts as strings, and the text of each."""
    low = LOWER[data]
    starts, ends, doc = words(low, offs, ALNUM)
    if not len(starts):
        return pa.array([], pa.large_string()), doc
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[ALNUM[low]].tobytes())), doc


def _blocks(batches):
    """One row for each block: its documents with their lengths, its distinct terms, and (term, document, tf) in the order of documents."""
    for b in batches:
        data, offs = text_buffers(b.column(1))
        i = 0
        while i < b.num_rows:
            j = i + 1
            while j < b.num_rows and j - i < BLOCK_DOCS and offs[j + 1] - offs[i] <= BLOCK_BYTES:
                j += 1
            terms, doc = _terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            coded = terms.dictionary_encode()
            vocabulary, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            size = max(1, len(vocabulary))
            entry, tf = np.unique(doc * size + code, return_counts=True)
            own = b.column(0).slice(i, j - i)
            yield pa.record_batch([
                pa.array([own], pa.list_(pa.int64())), pa.array([np.bincount(doc, minlength=j - i)], pa.list_(pa.int64())), pa.array([vocabulary.cast(pa.string())], pa.list_(pa.string())),
                pa.array([entry // size], pa.list_(pa.int32())), pa.array([entry % size], pa.list_(pa.int32())), pa.array([tf], pa.list_(pa.int32())),
            ], ["ids", "n", "terms", "doc", "code", "tf"])
            i = j


def build_index(documents: DataFrame) -> DataFrame:
    """The forward index of documents (doc_id, text) in blocks, as a saved table; block numbers them."""
    docs = in_batches(documents).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    schema = "ids array<long>, n array<long>, terms array<string>, doc array<int>, code array<int>, tf array<int>"
    return saved(docs.mapInArrow(_blocks, schema).withColumn("block", F.monotonically_increasing_id()), "index", **GROUPS)


def _impact(tf: np.ndarray, n: np.ndarray, count: int, length: int) -> np.ndarray:
    """What documents of n terms with tf occurrences add for a term of weight 1; count documents have length terms in all."""
    m = 100 - 90 + (90 * n * count) // length
    return (SCALE * tf) // (1000 * tf + 8 * m)


def _lists(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]


def _maxima(count: int, length: int):
    def run(batches):
        for b in batches:
            n, doc, code, tf = (_lists(b.column(c)) for c in (1, 2, 3, 4))
            size = np.diff(b.column(5).offsets.to_numpy())
            top, df = [], []
            for r in range(b.num_rows):
                order = np.argsort(code[r], kind="stable")
                first = np.searchsorted(code[r][order], np.arange(size[r]))
                top.append(np.maximum.reduceat(_impact(tf[r], n[r][doc[r]], count, length)[order], first) if size[r] else np.zeros(0, np.int64))
                df.append(np.bincount(code[r], minlength=size[r]))
            yield pa.record_batch([b.column(0), b.column(5), pa.array(top, pa.list_(pa.int64())), pa.array(df, pa.list_(pa.int64()))], ["block", "terms", "top", "df"])

    return run


def _query_terms(batches):
    """(id, text) to (query, term)."""
    for b in batches:
        data, offs = text_buffers(b.column(1))
        terms, doc = _terms(data, offs)
        yield pa.record_batch([b.column(0).take(pa.array(doc)), terms.cast(pa.string())], ["query", "term"])


def _scores(count: int, length: int, k: int):
    """Rows (ids, n, terms, doc, code, tf, asked): each query asked of the block gets its k best documents there."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            n, doc, code, tf = (_lists(b.column(c)) for c in (1, 3, 4, 5))
            for r in range(b.num_rows):
                place = {t: i for i, t in enumerate(b.column(2)[r].as_py())}
                order = np.argsort(code[r], kind="stable")
                first = np.searchsorted(code[r][order], np.arange(len(place) + 1))
                holder, impact = doc[r][order], _impact(tf[r], n[r][doc[r]], count, length)[order]
                own = ids[r].values
                # Documents in the order of ids, so that ties are broken by taking the first; rows without an id come last.
                turn = np.empty(len(own), np.int64)
                turn[pc.sort_indices(own).to_numpy()] = np.arange(len(own))
                query, score, at = [], [], []
                for q in b.column(6)[r].as_py():
                    total = np.zeros(len(own), np.int64)
                    for t in q["terms"]:
                        c = place.get(t["term"])
                        if c is not None:
                            total[holder[first[c] : first[c + 1]]] += t["w"] * impact[first[c] : first[c + 1]]
                    hit = np.flatnonzero(total)
                    hit = hit[np.lexsort([turn[hit], -total[hit]])[:k]]
                    query += [q["query"]] * len(hit)
                    score += total[hit].tolist()
                    at += hit.tolist()
                if at:
                    yield pa.record_batch([pa.array(query, pa.int64()), own.take(pa.array(at)), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k highest of each query, with their ranks; tasks cut to k before rows are gathered."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of an index for each query (query, text), those that score above 0."""
    collection = index.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("count"), F.sum("n").alias("length")).first()
    count, length = collection["count"], collection["length"] or 0
    schema = "query long, rank int, doc_id long, score long"
    if not count:
        return index.sparkSession.createDataFrame([], schema)
    asked = saved(in_batches(queries).select("query", "text").mapInArrow(_query_terms, "query long, term string").distinct(), "asked")

    # Maxima of the terms that are asked for, and those terms' weights.
    own = index.select("block", "n", "doc", "code", "tf", "terms").mapInArrow(_maxima(count, length), "block long, terms array<string>, top array<long>, df array<long>")
    entries = own.select("block", F.explode(F.arrays_zip("terms", "top", "df")).alias("t")).select("block", F.col("t.terms").alias("term"), F.col("t.top").alias("top"), F.col("t.df").alias("df"))
    maxima = saved(entries.join(asked.select("term").distinct(), "term", "left_semi"), "maxima")
    df = F.sum("df").cast("double")
    weight = F.floor(1000 * F.log((F.lit(2.0) * count + 2) / (2 * df + 1))).cast("long")
    weights = asked.join(maxima.groupBy("term").agg(weight.alias("w")), "term").filter("w > 0")
    weights = saved(weights, "weights")

    bounds = maxima.join(weights, "term").groupBy("query", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    bounds = saved(bounds, "bounds")
    needed = saved(weights.groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "terms")  # a query's own
    groups = max(1, -(-needed.count() // TOGETHER))
    best, last, take, tables = None, None, FIRST, []
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    while True:
        rest = bounds
        if best is not None:
            # Blocks come in the order of bound and number: those after the last taken are left, while they can still reach the k-th score.
            floor = best.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
            rest = rest.join(last, "query").filter("bound < last.bound OR bound = last.bound AND block > last.block").drop("last").join(floor, "query", "left").filter("floor IS NULL OR bound >= floor").drop("floor")
        now = saved(rest.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= take).select("query", "block", "bound"), "round")
        tables.append(now)
        if now.isEmpty():
            break
        reached = now.groupBy("query").agg(F.min_by(F.struct("bound", "block"), F.struct("bound", -F.col("block"))).alias("last"))
        last = saved(reached, "last")
        tables.append(last)
        # A block gets so many queries at once; a block that all queries ask for is scored by several tasks.
        rows = now.join(needed, "query").select("block", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("part"), F.struct("query", "terms").alias("q"))
        rows = rows.groupBy("block", "part").agg(F.collect_list("q").alias("asked"))
        found = index.join(rows.hint("merge"), "block").select("ids", "n", "terms", "doc", "code", "tf", "asked").mapInArrow(_scores(count, length, k), "query long, doc_id long, score long")
        found = found if best is None else found.unionByName(best.select("query", "doc_id", "score"))
        best = saved(_best(found, k), "best")
        tables.append(best)
        take *= MORE
    if best is None:
        removed(asked, maxima, weights, bounds, needed, *tables)
        return index.sparkSession.createDataFrame([], schema)
    removed(asked, maxima, weights, bounds, needed, *(t for t in tables if t is not best))
    return best.select("query", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank (from 1), doc_id and score.

    Takes doc_id and text of documents, item_id and text of items, whatever
    else there is.  Terms are runs of ASCII letters and digits, in lower case,
    and of characters beyond ASCII.  Null and empty texts have no terms; they
    are found by nothing and find nothing.  Equal scores are ranked by doc_id,
    documents without one last.  Each row of documents is a document, so
    repeated rows are ranked one after the other; rows of items that share an
    item_id are one item with the terms of all, and items without one are one.
    A very long text is a block of its own.  An empty table gives no rows.
    """
    index = build_index(documents)
    queries = items.select(F.col("item_id").cast("long").alias("query"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # An item without an id takes one that no other has, and gives it back.
    none = F.lit(-(1 << 63))
    out = search(index, queries.withColumn("query", F.coalesce("query", none)), k)
    removed(index)
    return out.select(F.when(F.col("query") != none, F.col("query")).alias("item_id"), "rank", "doc_id", "score")
