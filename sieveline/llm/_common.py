"""What the operators share: keys, folders, batches and joins by checked size."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import connected_components as components
from ..operators.iterate import cut as saved
from ..operators.iterate import removed, shared_folder, spread

__all__ = ["components", "dealt", "fresh_dir", "in_batches", "in_slices", "keyed", "partitions", "removed", "saved", "sized", "sliced", "text_hash", "together"]

LEAST_ID = -(1 << 63)
#: Rows of some 50 bytes that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Slices of so many rows that are broadcast one by one; texts are read once for each.
SLICES = 64


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def sized(rows: DataFrame, weight: str = "1") -> DataFrame:
    """Rows to join to a large table: broadcast if they are BROADCAST_ROWS at most (a row counts ``weight`` times, for each 50 bytes), else merged.

    They are counted first, so they should be saved ones; either way the join has the same result.
    """
    n = rows.agg(F.sum(F.expr(weight)).alias("n")).first()["n"] or 0
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows.hint("merge")


def sliced(rows: DataFrame, by: list[str], weight: str = "1") -> list[DataFrame]:
    """Saved rows to join, dealt by a hash of columns to as many slices as bring each to some BROADCAST_ROWS (a row counts ``weight`` times), to be broadcast; where that takes more than SLICES, one to be merged."""
    n = rows.agg(F.sum(F.expr(weight)).alias("n")).first()["n"] or 0
    if n > SLICES * BROADCAST_ROWS:
        return [rows.hint("merge")]
    return [F.broadcast(r) for r in dealt(rows, by, max(1, int(-(-n // max(1, BROADCAST_ROWS)))))]


def dealt(rows: DataFrame, by: list[str], k: int) -> list[DataFrame]:
    """Rows dealt to k slices by a hash of columns."""
    return [rows] if k == 1 else [rows.filter(F.pmod(F.xxhash64(*by), F.lit(k)) == i) for i in range(k)]


def in_slices(docs: DataFrame, rows: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None) -> list[DataFrame]:
    """docs joined with saved rows on columns that both have, in parts that make up the whole; docs, which hold the texts, are never moved.

    A part has a slice of the rows, which is broadcast, and the docs of the
    same hash.  With ``by``, slices are made by other columns of the rows, so
    that groups stay whole; an inner join then meets all docs in each part.
    Docs are read once for each part.
    """
    parts = sliced(rows, by or on)
    each = [docs] * len(parts) if by else dealt(docs, on, len(parts))
    return [d.join(r, on, how) for d, r in zip(each, parts, strict=True)]


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_batches(df: DataFrame, most: int = 4 << 20, deal: bool = True) -> DataFrame:
    """The same rows, of a small source dealt to all cores; from now on the session sends them to Python in Arrow batches of so many bytes at most.

    Batches are bounded by rows alone otherwise, or by 64 MB, which a few
    workers and the buffers of their executor multiply.  A smaller bound stays.
    Rows that were shuffled are not dealt again (deal=False): asking for their
    partitions would run the shuffle a first time.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        df.sparkSession.conf.set(key, str(most))
    return spread(df) if deal else df


def text_hash(text: F.Column) -> F.Column:
    """A hash that tells apart texts, and a null one from an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns k, id and text of the documents.

    k is the id where ids are distinct and not null, as they should be.
    Otherwise k is (id, whether it is null, hash of the text): rows that share
    an id but not a text stay apart, rows that share both count as one
    document and each gets its result.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = base.select("id").groupBy("id").count().filter((F.col("count") > 1) | F.col("id").isNull())
    if ids.isEmpty():
        return base.select(F.col("id").alias("k"), "id", "text")
    k = F.struct(
        F.coalesce("id", F.lit(LEAST_ID)).alias("i"),
        F.col("id").isNotNull().alias("real"),
        text_hash(F.col("text")).alias("h"),
    )
    return base.select(k.alias("k"), "id", "text")
