"""Findings of the third round, taken up again: what a task that reads holds."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sieveline.llm import ranking


def test_index_of_ranked_search_is_read_in_small_groups(spark):
    # up to 4,096 rows of a row group are decoded at once, and a row, which is a block, is hundreds of kilobytes.
    text = F.expr("concat_ws(' ', transform(sequence(1, 22000), x -> concat('w', pmod(xxhash64(id, x), 50000))))")
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), text.alias("text"))
    index = ranking.build_index(docs)
    groups = [f.metadata.row_group(g) for f in map(pq.ParquetFile, glob.glob(f"{index.cut_path}/*.parquet")) for g in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.count() == 1200
    assert max(g.num_rows for g in groups) <= 200 and max(g.total_byte_size for g in groups) <= 16 << 20
    ranking.removed(index)
