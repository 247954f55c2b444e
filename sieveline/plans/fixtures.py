"""The fixture tables read as the domain's tables: annotators' contacts, systems with two entities, texts as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARMS, TRUTH, THRESHOLD = ["click", "purchase", "view"], "signup", 40.0

#: The same in SQL, for oracles.
CONTACTS_SQL = "contacts AS (SELECT event_type AS arm, user_id AS system, (CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) AS res_row, value AS d_min, ts, event_id FROM events)"
SETS_SQL = CONTACTS_SQL + ", sets AS (SELECT DISTINCT arm, system, res_row FROM contacts WHERE d_min <= 40)"
SYSTEMS_SQL = "systems AS (SELECT DISTINCT l_suppkey AS protein, l_partkey AS ligand FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 20
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("system"), k.alias("res_row"), F.col("value").alias("d_min"), "ts", "event_id")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.contacts import asserted

    return asserted(contacts(spark, sf_dir), THRESHOLD)


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as atoms of ten systems (the labels): even ids are residue atoms, odd ones ligand atoms."""
    xyz = [(F.element_at("embedding", i + 1).cast("double") * 30).alias(c) for i, c in enumerate("xyz")]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("system"), *xyz)
    residues = rows.filter("vec_id % 2 = 0").select("system", F.floor(F.col("vec_id") / 8).alias("res_row"), (F.col("vec_id") % 8 == 0).alias("is_anchor"), F.col("vec_id").alias("atom_id"), "x", "y", "z")
    ligand = rows.filter("vec_id % 2 = 1").select("system", F.col("vec_id").alias("atom_idx"), "x", "y", "z")
    return residues, ligand


POINTS_SQL = """pts AS (SELECT vec_id, label AS system, embedding[1]::DOUBLE * 30 AS x, embedding[2]::DOUBLE * 30 AS y, embedding[3]::DOUBLE * 30 AS z FROM embeddings),
  residues AS (SELECT system, vec_id // 8 AS res_row, vec_id % 8 = 0 AS is_anchor, vec_id AS atom_id, x, y, z FROM pts WHERE vec_id % 2 = 0),
  ligand AS (SELECT system, vec_id AS atom_idx, x, y, z FROM pts WHERE vec_id % 2 = 1)"""


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a protein (supplier) and a ligand (part)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_partkey").alias("ligand")).distinct()
