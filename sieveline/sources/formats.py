"""Readers of text formats as DataFrames, and writers; structure files go through their fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", header).csv(path, schema=schema)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object keyed by id to rows (key, value)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def fasta(text: DataFrame, column: str = "value") -> DataFrame:
    """Whole FASTA texts to (name, sequence): the first word of a header, lines joined, blanks dropped."""
    records = F.explode(F.slice(F.split(F.concat(F.lit("\n"), F.col(column)), "\n>"), 2, 1 << 30)).alias("r")
    rows = text.select(records)
    head = F.split("r", "\n", 2)
    return rows.select(F.regexp_extract(head[0], r"^\s*(\S+)", 1).alias("name"), F.regexp_replace(F.coalesce(F.get(head, 1), F.lit("")), r"\s", "").alias("sequence"))


def _cut(line: Column, first: int, last: int) -> Column:
    return F.trim(F.substring(line, first, last - first + 1))


def pdb_atoms(lines: DataFrame, record: str = "ATOM", line: str = "value") -> DataFrame:
    """Fixed-column atom lines: first alternate location only, hydrogen and deuterium dropped."""
    c = F.col(line)
    element = F.upper(F.coalesce(F.nullif(_cut(c, 77, 78), F.lit("")), F.regexp_extract(_cut(c, 13, 16), "([A-Za-z])", 1)))
    rows = lines.filter(c.startswith(record) & F.substring(c, 17, 1).isin(" ", "A"))
    num = lambda a, b: _cut(c, a, b).cast("double")
    out = rows.select(_cut(c, 13, 16).alias("name"), _cut(c, 18, 20).alias("residue"), F.substring(c, 22, 1).alias("chain"), _cut(c, 23, 26).cast("int").alias("number"), num(31, 38).alias("x"), num(39, 46).alias("y"), num(47, 54).alias("z"), element.alias("element"))
    return out.filter(~F.col("element").isin("H", "D"))


def sdf_atoms(text: DataFrame, column: str = "value") -> DataFrame:
    """V2000 blocks to (model, atom, element, x, y, z, property): heavy atoms in order, and the minimizedAffinity of each model."""
    models = text.select(F.posexplode(F.filter(F.split(column, r"\$\$\$\$\r?\n?"), lambda m: F.length(F.trim(m)) > 0)).alias("model", "m"))
    lines = models.withColumn("l", F.split("m", "\r?\n"))
    n = F.trim(F.substring(F.element_at("l", 4), 1, 3)).cast("int")
    rows = lines.select("model", F.regexp_extract("m", r">\s*<minimizedAffinity>\s*\n\s*(-?[\d.]+)", 1).alias("affinity"), F.posexplode(F.slice(F.col("l"), F.lit(5), n)).alias("atom", "a"))
    a = F.col("a")
    out = rows.select("model", "atom", F.trim(F.substring(a, 32, 3)).alias("element"), *[F.trim(F.substring(a, 1 + 10 * i, 10)).cast("double").alias(v) for i, v in enumerate("xyz")], F.nullif("affinity", F.lit("")).cast("double").alias("affinity"))
    return out.filter(~F.col("element").isin("H", "D"))


def mmcif_atoms(text: DataFrame, column: str = "value", by: list[str] | None = None) -> DataFrame:
    """The _atom_site loop of mmCIF texts: one row an atom as a map from item to value ('.' and '?' are null), with the columns ``by`` of its text's row.

    Texts are read token by token, so values may be quoted or go over lines,
    and however many atoms there are, a batch of them is in memory beside the text.
    """
    import io

    import pyarrow as pa

    from .streamed import ROWS, cif_loop, cif_tokens

    by = by or []

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                rows = []
                for items, values in cif_loop(cif_tokens(io.StringIO(b.column(len(by))[r].as_py() or "")), "_atom_site"):
                    rows.append(list(zip(items, values, strict=True)))
                    if len(rows) == ROWS:
                        yield batch(b, r, rows)
                        rows = []
                if rows:
                    yield batch(b, r, rows)

    def batch(b, r, rows):
        own = [b.column(c).take(pa.array([r] * len(rows))) for c in range(len(by))]
        return pa.record_batch([*own, pa.array(rows, pa.map_(pa.string(), pa.string()))], [*by, "atom"])

    own = [f"`{c}` {text.schema[c].dataType.simpleString()}" for c in by]
    return text.select(*by, column).mapInArrow(run, ", ".join([*own, "atom map<string, string>"]))


def manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """sha256 manifests: "hash  path" lines."""
    parts = F.split(column, "  ", 2)
    return lines.filter(F.col(column).contains("  ")).select(parts[0].alias("sha256"), parts[1].alias("path"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def first_existing(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, path) of the first root, by priority, that has a file."""
    return candidates.join(existing.select("path"), "path", "left_semi").groupBy(key).agg(F.min_by("path", "priority").alias("path"))


def write_like(df: DataFrame, schema: StructType, path: str) -> None:
    """Write with exactly a schema's columns, order and types."""
    df.to(schema).write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)
