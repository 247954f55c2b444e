"""Structures, array shards and job inputs as DataFrames: what of an atom table is a residue, and what is a ligand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import _cut

#: The standard amino acids (fixed values).
STANDARD = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
#: Atoms of the backbone, the terminal oxygen among them (fixed values).
BACKBONE = ["N", "CA", "C", "O", "OXT"]

_XYZ = ("x", "y", "z")


def heavy(atoms: DataFrame) -> DataFrame:
    return atoms.filter(~F.upper("element").isin("H", "D"))


def pdb_residues(lines: DataFrame, by: list[str] | None = None, line: str = "value", order: str = "line") -> DataFrame:
    """Residues of fixed-column ATOM lines: (by, res_row, chain, number, residue, anchor, n_heavy).

    A residue is a chain and a number, in the order in which they first stand;
    its anchor is its alpha carbon, else its first heavy atom.  Only the first
    alternate location counts, and no hydrogen.  ``order`` numbers the lines.
    """
    by = by or []
    c = F.col(line)
    name = _cut(c, 13, 16)
    element = F.upper(F.coalesce(F.nullif(_cut(c, 77, 78), F.lit("")), F.substring(name, 1, 1)))
    rows = lines.filter(c.startswith("ATOM") & F.substring(c, 17, 1).isin(" ", "A")).select(
        *by, F.col(order).alias("_o"), F.substring(c, 22, 1).alias("chain"), _cut(c, 23, 26).alias("number"), _cut(c, 18, 20).alias("residue"), name.alias("_name"), element.alias("_e"),
        F.struct(*[_cut(c, 31 + 8 * i, 38 + 8 * i).cast("double").alias(v) for i, v in enumerate(_XYZ)]).alias("_p"),
    ).filter("_e <> 'H'")
    at = F.struct((F.col("_name") != "CA").alias("a"), F.when(F.col("_name") == "CA", -F.col("_o")).otherwise(F.col("_o")).alias("b"))  # the last alpha carbon, else the first atom
    one = rows.groupBy(*by, "chain", "number").agg(F.min("_o").alias("_first"), F.min_by("residue", "_o").alias("residue"), F.min_by("_p", at).alias("anchor"), F.count("*").alias("n_heavy"))
    turn = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_first"))
    return one.select(*by, (turn - 1).cast("int").alias("res_row"), "chain", "number", "residue", "anchor", "n_heavy")


def pdb_ligand(lines: DataFrame, line: str = "value") -> DataFrame:
    """(element, x, y, z) of HETATM lines without hydrogen; the element is its column, else the letters of the atom's name."""
    c = F.col(line)
    element = F.coalesce(F.nullif(_cut(c, 77, 78), F.lit("")), F.regexp_extract(_cut(c, 13, 16), "([A-Za-z]+)", 1))
    rows = lines.filter(c.startswith("HETATM"))
    out = rows.select(*[n for n in lines.columns if n != line], element.alias("element"), *[_cut(c, 31 + 8 * i, 38 + 8 * i).cast("double").alias(v) for i, v in enumerate(_XYZ)])
    return out.filter(~F.upper("element").isin("H", "D"))


def mmcif_table(atoms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of an _atom_site loop (maps) as columns: model, chain, residue, number, name, element, x, y, z."""
    get = lambda *names: F.coalesce(*[F.element_at("atom", n) for n in names])
    return atoms.select(
        *(by or []), F.coalesce(get("pdbx_PDB_model_num"), F.lit("1")).cast("int").alias("model"), get("auth_asym_id", "label_asym_id").alias("chain"), get("label_comp_id", "auth_comp_id").alias("residue"),
        get("auth_seq_id", "label_seq_id").alias("number"), get("label_atom_id", "auth_atom_id").alias("name"), F.upper(get("type_symbol")).alias("element"), *[get(f"Cartn_{v}").cast("double").alias(v) for v in _XYZ], get("id").cast("bigint").alias("id"),
    )


def residues(atoms: DataFrame, by: list[str]) -> DataFrame:
    """The residues of an atom table that count: of the standard twenty, with an alpha carbon and a heavy atom.

    atoms: by, id, model, chain, number, residue, name, element, x, y, z.
    Returns by, res_row (their order), chain, number, residue, and three beads:
    ca; sc, the mean of side-chain atoms, or of all heavy ones where there is
    none (sc_valid false); pep, the carbonyl carbon or else the alpha carbon.
    """
    rows = heavy(atoms).filter(F.col("residue").isin(STANDARD) & (F.col("model") == 1))
    side = ~F.col("name").isin(BACKBONE)
    spot = F.struct(*_XYZ)
    mean = lambda ok: F.struct(*[F.avg(F.when(ok, F.col(v))).alias(v) for v in _XYZ])
    one = rows.groupBy(*by, "chain", "number", "residue").agg(
        F.min("id").alias("_o"), F.count("*").alias("n_heavy"), F.min_by(F.when(F.col("name") == "CA", spot), F.when(F.col("name") == "CA", F.col("id"))).alias("ca"),
        mean(side).alias("_side"), mean(F.lit(True)).alias("_all"), F.count_if(side).alias("_n"), F.min_by(F.when(F.col("name") == "C", spot), F.when(F.col("name") == "C", F.col("id"))).alias("_c"),
    ).filter("ca IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("_o"))
    return one.select(*by, (turn - 1).cast("int").alias("res_row"), "chain", "number", "residue", "n_heavy", "ca", F.when(F.col("_n") > 0, F.col("_side")).otherwise(F.col("_all")).alias("sc"), (F.col("_n") > 0).alias("sc_valid"), F.coalesce("_c", "ca").alias("pep"))


def first_ligand(atoms: DataFrame, by: list[str], codes: list[str]) -> DataFrame:
    """Heavy atoms of the first residue, in each group, that has one of the codes."""
    rows = heavy(atoms).filter(F.col("residue").isin(codes) & (F.col("model") == 1))
    w = Window.partitionBy(*by).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("chain", "number", "residue")
    return rows.withColumn("_f", F.first(own).over(w)).filter(own == F.col("_f")).drop("_f")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, row_groups, codec, columns, keys) of Parquet files, read from their footers where the files are.

    Only the ends of the files are read, in one task a file.  Hadoop finds the files; Arrow reads them by their address.
    """
    import pyarrow as pa

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(p)
                with store.open_input_file(inner) as f:
                    meta = pq.ParquetFile(f).metadata
                    codec = meta.row_group(0).column(0).compression if meta.num_row_groups and meta.num_columns else None
                    out.append((p, meta.num_rows, meta.num_row_groups, codec, meta.schema.to_arrow_schema().names, b" ".join(k + b"=" + v for k, v in (meta.metadata or {}).items()).decode("utf8", "replace")))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "rows", "row_groups", "codec", "columns", "keys"), o, strict=True)) for o in out], schema=pa.schema([("path", pa.string()), ("rows", pa.int64()), ("row_groups", pa.int32()), ("codec", pa.string()), ("columns", pa.list_(pa.string())), ("keys", pa.string())]))

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, todo = [], [root]
    while todo:
        for s in store.listStatus(todo.pop()):
            name = s.getPath().getName()
            if s.isDirectory() and not name.startswith(("_", ".")):
                todo.append(s.getPath())
            elif name.endswith(".parquet"):
                files.append(s.getPath().toString())
    rows = spark.createDataFrame([(f,) for f in sorted(files)], "path string").repartition(max(1, len(files)))
    return rows.mapInArrow(run, "path string, rows bigint, row_groups int, codec string, columns array<string>, keys string")


def job_entities(texts: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Whole YAML job inputs to (key, entity, kind, sequence, chains, has_msa).

    Items are grouped by kind and sequence in the order in which they first
    stand; the entity is a group's place, ligands counted.  chains is how many
    ids the group's items have.
    """
    import pyarrow as pa

    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        import yaml

        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                groups: dict[tuple[str, str], list] = {}
                for item in (yaml.safe_load(text or "") or {}).get("sequences", []):
                    name = next(iter(item))
                    body = item[name]
                    what = name.lower()
                    if what in ("protein", "dna", "rna"):
                        sequence = str(body["sequence"])
                    elif what == "ligand":
                        sequence = str(body.get("smiles", body.get("ccd")))
                    else:
                        raise ValueError(f"{k}: unknown kind of entity {name}")
                    groups.setdefault((what, sequence), []).append(body)
                for i, ((what, sequence), bodies) in enumerate(groups.items()):
                    ids = sum(1 if isinstance(x.get("id"), str) else len(x.get("id") or [None]) for x in bodies)
                    for c, v in zip(out, (k, i, what, sequence, ids, any("msa" in x for x in bodies)), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.bool_())], [key, "entity", "kind", "sequence", "chains", "has_msa"])

    return texts.select(key, column).mapInArrow(run, f"`{key}` {kind}, entity int, kind string, sequence string, chains int, has_msa boolean")


def job_texts(chains: DataFrame, key: str) -> DataFrame:
    """(key, value): a whole YAML job input for each key, from its chains (key, chain, kind, sequence, msa), in the order of chains; job_entities() reads it.

    Chains of one kind and sequence are one entity with several ids.  msa, if
    not null, is the path that is written for a protein.
    """
    q = lambda c: F.to_json(F.struct(F.col(c).alias("v")))  # noqa: E731  # a quoted string is the same in YAML and JSON
    text = lambda c: F.regexp_extract(q(c), r'^\{"v":(.*)\}$', 1)
    body = F.when(F.lower("kind") == "ligand", F.concat(F.lit("      smiles: "), text("sequence"), F.lit("\n"))).otherwise(F.concat(F.lit("      sequence: "), text("sequence"), F.lit("\n")))
    per = chains.groupBy(key, "kind", "sequence").agg(F.min("chain").alias("first"), F.array_sort(F.collect_list("chain")).alias("ids"), F.max("msa").alias("msa"))
    msa = F.when(F.col("msa").isNotNull() & (F.lower("kind") == "protein"), F.concat(F.lit("      msa: "), text("msa"), F.lit("\n"))).otherwise("")
    ids = F.concat(F.lit("      id: "), F.to_json("ids"), F.lit("\n"))
    item = F.concat(F.lit("  - "), F.lower("kind"), F.lit(":\n"), ids, body, msa)
    items = per.select(key, F.struct("first", item.alias("item")).alias("i")).groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("items"))
    return items.select(key, F.concat(F.lit("version: 1\nsequences:\n"), F.array_join(F.transform("items", lambda x: x["item"]), "")).alias("value"))


def write_texts(texts: DataFrame, key: str, path: str) -> None:
    """One folder for each key with its text: partitioned by the key, so that a lost task is written again."""
    texts.select(F.col(key).cast("string").alias("key"), "value").write.partitionBy("key").mode("overwrite").option("lineSep", "\u0000").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of what write_texts() wrote; a key is a string, also if all look like numbers."""
    return spark.read.schema("value string, key string").option("lineSep", "\u0000").text(path).select("key", "value")


def within_lengths(chains: DataFrame, by: str, sequence: str, least: int = 10, most: int = 800, longest: int | None = None) -> DataFrame:
    """(by, total, longest) of the groups whose summed length is within bounds, or whose longest chain is, if that bound is given."""
    per = chains.groupBy(by).agg(F.sum(F.length(sequence)).alias("total"), F.max(F.length(sequence)).alias("longest"))
    ok = F.col("total").between(least, most) if longest is None else (F.col("total") >= least) & (F.col("longest") <= longest)
    return per.filter(ok)


def normal_id(x):
    """Identifiers with dots and doubled underscores as single ones."""
    return F.replace(F.replace(x, F.lit("."), F.lit("_")), F.lit("__"), F.lit("_"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of whole texts with their numbers, from 0."""
    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line", "value"))
