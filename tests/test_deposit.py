"""Each check of a deposit passes on sound tables and fails on a planted row."""

import pytest
from pyspark.sql import functions as F

from sieveline.operators import deposit
from sieveline.sources import formats
from sieveline.sources.structures import STANDARD, footers


def failed(suite):
    return {r["check"][:3] for r in suite.collect() if not r["passed"]}


def test_files_against_their_manifest(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.txt").write_text("x" * (n + 1))
    files = formats.file_hashes(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    lines = files.select(F.concat("sha256", F.lit("  "), "path").alias("value"))
    manifest = formats.manifest(lines)
    inventory = files.select("path", F.lit(5).alias("rows"), F.col("length").alias("bytes"))
    counted = files.select("path", F.lit(5).alias("rows"))
    run = lambda m=manifest, f=files, d=manifest, i=inventory, c=counted: failed(deposit.file_checks(m, f, d, i, c))
    swap = lambda df, c, v: df.withColumn(c, F.when(F.col("path") == "f1.txt", v).otherwise(F.col(c)))
    gone = lambda df: df.filter("path <> 'f1.txt'")
    assert run() == set()
    assert run(m=swap(manifest, "sha256", F.lit("0" * 64))) == {"q06", "q08"}
    assert run(m=gone(manifest)) == {"q07"}
    assert run(f=gone(files)) == {"q06", "q07", "q10"}
    assert run(d=swap(manifest, "sha256", F.lit("0"))) == {"q08"}
    assert run(d=gone(manifest)) == {"q09"}
    assert run(i=gone(inventory)) == {"q10"} and run(i=swap(inventory, "rows", F.lit(6))) == {"q10"} and run(i=swap(inventory, "bytes", F.lit(99).cast("long"))) == {"q10"}
    assert run(m=manifest.limit(0), f=files.limit(0), d=manifest.limit(0), i=inventory.limit(0), c=counted.limit(0)) == {"q06"}


LABEL = {"system": "a", "d_ca": 6.5, "d_min": 4.5, "contact_4": False, "contact_5": True, "contact_8": True}
BAD_LABELS = [
    ({"d_ca": 3.0}, "q18"), ({"d_min": 600.0, "d_ca": 600.0, "contact_5": False, "contact_8": False}, "q19"), ({"d_min": -1.0, "contact_4": True}, "q19"), ({"contact_5": False}, "q20"), ({"contact_5": False, "contact_4": True}, "q21"),
    ({"d_min": 4.5003}, "q22"), ({"d_min": 3.5, "contact_4": True}, "q23"), ({"system": "z"}, "q12"), ({"d_min": None}, "q18"), ({"contact_8": None}, "q20"), ({"d_ca": float("nan")}, "q19"),
]


@pytest.mark.parametrize(("change", "check"), BAD_LABELS)
def test_a_bad_label_is_found(spark, change, check):
    kind = "system string, d_ca double, d_min double, contact_4 boolean, contact_5 boolean, contact_8 boolean"
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    near = LABEL | {"system": "b", "d_min": 4.0, "contact_4": True}
    meta = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "system string, has_contacts boolean")
    assert failed(deposit.label_checks(frame(LABEL, near), meta)) == set()
    assert check in failed(deposit.label_checks(frame(LABEL, near, LABEL | change), meta))
    wrong = spark.createDataFrame([("a", False), ("b", None)], "system string, has_contacts boolean")
    assert failed(deposit.label_checks(frame(LABEL, near), wrong)) == {"q23"}


P = {"x": 0.0, "y": 1.0, "z": 2.0}
SYSTEM = {"system": "a", "res_types": ["ALA", "GLY"], "ca": [P, P], "sc": [P, P], "pep": [P, P], "sc_valid": [True, False], "shell": [P], "shell_index": [1], "scale": 100}
BAD_SYSTEMS = [
    ({"sc": [P]}, "q32"), ({"res_types": ["ALA", "ALA"]}, "q33"), ({"res_types": ["ALA", "UNK"]}, "q35"), ({"ca": [P, P | {"x": float("nan")}]}, "q36"), ({"pep": [P, None]}, "q36"), ({"shell_index": [2]}, "q37"), ({"shell_index": [-1]}, "q37"),
    ({"shell": [P, P]}, "q37"), ({"scale": 10}, "q39"), ({"scale": None}, "q39"), ({"ca": [], "sc": [], "pep": [], "sc_valid": [], "res_types": [], "shell": [], "shell_index": []}, "q30"),
]


@pytest.mark.parametrize(("change", "check"), BAD_SYSTEMS)
def test_a_bad_system_is_found(spark, change, check):
    p = "array<struct<x: double, y: double, z: double>>"
    kind = f"system string, res_types array<string>, ca {p}, sc {p}, pep {p}, sc_valid array<boolean>, shell {p}, shell_index array<int>, scale int"
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    assert failed(deposit.store_checks(frame(SYSTEM, SYSTEM), STANDARD, ["scale"])) == set()
    assert check in failed(deposit.store_checks(frame(SYSTEM, SYSTEM | change), STANDARD, ["scale"]))


def test_residues_against_their_source(spark):
    p = "struct<x: double, y: double, z: double>"
    kind = f"system string, res_row int, residue string, ca {p}, sc {p}, pep {p}, sc_valid boolean"
    rows = [(s, i, r, P, P, P, r != "GLY") for s in "ab" for i, r in enumerate(("ALA", "GLY", "SER"))]
    frame = lambda rs: spark.createDataFrame(rs, kind)
    counts = spark.createDataFrame([("a", 3), ("b", 3)], "system string, n_res int")
    source = frame(rows)
    run = lambda rs, c=counts: failed(deposit.source_checks(frame(rs), source, c))
    with_ = lambda k, v: [*rows[:4], tuple(v if i == k else x for i, x in enumerate(rows[4])), rows[5]]
    assert run(rows) == set()
    assert run([tuple({"x": 0.015, "y": 1.0, "z": 2.0} if x is P else x for x in r) for r in rows]) == set()  # within a step
    far = P | {"y": 1.03}
    assert run(with_(2, "VAL")) == {"q51"} and run(with_(3, far)) == {"q52"} and run(with_(4, far)) == {"q53"} and run(with_(5, far)) == {"q54"} and run(with_(5, None)) == {"q54"}
    assert run(rows[:-1]) == {"q51", "q57"} and run([*rows, ("b", 3, "ALA", P, P, P, True)]) == {"q51", "q57"}
    assert run([*rows[:3], tuple(False if i == 6 else x for i, x in enumerate(rows[3])), *rows[4:]]) == {"q55"}
    assert run(rows, counts.filter("system = 'a'")) == {"q57"}


def test_comparison_without_order(spark):
    kind = "system string, x double, y double, z double, d double"
    rows = [("a", float(i), 2.0 * i, -1.0, 10.0 + i) for i in range(6)] + [("b", 0.0, 0.0, 0.0, 1.0)]
    frame = lambda rs: spark.createDataFrame(rs, kind)
    run = lambda x, y, **k: {r["system"]: (r["n_stored"], r["n_again"], r["lost"], r["added"]) for r in deposit.unordered_comparison(frame(x), frame(y), ["system"], **k).collect()}
    same = {"a": (6, 6, 0, 0), "b": (1, 1, 0, 0)}
    assert run(rows, rows) == same and run(rows, rows[::-1]) == same  # members exchanged
    step = [(s, x + 0.012, y - 0.012, z + 0.01, d) for s, x, y, z, d in rows]
    assert run(rows, step) == same
    shifted = [(s, x + (0.3 if x == 2 else 0), y, z, d) for s, x, y, z, d in rows]
    assert run(rows, shifted) == same | {"a": (6, 6, 1, 1)}
    assert run(rows, rows[:-1]) == {"a": (6, 6, 0, 0), "b": (1, 0, 1, 0)}
    # The last ones are at 14.0 and 15.0: one within the margin of the limit needn't be there.
    assert run(rows, [r for r in rows if r[4] != 15.0], value="d", limit=15.0) == {"a": (5, 5, 0, 0), "b": (1, 1, 0, 0)}
    assert run(rows, [r for r in rows if r[4] != 14.0], value="d", limit=15.0)["a"] == (5, 4, 1, 0)


def test_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    run = lambda: failed(deposit.footer_checks(footers(spark, str(tmp_path))))
    t = pa.table({"a": [1]})
    pq.write_table(t, tmp_path / "a.parquet", compression="zstd")
    assert run() == set()
    pq.write_table(t.replace_schema_metadata({"made": "/home/someone/x"}), tmp_path / "b.parquet", compression="zstd")
    assert run() == {"q11"}
    pq.write_table(t, tmp_path / "b.parquet", compression="snappy")
    assert run() == {"q04"}
