"""Readers that stream: shards of arrays and structure files, in bounded pieces."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.sources import formats, streamed, structures


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_array_shards(spark, tmp_path, monkeypatch, save):
    for k in (1, 2):
        save(tmp_path / f"p{k}.npz", system_id=np.array([f"a{k}", f"b{k}", f"c{k}"]), offsets=np.array([0, 2, 2, 5]), rows=np.arange(5) * k, xyz=np.arange(15.0).reshape(5, 3), one=np.float32(15), none=np.zeros((0, 2)))
    shards = streamed.npz_shards(spark, str(tmp_path / "*.npz"), ["system_id", "offsets", "rows", "xyz", "one", "none"])
    assert {r["text"] for r in shards.filter("array = 'system_id'").collect()} == {f"{c}{k}" for c in "abc" for k in (1, 2)}
    assert {(r["i"], *r["values"]) for r in shards.filter("array = 'xyz'").collect()} == {(i, 3.0 * i, 3.0 * i + 1, 3.0 * i + 2) for i in range(5)}
    assert [r["values"] for r in shards.filter("array = 'one'").collect()] == [[15.0]] * 2 and shards.filter("array = 'none'").isEmpty()
    got = {(r["path"][-6:-4], r["row"]): r["values"] for r in streamed.csr_rows(spark, str(tmp_path / "*.npz"), "offsets", "rows").collect()}
    assert got == {(f"p{k}", r): [float(i * k) for i in v] for k in (1, 2) for r, v in ((0, (0, 1)), (1, ()), (2, (2, 3, 4)))}
    wide = {(r["path"][-6:-4], r["row"]): r["values"] for r in streamed.csr_rows(spark, str(tmp_path), "offsets", "xyz").collect()}
    assert wide["p1", 2] == [float(x) for x in range(6, 15)]


def test_ranges_and_pieces(tmp_path, monkeypatch):
    """Small pieces, small ranges and long rows give the same; what is read at once is bounded."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 40, 300)
    x = rng.standard_normal((int(sizes.sum()), 2))
    np.savez(tmp_path / "a.npz", o=np.concatenate([[0], np.cumsum(sizes)]), x=x)
    monkeypatch.setattr(streamed, "PIECE", 160)
    monkeypatch.setattr(streamed, "ROWS", 7)
    monkeypatch.setattr(streamed, "RANGE", 1600)
    most = []
    take = streamed._Rows.take
    monkeypatch.setattr(streamed._Rows, "take", lambda self, n: most.append(n) or take(self, n))
    npz = streamed.NpzReader({"path": str(tmp_path / "a.npz"), "arrays": "x"})
    parts = npz.partitions()
    assert len(parts) > 20
    got = [v for p in parts for b in npz.read(p) for v in b.column("values").to_pylist()]
    assert np.array_equal(np.array(got), x)
    csr = streamed.CsrReader({"path": str(tmp_path / "a.npz"), "offsets": "o", "values": "x"})
    rows = [v for p in csr.partitions() for b in csr.read(p) for v in b.column("values").to_pylist()]
    assert [len(v) // 2 for v in rows] == sizes.tolist() and np.array_equal(np.concatenate(rows).reshape(-1, 2), x)
    assert max(most) <= max(7, 10, int(sizes.max()))


def test_broken_shards(tmp_path):
    np.savez(tmp_path / "a.npz", o=np.array([0, 3, 2]), x=np.arange(3), p=np.array([0, 9]), q=np.array([1, 2]), c=np.asfortranarray(np.ones((2, 3))), obj=np.array([{}], dtype=object))
    read = lambda o: list(streamed.CsrReader({"path": str(tmp_path / "a.npz"), "offsets": o, "values": "x"}).read(streamed.Part(str(tmp_path / "a.npz"))))
    for o in "opq":
        with pytest.raises(ValueError, match="offsets"):
            read(o)
    for a in ("c", "obj"):
        with pytest.raises(ValueError, match="streamed"):
            streamed.NpzReader({"path": str(tmp_path / "a.npz"), "arrays": a}).partitions()


CIF = """data_x
_cell.length_a 10
loop_
_other.id
_other.text
1 'loop_ is a word'
2
;text
_atom_site.id
loop_
;
# a remark
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.Cartn_x
_atom_site.note
ATOM 1 CA ALA 1.5 'it''s a dog's tail' ATOM 2 "O5'" ALA
. ?
ATOM 3 'C B' GLY -2 # done
;two
lines
;
_after.this 1
"""


def test_tokens_of_structure_files(spark):
    rows = [dict(zip(*r, strict=True)) for r in streamed.cif_loop(streamed.cif_tokens(io.StringIO(CIF)), "_atom_site")]
    assert [(r["id"], r["label_atom_id"], r["Cartn_x"], r["note"]) for r in rows] == [("1", "CA", "1.5", "it''s a dog's tail"), ("2", "O5'", None, None), ("3", "C B", "-2", "two\nlines")]
    assert [r for _, r in streamed.cif_loop(streamed.cif_tokens(io.StringIO("data_y\n_atom_site.id 7\n_atom_site.name 'A B'\n")), "_atom_site")] == [["7", "A B"]]
    assert list(streamed.cif_loop(streamed.cif_tokens(io.StringIO("")), "_atom_site")) == []
    with pytest.raises(ValueError, match="1 of 2"):
        list(streamed.cif_loop(streamed.cif_tokens(io.StringIO("loop_\n_atom_site.a\n_atom_site.b\n1 2 3\n")), "_atom_site"))
    df = spark.createDataFrame([(1, CIF), (2, None), (3, "")], "k int, value string")
    assert [(r["k"], r["atom"]["id"], r["atom"]["Cartn_x"]) for r in formats.mmcif_atoms(df, by=["k"]).collect()] == [(1, "1", "1.5"), (1, "2", None), (1, "3", "-2")]


def large(n, seed=0):
    rng = random.Random(seed)
    items = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    names = ["N", "CA", "C", "O", "CB"]
    rows = [f"ATOM {i + 1} {names[i % 5][0]} {names[i % 5]} ALA {'AB'[i % 10 // 5]} {i // 5 + 1} {rng.uniform(-99, 99):.3f} {rng.uniform(-99, 99):.3f} {rng.uniform(-99, 99):.3f} 1" for i in range(n)]
    return "data_x\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in items) + "\n".join(rows) + "\n#\n"


def test_a_hundred_thousand_atoms(spark, tmp_path):
    text = large(100_000)
    assert formats.mmcif_atoms(spark.createDataFrame([(text,)], "value string")).count() == 100_000
    (tmp_path / "a.cif").write_text(text)
    (tmp_path / "b.cif").write_text(large(50, 1))
    atoms = streamed.mmcif_files(spark, str(tmp_path / "*.cif"))
    n = {r["path"][-5]: r["count"] for r in atoms.groupBy("path").count().collect()}
    assert n == {"a": 100_000, "b": 50}
    assert structures.residues(atoms, ["path"]).count() == 20_010
    alpha = atoms.filter(F.col("name") == "CA").filter(F.col("chain").isin("A"))
    assert alpha.count() == 10_005


def test_filters_are_applied_as_lines_are_read(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    (tmp_path / "a.cif").write_text(large(100))
    reader = streamed.CifReader({"path": str(tmp_path / "a.cif")})
    rest = list(reader.pushFilters([EqualTo(("name",), "CA"), In(("chain",), ("A", "Z")), GreaterThan(("x",), 0.0), EqualTo(("id",), 3)]))
    assert len(rest) == 2
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == 10 and {(r["name"], r["chain"]) for r in got} == {("CA", "A")}
