"""Readers that stream: NPZ shards and mmCIF files as Python data sources, a bounded piece of a file in memory at a time.

``register(spark)`` makes the formats known:

* ``npz``: option arrays (names, comma-separated); columns path, array, i,
  values, text: a row for each entry of an array's first axis.  A partition is
  one array of one file, or a range of its rows where the archive isn't
  compressed, so that its bytes can be sought.
* ``npz_csr``: options offsets and values; columns path, row, values: the slice
  of values between each two offsets.  Both arrays are read side by side, so no
  join is needed; an empty slice has an empty list.
* ``mmcif``: columns path and those of atoms; a partition is a file, read token
  by token.  Equality filters on columns of text are applied as lines are read.

Files are named by an absolute path or an address that Arrow opens, with * and
? in the last part.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Bytes of an array that are read at once, and rows of a batch.
PIECE, ROWS = 4 << 20, 10_000
#: Bytes of an array that make up a partition, where an archive can be sought.
RANGE = 64 << 20


def _files(address: str) -> list[str]:
    """The files an address names, those of a folder or a pattern."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address)
    prefix = address[: len(address) - len(path)] if address.endswith(path) else ""
    folder, _, last = path.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder or "/")) if fnmatch.fnmatch(f.base_name, last)]
    elif store.get_file_info(path).type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    else:
        found = [path]
    return [prefix + f for f in sorted(found)]


def _open(address: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address)
    return store.open_input_file(path)


# NPZ


@dataclass
class _Header:
    dtype: np.dtype
    rows: int
    width: int


def _header(member) -> _Header:
    version = np.lib.format.read_magic(member)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
    if dtype.hasobject:
        raise ValueError("an array of Python objects can't be streamed")
    if fortran and len(shape) > 1:
        raise ValueError("an array in column order can't be streamed by rows")
    shape = shape or (1,)
    return _Header(dtype, shape[0], int(np.prod(shape[1:], dtype=np.int64)))


class _Rows:
    """Rows of a member of an archive, read in order."""

    def __init__(self, archive: zipfile.ZipFile, name: str, start: int = 0) -> None:
        self.member = archive.open(f"{name}.npy")
        self.head = _header(self.member)
        self.size = self.head.dtype.itemsize * self.head.width
        if start:
            self.member.seek(self.member.tell() + start * self.size)

    def take(self, n: int) -> np.ndarray:
        raw = self.member.read(n * self.size) if self.size else b""
        if len(raw) != n * self.size:
            raise ValueError("the array ends too early")
        return np.frombuffer(raw, self.head.dtype).reshape(n, self.head.width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.float64).ravel()))


@dataclass
class Part(InputPartition):
    path: str
    array: str = ""
    start: int = 0
    stop: int = -1


class NpzReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.arrays = options["path"], [a.strip() for a in options["arrays"].split(",")]

    def partitions(self):
        out = []
        for path in _files(self.path):
            with _open(path) as f, zipfile.ZipFile(f) as archive:
                for name in self.arrays:
                    rows = _Rows(archive, name)
                    sought = archive.getinfo(f"{name}.npy").compress_type == zipfile.ZIP_STORED
                    step = max(1, RANGE // max(1, rows.size)) if sought else max(1, rows.head.rows)
                    out += [Part(path, name, s, min(s + step, rows.head.rows)) for s in range(0, rows.head.rows, step)]
        return out or [Part("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(partition.path) as f, zipfile.ZipFile(f) as archive:
            rows = _Rows(archive, partition.array, partition.start)
            text = rows.head.dtype.kind in "US"
            at = partition.start
            while at < partition.stop:
                n = min(ROWS, max(1, PIECE // max(1, rows.size)), partition.stop - at)
                x = rows.take(n)
                strings = [v.decode() if isinstance(v, bytes) else str(v) for v in x[:, 0]] if text and rows.head.width else [None] * n
                values = pa.nulls(n, pa.list_(pa.float64())) if text else _lists(x)
                yield pa.record_batch([pa.array([partition.path] * n), pa.array([partition.array] * n), pa.array(np.arange(at, at + n)), values, pa.array(strings, pa.string())], ["path", "array", "i", "values", "text"])
                at += n


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, array string, i bigint, values array<double>, text string"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)


class CsrReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.offsets, self.values = options["path"], options["offsets"], options["values"]

    def partitions(self):
        return [Part(p) for p in _files(self.path)] or [Part("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(partition.path) as f, _open(partition.path) as g, zipfile.ZipFile(f) as one, zipfile.ZipFile(g) as two:
            offsets, values = _Rows(one, self.offsets), _Rows(two, self.values)
            left, row = offsets.head.rows, 0
            last = int(offsets.take(1)[0, 0]) if left else 0
            if last:
                raise ValueError(f"offsets of {partition.path} begin at {last}")
            left -= 1
            while left > 0:
                n = min(ROWS, left)
                ends = offsets.take(n)[:, 0].astype(np.int64)
                if (np.diff(ends, prepend=last) < 0).any() or ends[-1] > values.head.rows:
                    raise ValueError(f"offsets of {partition.path} fall, or pass the end of {self.values}")
                # As many whole rows as make up a piece; a longer row is one of its own.
                i = 0
                while i < n:
                    j = max(i + 1, int(np.searchsorted(ends, last + max(1, PIECE // max(1, values.size)), "right")))
                    x = values.take(int(ends[j - 1]) - last)
                    cut = np.concatenate([[0], ends[i:j] - last]) * values.head.width
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.float64).ravel()))
                    yield pa.record_batch([pa.array([partition.path] * (j - i)), pa.array(np.arange(row, row + j - i)), lists], ["path", "row", "values"])
                    last, row, i = int(ends[j - 1]), row + j - i, j
                left -= n


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_csr"

    def schema(self) -> str:
        return "path string, row bigint, values array<double>"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)


# mmCIF


def cif_tokens(lines) -> Iterator[tuple[str, bool]]:
    """(value, whether it was quoted) of each token: words, values in quotes, and texts between lines that begin with ';'."""
    block: list[str] | None = None
    for line in lines:
        line = line.rstrip("\r\n")
        if block is not None:
            if line.startswith(";"):
                yield "\n".join(block), True
                block, line = None, line[1:]
            else:
                block.append(line)
                continue
        elif line.startswith(";"):
            block = [line[1:]]
            continue
        i, n = 0, len(line)
        while i < n:
            c = line[i]
            if c in " \t":
                i += 1
            elif c == "#":
                break
            elif c in "'\"":
                # A quote ends a value only before a blank or the end of the line.
                j = line.find(c, i + 1)
                while j != -1 and j + 1 < n and line[j + 1] not in " \t":
                    j = line.find(c, j + 1)
                j = n if j == -1 else j
                yield line[i + 1 : j], True
                i = j + 1
            else:
                j = i
                while j < n and line[j] not in " \t":
                    j += 1
                yield line[i:j], False
                i = j
    if block is not None:
        yield "\n".join(block), True


def cif_loop(tokens: Iterator[tuple[str, bool]], category: str) -> Iterator[tuple[list[str], list[str | None]]]:
    """(items, values) of each row of a category's loop, or of its single row outside one; '.' and '?' are null."""
    prefix = f"{category}.".lower()
    value = lambda t, quoted: None if not quoted and t in (".", "?") else t
    reserved = lambda t, quoted: not quoted and (t[:1] == "_" or t[:5].lower() in ("loop_", "data_", "save_", "stop_") or t[:7].lower() == "global_")
    single: dict[str, str | None] = {}
    pending = next(tokens, None)
    while pending is not None:
        word, quoted = pending
        pending = next(tokens, None)
        if quoted:
            continue
        if word.lower() == "loop_":
            items = []
            while pending is not None and not pending[1] and pending[0].startswith("_"):
                items.append(pending[0])
                pending = next(tokens, None)
            mine = bool(items) and items[0].lower().startswith(prefix)
            names = [x[len(prefix) :] for x in items]
            row: list[str | None] = []
            while pending is not None and not reserved(*pending):
                if mine:
                    row.append(value(*pending))
                    if len(row) == len(items):
                        yield names, row
                        row = []
                pending = next(tokens, None)
            if row:
                raise ValueError(f"a row of {category} has {len(row)} of {len(items)} values")
        elif word.lower().startswith(prefix) and pending is not None:
            single[word[len(prefix) :]] = value(*pending)
            pending = next(tokens, None)
    if single:
        yield list(single), list(single.values())


#: Columns of atoms, and the items that give them, the first that is there.
ATOM = {
    "model": ("pdbx_PDB_model_num",), "chain": ("auth_asym_id", "label_asym_id"), "residue": ("label_comp_id", "auth_comp_id"), "number": ("auth_seq_id", "label_seq_id"),
    "name": ("label_atom_id", "auth_atom_id"), "alternate": ("label_alt_id",), "element": ("type_symbol",), "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",), "id": ("id",),
}
_TYPES = {"model": pa.int32(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "id": pa.int64()}


def _cell(column: str, v: str | None):
    if column == "model":
        return 1 if v is None else int(v)
    if column in "xyz":
        return None if v is None else float(v)
    if column == "id":
        return None if v is None else int(v)
    return v.upper() if v is not None and column == "element" else v


class CifReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ATOM and f.attribute[0] not in _TYPES:
                values = set(f.value) if isinstance(f, In) else {f.value}
                own = self.wanted.setdefault(f.attribute[0], values)
                self.wanted[f.attribute[0]] = own & values
            else:
                yield f

    def partitions(self):
        return [Part(p) for p in _files(self.path)] or [Part("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(partition.path) as f, io.TextIOWrapper(f, "utf-8", "replace") as lines:
            for batch in atom_batches(cif_loop(cif_tokens(lines), "_atom_site"), self.wanted):
                yield pa.record_batch([pa.array([partition.path] * batch.num_rows), *batch.columns], ["path", *ATOM])


def atom_batches(rows, wanted: dict[str, set] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of an _atom_site loop as batches of atoms; wanted: the values of columns that are kept."""
    columns: dict[str, list] = {c: [] for c in ATOM}
    names, where = None, {}
    for items, values in rows:
        if items is not names:
            names = items
            where = {c: [items.index(x) for x in ATOM[c] if x in items] for c in ATOM}
        cells = {c: _cell(c, next((values[i] for i in at if values[i] is not None), None)) for c, at in where.items()}
        if wanted and any(cells[c] not in v for c, v in wanted.items()):
            continue
        for c, v in cells.items():
            columns[c].append(v)
        if len(columns["id"]) == ROWS:
            yield _atoms(columns)
            columns = {c: [] for c in ATOM}
    if columns["id"]:
        yield _atoms(columns)


def _atoms(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, _TYPES.get(c, pa.string())) for c, v in columns.items()], list(columns))


class CifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mmcif"

    def schema(self) -> str:
        return "path string, model int, chain string, residue string, number string, name string, alternate string, element string, x double, y double, z double, id bigint"

    def reader(self, schema) -> CifReader:
        return CifReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (NpzSource, CsrSource, CifSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def npz_shards(spark: SparkSession, path: str, arrays: list[str]) -> DataFrame:
    """(path, array, i, values, text) of NPZ shards: one row for each entry of an array's first axis; values are doubles, or text as it is."""
    register(spark)
    return spark.read.format("npz").option("arrays", ",".join(arrays)).load(path)


def csr_rows(spark: SparkSession, path: str, offsets: str, values: str) -> DataFrame:
    """(path, row, values) of NPZ shards: the slice of ``values`` between each two ``offsets``, in order, an empty one as well."""
    register(spark)
    return spark.read.format("npz_csr").option("offsets", offsets).option("values", values).load(path)


def mmcif_files(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of mmCIF files, with the path of each file."""
    register(spark)
    return spark.read.format("mmcif").load(path)
