"""Token-ID output: sorted-string-table shards.

A file holds the token ids of documents in the order of their keys:

    block*  index  bloom  footer

* A block holds entries up to ``BLOCK`` bytes, then the crc32 of them.  An entry
  is: shared (bytes of the key that the entry before has too), unshared, the
  value's bytes (three varints), the unshared bytes, the value.  The first key
  of a block is whole.
* The index holds for each block: its last key (varint length, bytes), offset
  and size (varints).  It is sparse: one entry a block.
* The Bloom filter has 10 bits a key and 7 probes.
* The footer is fixed: offset and size of index and Bloom filter, entries, ids,
  bytes per id (2 or 4), crc32 of index and filter, magic.

A key is 0x00 for a null doc_id, else 0x01 and the id as 8 big-endian bytes
with the sign bit flipped, so keys sort as ids do and nulls come first.  A
lookup asks the filter, finds a block by binary search in the index and reads
that block alone.

Shards are written by range of doc_id under names no other attempt has; a shard
counts only once it is in the manifest that its task returned, so a lost
executor or a second attempt leaves at most a file nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh_dir, in_batches, partitions, saved
from ._pretok import byte_level_starts, text_slices, tokenizer, worker_memo

BLOCK = 64 << 10
#: Bytes of blocks after which a task begins another file.
SHARD = 64 << 20
_FOOTER = struct.Struct("<QQQQQQIIQ")
_MAGIC = 0x31454C4241545353


def store_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of an address and the path in it; Hadoop's names of stores are Arrow's under another scheme."""
    scheme, _, rest = uri.partition("://")
    return pa.fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'wasbs': 'abfss', 'wasb': 'abfs'}.get(scheme, scheme) }://{rest}" if rest else uri)


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    """Entries in the order of their keys to a stream; equal keys may follow one another."""

    def __init__(self, stream, width: int) -> None:
        self.stream, self.width = stream, width
        self.block, self.last, self.keys, self.index, self.offset, self.ids = bytearray(), b"", [], [], 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must be in order")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.stream.write(bytes(self.block))
            self.index.append((self.last, self.offset, len(self.block)))
            self.offset += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(s) for k, o, s in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_probes(k, bits)] = 1
        bloom_ = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.stream.write(index + bloom_)
        self.stream.write(_FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom_), len(self.keys), self.ids, self.width, zlib.crc32(index + bloom_), _MAGIC))
        self.stream.close()


class Reader:
    """A shard, read block by block."""

    def __init__(self, path: str) -> None:
        fs, p = store_of(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        io, isize, bo, bsize, self.entries, self.ids, self.width, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a sorted-string table")
        tail = self.file.read_at(isize + bsize, io)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{path}: damaged index")
        self.bits = struct.unpack_from("<Q", tail, isize)[0]
        self.bloom = tail[isize + 8 :]
        self.last_keys, self.blocks, at = [], [], 0
        while at < isize:
            n, at = _read_varint(tail, at)
            self.last_keys.append(bytes(tail[at : at + n]))
            o, at = _read_varint(tail, at + n)
            s, at = _read_varint(tail, at)
            self.blocks.append((o, s))

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        o, s = self.blocks[block]
        data = self.file.read_at(s, o)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < s - 4:
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at).astype(np.uint32)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self._entries(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of all entries with that key."""
        out: list[np.ndarray] = []
        if self.may_hold(key):
            for i in range(bisect_left(self.last_keys, key), len(self.blocks)):
                found = [v for k, v in self._entries(i) if k == key]
                out += found
                if self.last_keys[i] > key:
                    break
        return out

    def close(self) -> None:
        self.file.close()


def encoded(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text of a column by a byte-level tokenizer file."""
    memo = worker_memo(path)
    for i, j, _, _, points, at, unsure in text_slices(column):
        starts = byte_level_starts(points, at) if not unsure.all() and points.size and points.max() < 0x2028 else None
        if starts is None or unsure.any():
            keep = np.repeat(~unsure, np.diff(at))
            points = points[keep]
            at = np.concatenate([[0], np.cumsum(np.where(unsure, 0, np.diff(at)))])
            starts = byte_level_starts(points, at)
        place, size = memo.look(points, starts, np.append(starts[1:], len(points))[: len(starts)])
        ids = memo.gather(place, size)
        total = np.concatenate([[0], np.cumsum(size)])
        bound = total[np.searchsorted(starts, at)]
        for d in range(j - i):
            if unsure[d]:
                yield np.array(tokenizer(path).encode(column[i + d].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bound[d] : bound[d + 1]]


def _write(path: str, end_id: int, folder: str, width: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, p = store_of(folder)
        writer, name, done, rows = None, None, 0, []

        def close():
            writer.close()
            rows.append((f"{folder}/{name}", part, done, len(writer.keys), writer.ids))

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoded(b.column(1), path), strict=True):
                if writer is None:
                    name = f"{part:06d}-{done:04d}-{uuid.uuid4().hex}.sst"
                    fs.create_dir(p, recursive=True)
                    writer = Writer(fs.open_output_stream(f"{p}/{name}"), width)
                writer.add(key_of(doc_id), np.append(ids, np.uint32(end_id)))
                if writer.offset >= SHARD:
                    close()
                    writer, done = None, done + 1
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("path", "part", "seq", "docs", "ids"))}, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def write_token_ids(documents: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write every text's ids, then end_id, to shards in the order of doc_id; returns the manifest.

    Manifest: path, part, seq, docs, ids and start (ids of all shards before).
    Null doc_ids come first; rows that share a doc_id are all kept, side by
    side in the order of their texts.  A null text has end_id alone.
    """
    spark = documents.sparkSession
    folder = folder or fresh_dir(spark, "token-ids")
    width = 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = saved(in_batches(dealt, deal=False).mapInArrow(_write(path, end_id, folder, width), "path string, part int, seq int, docs bigint, ids bigint"), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("bigint")))


def _read(batches):
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            reader = Reader(path)
            out: list[list] = [[], [], [], []]
            for key, ids in reader:
                out[0].append(id_of(key))
                out[1].append(start)
                out[2].append(len(ids))
                out[3].append(zlib.crc32(ids.astype("<u4").tobytes()))
                start += len(ids)
            reader.close()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """A row for each document of the shards: doc_id, start, n_tokens, ids_crc32."""
    shards = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return shards.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
