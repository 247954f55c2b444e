"""MinHash near-dedup: one permutation hashing with optimal densification.

* A document's set is its distinct ``w``-word shingles, lower-cased in A-Z; a
  document of fewer words has its whole word sequence as its one shingle.
* A shingle is known by 128 bits of BLAKE2b over its words, so counts and equal
  sets are decided by words.  Half of that, a 64-bit hash, fills K bins (the bin is the hash's top bits, the
  bin's value its least hash).  An empty bin borrows from the first filled bin
  in a random order of its own, which is optimal densification (Shrivastava,
  2017): any bin agrees with probability equal to the Jaccard similarity.
* Bins are banded.  With 64 bands of 8 bins, a pair at similarity 0.8 shares
  no band with probability 8e-6, and one at 0.2 shares one with 2e-4.
* Documents with equal sets are one class; only its smallest member is banded.
  A set too small to be like any other but an equal one isn't banded at all.
* A bucket does not give all its pairs but a star: edges from its smallest
  member, the hub, to the others.  A hub's members over all its buckets are one
  group, whose texts move once: in chunks of bounded size, each with the hub.
  A chunk compares its members' full sets, word by word and not by hash, until
  any two are compared or joined by links.
* Groups of several chunks that links leave in pieces are looked at again.  Up
  to a chunk of members outside the largest piece meet the other chunks one by
  one.  Where more are outside, members of different pieces meet if they share
  one of their rarest shingles, as many as two like sets must share one of (a
  prefix filter).  So no pair of a bucket is given up, and chunks don't meet in
  a square.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, in_batches, in_slices, keyed, removed, saved, together
from ._text import LOWER, mix, signed, single_spaced, slices, text_buffers, words

BINS, BANDS = 512, 64
#: Members, and bytes of their texts, of a chunk of a group; a longer text is a chunk of its own.
CHUNK, CHUNK_BYTES = 1024, 4 << 20
#: Bands that are shuffled at once, of all documents: a larger table takes some of its 64 bands after the others.
BAND_ROWS = 32_000_000

_U = np.uint64


@functools.cache
def _probes() -> tuple[np.ndarray, np.ndarray]:
    """tries[i, t]: the t-th bin that bin i tries when it is empty; and turn[i, j]: when it tries bin j."""
    tries = np.argsort(np.random.default_rng(8).random((BINS, BINS)), axis=1).astype(np.uint16)
    return tries, np.argsort(tries, axis=1).astype(np.uint16)


@functools.cache
def _band_factors() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, BINS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(BANDS, -1) | _U(1)


def signature(u: np.ndarray) -> np.ndarray:
    """The bins of hashes in order."""
    b = (u >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    sig = np.zeros(BINS, _U)
    full = b[first]
    sig[full] = u[first]
    if len(full) < BINS:
        tries, turn = _probes()
        filled = np.zeros(BINS, bool)
        filled[full] = True
        empty = np.flatnonzero(~filled)
        if len(full) < 48:
            sig[empty] = sig[full[turn[empty][:, full].argmin(axis=1)]]
        else:
            t = 0
            while len(empty):
                found = filled[tries[empty, t]]
                sig[empty[found]] = sig[tries[empty[found], t]]
                empty = empty[~found]
                t += 1
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = (sig.reshape(BANDS, -1) * _band_factors()).sum(axis=1, dtype=_U)
        return mix(rows + np.arange(BANDS, dtype=_U) * _U(0xA0761D6478BD642F))


def shingle_sets(texts: pa.Array, w: int):
    """Yields (index, distinct shingles) for every text, also the empty ones: 128 bits of BLAKE2b over a shingle's words, as two columns, in order."""
    data, offs = text_buffers(texts)
    for i, j in slices(offs):
        part, o = LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, doc = words(part, o)
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        if not len(starts):
            yield from ((i + d, np.zeros((0, 2), _U)) for d in range(j - i))
            continue
        text, begin, end = single_spaced(part, starts, ends)
        raw, last = memoryview(text).cast("B"), np.repeat(bounds[1:], np.diff(bounds))
        at = np.arange(len(starts))
        # A text of fewer words is one shingle; else each has w words.
        one = at == bounds[doc]
        at = at[(at + w <= last) | one]
        stop = end[np.minimum(at + w, last[at]) - 1]
        d = np.frombuffer(b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(begin[at].tolist(), stop.tolist(), strict=True)]), _U).reshape(-1, 2)
        own = doc[at]
        order = np.lexsort([d[:, 1], d[:, 0], own])
        d, own = d[order], own[order]
        new = np.ones(len(d), bool)
        new[1:] = (own[1:] != own[:-1]) | (d[1:] != d[:-1]).any(axis=1)
        d, own = d[new], own[new]
        cut = np.searchsorted(own, np.arange(j - i + 1))
        yield from ((i + x, d[cut[x] : cut[x + 1]]) for x in range(j - i))


def _signed_sets(w: int):
    def run(batches):
        for b in batches:
            n, sets, bands = [], [], []
            for _, u in shingle_sets(b.column(1), w):
                n.append(len(u))
                sets.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                bands.append(signed(band_hashes(signature(u[:, 0]))) if len(u) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, bands)])
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            size = pa.array(np.diff(text_buffers(b.column(1))[1]), pa.int64())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), size, pa.array(sets, pa.binary()), lists], ["k", "id", "n", "size", "set", "bands"])

    return run


def _listed_sets(w: int):
    """(text, hub, k, component) to hub, k, component and the set: its shingles in hexadecimal, and half of each as a number."""

    def run(batches):
        for b in batches:
            sets = [u for _, u in shingle_sets(b.column(0), w)]
            yield pa.record_batch([*b.columns[1:], pa.array([[row.tobytes().hex() for row in u] for u in sets], pa.list_(pa.string())), pa.array([signed(u[:, 0].copy()) for u in sets], pa.list_(pa.int64()))], ["hub", "k", "component", "s", "x"])

    return run


def exact_sets(texts: list[bytes], w: int) -> list[np.ndarray]:
    """The sorted shingle sets of texts as whole numbers, equal where and only where the words are."""
    code: dict[bytes, int] = {}
    lists = [np.array([code.setdefault(x, len(code)) for x in t.translate(_LOWERED).split()], np.int64) for t in texts]
    short = [i for i, x in enumerate(lists) if len(x) < w]
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    grams = flat
    for j in range(1, w):  # each number stands for the words so far; one more is joined to it
        m = len(flat) - j
        if m <= 0:
            break
        grams = np.unique(grams[:m] * len(code) + flat[j:], return_inverse=True)[1]
    whole: dict[tuple, int] = {}
    out = []
    for i, x in enumerate(lists):
        out.append(np.unique(grams[at[i] : at[i + 1] - w + 1]) if len(x) >= w else None)
    for i in short:
        x = lists[i]
        out[i] = np.array([-1 - whole.setdefault(tuple(x.tolist()), len(whole))], np.int64) if len(x) else np.zeros(0, np.int64)
    return out


_LOWERED = bytes(LOWER)


class Sets:
    """The sets of a group's members, by row and by shingle, to count what any one shares with all others."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(u) for u in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        _, column = np.unique(flat, return_inverse=True)
        self.column = column.astype(np.int32)
        self.row = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[np.argsort(self.column, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.column))]).astype(np.int64)

    def shared(self, i: int) -> np.ndarray:
        """How many shingles each member shares with the i-th."""
        c = self.column[self.at[i] : self.at[i + 1]]
        lo, size = self.first[c], self.first[c + 1] - self.first[c]
        total = np.cumsum(size)
        both = np.zeros(len(self.size), np.int64)
        k = 0
        while k < len(c):  # a few shingles at once, so that what is gathered stays small
            m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + 500_000, "right")))
            own = size[k:m]
            run = np.arange(int(own.sum())) + np.repeat(lo[k:m] - (np.cumsum(own) - own), own)
            both += np.bincount(self.row[run], minlength=len(both))
            k = m
        return both

    def linked(self, i: int, percent: int) -> np.ndarray:
        both = self.shared(i)
        return (both > 0) & (100 * both >= percent * (self.size[i] + self.size - both))


class Groups:
    """Disjoint groups of 0 .. n - 1 as labels."""

    def __init__(self, labels: np.ndarray) -> None:
        self.label = labels.copy()

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Join i's group with the others'; returns one of the others for each group that is new to it."""
        labels, one = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.label[np.isin(self.label, labels[new])] = self.label[i]
        return others[one[new]]


def _by_group(batches, n_keys: int):
    """Batches in the order of their first columns to one table for each value of those."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in range(n_keys)), strict=True))
        keys = [tuple(x.values()) if isinstance(x, dict) else x for x in keys]
        begin = 0
        for r in range(len(keys)):
            if keys[r] != (keys[r - 1] if r else last):
                if r > begin or parts:
                    parts.append(b.slice(begin, r - begin))
                    yield pa.Table.from_batches(parts)
                parts, begin = [], r
        parts.append(b.slice(begin))
        last = keys[-1] if keys else last
    if parts:
        yield pa.Table.from_batches(parts)


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _chunk_links(w: int, percent: int):
    """Rows (hub, chunk, k, text) in the order of hub and chunk; yields links that join all of a chunk that links can join.

    The hub is first, then whoever is outside the component with most members
    that were not compared with all others.  When nobody is left, any two
    members are in one component or one of them was compared.
    """

    def run(batches):
        for table in _by_group(batches, 2):
            n = table.num_rows
            if n < 2:
                continue
            sets = Sets(exact_sets(_texts(table.column("text")), w))
            groups, left, right = Groups(np.arange(n)), [], []
            todo = np.ones(n, bool)
            i = 0
            while True:
                todo[i] = False
                found = groups.join(i, np.flatnonzero(sets.linked(i, percent)))
                left += [i] * len(found)
                right += found.tolist()
                open_ = np.bincount(groups.label[todo], minlength=n)
                rest = np.flatnonzero(todo & (groups.label != open_.argmax()))
                if not len(rest):
                    break
                i = rest[0]
            if left:
                keys = table.column("k").combine_chunks()
                yield pa.record_batch([keys.take(pa.array(left)), keys.take(pa.array(right))], ["a", "b"])

    return run


def _loose_links(w: int, percent: int):
    """Rows (hub, a, b, loose, k, component, text): members outside the largest piece (loose) against a chunk; yields links between components."""

    def run(batches):
        for table in _by_group(batches, 3):
            loose = table.column("loose").to_numpy()
            if not loose.any() or loose.all():
                continue
            sets = Sets(exact_sets(_texts(table.column("text")), w))
            codes: dict[str, int] = {}
            own = np.array([codes.setdefault(str(c), len(codes)) for c in table.column("component").to_pylist()])
            groups, left, right = Groups(own), [], []
            for i in np.flatnonzero(loose):
                found = groups.join(i, np.flatnonzero(sets.linked(i, percent) & ~loose))
                left += [i] * len(found)
                right += found.tolist()
            if left:
                keys = table.column("k").combine_chunks()
                yield pa.record_batch([keys.take(pa.array(left)), keys.take(pa.array(right))], ["a", "b"])

    return run


def _piece_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components of a group; sets: hub, k, component, and s and x, the shingles.

    Candidates share numbers x, which can only be too many; s decides.
    Shingles are taken from the rarest of the group on.  Two sets that are
    alike share at least percent of the larger one, so they share one of the
    first n - ceil(percent * n / 100) + 1 of each.
    """
    each = sets.select("hub", "k", "component", F.size("x").alias("n"), F.explode("x").alias("x"))
    often = each.groupBy("hub", "x").agg(F.count("*").alias("f"))
    own = each.join(often.hint("merge"), ["hub", "x"]).groupBy("hub", "k", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("own"))  # a document's own
    first = own.select("hub", "k", "component", "n", F.explode(F.expr(f"slice(own, 1, int(n - ceil({percent} * n / 100) + 1))")).alias("p"))
    a, b = (first.select("hub", F.col("p.x").alias("x"), *[F.col(c).alias(c + side) for c in ("k", "component", "n")]) for side in "ab")
    near = F.expr(f"ka < kb AND componenta <> componentb AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = a.join(b.hint("merge"), ["hub", "x"]).filter(near).select("ka", "kb").distinct()
    s = sets.select("k", "s").dropDuplicates(["k"])
    both = pairs.join(s.select(F.col("k").alias("ka"), F.col("s").alias("sa")).hint("merge"), "ka").join(s.select(F.col("k").alias("kb"), F.col("s").alias("sb")).hint("merge"), "kb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def near_duplicates(documents: DataFrame, w: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    Takes columns doc_id and text, whatever else there is; returns k, doc_id,
    n_shingles, component_id (the smallest doc_id reachable by links, its own
    included) and kept (whether that is itself).  Null, empty and blank texts
    have no shingles, link with nothing and are kept.  Rows that share a doc_id
    are told apart by their texts and reach the same component_id only by
    links; rows that share both get the same result.
    """
    docs = in_batches(keyed(documents))
    key = docs.schema["k"].dataType.simpleString()
    sets = saved(docs.select("k", "text", "id").mapInArrow(_signed_sets(w), f"k {key}, id bigint, n bigint, size bigint, set binary, bands array<bigint>"), "sets")
    classes = saved(sets.filter("n > 0").groupBy("set").agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "classes")

    # Joins with tables that grow with the input are merged at every size, so that the plan is the same at every size.
    # A set of n is at most n / (n + 1) like an unequal one.
    # What isn't its class's smallest goes; bands, which are most of the rows' bytes, stay where they are.
    copies = saved(sets.filter("n > 0").select("k", "set").join(classes.filter("copies > 1").hint("merge"), "set").filter("k <> rep").select("k").distinct(), "copies")
    banded = together(in_slices(sets.filter((F.col("n") > 0) & (F.lit(100) * F.col("n") >= percent * (F.col("n") + 1))).select("k", "bands"), copies, ["k"], "left_anti")).select("k", "bands")
    # Buckets are of one band, so bands may go one after the other, and disk holds the shuffles of a few.
    step = max(1, min(BANDS, BAND_ROWS // max(1, classes.count())))
    found = []
    for first in range(1, BANDS + 1, step):
        some = banded.select("k", F.explode(F.slice("bands", first, step)).alias("band"))
        shared = some.groupBy("band").agg(F.min("k").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
        found.append(saved(some.join(shared.hint("merge"), "band").filter("k <> hub").select("hub", "k").distinct(), "pairs"))
    pairs = found[0]
    if len(found) > 1:
        pairs = saved(together(found).distinct(), "pairs")
        removed(*found)

    sizes = sets.select("k", "n", "size")
    sizes = sizes if key == "bigint" else sizes.dropDuplicates(["k"])
    weighed = pairs.join(sizes.hint("merge"), "k").join(sizes.select(F.col("k").alias("hub"), F.col("n").alias("hub_n")).hint("merge"), "hub")
    # A group of two whose sizes forbid a link is none.
    stats = weighed.groupBy("hub").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.min("n").alias("n"), F.first("hub_n").alias("hub_n"))
    stats = stats.filter(F.expr(f"members > 1 OR 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"))
    chunks = F.greatest(F.ceil(F.col("members") / F.lit(CHUNK)), F.ceil(F.col("bytes") / F.lit(CHUNK_BYTES))).cast("int")
    groups = saved(pairs.join(stats.select("hub", chunks.alias("chunks")), "hub"), "groups")
    place = F.pmod(F.xxhash64("k"), "chunks").cast("int")
    members = groups.select("hub", place.alias("chunk"), "k")
    hubs = groups.select("hub", "chunks").distinct().select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("k"))
    rows = saved(members.unionByName(hubs).select("hub", "chunk", "k"), "members")
    texts = docs.select("k", "text")

    def dealt(rows, by, links):
        """Links of the groups of saved rows, slice by slice: whole groups, so that one slice at a time is broadcast and texts move once for each group."""
        parts = in_slices(texts, rows, ["k"], by=by)
        return together([saved(part.select(*rows.columns, "text").repartition(*by).sortWithinPartitions(*by, "k").mapInArrow(links(w, percent), f"a {key}, b {key}"), "links") for part in parts])

    links = dealt(rows, ["hub", "chunk"], _chunk_links)  # the hub is its group's smallest
    joined = components(links)

    # Members of one chunk are joined or compared.  Two of different chunks are still to be, unless they are in one component.
    split = groups.filter("chunks > 1")
    if not split.isEmpty():
        left = split.join(joined.withColumnRenamed("node", "k"), "k", "left").select("hub", "k", "chunks", place.alias("chunk"), F.coalesce("component", "k").alias("component"))
        pieces = left.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("loose"))
        left = saved(left.join(pieces.filter("loose > 0"), "hub"), "pieces")
        # Up to a chunk of members outside the largest piece meet the group's chunks, one by one.
        few = left.filter(F.col("loose") <= CHUNK)
        whole = few.select("hub", F.lit(0).alias("a"), F.col("chunk").alias("b"), F.lit(False).alias("loose"), "k", "component")
        loose = few.filter("component <> largest").select("hub", F.lit(0).alias("a"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("b"), F.lit(True).alias("loose"), "k", "component")
        rows_ = saved(whole.unionByName(loose).select("hub", "a", "b", "loose", "k", "component"), "loose")
        found = dealt(rows_, ["hub", "a", "b"], _loose_links)
        # More of them would meet in a square of chunks: they meet by their rarest shingles.
        many = left.filter(F.col("loose") > CHUNK).select("hub", "k", "component")
        listed_ = [saved(part.select("text", "hub", "k", "component").mapInArrow(_listed_sets(w), f"hub {key}, k {key}, component {key}, s array<string>, x array<bigint>"), "listed") for part in in_slices(texts, many, ["k"])]
        listed = together(listed_)
        if not listed.isEmpty():
            found = found.unionByName(saved(_piece_links(listed, percent), "links"))
        removed(left, rows_, *listed_)
        if not found.isEmpty():
            joined = components(links.unionByName(found))
    removed(pairs, groups, rows, copies)

    joined = joined.withColumnRenamed("node", "rep")
    group = classes.join(joined, "rep", "left").select("set", F.coalesce("component", "rep").alias("component"))
    lean = sets.select("k", "id", "n", "set")
    out = lean.join(group, "set", "left").select("k", "id", "n", F.coalesce("component", "k").alias("component"))
    cid = F.col("component.i") if key != "bigint" else F.col("component")
    cid = cid if key == "bigint" else F.when(F.col("component.real"), cid)
    return out.select("k", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), cid.alias("component_id"), (F.col("component") == F.col("k")).alias("kept"))
