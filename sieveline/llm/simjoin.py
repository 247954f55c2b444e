"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors at a cosine of at least c lie within a squared distance of
2 - 2c.  After a random rotation, which spreads a vector evenly, the
coordinates are split into ``BLOCKS`` blocks; in at least one of them the
squared distance is at most the block's share of the budget, in proportion to
its dimensions.  So all pairs that are near in some block are candidates, and
none is missed.

A block's range join: cells of a grid over its first ``GRID`` coordinates, as
wide as twice the radius.  A vector is at home in one cell and a guest of those
greater neighbours that its ball reaches, so each pair meets in one cell.  A
cell that many vectors share is split into chunks that meet two by two; no
task holds more than two chunks.  The more vectors there are, the more of a
block's coordinates the grid takes, so that cells stay small.  Within a task, a
chunk is split again and again on the block's other coordinates until few pairs
are left to a part, and only those are compared.  Candidates are verified
exactly, in double precision on the whole vectors.

A pair may be near in several blocks.  It belongs to the first of them, which
each task can tell from the two vectors alone (rotated coordinates are rounded
to whole numbers, and all block distances are computed in whole numbers, so
every task decides alike).  So no pair needs to leave its task: vectors get
sums of their links, and components get one edge a vector.

Equal vectors are one class, whose smallest id stands for it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LEAST_ID, components, saved

BLOCKS = 8
#: Coordinates of the grid: three for up to so many vectors, and one more each time there are STEEP times as many.
GRID, GRID_ROWS, STEEP = 3, 250_000, 2
#: Vectors of a cell that one task takes; two chunks of about this size meet.
CHUNK = 16_384
#: Rotated coordinates are whole multiples of this.
STEP = 2.0**-14
#: Pairs verified at once, and pairs of a part that isn't split again.
PAIRS, LEAF = 100_000, 20_000


@functools.cache
def plan(dim: int, cosine: float) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, blocks, and for each block its budget, radius and cell width, in whole steps."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    rotation = q * np.sign(np.diag(r))
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)
    blocks = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    share = np.diff(edges) / dim
    # Rounding moves a coordinate by little over half a step, on both sides; the rest is for the factors' rounding.
    reach = np.sqrt(share * (2 - 2 * cosine)) / STEP + 1.2 * np.sqrt(np.diff(edges)) + 1
    radius = np.ceil(reach).astype(np.int64)
    return rotation, blocks, radius**2, radius, 2 * radius


def rotated(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in whole steps, the same for a vector in any batch.

    Both factors are rounded to whole multiples of 2**-20, so every product and
    sum is a whole number below 2**53 and exact in whatever order it is formed.
    """
    norm = np.zeros(len(x))
    for j in range(x.shape[1]):
        norm += x[:, j] * x[:, j]
    unit = np.rint(x / np.sqrt(norm)[:, None] * 2.0**20)
    return np.rint(unit @ np.rint(rotation * 2.0**20) * (2.0**-40 / STEP)).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _classes(batches):
    """(id, v) to (id, h, v): a hash of the vector's bits, null where it can't be compared."""
    import hashlib

    for b in batches:
        values, hashes, out = b.column(1).to_pylist(), [], []
        for v in values:
            x = None
            if v is not None and len(v) and all(c is not None for c in v):
                a = np.array(v, np.float64)
                if np.isfinite(a).all() and a.any():
                    x = a + 0.0  # -0 is 0
            hashes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if x is not None else None)
            if x is not None and not 1e-100 < (most := np.abs(x).max()) < 1e100:
                x = np.ldexp(x, -int(np.frexp(most)[1]))  # the same direction, with squares that neither overflow nor vanish
            out.append(x)
        yield pa.record_batch([b.column(0), pa.array(hashes, pa.binary()), pa.array(out, b.column(1).type)], ["id", "h", "v"])


def _parts(c: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """The cells of numbers c, in order, and which of them are in each."""
    cell = np.floor_divide(c, width)
    order = np.argsort(cell, kind="stable")
    values, first = np.unique(cell[order], return_index=True)
    return list(zip(values.astype(int).tolist(), np.split(order, first[1:]), strict=True))


def within(own: np.ndarray, left: np.ndarray, right: np.ndarray | None, at: int, width: int, radius: int, budget: int):
    """Pairs of rows of own (whole numbers) at a squared distance of at most budget, each once.

    One of left and one of right, which have no row in common; or, if right is
    None, two of left.  Coordinates from ``at`` on split what is too much.
    """
    size = len(left) * len(right) if right is not None else len(left) ** 2 // 2
    if size <= LEAF or at >= own.shape[1]:
        step = max(1, 4 * PAIRS // max(1, len(left if right is None else right)))
        for t in range(0, len(left), step):
            p = left[t : t + step]
            r = left[t:] if right is None else right
            d = own[p] @ own[r].T
            d *= -2
            d += (own[r] ** 2).sum(axis=1)
            d += (own[p] ** 2).sum(axis=1)[:, None]
            x, y = np.nonzero(d <= budget)
            if right is None:
                x, y = x[x < y], y[x < y]
            yield p[x], r[y]
        return
    c = own[left, at]
    if right is None:
        last: tuple[int, np.ndarray] | None = None
        for cell, rows in _parts(c, width):
            part = left[rows]
            yield from within(own, part, None, at + 1, width, radius, budget)
            if last and last[0] == cell - 1:  # a pair of two cells meets in the greater one; cells further apart hold none
                near, close = part[c[rows] <= cell * width + radius], last[1][own[last[1], at] >= cell * width - radius]
                if len(near) and len(close):
                    yield from within(own, near, close, at + 1, width, radius, budget)
            last = cell, part
    else:
        d = own[right, at]
        for cell, rows in _parts(c, width):
            close = right[(d >= cell * width - radius) & (d < (cell + 1) * width + radius)]
            if len(close):
                yield from within(own, left[rows], close, at + 1, width, radius, budget)


def _deal(cosine: float, whole: bool, grid: int):
    """(k, n, v) to a row for each block and cell a vector is in: home is 1 where it lives. Without k, n and v unless whole."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column(2)], np.int64)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                own = b.take(pa.array(rows))
                rotation, blocks, _, radius, width = plan(dim, cosine)
                q = rotated(_matrix(own.column(2), dim), rotation)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for j, block in enumerate(blocks):
                    base = 2 * (int(1.01 / STEP) // int(width[j]) + 3)  # cells of a coordinate, neighbours included
                    g = min(grid, block.stop - block.start, int(62 / np.log2(base)))
                    cell, rest = np.divmod(q[:, block][:, :g], width[j])
                    for code in range(3**g):
                        step = np.array([code // 3**i % 3 - 1 for i in range(g)])
                        lead = step[np.flatnonzero(step)[:1]]
                        if len(lead) and lead[0] < 0:
                            continue  # the pair meets in the greater cell
                        far = np.where(step == 1, width[j] - rest, np.where(step == -1, rest + 1, 0))
                        at = np.flatnonzero((far.astype(np.int64) ** 2).sum(axis=1) <= radius[j] ** 2)
                        if len(at):
                            to = cell[at] + step
                            code_ = np.zeros(len(at), np.int64)
                            for i in range(g):
                                code_ = code_ * base + (to[:, i] + base // 2)
                            out[0].append(at)
                            out[1].append(np.full(len(at), dim * 64 + j, np.int64))
                            out[2].append(code_)
                            out[3].append(np.full(len(at), int(not len(lead)), np.int8))
                at, block_, cell_, home = (np.concatenate(o) for o in out)
                for x in range(0, len(at), 20_000):
                    y = slice(x, x + 20_000)
                    front = own.take(pa.array(at[y])).columns if whole else []
                    yield pa.record_batch([*front, pa.array(block_[y]), pa.array(cell_[y]), pa.array(home[y])], ["k", "n", "v"][: 3 * whole] + ["block", "cell", "home"])

    return run


def _meet(cosine: float, grid: int):
    """The vectors of two chunks of a cell (or one) to (k, links, root)."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        dim, j = divmod(block, 64)
        rotation, blocks, budget, radius, width = plan(dim, cosine)
        x = _matrix(table.column("v"), dim)
        q = rotated(x, rotation).astype(np.float64)  # whole numbers below 2**53: exact in any order
        home, size = table.column("home").to_numpy() == 1, table.column("n").to_numpy()
        chunk = table.column("chunk").to_numpy()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        links = np.zeros(len(x), np.int64)
        parent = np.arange(len(x))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        own = q[:, blocks[j]]
        mine, other = chunk == a, chunk == b
        one, two, near_by = np.flatnonzero(mine & home), np.flatnonzero(other & home), np.flatnonzero(mine & ~home)
        split = (min(grid, own.shape[1]), int(width[j]), int(radius[j]), int(budget[j]))

        def near():
            """Pairs of one at home and any other, near in this block."""
            if a == b:
                yield from within(own, one, None, *split)
                yield from within(own, one, near_by, *split)
            else:
                yield from within(own, one, np.flatnonzero(other), *split)
                yield from within(own, two, near_by, *split)

        for p, r in near():
            for s in range(0, len(p), PAIRS):
                u, v = p[s : s + PAIRS], r[s : s + PAIRS]
                ok = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
                u, v = u[ok], v[ok]
                first = np.ones(len(u), bool)
                for i in range(j):  # near in an earlier block: it is counted there
                    d = q[u][:, blocks[i]] - q[v][:, blocks[i]]
                    first &= (d * d).sum(axis=1) > budget[i]
                u, v = u[first], v[first]
                np.add.at(links, u, size[v])
                np.add.at(links, v, size[u])
                for m, n in zip(u.tolist(), v.tolist(), strict=True):
                    m, n = find(m), find(n)
                    if m != n:
                        parent[max(m, n)] = min(m, n)
        at = np.flatnonzero(links)
        roots = np.array([find(i) for i in at.tolist()], np.int64)
        keys = table.column("k").combine_chunks()
        return pa.table({"k": keys.take(pa.array(at, pa.int64())), "links": pa.array(links[at]), "root": keys.take(pa.array(roots, pa.int64()))})

    return run


def similar_vectors(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Link all vectors at a cosine of at least ``cosine``, and group what links reach.

    Takes columns vec_id and embedding, whatever else there is; returns, for
    each row, vec_id, n_links (other vectors linked directly), component_id
    (the smallest vec_id reachable, its own included) and kept.  Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing and are kept; so do vectors of different lengths with each other.
    Rows that repeat a vec_id and a vector count as vectors of their own.
    """
    spark = embeddings.sparkSession
    floats = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    of = "array<float>" if floats else "array<double>"
    raw = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast(of).alias("v"))
    rows = raw.mapInArrow(_classes, f"id bigint, h binary, v {of}")
    odd = raw.groupBy("id").count().filter((F.col("count") > 1) | F.col("id").isNull())
    simple = odd.isEmpty()
    key = F.col("id") if simple else F.struct(F.coalesce("id", F.lit(LEAST_ID)).alias("i"), F.col("id").isNotNull().alias("real"), F.xxhash64("h").alias("x"))
    rows = saved(rows.select(key.alias("k"), "id", "h", "v"), "vectors")
    kind = rows.schema["k"].dataType.simpleString()
    # The classes' vectors come from their smallest member's row, so no vectors are combined.
    classes = rows.filter("h IS NOT NULL").groupBy("h").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    classes = saved(classes, "vector-classes")
    single = rows.select("k", "h", "v").join(classes.withColumnRenamed("n", "size"), ["k", "h"]).dropDuplicates(["k", "h"]).select("k", F.col("size").alias("n"), "v")

    single = saved(single, "single-vectors")
    grid = GRID + max(0, int(np.ceil(np.log2(max(1, single.count()) / GRID_ROWS) / np.log2(STEEP))))
    dealt = single.mapInArrow(_deal(cosine, True, grid), f"k {kind}, n bigint, v {of}, block bigint, cell bigint, home tinyint")
    counted = single.mapInArrow(_deal(cosine, False, grid), "block bigint, cell bigint, home tinyint")
    # Cells are bounded by the grid: their number depends on the width, not on the rows.
    cells = counted.groupBy("block", "cell").agg(F.count("*").alias("rows"), F.sum("home").alias("homes")).filter("homes > 0").select("block", "cell", F.ceil(F.col("rows") / F.lit(CHUNK)).cast("int").alias("chunks"))
    parts = F.expr("transform(sequence(0, chunks - 1), c -> struct(least(c, chunk) AS a, greatest(c, chunk) AS b))")
    met = dealt.join(cells, ["block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("k"), "chunks").cast("int")).withColumn("part", F.explode(parts))
    met = met.select("block", "cell", F.col("part.a").alias("a"), F.col("part.b").alias("b"), "chunk", "k", "n", "v", "home")
    found = saved(met.groupBy("block", "cell", "a", "b").applyInArrow(_meet(cosine, grid), f"k {kind}, links bigint, root {kind}"), "linked")

    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("k").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "k")
    group = classes.join(links, "k", "left").join(joined, "k", "left").select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "k").alias("component"))
    out = rows.select("k", "id", "h").join(group, "h", "left")
    component = F.coalesce("component", "k")
    cid = component if simple else F.when(component["real"], component["i"])
    kept = component == F.col("k") if simple else component["i"] == F.col("k")["i"]
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"), kept.alias("kept"))
