"""Matching of labelled graphs: colour refinement, then exact search inside colour classes.

nodes: graph, node, label.  edges: graph, a, b, label, undirected, each once.
A graph is small (a molecule); there may be any number of them.  colours()
refines all in the same rounds of joins, and colours of different graphs are
comparable; a pair that is matched is refined where its graphs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut, removed

#: Matches of two graphs that are listed, and partial ones that are tried at most before a pair counts as undecided.
MOST, STEPS = 64, 1_000_000
#: Forms of pairs of graphs whose maps a task remembers.
FORMS = 20_000


def _both(edges: DataFrame) -> DataFrame:
    e = edges.select("graph", "a", "b", F.col("label").cast("string").alias("l"))
    return e.unionByName(e.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "l")).distinct()


def colours(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(graph, node, colour): the coarsest stable colouring; equal colours, in one graph or two, mean that no round tells two nodes apart.

    A round gives each node a digest of its colour and its neighbours' (an
    aggregate per node).  It ends when no graph has more colours than before;
    graphs that are done stay as they are, so that colours of graphs of the
    same form are made in the same number of rounds.
    """
    both = cut(_both(edges))
    text = lambda *c: F.md5(F.concat_ws("|", *c).cast("binary"))
    now = cut(nodes.select("graph", "node", text(F.coalesce(F.col("label").cast("string"), F.lit("?"))).alias("colour")).withColumn("open", F.lit(True)).withColumn("kinds", F.lit(0).cast("long")))
    for _ in range(rounds):
        kinds = now.groupBy("graph").agg(F.count_distinct("colour").alias("n"))
        now_ = now.join(kinds, "graph").select("graph", "node", "colour", (F.col("n") > F.col("kinds")).alias("open"), F.col("n").alias("kinds"))
        last, now = now, cut(now_)
        removed(last)
        if now.filter("open").isEmpty():
            removed(both)
            return now.select("graph", "node", "colour")
        near = both.join(now.filter("open").select("graph", F.col("node").alias("b"), "colour"), ["graph", "b"])
        around = near.groupBy("graph", F.col("a").alias("node")).agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", F.coalesce("l", F.lit("?")), "colour")))).alias("around"))  # a node's own neighbours
        new = now.join(around, ["graph", "node"], "left").withColumn("colour", F.when(F.col("open"), text("colour", F.coalesce("around", F.lit("")))).otherwise(F.col("colour"))).drop("around")
        last, now = now, cut(new)
        removed(last)
    raise RuntimeError(f"colours still change after {rounds} rounds")


def _search(one: list, near_one: list[dict], two: list, near_two: list[dict], most: int, steps: int) -> tuple[list[tuple[int, ...]], bool]:
    """Maps from places of two to places of one that keep colours and edges, in lexicographic order; and whether the search was cut short."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(one):
        places.setdefault(c, []).append(i)
    found: list[tuple[int, ...]] = []
    n, tried = len(two), 0
    at: list[int] = []
    used: set[int] = set()

    def fits(i: int) -> Iterator[int]:
        for x in places.get(two[i], ()):
            if x not in used and all(near_one[x].get(at[j]) == label for j, label in near_two[i].items() if j < i) and sum(j < i for j in near_two[i]) == sum(y in used for y in near_one[x]):
                yield x

    stack = [fits(0)] if n else []
    if not n:
        return [()], False
    while stack:
        tried += 1
        if tried > steps:
            return found, True
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if at:
                used.discard(at.pop())
            continue
        at.append(x)
        used.add(x)
        if len(at) == n:
            found.append(tuple(at))
            if len(found) == most:
                return found, False
            used.discard(at.pop())
        else:
            stack.append(fits(len(at)))
    return found, False


def _all_maps(one: list, near_one: list[dict], two: list, near_two: list[dict], most: int, steps: int) -> list[tuple[int, ...]] | None:
    """All maps as _search() lists them, if they are no more than most; else, or after so many steps, None.

    Places of two are taken from neighbour to neighbour, so a partial map that leads nowhere ends soon.
    """
    places: dict = {}
    for i, c in enumerate(one):
        places.setdefault(c, []).append(i)
    n, order, met = len(two), [], {}
    rare = lambda i: (len(places.get(two[i], ())), i)
    left = set(range(n))
    while left:
        beside = [i for i in left if any(j in met for j in near_two[i])]
        i = min(beside or left, key=rare)
        # Its neighbours that are placed before it.
        order.append((i, [(j, label) for j, label in near_two[i].items() if j in met]))
        met[i] = True
        left.discard(i)
    found: list[tuple[int, ...]] = []
    at: list[int] = [-1] * n
    used: set[int] = set()

    def fits(k: int) -> Iterator[int]:
        i, before = order[k]
        for x in near_one[at[before[0][0]]] if before else places.get(two[i], ()):
            if x not in used and one[x] == two[i] and all(near_one[x].get(at[j]) == label for j, label in before) and sum(y in used for y in near_one[x]) == len(before):
                yield x

    stack, tried = [fits(0)], 0
    while stack:
        tried += 1
        if tried > steps:
            return None
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if stack:
                i = order[len(stack) - 1][0]
                used.discard(at[i])
            continue
        i = order[len(stack) - 1][0]
        at[i] = x
        if len(stack) == n:
            found.append(tuple(at))
            if len(found) > most:
                return None
        else:
            used.add(x)
            stack.append(fits(len(stack)))
    return sorted(found)


def _graphs(nodes, edges) -> Iterator[tuple[list, tuple, tuple]]:
    """Of each row's graph: its nodes, their labels, and its edges between places as (place, place, label)."""
    flat = nodes.flatten()
    names, labels = flat.field("node").to_pylist(), flat.field("l").to_pylist()
    flat = edges.flatten()
    lines = list(zip(flat.field("a").to_pylist(), flat.field("b").to_pylist(), flat.field("l").to_pylist(), strict=True))
    at = to = 0
    for n, m in zip(nodes.value_lengths().fill_null(0).to_pylist(), edges.value_lengths().fill_null(0).to_pylist(), strict=True):
        own = names[at : at + n]
        place = {x: i for i, x in enumerate(own)}
        yield own, tuple(labels[at : at + n]), tuple((place[a], place[b], label) for a, b, label in lines[to : to + m])
        at, to = at + n, to + m


def _near(n: int, edges: tuple) -> list[dict]:
    near: list[dict] = [{} for _ in range(n)]
    for a, b, label in edges:
        near[a][b] = near[b][a] = label
    return near


def _refined(labels: list, near: list[dict]) -> list[int]:
    """The coarsest stable colours of nodes that begin with their labels."""
    kinds: dict = {}
    colour = [kinds.setdefault(x, len(kinds)) for x in labels]
    while True:
        last, kinds = len(kinds), {}
        colour = [kinds.setdefault((c, tuple(sorted((label, colour[j]) for j, label in x.items()))), len(kinds)) for c, x in zip(colour, near, strict=True)]
        if len(kinds) == last:
            return colour


def _maps(labels_one: tuple, edges_one: tuple, labels_two: tuple, edges_two: tuple, most: int, steps: int) -> tuple[str, list]:
    """The status and the maps of two graphs with as many nodes."""
    n = len(labels_one)
    one, two = _near(n, edges_one), _near(n, edges_two)
    # Both at once, so that equal colours mean the same in both.
    colour = _refined([*labels_one, *labels_two], [*one, *({j + n: label for j, label in x.items()} for x in two)])
    if sorted(colour[:n]) != sorted(colour[n:]):
        return "none", []
    found, short = _all_maps(colour[:n], one, colour[n:], two, most, steps), False
    if found is None:
        found, short = _search(colour[:n], one, colour[n:], two, most, steps)
    return "undecided" if short and not found else "matched" if found else "none", found


def matches(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """(ref, pose, status, n_matches, ambiguous, maps) for pairs (ref, pose) of graphs.

    maps: up to ``most`` arrays, in order; a map has, for each node of pose in
    their order, the node of ref that it is.  Nodes keep their label, edges
    theirs.  status: matched, none, sizes_differ, or undecided after ``steps``
    partial maps.  ambiguous: more than one map, so nodes are interchangeable.
    """
    import pyarrow as pa

    kind = nodes.schema["node"].dataType.simpleString()
    graph = pairs.schema["ref"].dataType.simpleString()
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("l")
    # A pair's two graphs in one place: each is small, so its colours are refined there and no round is a join.
    form = nodes.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("node", word("label")))).alias("nodes"))
    lines = edges.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("a", "b", word("label")))).alias("edges"))
    form = cut(form.join(lines, "graph", "left"))
    two = pairs.select("ref", "pose").distinct()
    for side in ("ref", "pose"):
        two = two.join(form.select(F.col("graph").alias(side), F.col("nodes").alias(f"{side}_nodes"), F.coalesce("edges", F.array()).alias(f"{side}_edges")), side, "left")

    def run(batches):
        seen: dict = {}
        for b in batches:
            out: list[tuple] = []
            for ref, pose, (names, *one), (_, *other) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _graphs(b.column(2), b.column(3)), _graphs(b.column(4), b.column(5)), strict=True):
                if len(one[0]) != len(other[0]) or not names:
                    out.append((ref, pose, "sizes_differ", 0, False, []))
                    continue
                # Graphs of the same form have the same maps of places; so many forms are remembered.
                key = (*one, *other)
                if key not in seen:
                    if len(seen) >= FORMS:
                        seen.clear()
                    seen[key] = _maps(*key, most, steps)
                status, found = seen[key]
                out.append((ref, pose, status, len(found), len(found) > 1, [[names[i] for i in m] for m in found]))
            if out:
                cols = list(zip(*out, strict=True))
                node = b.schema.field("ref_nodes").type.value_type.field("node").type
                yield pa.record_batch([pa.array(cols[0], b.schema.field("ref").type), pa.array(cols[1], b.schema.field("pose").type), pa.array(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4]), pa.array(cols[5], pa.list_(pa.list_(node)))], ["ref", "pose", "status", "n_matches", "ambiguous", "maps"])

    return two.select("ref", "pose", "ref_nodes", "ref_edges", "pose_nodes", "pose_edges").mapInArrow(run, f"ref {graph}, pose {graph}, status string, n_matches int, ambiguous boolean, maps array<array<{kind}>>")


def matches_or_skeleton(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, most: int = MOST) -> DataFrame:
    """matches(), and for pairs without one, matches of the graphs with all edges alike; skeleton tells which."""
    first = cut(matches(nodes, edges, pairs, most).withColumn("skeleton", F.lit(False)))
    rest = first.filter("status = 'none'").select("ref", "pose")
    again = matches(nodes, edges.withColumn("label", F.lit("-")), rest, most).withColumn("skeleton", F.lit(True))
    return first.filter("status <> 'none'").unionByName(again)


def automorphisms(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """(graph, n, maps): the maps of each graph to itself, the identity first."""
    own = nodes.select(F.col("graph").alias("ref"), F.col("graph").alias("pose")).distinct()
    return matches(nodes, edges, own, most).select(F.col("ref").alias("graph"), F.col("n_matches").alias("n"), "maps")


def explained_by_symmetry(rows: DataFrame, atoms: DataFrame, maps: DataFrame, floor: float = 0.01) -> DataFrame:
    """(graph, mean_error, n_auto, best_error, explained): whether stored distances agree with coordinates, as they are or with equivalent atoms exchanged.

    rows: graph, node, px, py, pz (a fixed point) and stored (its distance to
    the node).  atoms: graph, node, x, y, z.  maps: those of automorphisms().
    mean_error is that of the order as it is; best_error the least over all
    maps; explained, if the first is above the floor and the second isn't.
    """
    order = maps.select("graph", "n", F.posexplode("maps").alias("m", "map"))
    places = atoms.groupBy("graph").agg(F.sort_array(F.collect_list("node")).alias("own"))  # a graph's own
    moved = order.join(places, "graph").select("graph", "n", "m", F.explode(F.arrays_zip("own", "map")).alias("p")).select("graph", "n", "m", F.col("p.own").alias("node"), F.col("p.map").alias("at"))
    where = moved.join(atoms.select("graph", F.col("node").alias("at"), "x", "y", "z"), ["graph", "at"])
    gap = F.sqrt(sum(((F.col(v) - F.col(f"p{v}")) ** 2 for v in "yz"), (F.col("x") - F.col("px")) ** 2))
    error = rows.join(where, ["graph", "node"]).groupBy("graph", "n", "m").agg(F.avg(F.abs(gap - F.col("stored"))).alias("e"))
    out = error.groupBy("graph", F.col("n").alias("n_auto")).agg(F.max(F.when(F.col("m") == 0, F.col("e"))).alias("mean_error"), F.min("e").alias("best_error"))
    high: Column = F.col("mean_error") > floor
    return out.select("graph", "mean_error", "n_auto", "best_error", (high & (F.col("n_auto") > 1) & (F.col("best_error") <= floor)).alias("explained"))
