"""Rounds of joins: components and leader clustering without gathering a neighbourhood."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    One is chosen only for a master of one machine that names none, as in tests.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return _scratch[-1] if _scratch else folder.rstrip("/")


#: Folders of the scratch() blocks that are open, the innermost last.
_scratch: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything cut() writes inside the block is deleted at its end; results that are still needed are written elsewhere before."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        _delete(spark, folder)


#: With it, what a command has shuffled is deleted when the command ends, not when the JVM comes to collect it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the commands inside the block are deleted as each ends, so disk holds those of one command and not of all before it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, what: str = "round", **options: str) -> DataFrame:
    """End the lineage of the rows: they are written to a fresh folder in the shared one, with options of the writer, and read again.

    A lost executor then costs no more than its running tasks, and the disk of
    their shuffles is free again.  removed() takes the folder away.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path  # type: ignore[attr-defined]
    return out


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many tasks as the cluster runs at once, if a small source comes in fewer; a larger one stays as it is read.

    It is meant for sources: to count the partitions of shuffled rows, Spark runs their shuffle.
    """
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


#: Rows that a task of a shuffle by keys gets, so that what it sorts or groups stays bounded however large the table is.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many partitions a shuffle of so many rows is cut to: those that the session names, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def removed(*tables: DataFrame) -> None:
    """Delete the folders of tables that cut() wrote, whatever store holds them; nothing may still read them."""
    for df in tables:
        _delete(df.sparkSession, df.cut_path)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for all nodes that have an edge.

    Rounds of two steps (Kiveris et al., 2014): every node hands its larger
    neighbours to the least of its neighbourhood, then every node hands its
    smaller neighbours, and itself, to the least of them.  Both are a minimum
    per node and a join, so no neighbourhood is gathered.  It ends when every
    node hangs from one node that hangs from none.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")
        if loose.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        last, e = e, cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        removed(last)
    raise RuntimeError(f"edges still move after {rounds} rounds")


def leader_clusters(nodes: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """Leader (Butina) clusters of nodes (node: bigint) over pairs (i, j) of neighbours.

    Nodes are visited by falling degree, then falling node; one that is free
    leads and takes its free neighbours.  A node leads exactly if no neighbour
    visited earlier leads, so whole layers are decided at once: each round, the
    undecided without an undecided earlier neighbour lead and their neighbours
    follow.  A follower belongs to the earliest leader beside it.  Returns
    node, leader, cluster (leaders counted from 0 in the order of visits).
    """
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).filter("i <> j").distinct()
    degree = both.groupBy("i").agg(F.count("*").alias("degree")).withColumnRenamed("i", "node")
    order = nodes.select("node").join(degree, "node", "left").select("node", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), (-F.col("node")).alias("n")).alias("turn"))
    return clusters_in_order(order, both, rounds)


def clusters_in_order(order: DataFrame, both: DataFrame, rounds: int = 200) -> DataFrame:
    """leader_clusters of nodes visited in any order: (node, turn), turn a struct that orders them without ties; both: (i, j) in both directions."""
    order = cut(order)
    edges = cut(both.join(order.withColumnRenamed("node", "i").withColumnRenamed("turn", "ti"), "i").join(order.withColumnRenamed("node", "j").withColumnRenamed("turn", "tj"), "j"))
    open_, rest, leaders = order, edges, None
    for _ in range(rounds):
        # Only edges between undecided nodes are left, so rounds get cheaper as nodes are decided.
        lead = cut(open_.join(rest.filter(F.col("tj") < F.col("ti")).select(F.col("i").alias("node")), "node", "left_anti"))
        leaders = lead if leaders is None else leaders.unionByName(lead)
        follow = rest.join(lead.select(F.col("node").alias("j")), "j", "left_semi").select(F.col("i").alias("node"))
        open_ = cut(open_.join(lead.select("node"), "node", "left_anti").join(follow, "node", "left_anti"))
        if open_.isEmpty():
            break
        own = open_.select("node")
        rest = cut(rest.join(own.withColumnRenamed("node", "i"), "i", "left_semi").join(own.withColumnRenamed("node", "j"), "j", "left_semi"))
    else:
        raise RuntimeError(f"nodes are undecided after {rounds} rounds")
    near = edges.join(leaders.select(F.col("node").alias("j")), "j", "left_semi").groupBy("i").agg(F.min(F.struct("tj", "j")).alias("m")).select(F.col("i").alias("node"), F.col("m.j").alias("beside"))
    led = leaders.select("node", F.lit(True).alias("leads"))
    out = order.join(led, "node", "left").join(near, "node", "left").select("node", F.when(F.col("leads"), F.col("node")).otherwise(F.col("beside")).alias("leader"))
    # Ids follow the order of visits.
    from .ranking import ranked

    ids = ranked(leaders, [F.col(f"turn.{f.name}") for f in order.schema["turn"].dataType.fields], "cluster").select(F.col("node").alias("leader"), (F.col("cluster") - 1).alias("cluster"))
    return out.join(ids, "leader").select("node", "leader", "cluster")
