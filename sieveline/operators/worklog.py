"""A work log as a table: latest status per job, what to try again, and circuit breakers over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRY = ("error", "timeout")


def latest(log: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Each job's last event and the number of its events."""
    return log.groupBy(key).agg(F.max_by("status", F.struct(time, tie)).alias("status"), F.max(time).alias("at"), F.count("*").alias("attempts"))


def to_retry(latest_: DataFrame, most: int, states: tuple[str, ...] = RETRY) -> DataFrame:
    return latest_.filter(F.col("status").isin(*states) & (F.col("attempts") < most))


def not_done(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return jobs.join(done.select(key), key, "left_anti")


def breaker(log: DataFrame, key: str, time: str, bad: str, seconds: int, most: int) -> DataFrame:
    """Bad events with how many there were in the window before them, and whether that trips the breaker."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    rows = log.filter(F.col("status") == bad).withColumn("recent", F.count("*").over(w))
    return rows.withColumn("tripped", F.col("recent") >= most)


def budget(log: DataFrame, key: str, time: str, tie: str, cost: str, most: float) -> DataFrame:
    """The first event of each key at which its running cost exceeds the budget."""
    w = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("spent", F.round(F.sum(cost).over(w), 6)).filter(F.col("spent") > most)
    return rows.groupBy(key).agg(F.min_by(tie, F.struct(time, tie)).alias(tie), F.min("spent").alias("spent"))


def messages(log: DataFrame, text: str) -> DataFrame:
    """Seconds and reason of log lines such as "Sleeping for 30s. Reason: queue"."""
    pattern = r"Sleeping for (\d+)s\. Reason: (\w+)"
    hit = log.filter(F.col(text).rlike(pattern))
    return hit.groupBy(F.regexp_extract(text, pattern, 2).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.regexp_extract(text, pattern, 1).cast("bigint")).alias("seconds"))


def due(latest_: DataFrame, now: str, first: int = 60, factor: float = 2.0, longest: int = 3600, most: int = 3, states: tuple[str, ...] = RETRY) -> DataFrame:
    """Jobs to try again now, with how long each had to wait: ``first`` seconds after the first attempt, and ``factor`` times as long after each further one, up to ``longest``."""
    wait = F.least(F.lit(float(longest)), F.lit(float(first)) * F.pow(F.lit(float(factor)), F.col("attempts") - 1))
    rows = to_retry(latest_, most, states).withColumn("wait", wait)
    return rows.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) >= F.col("wait") * 1_000_000)


def reasons(log: DataFrame, reason: str) -> DataFrame:
    """(reason, n, share): how often each reason stands in the log, nulls left out."""
    rows = log.filter(F.col(reason).isNotNull())
    total = rows.agg(F.count("*").alias("_total"))
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("_total")).alias("share"))  # one row


def wall_times(log: DataFrame, key: str, time: str) -> DataFrame:
    """Jobs, and the mean, median and longest seconds between a job's first and last event."""
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    per = log.groupBy(key).agg((F.max(t) - F.min(t)).alias("s"))
    return per.agg(F.count("*").alias("jobs"), F.avg("s").alias("mean"), F.percentile("s", 0.5).alias("median"), F.max("s").alias("longest"))
