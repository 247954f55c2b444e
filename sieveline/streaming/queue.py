"""A work queue on a stream: the state of each job, back-off and retry limits kept by timers (the batch forms are in operators.worklog)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.worklog import RETRY

SCHEMA = "job string, kind string, status string, attempts long, at timestamp, due timestamp"


def queue(stream: DataFrame, key: str, time: str, tie: str, late: str = "5 minutes", first: int = 60, factor: float = 2.0, longest: int = 3600, most: int = 3, states: tuple[str, ...] = RETRY) -> DataFrame:
    """Rows (job, kind, status, attempts, at, due) as jobs' events (key, time, tie, status) come in.

    kind is ``state`` for a job that had events: its last status by (time, tie)
    and how many events it had; for one to be tried again, due is when: first
    seconds after its first event, factor times as long after each further
    one, longest at most.  It is ``due`` once the watermark has passed that
    time and no other event came; and ``given_up`` once a job has failed
    ``most`` times.  A replayed log ends in the states of worklog.latest(), and
    what is due in those of worklog.due() at the watermark.
    """
    import pandas as pd

    def wait(attempts: int) -> int:
        return int(min(float(longest), float(first) * float(factor) ** (attempts - 1)) * 1_000_000)

    def stamp(us: int | None):
        return pd.NaT if us is None else pd.Timestamp(us, unit="us")

    def run(job, parts, state) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            status, attempts, at, _ = state.get
            out.append((job[0], "due", status, attempts, stamp(at), stamp(at + wait(attempts))))
        else:
            status, attempts, at, last = state.get if state.exists else (None, 0, None, None)
            for part in parts:
                attempts += len(part)
                for t, n, s in zip(part["at"].tolist(), part["tie"].tolist(), part["status"].tolist(), strict=True):
                    if at is None or (t, n) > (at, last):
                        at, last, status = t, n, s
            state.update((status, attempts, at, last))
            again = status in states and attempts < most
            due = at + wait(attempts) if again else None
            out.append((job[0], "state", status, attempts, stamp(at), stamp(due)))
            if status in states and not again:
                out.append((job[0], "given_up", status, attempts, stamp(at), pd.NaT))
            if again:
                if due // 1000 > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(due // 1000)
                else:
                    out.append((job[0], "due", status, attempts, stamp(at), stamp(due)))
        frame = pd.DataFrame(out, columns=["job", "kind", "status", "attempts", "at", "due"])
        yield frame.astype({"at": "datetime64[us]", "due": "datetime64[us]"})

    rows = stream.select(F.col(key).cast("string").alias("job"), F.col(time).cast("timestamp").alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), "status")
    return rows.withWatermark("time", late).groupBy("job").applyInPandasWithState(run, SCHEMA, "status string, attempts long, at long, tie long", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(stream: DataFrame, path: str, **settings) -> DataFrame:
    """All rows that queue() gives for what a stream has so far, written under the path; a run that was cut short goes on from its checkpoint."""
    q = queue(stream, **settings).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(SCHEMA).parquet(f"{path}/rows")
