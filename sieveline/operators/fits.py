"""Many logistic regressions at once: one Newton iteration over aggregates, grouped.

A row of a group belongs to one fold and trains the models of all others.  In
an iteration every task adds up, for each model it has rows of, the loss, the
gradient and the curvature; a model's sums meet in one place, which solves for
its step.  So an iteration is one job however many models there are, and what
is shuffled depends on their number and dimension, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: Numbers of coefficients that are sent to all tasks at once; more models are fitted in turns.
COEFFICIENTS = 2_000_000


def _sums(group: str, folds: int, weights: dict, dim: int):
    """Rows (group, fold, y, v), sorted by group: for each model (group, left-out fold) the loss, gradient and curvature of this task's rows."""
    d = dim + 1

    def flush(own, x, y, fold) -> Iterator[tuple]:
        w = weights.get(own)
        if w is None:
            return
        for f in range(folds):
            keep = fold != f
            if not keep.any() or w[f] is None:
                continue
            xs, ys = x[keep], y[keep]
            z = xs @ w[f]
            p = 1 / (1 + np.exp(-z))
            loss = float((np.logaddexp(0, z) - ys * z).sum())
            yield own, f, len(ys), int(ys.sum()), np.concatenate([[loss], xs.T @ (p - ys), ((xs * (p * (1 - p))[:, None]).T @ xs).ravel()])

    def run(batches):
        own, kind, parts, out = None, None, [], []
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.ones((n, d))
            x[:, :dim] = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            y, fold = (b.column(c).to_numpy() for c in (2, 1))
            groups, kind = b.column(0).to_pylist(), b.column(0).type
            edges = [0, *(i for i in range(1, n) if groups[i] != groups[i - 1]), n]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if groups[i] != own and parts:
                    out += flush(own, *(np.concatenate(c) for c in zip(*parts, strict=True)))
                    parts = []
                own = groups[i]
                parts.append((x[i:j], y[i:j], fold[i:j]))
                if sum(len(q[0]) for q in parts) > 4096:  # a large group is added up bit by bit
                    out += flush(own, *(np.concatenate(c) for c in zip(*parts, strict=True)))
                    parts = []
            if len(out) > 64:
                yield _batch(out, group, kind)
                out = []
        if parts:
            out += flush(own, *(np.concatenate(c) for c in zip(*parts, strict=True)))
        if out:
            yield _batch(out, group, kind)

    return run


def _batch(out: list[tuple], group: str, kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4].tobytes() for r in out], pa.binary())], [group, "fold", "n", "n1", "sums"])


def _step(group: str, weights: dict, best: dict, penalty: float, dim: int):
    """One model's sums to its next coefficients: a Newton step, or half the way back if the last one made the loss larger."""
    d = dim + 1
    ridge = np.append(np.full(dim, penalty), 0.0)  # the intercept is free

    def solve(table: pa.Table) -> pa.Table:
        own, f = table.column(group)[0].as_py(), table.column("fold")[0].as_py()
        total = np.sum([np.frombuffer(s.as_py(), float) for s in table.column("sums")], axis=0)
        n, n1 = (sum(table.column(c).to_pylist()) for c in ("n", "n1"))
        w = weights[own][f]
        loss = float(total[0] + 0.5 * (ridge * w * w).sum())
        known = best.get((own, f))
        if n1 in (0, n):
            new, kept, least, moved = None, None, None, 0.0
        elif known is not None and loss > known[1] * (1 + 1e-12) + 1e-12:
            new, kept, least = (w + known[0]) / 2, known[0], known[1]
            moved = float(np.abs(new - known[0]).max())
        else:
            h = total[1 + d :].reshape(d, d) + np.diag(ridge)
            step = np.linalg.lstsq(h, total[1 : 1 + d] + ridge * w, rcond=None)[0]
            new, kept, least = w - step, w, loss
            moved = float(np.abs(step).max() / (1 + np.abs(w).max()))
        lists = lambda v: pa.array([v], pa.list_(pa.float64()))
        return pa.table([table.column(group).slice(0, 1), pa.array([f], pa.int32()), lists(new), lists(kept), pa.array([least], pa.float64()), pa.array([moved])], [group, "fold", "w", "kept", "loss", "moved"])

    return solve


def grouped_logistic(rows: DataFrame, group: str, label: str, vector: str, fold: str, folds: int, penalty: float = 1.0, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """(group, fold, w): for each group and fold, the logistic regression of label (0 or 1) on vector over the group's rows of all other folds.

    w are the coefficients, the intercept last.  Minimised are the summed loss
    and penalty / 2 times the squared coefficients, the intercept apart.  A
    model whose rows have one label only has a null w.  All vectors have the
    same length.  ``folds`` = 1 with fold -1 on all rows fits all of them.
    """
    spark = rows.sparkSession
    table = cut(rows.select(F.col(group), F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.transform(vector, lambda v: v.cast("double")).alias("v")).repartitionByRange(F.col(group), F.rand(7)).sortWithinPartitions(group))
    dim = table.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    kind = rows.schema[group].dataType.simpleString()
    groups = [r[0] for r in table.select(group).distinct().orderBy(group).collect()]  # settings, such as tags of a sweep
    turn = max(1, COEFFICIENTS // ((dim + 1) * folds))
    done: list[tuple] = []
    for at in range(0, len(groups), turn):
        mine = set(groups[at : at + turn])
        weights: dict = {g: [np.zeros(dim + 1) for _ in range(folds)] for g in mine}
        final: dict = {}
        best: dict = {}
        part = table if len(mine) == len(groups) else table.filter(F.col(group).isin(list(mine)))
        for _ in range(rounds):
            sums = part.mapInArrow(_sums(group, folds, weights, dim), f"`{group}` {kind}, fold int, n long, n1 long, sums binary")
            got = sums.groupBy(group, "fold").applyInArrow(_step(group, weights, best, penalty, dim), f"`{group}` {kind}, fold int, w array<double>, kept array<double>, loss double, moved double").collect()
            for r in got:
                g, f = r[group], r["fold"]
                if r["w"] is None or r["moved"] <= tolerance:
                    final[g, f] = r["w"]
                    weights[g][f] = None
                else:
                    weights[g][f] = np.array(r["w"])
                    best[g, f] = (np.array(r["kept"]), r["loss"])
            weights = {g: w for g, w in weights.items() if any(x is not None for x in w)}
            if not weights or not got:
                break
        else:
            raise RuntimeError(f"{len(weights)} groups have models that still move after {rounds} rounds")
        done += [(g, f, None if w is None else [float(x) for x in w]) for (g, f), w in final.items()]
    return spark.createDataFrame(done, f"`{group}` {kind}, fold int, w array<double>")
