"""Gradient boosting for a 0/1 label: trees with early stopping and drop-out, and a linear booster.

Each round is one tree (``trees.grown``) on the gradients of the log loss. What the trees so far say of a row is kept beside it (``outs``, a
number for each tree) and written anew every ``CHUNK`` rounds, so a round evaluates only the trees since. The pass that starts a
round also sums the losses of the rounds before, so early stopping costs no pass of its own.

Rows with ``valid`` aren't trained on; the round whose mean log loss on them is least is the best one, and the model is cut back to it.
With drop-out (dart) each round leaves out trees drawn by the seed, and scales the new and the left-out ones so that their sum
stays; the weights of every round are kept, so that any round can be scored as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.operators import metrics, trees
from glint.operators.trees import Binned, Growth, Tree
from glint.sources import written

CHUNK = 10


def leaf_values(tree: Tree, penalty: float) -> np.ndarray:
    return -tree.sums[:, 0] / (tree.sums[:, 1] + penalty)


def log_loss(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, margin) - y * margin


@dataclass(frozen=True)
class Boosted:
    """Trees, the weight of each as of every round (row r: after r trees), the start and the penalty; ``best`` is the number of trees used."""

    trees: list[Tree]
    weights: np.ndarray
    start: float
    penalty: float
    best: int
    losses: list[tuple[float, float]]  # mean log loss of training and validation rows after 0, 1, .. trees
    data: Binned = field(repr=False)

    @property
    def used(self) -> list[Tree]:
        return self.trees[: self.best]

    def outs(self, bins: np.ndarray) -> np.ndarray:
        return np.stack([leaf_values(t, self.penalty)[t.leaves(bins)] for t in self.trees], axis=1) if self.trees else np.zeros((len(bins), 0))


def dropped(seed: int, turn: int, share: float) -> np.ndarray:
    """Which of the ``turn`` trees so far are left out in this round."""
    return np.random.default_rng([seed, turn]).random(turn) < share


def reweighted(weights: np.ndarray, out: np.ndarray, rate: float) -> np.ndarray:
    """The weights with that of a new tree: ``rate``, or with k trees left out rate / (k + rate), theirs being scaled by k / (k + rate)."""
    k = int(out.sum())
    if not k:
        return np.append(weights, rate)
    return np.append(np.where(out, weights * (k / (k + rate)), weights), rate / (k + rate))


def boost(data: Binned, rounds: int = 200, how: Growth | None = None, rate: float = 0.1, patience: int = 50, drop: float = 0.0, seed: int = 42) -> Boosted:
    """At most ``rounds`` trees; ends when the best validation loss is ``patience`` rounds old. ``data`` was binned with a boolean column ``valid`` among ``more``.

    Without validation rows all rounds are made and used.
    """
    how = how or Growth("newton", depth=3)
    rows = data.rows.agg(F.count_if(~F.col("valid")), F.sum(F.when(~F.col("valid"), F.col("y")))).first()
    share = min(max((rows[1] or 0.0) / max(1, rows[0]), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    state = written.write(data.rows.withColumn("outs", F.array().cast("array<double>")), "boosting")
    made: list[Tree] = []
    fresh: list[Tree] = []  # those that outs doesn't hold yet
    history, losses = [np.zeros(0)], []
    spark = data.rows.sparkSession
    while True:
        turn = len(made)
        out = dropped(seed, turn, drop) if drop else np.zeros(turn, bool)
        sent = spark.sparkContext.broadcast((list(fresh), history[-1], out))

        def scored(named: dict[str, np.ndarray], b: np.ndarray, sent=sent) -> tuple[np.ndarray, np.ndarray]:
            """Margins of all trees, and of those that aren't left out."""
            late, weights, out = sent.value
            outs = np.concatenate([named["outs"].reshape(len(b), -1), *[leaf_values(t, how.penalty)[t.leaves(b)][:, None] for t in late]], axis=1)
            return start + outs @ weights, start + outs @ np.where(out, 0.0, weights)

        def channels(named: dict[str, np.ndarray], y: np.ndarray, b: np.ndarray, scored=scored) -> np.ndarray:
            p = 1 / (1 + np.exp(-scored(named, b)[1]))
            return np.stack((p - y, p * (1 - p)), axis=1)[:, None, :] * (named["valid"] == 0)[:, None, None]

        def loss(named: dict[str, np.ndarray], y: np.ndarray, b: np.ndarray, scored=scored) -> np.ndarray:
            own, valid = log_loss(y, scored(named, b)[0]), named["valid"] != 0
            return np.array([own[~valid].sum(), (~valid).sum(), own[valid].sum(), valid.sum()])

        ended = turn >= rounds
        grown, sums = trees.grown(Binned(state, data.keys, data.cols, data.cuts), 0 if ended else 1, how if not ended else Growth("newton", depth=1), ["valid", "outs"], channels if not ended else (lambda named, y, b: np.zeros((len(b), 0, 2))), 2, loss)
        sent.unpersist()
        sums = np.zeros(4) if sums is None else sums
        losses.append((float(sums[0] / max(1, sums[1])), float(sums[2] / max(1, sums[3]))))
        best = min(range(len(losses)), key=lambda i: (round(losses[i][1], 12), i)) if sums[3] else len(made)
        if ended or turn - best >= patience:
            break
        made.append(grown[0])
        fresh.append(grown[0])
        history.append(reweighted(history[-1], out, rate))
        if len(fresh) == CHUNK:
            old, state = state, _kept(state, data, fresh, how.penalty)
            written.delete(old)
            fresh = []
    written.delete(state)
    weights = np.zeros((len(history), len(made)))
    for r, w in enumerate(history):
        weights[r, : len(w)] = w
    return Boosted(made, weights, start, how.penalty, best, losses, data)


def _kept(state: DataFrame, data: Binned, fresh: list[Tree], penalty: float) -> DataFrame:
    names = state.columns
    i, k = names.index("bins"), names.index("outs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                new = np.stack([leaf_values(t, penalty)[t.leaves(b)] for t in fresh], axis=1)
                outs = np.concatenate((np.array(batch.column(k).to_pylist(), float).reshape(len(b), -1), new), axis=1)
                yield batch.set_column(k, "outs", pa.array(outs.tolist(), pa.list_(pa.float64())))

    return written.write(state.mapInArrow(run, state.schema), "boosting")


def staged(model: Boosted, only_valid: bool = True) -> DataFrame:
    """keys, y, valid, iteration (number of trees) and margin of each row after each round."""
    data, keys = model.data, model.data.keys
    sent = data.rows.sparkSession.sparkContext.broadcast(replace(model, data=None))
    kinds = ", ".join(f"`{c}` {data.rows.schema[c].dataType.simpleString()}" for c in data.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = len(keys), sent.value
        for batch in batches:
            if batch.num_rows:
                b = np.frombuffer(b"".join(batch.column(n + 2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                margins = m.start + m.outs(b) @ m.weights.T
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(margins.tolist(), pa.list_(pa.float64()))], [*keys, "y", "valid", "margins"])

    rows = data.rows.where("valid") if only_valid else data.rows
    found = rows.select(*data.keys, "y", "valid", "bins").mapInArrow(run, f"{kinds}, y double, valid boolean, margins array<double>")
    return found.select(*data.keys, "y", "valid", F.posexplode("margins").alias("iteration", "margin"))


def scored(model: Boosted) -> DataFrame:
    """keys, y, valid, margin, p1 and yhat of each row by the best round."""
    last = staged(model, only_valid=False).where(F.col("iteration") == model.best).drop("iteration")
    return last.withColumn("p1", 1 / (1 + F.exp(-F.col("margin")))).withColumn("yhat", (F.col("p1") >= 0.5).cast("int"))


def evaluated(stages: DataFrame) -> DataFrame:
    """iteration, loss (mean log loss) and roc_auc of ``staged`` rows."""
    m = F.col("margin")
    loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - F.col("y") * m
    return stages.groupBy("iteration").agg(F.avg(loss).alias("loss")).join(metrics.roc_auc(stages, "y", "margin", ["iteration"]), "iteration")


def best_iteration(curve: DataFrame, metric: str = "loss") -> DataFrame:
    """iteration and value of the best row of ``evaluated``: least loss or largest roc_auc, of equals the first."""
    value = F.round(metric, 12)
    return curve.orderBy(value if metric == "loss" else value.desc(), "iteration").limit(1).select("iteration", F.col(metric).alias("value"))


# ---- linear booster ------------------------------------------------------------------------------------------------


def linear(df: DataFrame, y: str, cols: list[str], rounds: int = 20, rate: float = 1.0, l2: float = 0.0, l1: float = 0.0) -> tuple[float, list[float], list[float]]:
    """(bias, weights, mean log loss before each round) of a logistic model.

    A round is one pass: the sums of gradients and second derivatives at the weights so far, (columns + 1)^2 numbers a task,
    on whose quadratic model coordinates are moved in turn, with soft thresholding by l1. Rows with a missing value or
    label are left out.
    """
    ok = df.where(F.col(y).isNotNull())
    for c in cols:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    rows = written.write(ok.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]), "linear")
    n, tasks = len(cols) + 1, rows.rdd.getNumPartitions()
    w, losses = np.zeros(n), []
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + n + n * n)
            for batch in batches:
                y = batch.column(0).to_numpy()
                x = np.column_stack([np.ones(len(y)), *[batch.column(i).to_numpy() for i in range(1, n)]])
                m = x @ w
                p = 1 / (1 + np.exp(-m))
                total += np.concatenate(([len(y), log_loss(y, m).sum()], (p - y) @ x, (x.T @ (x * (p * (1 - p))[:, None])).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "task", "sums"])

        sums = trees.added(rows.mapInArrow(run, "tree int, task int, sums binary"), tasks).get(0)
        if sums is None or not sums[0]:
            break
        losses.append(float(sums[1] / sums[0]))
        w = descended(w, sums[2 : 2 + n], sums[2 + n :].reshape(n, n), rate, l2, l1)
    written.delete(rows)
    return float(w[0]), w[1:].tolist(), losses


def descended(w: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, l2: float, l1: float, sweeps: int = 200) -> np.ndarray:
    """The weights after a round: ``rate`` of the way to the least of the quadratic model (g, h) with penalties, by coordinates in turn.

    The first weight is the bias, which isn't penalised. Coordinates without a second derivative stay.
    """
    goal = w.copy()
    for _ in range(sweeps):
        before = goal.copy()
        for j in range(len(w)):
            ridge, lasso = (0.0, 0.0) if j == 0 else (l2, l1)
            if h[j, j] + ridge > 1e-12:
                target = h[j, j] * goal[j] - g[j] - h[j] @ (goal - w)
                goal[j] = np.sign(target) * max(abs(target) - lasso, 0.0) / (h[j, j] + ridge)
        if np.abs(goal - before).max(initial=0) < 1e-10:
            break
    return w + rate * (goal - w)
