"""Search over boosting parameters: all candidates and folds grow together, and a Parzen model of past trials draws the next ones.

A candidate is fitted once for each fold, on the rows of the others. The rows are binned once and dealt, with a copy for each group of
models, to tasks; a level of the trees of all models is one pass over them. What a task has summed is added by model, and the
best splits are found where the sums meet, so the driver gets splits only. Areas come from one table of out-of-fold scores.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.operators import metrics, trees
from glint.operators.boosting import leaf_values
from glint.operators.trees import Binned, Growth, Tree
from glint.sources import written

#: Models that share a copy of the rows.
TOGETHER = 160
_SPLIT = "tree int, node int, feature int, cut int, gain double, left array<double>, right array<double>"

Space = dict[str, tuple]


# ---- drawing candidates ---------------------------------------------------------------------------------------------


def drawn(space: Space, n: int, seed: int = 42) -> list[dict]:
    """n independent draws: ("int", low, high) excludes high, ("uniform", low, width), ("log", low, high), ("choice", values...)."""
    rng = random.Random(seed)
    draw = {"int": lambda a, b: rng.randrange(a, b), "uniform": lambda a, w: rng.uniform(a, a + w), "log": lambda a, b: a * (b / a) ** rng.random(), "choice": lambda *v: rng.choice(v)}
    return [{name: draw[kind](*args) for name, (kind, *args) in space.items()} for _ in range(n)]


def _scale(kind: str, args: list) -> tuple[float, float]:
    """Ends of the line that values of a kind lie on."""
    if kind == "log":
        return math.log(args[0]), math.log(args[1])
    return (args[0] - 0.5, args[1] - 0.5) if kind == "int" else (args[0], args[0] + args[1])


def density(points: list[float], low: float, high: float, x: np.ndarray) -> np.ndarray:
    """A Parzen density on [low, high]: a normal kernel at each point, one of the whole width in the middle, each cut off at the ends."""
    centres = np.array([*points, (low + high) / 2])
    ordered = np.sort(np.array([low, *points, high]))
    gap = [max(v - ordered[i], ordered[i + 2] - v) for v in points for i in [int(np.searchsorted(ordered[1:-1], v))]]
    least = (high - low) / min(100, 1 + len(centres))
    width = np.array([*np.clip(gap, least, high - low), high - low])
    z = lambda v: 0.5 * (1 + np.vectorize(math.erf)((v - centres) / width / math.sqrt(2)))
    mass = z(high) - z(low)
    bell = np.exp(-0.5 * ((x[:, None] - centres) / width) ** 2) / (width * math.sqrt(2 * math.pi)) / mass
    return bell.mean(axis=1)


def parzen(space: Space, trials: list[tuple[dict, float]], n: int, seed: int = 42, good: float = 0.25, tries: int = 24) -> list[dict]:
    """n candidates, each value being the one of ``tries`` draws near good trials that is likelier among the good than among the bad ones.

    The good trials are the share ``good`` of them with the largest scores (of equals the earlier); without trials draws are independent.
    """
    if not trials:
        return drawn(space, n, seed)
    ordered = sorted(range(len(trials)), key=lambda i: (-trials[i][1], i))
    cut = max(1, math.ceil(good * len(trials)))
    best, rest = ([trials[i][0] for i in part] for part in (ordered[:cut], ordered[cut:]))
    rng = random.Random(seed)
    out: list[dict] = [{} for _ in range(n)]
    for name, (kind, *args) in space.items():
        if kind == "choice":
            weight = lambda part, v: (sum(p[name] == v for p in part) + 1) / (len(part) + len(args))  # noqa: E731, B023
            odds = {v: weight(best, v) / weight(rest, v) for v in args}
            for o in out:
                some = rng.choices(args, [weight(best, v) for v in args], k=tries)
                o[name] = max(some, key=lambda v: odds[v])  # noqa: B023
            continue
        low, high = _scale(kind, args)
        at = lambda p: math.log(p[name]) if kind == "log" else float(p[name])  # noqa: E731, B023
        near, far = [at(p) for p in best], [at(p) for p in rest]
        for o in out:
            some = [min(high, max(low, rng.gauss(c, (high - low) / (1 + len(near))))) if (c := rng.choice([*near, None])) is not None else rng.uniform(low, high) for _ in range(tries)]
            x = np.array(some)
            v = some[int(np.argmax(density(near, low, high, x) / density(far, low, high, x)))]
            o[name] = math.exp(v) if kind == "log" else min(args[1] - 1, max(args[0], round(v))) if kind == "int" else v
    return out


# ---- fitting them together -----------------------------------------------------------------------------------------------


@dataclass
class _Model:
    fold: int
    how: Growth
    rate: float
    rounds: int
    start: float
    trees: list[Tree]
    live: bool = True


def dealt(data: Binned, models: int) -> tuple[Binned, int]:
    """A written copy of the rows for each group of at most TOGETHER models (``grp``), and how many partitions a group may have."""
    groups = -(-models // TOGETHER)
    parts = max(1, data.rows.rdd.getNumPartitions())
    rows = data.rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups * parts, "grp", F.pmod(F.xxhash64(*data.keys), F.lit(parts)))
    return Binned(written.write(rows, "search"), data.keys, data.cols, data.cuts), groups * parts


def _margin(m: _Model, b: np.ndarray) -> np.ndarray:
    out = np.full(len(b), m.start)
    for t in m.trees:
        out += m.rate * leaf_values(t, m.how.penalty)[t.leaves(b)]
    return out


def _read(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, y, fold, bins) of the batches of rows (y, bins, fold, grp), apart by group."""
    for batch in batches:
        if batch.num_rows:
            b = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, d)
            y, fold, grp = (batch.column(i).to_numpy() for i in (0, 2, 3))
            for g in np.unique(grp).tolist():
                own = grp == g
                yield g, y[own], fold[own], b[own]


def _splits(data: Binned, sent, level: int, groups: int, tasks: int, bins: int) -> list:
    d, width = len(data.cols), 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, growing = sent.value
        held: dict[int, np.ndarray] = {}
        for g, y, fold, b in _read(batches, d):
            for i in range(g, len(models), groups):
                m = models[i]
                if not m.live or m.how.depth <= level:
                    continue
                at = growing[i].leaves(b, level) - (width - 1)
                rows = np.flatnonzero((fold != m.fold) & (at >= 0))
                p = 1 / (1 + np.exp(-_margin(m, b[rows])))
                hist = held.setdefault(i, np.zeros((width, d, bins, 2)))
                base = at[rows] * bins
                for c, w in enumerate((p - y[rows], p * (1 - p))):
                    for f in range(d):
                        hist[:, f, :, c] += np.bincount(base + b[rows, f], w, minlength=width * bins).reshape(width, bins)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([task] * len(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())], ["tree", "task", "sums"])

    def find(group: pa.Table) -> pa.Table:
        t = group.column("tree")[0].as_py()
        hist = sum(np.frombuffer(s.as_py()) for s in group.column("sums")).reshape(width, d, bins, 2)
        found = trees.best_splits(hist, 0, level, sent.value[0][t].how)
        if level == 0:
            found = [(-1, -1, -1, 0.0, hist[0, 0].sum(axis=0).tolist(), []), *found]
        columns = list(zip(*[(t, *s) for s in found], strict=True)) or [[] for _ in range(7)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SPLIT.split(", ")])

    parts = data.rows.select("y", "bins", "fold", "grp").mapInArrow(run, "tree int, task int, sums binary")
    return trees.reduced(parts, tasks).groupBy("tree").applyInArrow(find, _SPLIT).collect()  # models x nodes of a level


def fitted(data: Binned, candidates: list[dict], folds: int) -> DataFrame:
    """candidate, fold and roc_auc of each candidate on each fold. ``data`` was binned with an int column ``fold`` among ``more``.

    A candidate has depth, rate, penalty, least (hessian of a child) and rounds.
    """
    counts = {r["fold"]: (r["n"], r["s"]) for r in data.rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # a row for each fold
    models = []
    for c in candidates:
        for k in range(folds):
            n, s = (sum(v[i] for f, v in counts.items() if f != k) for i in (0, 1))
            share = min(max(s / max(1, n), 1e-6), 1 - 1e-6)
            models.append(_Model(k, Growth("newton", int(c["depth"]), float(c["least"]), float(c["penalty"])), float(c["rate"]), int(c["rounds"]), math.log(share / (1 - share)), []))
    spark = data.rows.sparkSession
    copies, tasks = dealt(data, len(models))
    groups = -(-len(models) // TOGETHER)
    bins = max([2, *(len(c) + 1 for c in data.cuts)])
    for turn in range(max((m.rounds for m in models), default=0)):
        growing = [Tree.empty(m.how.depth, 2) for m in models]
        for m in models:
            m.live = turn < m.rounds
        for level in range(max((m.how.depth for m in models if m.live), default=0)):
            sent = spark.sparkContext.broadcast((models, growing))  # models x rounds x nodes
            found = _splits(copies, sent, level, groups, tasks, bins)
            sent.unpersist()
            for r in found:
                tree = growing[r["tree"]]
                if r["node"] < 0:
                    tree.sums[0] = r["left"]
                else:
                    tree.feature[r["node"]], tree.cut[r["node"]], tree.gain[r["node"]] = r["feature"], r["cut"], r["gain"]
                    tree.sums[2 * r["node"] + 1], tree.sums[2 * r["node"] + 2] = r["left"], r["right"]
        for m, tree in zip(models, growing, strict=True):
            if m.live:
                m.trees.append(tree)
    sent, d = spark.sparkContext.broadcast(models), len(data.cols)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, y, fold, b in _read(batches, d):
            for i in range(g, len(sent.value), groups):
                rows = fold == sent.value[i].fold
                n = int(rows.sum())
                yield pa.RecordBatch.from_arrays([pa.array([i // folds] * n, pa.int32()), pa.array(fold[rows], pa.int32()), pa.array(y[rows]), pa.array(_margin(sent.value[i], b[rows]))], ["candidate", "fold", "y", "margin"])

    said = copies.rows.select("y", "bins", "fold", "grp").mapInArrow(score, "candidate int, fold int, y double, margin double")
    out = written.write(metrics.roc_auc(said, "y", "margin", ["candidate", "fold"]), "areas")
    written.delete(copies.rows)
    return out


def searched(data: Binned, space: Space, batches: list[int], folds: int = 5, seed: int = 42) -> list[tuple[int, dict, float]]:
    """(batch, parameters, mean area over the folds) of every trial: the first batch is drawn at random, later ones by ``parzen``."""
    trials: list[tuple[int, dict, float]] = []
    for i, n in enumerate(batches):
        some = parzen(space, [(p, a) for _, p, a in trials], n, seed + i)
        table = fitted(data, some, folds)
        areas = {r["candidate"]: r["a"] for r in table.groupBy("candidate").agg(F.avg("roc_auc").alias("a")).collect()}  # a row for each candidate
        written.delete(table)
        trials += [(i, p, areas.get(k) or 0.0) for k, p in enumerate(some)]
    return trials
