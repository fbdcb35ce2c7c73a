"""Tree ensembles grown from histograms: forests with out-of-bag votes, and boosting with staged scores.

Rows are binned once and written (``Binned``). All trees of a forest, or all candidates of a search, grow together: a level of
all of them is one pass over the rows, in which each task sums its rows by (tree, node, feature, bin), and the sums of tasks
are added in two steps, so that no task or driver holds more than about the square root of them. A tree is a small table
(heap-numbered nodes), which is what is broadcast: trees x 2^(depth + 1) nodes.

A missing value (null or NaN) falls in the lowest bin. Rows are told apart by their keys; draws come from md5 of the
keys, so reruns agree and SQL can check them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.operators.sampling import order
from glint.sources import written

BINS = 32
#: Sums of so many tasks are added by the driver; those of more are first added in groups.
DIRECT = 32
_POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]


# ---- rows --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Binned:
    """rows: key columns, y (double), bins (a byte for each column), and further columns; cuts: the upper edge of each bin but the last, by column."""

    rows: DataFrame
    keys: list[str]
    cols: list[str]
    cuts: list[np.ndarray]


def cuts(df: DataFrame, cols: list[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 ascending cuts of each column with about as many rows between any two, all in one pass."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(ok(c), at, F.lit(100 * bins)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(len(cols))]


def binned(df: DataFrame, keys: list[str], y: str, cols: list[str], more: tuple[str, ...] = (), bins: int = BINS) -> Binned:
    """The rows of ``df`` with a label, binned and written. bin b holds the values over cut b - 1 up to cut b."""
    if bins > 256:
        raise ValueError("a bin is a byte")
    edges = cuts(df, cols, bins)
    held = [*keys, *more]
    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(held) + 1
            x = [np.nan_to_num(batch.column(n + i).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf, posinf=np.inf, neginf=-np.inf) for i in range(len(cols))]
            b = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x, strict=True)], axis=1).astype(np.uint8) if cols else np.zeros((batch.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([r.tobytes() for r in b], pa.binary())], [*held, "y", "bins"])

    own = df.where(F.col(y).isNotNull()).select(*held, F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    return Binned(written.write(own.mapInArrow(run, f"{kinds}, y double, bins binary"), "binned"), keys, cols, edges)


def bootstrap(keys: list[str], trees: int, seed: str = "42") -> Column:
    """array<int> of how often each of ``trees`` draws a row: Poisson counts of mean 1, four from each md5 (counts over 8 are cut)."""
    steps = F.array(*[F.lit(p) for p in _POISSON])
    hashes = F.array(*[order(keys, f"{seed}:{i}") for i in range(-(-trees // 4))])
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _count(F.get(hashes, F.floor(t / 4).cast("int")), t % 4, steps))


def _count(md5: Column, part: Column, steps: Column) -> Column:
    u = F.conv(F.substring(md5, 1 + part * 8, F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return F.size(F.filter(steps, lambda s: s <= u))


# ---- trees -------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes numbered as in a heap: feature (-1: a leaf), the last bin that goes left, sums of the channels, gain of the split."""

    feature: np.ndarray
    cut: np.ndarray
    sums: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int, channels: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros((n, channels)), np.zeros(n))

    @property
    def depth(self) -> int:
        return len(self.feature).bit_length() - 1

    def leaves(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row ends in (after at most ``levels`` splits)."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[at]
            inner = f >= 0
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass(frozen=True)
class Growth:
    """What a level's split depends on: ``gain`` of channel sums (left, right), the least rows (or hessian) of a child, features tried at a node."""

    kind: str = "gini"
    depth: int = 5
    least: float = 1.0
    penalty: float = 1.0
    features: int | None = None
    seed: int = 42


def _worth(kind: str, s: np.ndarray, penalty: float) -> np.ndarray:
    """What a node with channel sums s explains: for "gini" the classes' squared weights by weight, for "newton" (g, h) the loss it saves."""
    if kind == "gini":
        total = s.sum(axis=-1)
        return np.divide((s * s).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)
    return s[..., 0] ** 2 / (s[..., 1] + penalty)


def _weight(kind: str, s: np.ndarray) -> np.ndarray:
    return s.sum(axis=-1) if kind == "gini" else s[..., 1]


def best_splits(hist: np.ndarray, tree: int, level: int, how: Growth) -> list[tuple[int, int, int, float, list[float], list[float]]]:
    """(node, feature, cut, gain, sums left, sums right) of each node of the level worth splitting; hist: nodes x features x bins x channels.

    Of equal gains the first feature and the lowest cut; with ``features``, only so many drawn for each node are tried.
    """
    out = []
    nodes, d = hist.shape[:2]
    for i in range(nodes):
        left = hist[i].cumsum(axis=1)[:, :-1]
        whole = hist[i, 0].sum(axis=0)
        if d == 0 or _weight(how.kind, whole) <= 0:
            continue
        right = whole - left
        gain = _worth(how.kind, left, how.penalty) + _worth(how.kind, right, how.penalty) - _worth(how.kind, whole, how.penalty)
        ok = (_weight(how.kind, left) >= how.least) & (_weight(how.kind, right) >= how.least)
        if how.features and how.features < d:
            tried = np.random.default_rng([how.seed, tree, level, i]).choice(d, how.features, replace=False)
            ok &= np.isin(np.arange(d), tried)[:, None]
        gain = np.where(ok, np.round(gain, 9), -np.inf)
        f, b = divmod(int(gain.argmax()), gain.shape[1])
        if gain[f, b] > 1e-9:
            out.append(((1 << level) - 1 + i, f, b, float(gain[f, b]), left[f, b].tolist(), right[f, b].tolist()))
    return out


def _parts(data: Binned, columns: list[str], channels: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], sent, level: int, bins: int, extra=None) -> DataFrame:
    """(tree, task, sums) of each task: histograms of the level's nodes, and the sums of ``extra`` (numbered -1)."""
    d = len(data.cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = sent.value
        task, width = TaskContext.get().partitionId(), 1 << level
        held: np.ndarray | None = None
        other = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, d)
            y = batch.column(0).to_numpy()
            named = {c: np.array(batch.column(2 + i).to_pylist(), float) for i, c in enumerate(columns)}
            w = channels(named, y, b)  # rows x trees x channels
            if held is None:
                held = np.zeros((len(trees), width, d, bins, w.shape[2]))
            if extra is not None:
                other = other + extra(named, y, b)
            for t, tree in enumerate(trees):
                at = tree.leaves(b, level) - (width - 1)
                live = np.flatnonzero((at >= 0) & (w[:, t] != 0).any(axis=1))
                if not len(live):
                    continue
                at, rows = at[live] * bins, b[live]
                for c in range(w.shape[2]):
                    own = w[live, t, c]
                    for f in range(d):
                        held[t, :, f, :, c] += np.bincount(at + rows[:, f], own, minlength=width * bins).reshape(width, bins)
        if held is not None:
            n = list(range(len(trees))) + ([-1] if extra is not None else [])
            sums = [h.tobytes() for h in held] + ([np.asarray(other, float).tobytes()] if extra is not None else [])
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array([task] * len(n), pa.int32()), pa.array(sums, pa.binary())], ["tree", "task", "sums"])

    return data.rows.select("y", "bins", *columns).mapInArrow(run, "tree int, task int, sums binary")


def reduced(parts: DataFrame, tasks: int) -> DataFrame:
    """(tree, task, sums) with the sums of ``tasks`` tasks added in two steps if they are many, so that no group holds more than about the root of them."""

    def run(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in group.column("sums"))
        return pa.table([group.column("tree").slice(0, 1), group.column("task").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["tree", "task", "sums"])

    if tasks > DIRECT:
        groups = math.isqrt(tasks)
        for more in (groups, 1):
            parts = parts.withColumn("task", F.col("task") % more).groupBy("tree", "task").applyInArrow(run, "tree int, task int, sums binary")
    return parts


def added(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """The sums of all tasks by tree, from (tree, task, sums)."""
    out: dict[int, np.ndarray] = {}
    for r in sorted(reduced(parts, tasks).collect(), key=lambda r: (r["tree"], r["task"])):  # as many rows as trees, or DIRECT times as many
        out[r["tree"]] = out.get(r["tree"], 0) + np.frombuffer(r["sums"])
    return out


def grown(data: Binned, trees: int, how: Growth, columns: list[str], channels, n_channels: int, extra=None) -> tuple[list[Tree], np.ndarray | None]:
    """Trees grown together level by level; ``channels`` gives each row's weight in each tree and channel, from ``columns``. Also the sums of ``extra``."""
    spark = data.rows.sparkSession
    bins = max([2, *(len(c) + 1 for c in data.cuts)])
    out = [Tree.empty(how.depth, n_channels) for _ in range(trees)]
    tasks, aside = data.rows.rdd.getNumPartitions(), None
    for level in range(how.depth):
        sent = spark.sparkContext.broadcast(out)
        sums = added(_parts(data, columns, channels, sent, level, bins, extra if level == 0 else None), tasks)
        sent.unpersist()
        if level == 0:
            aside = sums.get(-1)
        any_split = False
        for t, tree in enumerate(out):
            if t not in sums:
                continue
            hist = sums[t].reshape(1 << level, len(data.cols), bins, n_channels)
            if level == 0 and len(data.cols):
                tree.sums[0] = hist[0, 0].sum(axis=0)
            for node, f, b, gain, left, right in best_splits(hist, t, level, how):
                any_split = True
                tree.feature[node], tree.cut[node], tree.gain[node] = f, b, gain
                tree.sums[2 * node + 1], tree.sums[2 * node + 2] = left, right
        if not any_split:
            break
    return out, aside


def nodes(spark: SparkSession, trees: list[Tree], data: Binned) -> DataFrame:
    """tree, node, feature (null: a leaf), threshold (values up to it go left), gain, weight: the trees as a table."""
    rows = []
    for t, tree in enumerate(trees):
        live = [0]
        while live:
            i = live.pop()
            f = int(tree.feature[i])
            if f >= 0:
                live += [2 * i + 1, 2 * i + 2]
                rows.append((t, i, data.cols[f], float(data.cuts[f][tree.cut[i]]), float(tree.gain[i]), float(tree.sums[i].sum())))
            else:
                rows.append((t, i, None, None, None, float(tree.sums[i].sum())))
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, gain double, weight double")


def importances(nodes: DataFrame) -> DataFrame:
    """feature, splits and gain of ``nodes``, with their shares."""
    each = nodes.where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    total = each.agg(F.sum("splits").alias("_s"), F.sum("gain").alias("_g"))
    return each.join(F.broadcast(total)).select("feature", "splits", "gain", F.try_divide("splits", "_s").alias("split_share"), F.try_divide("gain", "_g").alias("gain_share"))  # one row


# ---- forests ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    classes: list[float]
    data: Binned = field(repr=False)


def class_weights(rows: DataFrame, balanced: bool) -> dict[float, float]:
    """1 for each class, or n / (classes * rows of the class)."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
    return {c: sum(n.values()) / (len(n) * k) if balanced else 1.0 for c, k in sorted(n.items())}


def forest(data: Binned, trees: int = 20, how: Growth | None = None, balanced: bool = False) -> Forest:
    """Trees on bootstrap draws; ``data`` was binned with a column ``drawn`` (``bootstrap``) among ``more``."""
    weights = class_weights(data.rows, balanced)
    classes, of = list(weights), np.array(list(weights.values()))
    how = how or Growth(features=max(1, round(math.sqrt(len(data.cols)))))

    def channels(named: dict[str, np.ndarray], y: np.ndarray, b: np.ndarray) -> np.ndarray:
        hot = (y[:, None] == np.array(classes)) * of
        return named["drawn"][:, :trees, None] * hot[:, None, :]

    grown_trees, _ = grown(data, trees, how, ["drawn"], channels, len(classes))
    return Forest(grown_trees, classes, data)


def votes(model: Forest, out_of_bag: bool = True) -> DataFrame:
    """keys, y, n_votes, votes (array by class, of mean leaf shares), yhat (null without a vote) of the binned rows.

    Out of bag, a row is voted on only by trees that didn't draw it. Of equal votes the smallest class wins.
    """
    data, keys, classes, k = model.data, model.data.keys, model.classes, len(model.classes)
    sent = data.rows.sparkSession.sparkContext.broadcast(model.trees)
    kinds = ", ".join(f"`{c}` {data.rows.schema[c].dataType.simpleString()}" for c in data.keys)
    columns = [*data.keys, "y", "bins", "drawn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(keys)
            b = np.frombuffer(b"".join(batch.column(n + 1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            drawn = np.array(batch.column(n + 2).to_pylist())
            total, count = np.zeros((len(b), k)), np.zeros(len(b), np.int64)
            for t, tree in enumerate(sent.value):
                s = tree.sums[tree.leaves(b)]
                s = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)
                own = drawn[:, t] == 0 if out_of_bag else np.ones(len(b), bool)
                total += s * own[:, None]
                count += own
            mean = np.divide(total, count[:, None], out=np.zeros_like(total), where=count[:, None] > 0)
            said = [None if not c else classes[i] for c, i in zip(count.tolist(), np.round(mean, 9).argmax(axis=1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(count), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(said, pa.float64())], [*keys, "y", "n_votes", "votes", "yhat"])

    return data.rows.select(*columns).mapInArrow(run, f"{kinds}, y double, n_votes long, votes array<double>, yhat double")


def oob_score(voted: DataFrame) -> DataFrame:
    """n (rows with a vote), without_vote and accuracy of out-of-bag ``votes``."""
    return voted.agg(F.count("yhat").alias("n"), (F.count("*") - F.count("yhat")).alias("without_vote"), F.avg(F.when(F.col("yhat").isNotNull(), (F.col("yhat") == F.col("y")).cast("double"))).alias("accuracy"))
