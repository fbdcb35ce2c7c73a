"""Incremental PCA: moments of chunks that are stored, added and turned into components.

A chunk's moments are its count, sums and sums of products around a fixed shift, as rows (chunk, i, j, s) with i <= j; -1 stands
for the constant 1. They are plain sums, so any split of the data into chunks adds up to the same, in any order, and a chunk that is
written again takes its old place. The components come from the added sums, (columns + 1)^2 / 2 numbers whatever the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chunk string, i int, j int, s double"


def moments(df: DataFrame, cols: list[str], chunk: str | None = None, shift: list[float] | None = None) -> DataFrame:
    """The moments of each ``chunk`` (a column; without it one chunk 'all'). Rows with a missing value are left out."""
    base = np.array(shift or [0.0] * len(cols))
    upper = np.triu_indices(len(cols) + 1)
    i, j = (u.astype(np.int32) - 1 for u in upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]).reshape(len(names), -1)
            ok = ~np.isnan(x).any(axis=1)
            names, x = names[ok], x[ok] - base
            z = np.column_stack((np.ones(len(x)), x))
            for name in set(names.tolist()):
                own = z[names == name]
                held[name] = held.get(name, 0) + own.T @ own
            if len(held) > 4096:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(g[upper])], ["chunk", "i", "j", "s"])

    name = F.lit("all") if chunk is None else F.col(chunk).cast("string")
    rows = df.select(F.coalesce(name, F.lit("")).alias("chunk"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)])
    return rows.mapInArrow(run, SCHEMA).groupBy("chunk", "i", "j").agg(F.sum("s").alias("s"))


@dataclass(frozen=True)
class Moments:
    """Count, means and the scatter matrix (sums of products around the means)."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray


def merged(parts: DataFrame, n_cols: int, shift: list[float] | None = None) -> Moments:
    """The moments of all chunks of ``parts`` together."""
    g = np.zeros((n_cols + 1, n_cols + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (columns + 1)^2 / 2 rows
        g[r["i"] + 1, r["j"] + 1] = g[r["j"] + 1, r["i"] + 1] = r["s"]
    n = g[0, 0]
    if not n:
        return Moments(0, np.zeros(n_cols), np.zeros((n_cols, n_cols)))
    mean = g[0, 1:] / n
    return Moments(int(round(n)), mean + np.array(shift or [0.0] * n_cols), g[1:, 1:] - n * np.outer(mean, mean))


@dataclass(frozen=True)
class Components:
    """Directions (rows) of the most variance, the shares they explain, means and scales of the columns."""

    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    shares: np.ndarray


def components(m: Moments, cols: list[str], k: int = 2, standard: bool = True) -> Components:
    """The first ``k`` principal components. Signs are fixed: each direction's entry of largest modulus (of equals the first) is positive.

    With ``standard`` columns are divided by their standard deviation first (a constant by 1).
    """
    covariance = m.scatter / max(1, m.n)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale = np.where(deviation > 1e-12, deviation, 1.0) if standard else np.ones(len(cols))
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")[:k]
    directions = vectors[:, order].T
    lead = np.round(np.abs(directions), 9).argmax(axis=1)
    directions = directions * np.where(directions[np.arange(len(order)), lead] < 0, -1.0, 1.0)[:, None]
    total = values.sum()
    return Components(cols, m.mean, scale, directions, values[order] / total if total > 0 else np.zeros(len(order)))


def projected(df: DataFrame, c: Components) -> DataFrame:
    """``df`` with pc1, pc2, .. as plain expressions."""
    z = [(F.col(name).cast("double") - float(m)) / float(s) for name, m, s in zip(c.cols, c.mean, c.scale, strict=True)]
    return df.select("*", *[sum((x * float(w) for x, w in zip(z, d, strict=True)), F.lit(0.0)).alias(f"pc{i}") for i, d in enumerate(c.directions, 1)])


# ---- a store of chunks ------------------------------------------------------------------------------------------------


def update(spark: SparkSession, root: str, df: DataFrame, cols: list[str], chunk: str) -> None:
    """Store the moments of ``df`` as the chunk of this name; one of the same name is replaced, so repeating an update changes nothing.

    The first update fixes the columns and the shift (its own means) below ``root``.
    """
    have = _head(spark, root)
    if have is None:
        own = merged(moments(df, cols), len(cols))
        have = {"cols": cols, "shift": own.mean.tolist()}
        spark.createDataFrame([(json.dumps(have),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/head")
    if have["cols"] != cols:
        raise ValueError(f"the store has the columns {have['cols']}")
    one = moments(df, cols, shift=have["shift"]).select("i", "j", "s", F.lit(chunk).alias("chunk"))
    one.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{root}/chunks")


def _head(spark: SparkSession, root: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/head/_SUCCESS")
    return json.loads(spark.read.text(f"{root}/head").first()[0]) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def stored(spark: SparkSession, root: str) -> tuple[Moments, list[str]]:
    """The moments of all chunks of the store, and their columns."""
    have = _head(spark, root)
    if have is None:
        raise ValueError(f"nothing is stored in {root}")
    return merged(spark.read.parquet(f"{root}/chunks"), len(have["cols"]), have["shift"]), have["cols"]
