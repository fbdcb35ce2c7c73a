"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``ORDER`` nearest pivots in order of nearness (largest inner product of the normalised vectors);
pivots are a bounded sample of ``PIVOTS`` vectors, chosen by hash. The index is dealt to shards of about ``SHARD`` vectors; in a
shard, each pivot's inverted file posts the vectors that have it, with its rank in their orders. A query reads the files
of its own pivots, which gives the footrule distance to every vector of the shard that shares a pivot (ranks beyond
ORDER count as ORDER), the ``SHARE`` of the shard that is nearest by footrule is reranked by exact inner products, and
the best of each shard are merged. Queries are a stated set, sent to the shards in blocks.

Inner products of vectors of different lengths aren't nearness of directions, so vectors get one more component for
the permutations, sqrt(largest norm ** 2 - norm ** 2) (0 for a query): then the largest inner product is the nearest
direction.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of a
length other than the commonest (the smallest of these if several are), nor rows without an id; a query's own row (every
row with its id) is no candidate; ties go to the smaller id; with fewer candidates than asked for, all that are found
are returned; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.llm import scratch

PIVOTS = 256
ORDER = 32
SHARE = 0.35
SHARD = 8192
BLOCK = 512


def usable(vectors: DataFrame) -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    inf = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf)) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size(v) == (size[0].d if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _orders(v: np.ndarray, pivots: np.ndarray, largest: float | None) -> np.ndarray:
    """The nearest pivots of each row in order; largest is None for queries."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    more = np.zeros_like(norm) if largest is None else np.sqrt(np.maximum(0, largest**2 - norm**2))
    v = np.hstack((v, more))
    near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T
    k = min(ORDER, len(pivots))
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows = scratch.cut(usable(vectors), "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    about = rows.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    n, largest = about.n, about.largest or 1.0
    chosen = [r.vector for r in rows.orderBy(F.xxhash64("id"), "id", "vector").limit(PIVOTS).collect()]  # PIVOTS vectors at most
    p = np.array(chosen, float)
    if len(chosen):
        p = np.hstack((p, np.sqrt(np.maximum(0, largest**2 - np.linalg.norm(p, axis=1, keepdims=True) ** 2))))
        p /= np.linalg.norm(p, axis=1, keepdims=True)
    pivots = spark.sparkContext.broadcast((p, float(largest)))
    shards, block = max(1, -(-n // SHARD)), BLOCK
    indexed = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select(F.col("id").alias("q"), F.col("vector").alias("qv"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    # each block of queries goes to every shard, and a task holds one shard and one block at a time
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    per = max(1, min(blocks, 8))
    group = F.col("block") % per
    asked = asked.withColumn("part", group)
    indexed = indexed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))

    def best(key, left, right):
        p, largest = pivots.value
        ids, v = left["id"].to_numpy(), _matrix(left["vector"].combine_chunks())
        found: list[tuple] = []
        if len(ids) and len(right):
            orders = _orders(v, p, largest)
            depth = orders.shape[1]
            flat = np.argsort(orders.ravel(), kind="stable")  # inverted files: by pivot, the rows and ranks
            files = np.searchsorted(orders.ravel()[flat], np.arange(len(p) + 1))
            row, rank = flat // depth, flat % depth
            wanted = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
            q_ids, q_all = right["q"].to_numpy(), _matrix(right["qv"].combine_chunks())
            for at in range(0, len(q_ids), block):
                for q_id, q, q_order in zip(q_ids[at : at + block], q_all[at : at + block], _orders(q_all[at : at + block], p, None), strict=True):
                    shared = np.zeros(len(ids))
                    for r, pivot in enumerate(q_order):  # footrule = what two orders without a common pivot have, less this
                        lo, hi = files[pivot], files[pivot + 1]
                        shared[row[lo:hi]] += 2 * (depth - np.maximum(r, rank[lo:hi]))
                    near = np.flatnonzero(shared >= np.partition(shared, -wanted)[-wanted]) if wanted < len(ids) else np.arange(len(ids))
                    near = near[ids[near] != q_id]
                    score = (v[near] * q).sum(1)
                    if len(near) > k:
                        edge = np.partition(score, -k)[-k]
                        near, score = near[score >= edge], score[score >= edge]
                    top = np.lexsort((ids[near], -score))[:k]
                    found += [(int(q_id), int(ids[near[i]]), float(score[i])) for i in top]
        return pa.table({n: pa.array([f[c] for f in found], t) for c, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    out = indexed.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(best, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
