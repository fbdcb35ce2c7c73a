"""Best-fit packing of documents into sequences of ``capacity`` words under conflicts.

Documents are cut into pieces of at most ``capacity`` words; full pieces are bins of their own, what is left of each
document is packed. Pieces are dealt to shards by hash, about ``SHARD`` in each, and a shard is packed in one task:
pieces in descending size, each into the open bin with the smallest residual that holds it and is compatible. A bin
carries a bitmap of duplicate clusters (two pieces of one cluster never share it) and ``per_source`` bitmaps of sources
(plane i has the sources with more than i pieces in it; the last plane's may not add another). Bins are kept by
residual, with a bitmap of the residuals that have bins: the search takes the next set bit at or above the size, and goes
on to the successor until a bin is compatible; if none is, a new bin is opened. So a hot source or cluster costs more
bins, never a larger task.

The next piece of the same size, cluster and source goes on where the last search ended, as every bin before is known to
be in conflict; so a group of many copies is packed in one pass over the bins.

Defined cases: null text or one without words is a piece of size 0 that needs a bin as any other; null source and null
cluster are in conflict with nothing; equal sizes go by cluster, source, doc_id, so
reruns agree; repeated rows are packed each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glint.llm import scratch

CAPACITY = 2048
PER_SOURCE = 4
SHARD = 8192
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r: there are bins with residual r
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.last, self.from_ = None, (0, 0)

    def _compatible(self, b: int, cluster: int, source: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def put(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """The bin, and the place in it; cluster and source are single bits, or 0 for none."""
        same = (size, cluster, source) == self.last and cluster
        r, i = self.from_ if same else (size, 0)
        found = None
        while found is None and self.some >> r:
            r += (self.some >> r & -(self.some >> r)).bit_length() - 1
            bins = self.at[r]
            while i < len(bins) and not self._compatible(bins[i], cluster, source):
                i += 1
            if i < len(bins):
                found = bins[i]
            else:
                r, i = r + 1, 0
            if r > self.capacity:
                break
        self.last, self.from_ = (size, cluster, source), (r, i)
        if found is None:
            found, left = len(self.clusters), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        else:
            left = r
            del self.at[r][i]
            if not self.at[r]:
                self.some &= ~(1 << r)
        self.clusters[found] |= cluster
        for plane in range(self.per_source - 1, 0, -1):
            self.sources[found][plane] |= self.sources[found][plane - 1] & source
        self.sources[found][0] |= source
        left -= size
        if left:
            # behind the bins that a search for the same piece has passed
            self.at[left].append(found)
            self.some |= 1 << left
        return found, self.capacity - left - size


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, source, piece, size, shard, bin, start for each piece; bins are numbered within their shard.

    Without ``cluster``, texts that are equal but for case and white space are a cluster.
    """
    text = F.col("text").cast("string")
    if cluster is None:
        cluster = F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), r"[\x20\x09-\x0D]+", " "))
    cluster = F.when(text.isNotNull(), cluster)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.cast("long").alias("cluster"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("words"), F.xxhash64(text).alias("h"))
    rows = scratch.cut(rows, "sizes")
    shards = max(1, -(-rows.count() // SHARD))
    shard = F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)).cast("int")
    full = F.when(F.col("words") > 0, F.floor((F.col("words") - 1) / capacity)).otherwise(0).cast("long")
    pieces = rows.withColumn("full", full).withColumn("shard", shard).withColumn("rest", F.col("words") - F.col("full") * capacity)

    def run(key, table):
        # bits are numbered by value, not by order of arrival, so reruns agree
        sources = table["source"].to_pylist()
        names = {s: 1 << i for i, s in enumerate(sorted(set(sources) - {None}))}
        source = [names.get(s, 0) for s in sources]
        # a cluster with one piece in the shard is in conflict with nothing, and needs no bit
        clusters = table["cluster"].to_pylist()
        values, counts = np.unique([c for c in clusters if c is not None], return_counts=True)
        bits = {c: 1 << i for i, c in enumerate(values[counts > 1].tolist())}
        cluster = [bits.get(c, 0) for c in clusters]
        size, ids, full = (table[c].to_pylist() for c in ("rest", "doc_id", "full"))
        order = sorted(range(len(ids)), key=lambda i: (-size[i], cluster[i], source[i], ids[i] is None, ids[i] or 0))
        bins = Bins(capacity, per_source)
        put: list = [None] * len(ids)
        for i in order:
            put[i] = bins.put(size[i], cluster[i], source[i])
        out: list[tuple] = []
        more = len(bins.clusters)
        shard_no = key[0].as_py()
        for i, (s, (b, start)) in enumerate(zip(sources, put, strict=True)):
            for p in range(full[i]):
                out.append((ids[i], s, p, capacity, shard_no, more, 0))
                more += 1
            out.append((ids[i], s, full[i], size[i], shard_no, b, start))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "source", "piece", "size", "shard", "bin", "start"])

    return pieces.select("shard", "doc_id", "source", "cluster", "full", "rest").groupBy("shard").applyInArrow(run, "doc_id long, source string, piece long, size long, shard int, bin long, start long")
