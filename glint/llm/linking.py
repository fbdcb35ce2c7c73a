"""Classes of linked things: candidate pairs from inverted lists without expanding large lists, and connected components.

A list is the set of ids that share a key. In a list of at most ``LONG`` ids every pair is a candidate. A longer one
may be a common key, or a large group of things that are all alike; it is first compared with a few of its own members
(``star``), which joins a group of likes at a cost in proportion to its size. After that only members that are still in
different components are paired (``across``), so no link between different components is lost, and pairs whose
class is already known are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm import scratch

LONG = 64
STARS = 4
FILTER = 1 << 23


def sift(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Without most rows whose ``column`` isn't among ``ids`` (one column): what goes into a join with them, so that wide rows aren't shuffled for nothing.

    A bitmap of the ids' hashes is broadcast, FILTER / 64 words at most, whatever the number of ids.
    """
    bits = ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("_bits"))
    own = F.pmod(F.xxhash64(column), F.lit(FILTER))
    return rows.join(F.broadcast(words), F.shiftright(own, 6) == F.col("_word")).where(F.getbit("_bits", own % 64) == 1).drop("_word", "_bits")


def star(posts: DataFrame) -> DataFrame:
    """(a, b): each id of a list (key, id) with STARS members of it, chosen by minima that are combined before the shuffle."""
    picks = [F.min("id")] + [F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(1, STARS)]
    centres = posts.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("centres"))
    pairs = posts.join(centres, "key").select("id", F.explode("centres").alias("c")).where("id <> c")
    return pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def across(posts: DataFrame, roots: DataFrame, extra: tuple[str, ...] = (), condition: str = "true") -> DataFrame:
    """(a, b) of the lists (key, id, index) whose ids are in different components of ``roots`` (id, root); a is an index entry.

    ``condition`` is SQL on the ``extra`` columns, with a and b at the ends of their names, that every link meets.
    """
    placed = posts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    placed = placed.join(mixed, "key", "left_semi")
    left = placed.where("index").select("key", F.col("id").alias("a"), F.col("root").alias("ra"), *[F.col(c).alias(f"{c}a") for c in extra])
    right = placed.select("key", F.col("id").alias("b"), F.col("root").alias("rb"), "index", *[F.col(c).alias(f"{c}b") for c in extra])
    pairs = left.join(right, "key").where(f"ra <> rb and (not index or a < b) and {condition}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _spread(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, aren't stars yet: a node with a smaller neighbour has another neighbour."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 and n > 1").count() > 0


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b); the root is the smallest id that can be reached.

    Alternating large-star and small-star steps: each node's larger, then smaller, neighbours are linked to its
    smallest neighbour, until every link leads to a root. A step is a minimum by node and a join, so a node with many
    links is no list in one task, and the number of steps grows with the logarithm of the number of nodes. Each step
    is written, so that plans stay small: the driver plans them anew after each of their shuffles.
    """
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while _spread(edges):
        # the larger end of an edge goes to the smallest neighbour of the smaller one, or to that one if it has none
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = scratch.cut(edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")), "links")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        step = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.cut(step, "links")
        for done in (edges, large):
            scratch.drop(done)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
