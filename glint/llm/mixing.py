"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words. Sources share the total size of all documents by weight; a target stops at
``max_epochs`` times its source's size and the excess goes to the other sources by weight. Each source first gives
whole epochs (every document once in each), then a weighted sample without replacement for the rest of its target:
documents in ascending order of ``-ln(u) / quality``, taken while their prefix sum is within the budget; the document
at the edge gives only the words that are left, so a source's taken words equal its target to the nearest word.

The prefix sum is in two steps: sums by (source, range of keys), then row by row inside the one range that holds the
edge. So a source with a third of all rows is never sorted in one task.

Defined cases: null text has size 0, quality is then least; null source is a source, the last; sources without words
have target 0; equal keys are ordered by doc_id, size and the text's hash, and rows equal in all three are
interchangeable; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096


def quality(text: Column) -> Column:
    """From 0.1 to 1: the share of a text's characters that are neither symbols nor digits."""
    odd = F.length(text) - F.length(F.translate(text, "#*$%&|<>0123456789", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.9) * odd.cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double"), F.lit(0.1))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends only on the key and the seed."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sources: DataFrame, weights: list[float], max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Sources are filled in ascending order of cap / weight: one is at its cap if its share of what is left by weight
    would reach it, and from the first that isn't on, all get the same amount for each unit of weight.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = sources.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("place")).withColumn("weight", w)
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", "place")
    everyone = Window.partitionBy()
    ranked = ranked.withColumn("left", F.sum("source_size").over(everyone).cast("double") - (F.sum("cap").over(order) - F.col("cap")))
    ranked = ranked.withColumn("unit", F.col("left") / (F.sum("weight").over(everyone) - (F.sum("weight").over(order) - F.col("weight"))))
    level = F.max(F.when(F.col("fill") > F.col("unit"), F.col("unit"))).over(everyone)  # the unit falls again after the first
    first = F.min(F.when(F.col("fill") > F.col("unit"), F.col("fill"))).over(everyone)
    return ranked.withColumn("target", F.when(F.col("fill") >= first, F.least(F.col("cap"), F.col("weight") * level)).otherwise(F.col("cap"))).select("source", "source_size", "weight", "target")


def plan(docs: DataFrame, weights: list[float], max_epochs: int = 3, seed: str = "mix:") -> DataFrame:
    """doc_id, source, size, source_size, weight, target, epochs, taken for each row of docs."""
    text = F.col("text").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.ln(uniform(F.col("doc_id"), seed)) / quality(text)).alias("key"), F.xxhash64(text).alias("tie"),
    )
    sized = scratch.cut(sized.withColumn("range", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int")), "mix")
    in_range = scratch.cut(sized.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    aims = targets(in_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.floor(target / size.cast("double") + 1e-9)).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.round(target).cast("long") - F.col("epochs") * size, F.lit(0).cast("long")))
    ranges = in_range.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words"))
    edge = ranges.alias("r").join(aims.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")), "right").groupBy("a.source", "source_size", "weight", "target", "epochs", "budget").agg(
        F.max(F.when(F.col("before") < F.col("budget"), F.struct("range", "before"))).alias("edge"),
    )
    edge = edge.select(F.col("source").alias("of"), "source_size", "weight", "target", "epochs", "budget", F.coalesce("edge.range", F.lit(-1)).alias("edge"), F.coalesce("edge.before", F.lit(0)).alias("before"))
    edge = scratch.cut(edge, "mix-edge")  # a row for each source, which two joins read
    rows = sized.join(edge, F.col("source").eqNullSafe(F.col("of")))
    inside = F.col("range") == F.col("edge")
    whole = rows.where(~inside).withColumn("part", F.when(F.col("range") < F.col("edge"), F.col("size")).otherwise(0))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = rows.where(inside).withColumn("part", F.greatest(F.least(F.col("size"), F.col("budget") - running), F.lit(0)))
    return whole.unionByName(cut).select("doc_id", "source", "size", "source_size", "weight", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "tie")


def mixed(docs: DataFrame, weights: list[float], max_epochs: int = 3, seed: str = "mix:") -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each time it is taken; at a source's edge, its first words up to the budget."""
    names = docs.columns
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}  # so that no further column has a name used here
    text = at["text"].cast("string")
    planned = plan(docs, weights, max_epochs, seed).select("doc_id", "source", "tie", "size", "taken")
    planned = planned.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "tie", "size").orderBy(F.col("taken").desc())))
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy(at["doc_id"], at["source"], F.xxhash64(text)).orderBy(F.lit(0))))
    same = at["doc_id"].cast("long").eqNullSafe(F.col("doc_id")) & at["source"].cast("string").eqNullSafe(F.col("source")) & (F.xxhash64(text) == F.col("tie")) & (F.col("own") == F.col("nth"))
    repeats = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> least(size, taken - (i - 1) * size))")
    out = rows.join(planned.where("taken > 0"), same).withColumn("words", F.explode(repeats))
    whole = F.col("words") == F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    new = {"text": F.when(whole, text).otherwise(head)}
    if "n_chars" in at:
        new["n_chars"] = F.when(whole, at["n_chars"]).otherwise(F.length(new["text"]))
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else at[c]).alias(c) for c in names])
