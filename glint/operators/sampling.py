"""Reproducible samples and splits, ordered by the md5 of a key.

Ranks within a class come from a window over (class, salt) and the salts' counts, so a class with most of the rows isn't
sorted in one task: md5's first digits are the salt, and order by salt then md5 is order by md5.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.operators.stats import ecdf

#: Up to this many classes their counts by salt (256 rows each) are broadcast.
SMALL = 1024


def order(keys: list[str], seed: str = "42") -> Column:
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(seed)))


def ranked(df: DataFrame, keys: list[str], by: list[str] | None = None, seed: str = "42", upto: int | None = None, small: bool = False) -> DataFrame:
    """With ``_rank`` (from 1) in md5 order within ``by``, and ``_size``, the rows of it.

    With ``upto``, only rows of salts that hold a rank up to it (all of these, and some more): others never reach the sort.
    ``small``: the caller has checked that the counts (256 for each ``by``) may be broadcast.
    """
    by = by or []
    df = df.withColumn("_md5", order(keys, seed)).withColumn("_salt", F.substring("_md5", 1, 2))
    counts = df.groupBy(*by, "_salt").agg(F.count("*").alias("_n"))  # 256 rows a class
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_salt")) - F.col("_n")).withColumn("_size", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    keyed = before.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate([*by, "_salt"])], "_before", "_size")
    if upto is not None:
        keyed = keyed.where(F.col("_before") < upto)
    same = F.lit(True)
    for i, c in enumerate([*by, "_salt"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    near = df.join(F.broadcast(keyed) if small or not by else keyed, same)  # without classes, 256 rows
    place = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_md5", *keys))
    return near.withColumn("_rank", F.col("_before") + place).drop("_md5", "_salt", "_before", *[f"_of_{i}" for i in range(len(by) + 1)])


def _classes(df: DataFrame, y: str) -> tuple:
    """Number of classes, rows of the smallest, and which that is."""
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    return tuple(counts.agg(F.count("*"), F.coalesce(F.min("_n"), F.lit(0)), F.min_by(y, "_n")).first())


def balanced(df: DataFrame, keys: list[str], y: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each class; ValueError if one has fewer. n <= 0: all rows."""
    if n <= 0:
        return df
    classes, least, which = _classes(df, y)
    if classes and least < n:
        raise ValueError(f"class {which} has {least} rows, fewer than {n}")
    return ranked(df, keys, [y], seed, n, classes <= SMALL).where(F.col("_rank") <= n).drop("_rank", "_size")


def shares(sizes: DataFrame, fraction: float) -> DataFrame:
    """(class, quota) of (_y, n): ceil(fraction * rows) split by largest remainder, ties to the smaller class."""
    everyone = Window.partitionBy()
    ideal = sizes.withColumn("total", F.ceil(F.round(F.sum("n").over(everyone) * F.lit(fraction), 9))).withColumn("ideal", F.col("n") * F.col("total") / F.sum("n").over(everyone))
    ideal = ideal.withColumn("base", F.floor("ideal")).withColumn("left", F.col("total") - F.sum("base").over(everyone))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("ideal") - F.col("base"), 9)), "_y"))
    return ideal.select("_y", (F.col("base") + (place <= F.col("left")).cast("long")).alias("quota"))


def quotas(df: DataFrame, y: str, fraction: float) -> DataFrame:
    return shares(df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("n")), fraction)


def three_way(df: DataFrame, keys: list[str], y: str, test: float = 0.2, val: float = 0.2, seed: str = "42") -> DataFrame:
    """With ``part``: 'test' is a stratified share of all rows, 'val' one of the rest, 'train' what is left. Rows are ranked once."""
    sizes = df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("n"))
    first = shares(sizes, test)
    taken = first.select(F.col("_y").alias("_z"), "quota")
    rest = sizes.join(taken, F.col("_y").eqNullSafe(F.col("_z"))).select("_y", (F.col("n") - F.col("quota")).alias("n"))
    second = shares(rest, val).select("_y", F.col("quota").alias("_more"))
    both = second.join(taken, F.col("_y").eqNullSafe(F.col("_z"))).drop("_z")
    r = ranked(df, keys, [y], seed).join(F.broadcast(both), F.col(y).eqNullSafe(F.col("_y")))  # a row for each class
    part = F.when(F.col("_rank") <= F.col("quota"), "test").when(F.col("_rank") <= F.col("quota") + F.col("_more"), "val").otherwise("train")
    return r.withColumn("part", part).select(*df.columns, "part")


def holdout(df: DataFrame, keys: list[str], y: str, fraction: float | None = None, seed: str = "42") -> DataFrame:
    """With ``picked``, the rows held out when a model is finalised: a stratified ``fraction``, by default about 100 rows but at
    most a tenth, and none of 100 rows or fewer."""
    if fraction is None:
        n = df.count()
        fraction = min(0.1, 100 / n) if n > 100 else 0.0
    return stratified(df, keys, y, fraction, seed)


def stratified(df: DataFrame, keys: list[str], y: str, fraction: float, seed: str = "42") -> DataFrame:
    """All rows with ``picked``: whether they are in the stratified sample (the others are its complement)."""
    q = quotas(df, y, fraction)
    r = ranked(df, keys, [y], seed)
    return r.join(F.broadcast(q), F.col(y).eqNullSafe(F.col("_y"))).withColumn("picked", F.col("_rank") <= F.col("quota")).drop("_rank", "_size", "_y", "quota")  # a row for each class


def rare_preserving(df: DataFrame, keys: list[str], y: str, fraction: float, seed: str = "42") -> DataFrame:
    """All rows of the classes with the fewest rows, and a stratified sample of the others."""
    sizes = df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("n")).withColumn("rare", F.col("n") == F.min("n").over(Window.partitionBy()))
    marked = df.join(F.broadcast(sizes), F.col(y).eqNullSafe(F.col("_y"))).drop("_y", "n")
    rest = stratified(marked.where("not rare").drop("rare"), keys, y, fraction, seed).where("picked").drop("picked")
    return marked.where("rare").drop("rare").unionByName(rest)


def stratified_sample(df: DataFrame, keys: list[str], y: str, fraction: float, seed: str = "42") -> DataFrame:
    """Only the picked rows of ``stratified``; salts beyond the largest quota never reach the sort."""
    q = quotas(df, y, fraction)
    classes, most = q.agg(F.count("*"), F.coalesce(F.max("quota"), F.lit(0))).first()
    r = ranked(df, keys, [y], seed, most, classes <= SMALL)
    return r.join(F.broadcast(q), F.col(y).eqNullSafe(F.col("_y"))).where(F.col("_rank") <= F.col("quota")).select(*df.columns)  # a row for each class


def uniform(df: DataFrame, keys: list[str], n: int, seed: str = "42") -> DataFrame:
    """n rows (all, if fewer), the first by md5."""
    return ranked(df, keys, seed=seed, upto=n).where(F.col("_rank") <= n).drop("_rank", "_size")


def first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows in order of the keys; rows are sorted and numbered by ranges, never in one task."""
    return ecdf(df, keys[0], keys[1:], steps="_step").where(F.col("_step") <= n).drop("_step")


def with_replacement(df: DataFrame, keys: list[str], fraction: float, seed: str = "42") -> DataFrame:
    """Each row as many times as a Poisson count of mean ``fraction`` (at most 1) says; the count comes from the row's md5, so reruns agree.

    ``copy`` numbers a row's repetitions from 1. Counts over 16 (a chance below 1e-14) are cut.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be over 0 and at most 1")
    steps, term, total = [], math.exp(-fraction), 0.0
    for k in range(1, 17):
        total += term
        steps.append(total)
        term *= fraction / k
    u = F.conv(F.substring(order(keys, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)
    times = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= u))
    return df.withColumn("copy", times).where("copy > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy"))))


def kfold(df: DataFrame, keys: list[str], y: str, k: int = 5, seed: str = "42") -> DataFrame:
    """With ``fold`` (0 to k - 1), stratified by class."""
    return ranked(df, keys, [y], seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def narrow_folds(df: DataFrame, keys: list[str], y: str, cols: list[str], k: int = 5, seed: str = "42") -> DataFrame:
    """y, cols and ``fold`` as ``kfold`` deals it, without the keys: a row is sorted with the bytes of its md5 alone. For keys that are numbers, and few classes.

    Rows that share keys, y and fold have a common ``twin``; it is null in all others.
    """
    hexed, empty = order(keys, seed), reduce(or_, [F.col(c).isNull() for c in keys])
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in keys])  # which are missing: md5 alone doesn't tell
    digest = F.when(empty, F.concat(F.unhex(hexed), nulls.cast("binary"))).otherwise(F.unhex(hexed))
    rows = df.select(y, *cols, digest.alias("_md5"), F.conv(F.substring(hexed, 1, 2), 16, 10).cast("short").alias("_salt"))
    counts = rows.groupBy(y, "_salt").agg(F.count("*").alias("_n"))  # 256 rows a class
    before = counts.select(F.col(y).alias("_y"), F.col("_salt").alias("_of"), (F.sum("_n").over(Window.partitionBy(y).orderBy("_salt")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy(y, "_salt").orderBy("_md5")
    same = lambda other: F.coalesce(other("_md5", k).over(w) == F.col("_md5"), F.lit(False))
    placed = rows.withColumn("_place", F.row_number().over(w)).withColumn("twin", F.when(same(F.lag) | same(F.lead), F.col("_md5")))
    near = placed.join(F.broadcast(before), F.col(y).eqNullSafe(F.col("_y")) & (F.col("_salt") == F.col("_of")))
    return near.select(y, *cols, ((F.col("_before") + F.col("_place") - 1) % k).cast("int").alias("fold"), "twin")


def balanced_subsets(df: DataFrame, keys: list[str], y: str, subsets: int = 10, per_class: int = 25_000) -> DataFrame:
    """``subsets`` independent draws, each with the same number of rows (per_class at most) of each class."""
    classes, least, _ = _classes(df, y)
    n = min(least, per_class)
    many = df.withColumn("subset", F.explode(F.sequence(F.lit(1), F.lit(subsets))))
    return ranked(many, [*keys, "subset"], ["subset", y], upto=n, small=classes * subsets <= SMALL).where(F.col("_rank") <= n).drop("_rank", "_size")


def identical_subsets(df: DataFrame, keys: list[str], subset: str = "subset") -> DataFrame:
    """(a, b, same) for each two subsets, a < b: whether they hold the same rows, by count and the sums of two hashes of the keys."""
    h = F.xxhash64(*keys)
    digest = F.struct(F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("z"), F.bit_xor(h).alias("w"))
    each = df.groupBy(subset).agg(digest.alias("d"))  # a row for each subset
    a, b = each.select(F.col(subset).alias("a"), F.col("d").alias("da")), each.select(F.col(subset).alias("b"), F.col("d").alias("db"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (F.col("da") == F.col("db")).alias("same"))
