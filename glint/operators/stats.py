"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.sources import written

#: So many counted values at most are summed in one task for each group.
FEW = 1 << 16


def proportions(df: DataFrame, y: str) -> DataFrame:
    n = df.groupBy(y).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, NULL with a constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx == 0) | (sy == 0), None).otherwise(F.try_divide(F.covar_pop(x, y), sx * sy))


def edges(df: DataFrame, x: str, ranges: int = 256) -> DataFrame:
    """One row ``edges``: at most ``ranges`` - 1 ascending cuts of x with about as many rows between any two."""
    cuts = F.percentile_approx(x, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges))
    return df.agg(F.array_distinct(F.coalesce(cuts, F.array().cast(f"array<{df.schema[x].dataType.simpleString()}>"))).alias("_edges"))


def _range_of(x: str, cuts: str) -> Column:
    return F.size(F.filter(cuts, lambda e: e < F.col(x)))


def prefixed(counted: DataFrame, x: str, sums: list[str], by: list[str] | None = None, ranges: int = 256) -> DataFrame:
    """``counted`` (a row for each x within ``by``, no null or NaN x) with ``below_c`` and ``all_c`` of each c in ``sums``: c
    summed over the smaller x, and over all x, within ``by``.

    ``counted`` is worked out once and written. If it has at most ``FEW`` rows these are summed as they are; else sums run inside
    ranges of x within ``by`` and are moved on by the totals of the ranges below (``ranges`` rows for each ``by``), so no task
    holds all values. Both give the same.
    """
    by = by or []
    names = counted.columns
    counted = written.write(counted, "counted")
    if counted.count() <= FEW:
        everyone = Window.partitionBy(*by)
        below = everyone.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        return counted.select(*names, *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"below_{c}") for c in sums], *[F.sum(c).over(everyone).alias(f"all_{c}") for c in sums])
    ranged = counted.join(F.broadcast(edges(counted, x, ranges))).withColumn("_part", _range_of(x, "_edges")).drop("_edges")  # one row
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    before, everyone = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)
    keys = [*by, "_part"]
    moved = totals.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(keys)], *[(F.sum(c).over(before) - F.col(c)).alias(f"_before_{c}") for c in sums], *[F.sum(c).over(everyone).alias(f"all_{c}") for c in sums])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    near = ranged.join(moved if by else F.broadcast(moved), same)  # ``ranges`` rows
    inside = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    below = [(F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"below_{c}") for c in sums]
    return near.select(*names, *below, *[f"all_{c}" for c in sums])


def quantiles(df: DataFrame, x: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``by`` and a column for each name of ``probs``: the exact quantile of x (null and NaN left out), linear between neighbours.

    Values are counted first; only the two values around each rank are looked at. Without any value a quantile is NULL
    (no row at all with ``by``).
    """
    by = by or []
    valid = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    counted = valid.groupBy(*by, x).agg(F.count("*").alias("_c"))
    placed = prefixed(counted, x, ["_c"], by)
    out = []
    for name, q in probs.items():
        k = (F.col("all__c") - 1) * F.lit(float(q))
        at = lambda r: F.max(F.when((F.col("below__c") <= r) & (r < F.col("below__c") + F.col("_c")), F.col(x).cast("double")))
        low, high = at(F.floor(k)), at(F.ceil(k))
        out.append((low + (high - low) * F.max(k - F.floor(k))).alias(name))
    return placed.groupBy(*by).agg(*out)


def ecdf(df: DataFrame, x: str, keys: list[str], ranges: int | None = None, steps: str | None = None) -> DataFrame:
    """Each row's ``cdf`` i / n (or, in a column named by ``steps``, i) in ascending order of x; equal values get steps of their own, in order of the keys.

    Rows are sorted by ranges of (x, keys), numbered within their range as they are written, and moved on by the rows of the ranges
    below; no task sorts all rows, whatever value they share.
    """
    dealt = df.repartitionByRange(ranges, x, *keys) if ranges else df.repartitionByRange(x, *keys)
    # the upper bits of the id are the task, the lower 33 count its rows
    rows = written.write(dealt.sortWithinPartitions(x, *keys).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    counts = rows.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    near = rows.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return near.select(*df.columns, place.alias(steps) if steps else (place / F.col("_all")).alias("cdf"))


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """bin, n, density of equal widths from the least to the largest value, the last bin closed."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("all"))
    counted = df.groupBy(x).agg(F.count("*").alias("n")).where(F.col(x).isNotNull())
    each = counted.join(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.floor(F.try_divide(F.col(x) - F.col("lo"), width)), F.lit(bins - 1))
    return each.groupBy(F.coalesce(bin_, F.lit(0)).cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.try_divide(F.sum("n"), F.first("all") * F.first(width)).alias("density"))


def terciles(x: Column, low: Column, high: Column) -> Column:
    return F.when(x <= low, "green").when(x <= high, "orange").otherwise("red")


def scale_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population standard deviation of each column, in one pass."""
    return df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])


def scaled(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / deviation by the row of ``scale_fit``; a constant's deviation counts as 1."""
    near = df.join(F.broadcast(fit))  # one row
    unit = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return near.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / unit(c) for c in cols}).select(*df.columns)


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return scaled(df, scale_fit(df, cols), cols)


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """To 0..1; a constant gives 0."""
    fit = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = df.join(F.broadcast(fit))  # one row
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)))
    return out.select(*df.columns)


def label_encode(df: DataFrame, c: str, to: str) -> DataFrame:
    """Numbers from 0 in order of the values as strings. The distinct values are sorted by ranges, numbered as they are written, and joined."""
    values = df.select(F.col(c).cast("string").alias("_v")).distinct()
    codes = ecdf(values, "_v", [], steps="_step").select("_v", (F.col("_step") - 1).cast("int").alias(to))
    return df.join(codes, F.col(c).cast("string").eqNullSafe(F.col("_v"))).drop("_v")


def median_impute(df: DataFrame, c: str) -> DataFrame:
    m = quantiles(df, c, {"_median": 0.5})
    return df.join(F.broadcast(m)).withColumn(c, F.coalesce(F.when(~F.isnan(c), F.col(c)), "_median")).drop("_median")  # one row
