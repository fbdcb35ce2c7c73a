"""Delay-Doppler maps: a row for each time, holding one rows x columns map for each channel.

All of it is local to the row (arrays of a time's 20 or so channels), so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source variables and the names of the 16 columns of the exploration frame.
EDA_COLUMNS = {
    "ddm_timestamp_utc": "Timestamp",
    "ddm": "DDM Channel",
    "ddm_ant": "DDM Antenna",
    "ac_alt": "Aircraft altitude",
    "ac_lat": "Aircraft latitude",
    "ac_lon": "Aircraft longitude",
    "sp_alt": "Specular point altitude",
    "sp_lat": "Specular point latitude",
    "sp_lon": "Specular point longitude",
    "sp_inc_angle": "Specular point incidence angle",
    "sp_surface_type": "Surface type",
    "fresnel_major": "Fresnel major axis",
    "fresnel_minor": "Fresnel minor axis",
    "fresnel_orientation": "Fresnel orientation",
    "ddm_snr": "DDM SNR",
    "ddm_noise_floor": "DDM noise floor",
}


def _valid(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def nan_to_zero(cells: str) -> Column:
    """An array's null and NaN values as 0."""
    return F.transform(cells, lambda v: F.when(_valid(v), v).otherwise(F.lit(0.0)))


def by_channel(df: DataFrame, maps: str = "ddm", per_channel: tuple[str, ...] = ()) -> DataFrame:
    """A row for each time and ``channel`` (from 0): the channel's map as one array in row order, its element of each array in
    ``per_channel``, and all other columns repeated. A time without channels gives no row; a shorter array gives NULLs."""
    rest = [c for c in df.columns if c not in (maps, *per_channel)]
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(maps, *per_channel)).alias("channel", "_of"))
    return zipped.select(*rest, "channel", F.flatten(F.col("_of")[maps]).alias(maps), *[F.col("_of")[c].alias(c) for c in per_channel])


def fill_and_filter(df: DataFrame, maps: str = "ddm") -> tuple[DataFrame, DataFrame]:
    """(kept, lost). In ``kept`` the maps are arrays in row order; a channel whose map has no valid cell has, cell by cell, the
    mean of the time's other maps, and ``filled`` says so for each channel. Maps with some NaN stay as they are, and a cell that
    is NaN in all of them is NaN in the mean. ``lost`` are the times without any valid map, untouched.
    """
    has = F.exists(F.flatten(F.flatten(maps)), _valid)
    flat = df.where(has).withColumn("_flat", F.transform(maps, F.flatten))
    empty = F.transform("_flat", lambda m: ~F.coalesce(F.exists(m, _valid), F.lit(False)))
    good = flat.withColumn("filled", empty).withColumn("_good", F.filter("_flat", lambda m: F.exists(m, _valid)))
    values = lambda i: F.filter(F.transform("_good", lambda m: m[i]), _valid)
    mean = lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) / F.size(vs)).otherwise(F.lit(float("nan")))
    cells = F.sequence(F.lit(0), F.size(F.col("_good")[0]) - 1)
    with_mean = good.withColumn("_mean", F.transform(F.transform(cells, values), mean))
    filled = F.zip_with("_flat", "filled", lambda m, e: F.when(e, F.col("_mean")).otherwise(m))
    return with_mean.withColumn(maps, filled).drop("_flat", "_good", "_mean"), df.where(~F.coalesce(has, F.lit(False)))


def eda_frame(df: DataFrame) -> DataFrame:
    """The 16 columns of the exploration frame under their readable names; ``df`` has the source variables, one row for each time and channel."""
    return df.select(*[F.col(c).cast("long").alias(n) if c == "ac_alt" else F.col(c).alias(n) for c, n in EDA_COLUMNS.items()])


def coverage(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time and the number of rows."""
    return df.agg(F.min(ts).alias("coverage_start"), F.max(ts).alias("coverage_end"), F.count("*").alias("n"))


def overflows(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: for each column whether a value is infinite or at least the largest double, and ``found``, whether any has one."""
    over = lambda c: ~F.isnan(c) & (F.abs(c) >= F.lit(1.7976931348623157e308))
    each = df.agg(*[F.coalesce(F.bool_or(over(F.col(c).cast("double"))), F.lit(False)).alias(c) for c in cols])
    return each.withColumn("found", F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0]))


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right, and whether the two sides fit one to one."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    n = lambda c: F.count_if(c).alias
    both = a.join(b, key, "full").agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull())("both"), n(F.col("_b").isNull())("only_left"), n(F.col("_a").isNull())("only_right"), F.coalesce(F.max(F.greatest("_a", "_b")), F.lit(1)).alias("_most"))
    return both.select("both", "only_left", "only_right", ((F.col("only_left") + F.col("only_right") == 0) & (F.col("_most") <= 1)).alias("one_to_one"))
