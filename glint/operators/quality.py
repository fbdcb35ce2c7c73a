"""Quality masks, labels, geometry and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("filtered", "unfiltered", "with_lat_lons", "with_lat_lons_time")


def present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def quality(df: DataFrame, mode: str = "filtered") -> DataFrame:
    """Gains of at least 5, a positive signal-to-noise ratio (not in mode ``unfiltered``), 2 to 10 km; no null or NaN."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    need = ["copol", "xpol", "distance"] + ["snr"] * (mode != "unfiltered") + ["lat", "lon"] * mode.startswith("with_lat_lons") + ["ts"] * mode.endswith("time")
    keep = (F.col("copol") >= 5) & (F.col("xpol") >= 5) & F.col("distance").between(2000, 10000)
    if mode != "unfiltered":
        keep = keep & (F.col("snr") > 0)
    for c in need:
        keep = keep & (present(c) if c != "ts" else F.col(c).isNotNull())
    return df.where(keep)


def valid_vector(ddm: str, n: int | None = None) -> Column:
    """No null or NaN cell, a positive sum, and n cells if n is given."""
    ok = ~F.exists(ddm, lambda v: v.isNull() | F.isnan(v)) & (F.aggregate(ddm, F.lit(0.0), lambda a, v: a + v) > 0)
    return ok & (F.size(ddm) == n) if n else ok


def known_code(code: Column) -> Column:
    return F.coalesce(code, F.lit(0)).cast("int")


def binary_label(code: Column) -> Column:
    """1 on land (codes 1 to 7, inland water included), else 0."""
    return known_code(code).between(1, 7).cast("int")


def multiclass_label(code: Column) -> Column:
    return F.when(known_code(code) == -1, 0).otherwise(known_code(code))


def slant_distance(ac_alt: Column, sp_alt: Column, inc: Column) -> Column:
    return F.try_divide(ac_alt - sp_alt, F.cos(F.radians(inc)))


def ground_distance(ac_alt: Column, sp_alt: Column, inc: Column) -> Column:
    return F.try_divide((ac_alt - sp_alt) * F.sin(F.radians(inc)), F.cos(F.radians(inc)))


def hypotenuse(ground: Column, height: Column) -> Column:
    return F.sqrt(ground * ground + height * height)


def fill_and_filter(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """NaN or null values get the mean of the group's valid ones; groups without any are dropped."""
    valid = F.when(present(value), F.col(value))
    everyone = Window.partitionBy(*group)
    return df.withColumn("_n", F.count(valid).over(everyone)).withColumn("_mean", F.avg(valid).over(everyone)).where("_n > 0").withColumn(value, F.coalesce(valid, "_mean")).drop("_n", "_mean")


def mixed_surface(codes: str) -> Column:
    """Whether a time's codes have ocean and land."""
    return F.exists(codes, lambda c: c == -1) & F.exists(codes, lambda c: c.between(1, 7))
