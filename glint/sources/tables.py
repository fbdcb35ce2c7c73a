"""Sources and sinks. Parquet is the store; the stand-ins derive observations, vectors and scores from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
#: Variables that an input must have.
REQUIRED = {"raw_counts", "ac_alt", "sp_alt", "sp_inc_angle", "sp_rx_gain_copol", "sp_rx_gain_xpol", "ddm_snr"}
#: Surface and antenna codes.
SURFACES = {-1: "Ocean", 0: "NaN", 1: "Artifical", 2: "Barely vegetated", 3: "Inland water", 4: "Crop", 5: "Grass", 6: "Shrub", 7: "Forest"}
ANTENNAS = {0: "None", 1: "Zenith", 2: "LHCP", 3: "RHCP"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, root: str, suffix: str = ".parquet", pick: int | None = None, seed: int = 42) -> DataFrame:
    """All files below ``root`` with the suffix, or ``pick`` of them in the order of a seeded md5 of their names; files that can't be read are skipped."""
    reader = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    if pick is None:
        return reader.parquet(root)
    names = reader.format("binaryFile").load(root).select("path").orderBy(F.md5(F.concat("path", F.lit(str(seed))))).limit(pick)
    return reader.parquet(*[r.path for r in names.collect()])  # ``pick`` names


def check_integrity(df: DataFrame, required: set[str] = REQUIRED, arrays: tuple[str, ...] = ("raw_counts",)) -> None:
    """Raise ValueError if a required column is missing or one of ``arrays`` isn't an array."""
    if missing := sorted(required - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    if flat := [a for a in arrays if a in df.columns and df.schema[a].dataType.typeName() != "array"]:
        raise ValueError(f"not arrays: {flat}")


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def decode(code: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: gains, signal-to-noise ratio, distance, and a surface code from the line's flags."""
    return table(spark, sf_dir, "lineitem").select(
        *KEY, F.col("l_quantity").alias("copol"), (F.col("l_tax") * 100).alias("xpol"), F.col("l_discount").alias("snr"), (F.col("l_extendedprice") / 10).alias("distance"),
        (F.col("l_linenumber") - 1).cast("int").alias("lat"), F.col("l_suppkey").alias("lon"), "l_returnflag", "l_linestatus", F.col("l_shipdate").alias("ts"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 power vectors with surface codes (0 is ocean, 8 and 9 unknown)."""
    code = F.when(F.col("label") == 0, -1).when(F.col("label").between(1, 7), F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("ddm"), code.cast("int").alias("code"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored observations; p and p2 are two models' scores in thousandths."""
    p = F.round(F.col("l_extendedprice") * 100).cast("long") % 1000
    p2 = (F.col("l_partkey") * 7919 + F.col("l_orderkey")) % 1000
    return table(spark, sf_dir, "lineitem").select(*KEY, (F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p"), p2.alias("p2"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as 20 channels' values by hour; every 17th is NaN."""
    value = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"), F.col("ts"), (F.col("user_id") % 20).cast("int").alias("channel"), value.alias("v"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as times of at most 20 channels: an 8 x 8 map and a code for each, an altitude for all; some maps have NaN
    in one cell, some in all, and every 11th time has no valid map."""
    t, channel = F.floor(F.col("vec_id") / 20), F.col("vec_id") % 20
    nan = F.lit(float("nan"))
    none = (F.col("vec_id") % 7 == 3) | (t % 11 == 5)
    cells = F.transform("embedding", lambda v, i: F.when(none | ((F.col("vec_id") % 13 == 1) & (i == 0)), nan).otherwise(F.abs(v.cast("double"))))
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("cells", r * 8 + 1, 8))
    rows = table(spark, sf_dir, "embeddings").select(t.cast("long").alias("t"), channel.cast("int").alias("channel"), cells.alias("cells"), F.col("label").alias("code"))
    one = rows.select("t", F.struct("channel", grid.alias("ddm"), "code").alias("of"))
    times = one.groupBy("t").agg(F.array_sort(F.collect_list("of")).alias("of"))  # 20 at most
    return times.select("t", (F.col("t") * 10).alias("ac_alt"), F.col("of.ddm").alias("ddm"), F.col("of.code").alias("code"))


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under the names of the source variables."""
    at = F.date_format(F.expr("timestampadd(SECOND, cast(l_orderkey % 3600 as int), l_shipdate)"), "yyyy-MM-dd HH:mm:ss")
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        at.alias("ddm_timestamp_utc"), c("l_linenumber").alias("ddm"), (c("l_suppkey") % 4).alias("ddm_ant"), c("l_quantity").alias("ac_alt"), c("l_discount").alias("ac_lat"), c("l_tax").alias("ac_lon"),
        c("l_extendedprice").alias("sp_alt"), (-c("l_discount")).alias("sp_lat"), (-c("l_tax")).alias("sp_lon"), c("l_quantity").alias("sp_inc_angle"), (c("l_partkey") % 9 - 1).alias("sp_surface_type"),
        (c("l_extendedprice") / 2).alias("fresnel_major"), (c("l_extendedprice") / 4).alias("fresnel_minor"), (c("l_partkey") % 180).alias("fresnel_orientation"), c("l_discount").alias("ddm_snr"), c("l_tax").alias("ddm_noise_floor"),
    )
