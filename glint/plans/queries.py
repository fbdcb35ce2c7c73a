"""The registered queries, each beside its SQL for another engine. Numbers are rounded to six places in both."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.operators import geo, learning, metrics, quality, sampling, stats
from glint.plans import features as X
from glint.sources import tables, written
from glint.sources.tables import KEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def six(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + F.lit(0.0)).alias(name or c)


def sixes(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, *[six(c) for c in cols])


def _r(e: str, name: str) -> str:
    return f"round(({e})::double, 6) + 0::double AS {name}"


_KEY = ", ".join(KEY)
_OBS = "obs AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity AS copol, l_tax*100 AS xpol, l_discount AS snr, l_extendedprice/10 AS distance, (l_linenumber-1)::int AS lat, l_suppkey AS lon, l_returnflag, l_linestatus FROM lineitem)"
_VEC = "vec AS (SELECT vec_id, embedding, CASE WHEN label=0 THEN -1 WHEN label BETWEEN 1 AND 7 THEN label END AS code FROM embeddings), raw AS (SELECT vec_id, code, unnest(embedding)::double AS e, generate_subscripts(embedding,1) - 1 AS i FROM vec), cell AS (SELECT vec_id, code, abs(e) AS r, abs(e) + 1e-10 AS x, i FROM raw)"
_SCORES = "s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y, round(l_extendedprice*100)::bigint % 1000 AS p, (l_partkey*7919 + l_orderkey) % 1000 AS p2 FROM lineitem)"
_GAINS = "copol >= 5 AND xpol >= 5 AND distance BETWEEN 2000 AND 10000"


def _vectors(spark, d, wanted):
    return sixes(X.features(tables.vectors(spark, d), "ddm", ["vec_id"], 8, 8, wanted), ["vec_id"], wanted)


# ---- quality, labels, geometry --------------------------------------------------------------------------------------


@query(f"WITH {_OBS} SELECT {_KEY}, copol, snr FROM obs WHERE {_GAINS} AND snr > 0")
def q_quality_filtered(spark, d):
    return quality.quality(tables.observations(spark, d)).select(*KEY, "copol", "snr")


@query(f"WITH {_OBS} SELECT {_KEY}, copol, snr FROM obs WHERE {_GAINS}")
def q_quality_unfiltered(spark, d):
    return quality.quality(tables.observations(spark, d), "unfiltered").select(*KEY, "copol", "snr")


@query(f"WITH {_OBS} SELECT {_KEY}, lat, lon FROM obs WHERE {_GAINS} AND snr > 0 AND lat IS NOT NULL AND lon IS NOT NULL")
def q_quality_latlon(spark, d):
    return quality.quality(tables.observations(spark, d), "with_lat_lons").select(*KEY, "lat", "lon")


@query(f"WITH {_VEC} SELECT CASE WHEN coalesce(code,0) BETWEEN 1 AND 7 THEN 1 ELSE 0 END AS y, count(*) AS n FROM vec GROUP BY 1")
def q_label_counts(spark, d):
    return tables.vectors(spark, d).where(quality.valid_vector("ddm", 64)).groupBy(quality.binary_label(F.col("code")).alias("y")).agg(F.count("*").alias("n"))


@query(f"WITH {_VEC} SELECT CASE WHEN coalesce(code,0) = -1 THEN 0 ELSE coalesce(code,0) END AS y, count(*) AS n, {_r('count(*)::double / sum(count(*)) OVER ()', 'share')} FROM vec GROUP BY 1")
def q_label_proportions(spark, d):
    return stats.proportions(tables.vectors(spark, d).select(quality.multiclass_label(F.col("code")).alias("y")), "y").select("y", "n", six("share"))


_NAMES = "CASE coalesce(code,0) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in tables.SURFACES.items()) + " END"
_ANTS = "CASE vec_id % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in tables.ANTENNAS.items()) + " END"


@query(f"WITH {_VEC} SELECT vec_id, {_NAMES} AS surface, {_ANTS} AS antenna FROM vec")
def q_enum_decode(spark, d):
    v = tables.vectors(spark, d)
    return v.select("vec_id", tables.decode(quality.known_code(F.col("code")), tables.SURFACES).alias("surface"), tables.decode((F.col("vec_id") % 4).cast("int"), tables.ANTENNAS).alias("antenna"))


_DIST = "l_quantity*100 AS ac, l_tax*100 AS sp, (l_discount*500)::double AS inc"


@query(f"WITH t AS (SELECT {_KEY}, {_DIST} FROM lineitem) SELECT {_KEY}, {_r('(ac-sp)/cos(radians(inc))', 'slant')}, {_r('(ac-sp)*sin(radians(inc))/cos(radians(inc))', 'ground')} FROM t")
def q_distance(spark, d):
    t = tables.table(spark, d, "lineitem").select(*KEY, (F.col("l_quantity") * 100).alias("ac"), (F.col("l_tax") * 100).alias("sp"), (F.col("l_discount") * 500).alias("inc"))
    args = F.col("ac"), F.col("sp"), F.col("inc")
    return t.select(*KEY, six(quality.slant_distance(*args), "slant"), six(quality.ground_distance(*args), "ground"))


@query(f"WITH t AS (SELECT {_KEY}, {_DIST} FROM lineitem) SELECT count(*) AS n, count(*) FILTER (abs(sqrt(power((ac-sp)*sin(radians(inc))/cos(radians(inc)), 2) + power(ac-sp, 2)) - abs((ac-sp)/cos(radians(inc)))) > 1e-6) AS n_off FROM t")
def q_hypotenuse(spark, d):
    t = tables.table(spark, d, "lineitem").select((F.col("l_quantity") * 100).alias("ac"), (F.col("l_tax") * 100).alias("sp"), (F.col("l_discount") * 500).alias("inc"))
    args = F.col("ac"), F.col("sp"), F.col("inc")
    off = F.abs(quality.hypotenuse(quality.ground_distance(*args), F.col("ac") - F.col("sp")) - F.abs(quality.slant_distance(*args))) > 1e-6
    return t.agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"))


@query("SELECT event_id, strftime(ts + INTERVAL (user_id % 3600) SECOND, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def q_timestamp_add(spark, d):
    e = tables.table(spark, d, "events")
    return e.select("event_id", F.date_format(F.expr("timestampadd(SECOND, cast(user_id % 3600 as int), ts)"), "yyyy-MM-dd HH:mm:ss").alias("at"))


_SERIES = "e AS (SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, (user_id % 20)::int AS channel, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events)"
@query(f"WITH {_SERIES}, m AS (SELECT *, avg(v) OVER (PARTITION BY hour, channel) AS m FROM e) SELECT event_id, {_r('coalesce(v, m)', 'v')} FROM m WHERE m IS NOT NULL")
def q_fill_and_filter(spark, d):
    return quality.fill_and_filter(tables.series(spark, d), ["hour", "channel"], "v").select("event_id", six("v"))


@query("SELECT user_id, bool_or(c = -1) AND bool_or(c BETWEEN 1 AND 7) AS mixed FROM (SELECT user_id, (event_id % 9)::int - 1 AS c FROM events) GROUP BY 1")
def q_mixed_surface(spark, d):
    e = tables.table(spark, d, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 9).cast("int") - 1).alias("codes"))  # nine codes at most
    return e.select("user_id", quality.mixed_surface("codes").alias("mixed"))


# ---- features --------------------------------------------------------------------------------------------------------

_SUM = "sum(x)"
_G = f"g AS (SELECT vec_id, avg(x) AS m, sum(x) AS s, count(*) AS n FROM cell GROUP BY 1)"


@query(f"WITH {_VEC} SELECT vec_id, {_r('avg(x)', 'mean')}, {_r('stddev_pop(x)', 'std')}, {_r('min(x)', 'min')}, {_r('max(x)', 'max')}, {_r('quantile_cont(x, 0.5)', 'median')}, {_r('max(x) - min(x)', 'range')} FROM cell GROUP BY 1")
def q_features_basic(spark, d):
    return _vectors(spark, d, ["mean", "std", "min", "max", "median", "range"])


@query(f"WITH {_VEC}, {_G} SELECT c.vec_id, {_r('avg(power(x-m,3)) / power(avg(power(x-m,2)),1.5)', 'skew')}, {_r('avg(power(x-m,4)) / power(avg(power(x-m,2)),2) - 3', 'kurtosis')} FROM cell c JOIN g ON g.vec_id = c.vec_id GROUP BY 1")
def q_features_moments(spark, d):
    return _vectors(spark, d, ["skew", "kurtosis"])


@query(f"WITH {_VEC}, {_G}, o AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x) AS k FROM cell) SELECT o.vec_id, {_r('-sum(x/s*ln(x/s))', 'entropy')}, {_r('sum((2*k-n-1)*x) / (any_value(n)*any_value(s))', 'gini')} FROM o JOIN g ON g.vec_id = o.vec_id GROUP BY 1")
def q_features_entropy_gini(spark, d):
    return _vectors(spark, d, ["entropy", "gini"])


@query(f"WITH {_VEC}, c AS (SELECT vec_id, sum(i*x)/sum(x) AS com, max(x) AS top FROM cell GROUP BY 1) SELECT cell.vec_id, {_r('min(CASE WHEN x = top THEN i END)', 'peak_index')}, {_r('max(x)', 'peak_value')}, {_r('any_value(com)', 'center_of_mass')}, {_r('sum((i-com)*(i-com)*x)', 'inertia')} FROM cell JOIN c ON c.vec_id = cell.vec_id GROUP BY 1")
def q_features_position(spark, d):
    return _vectors(spark, d, ["peak_index", "peak_value", "center_of_mass", "inertia"])


def _segment_sql() -> str:
    from glint.functions.arrays import parts

    out = []
    for k, (s, n) in enumerate(parts(64, 3), 1):
        w = f"FILTER (WHERE i >= {s} AND i < {s + n})"
        out += [_r(f"sum(x) {w}", f"sum_third_{k}"), _r(f"avg(x) {w}", f"mean_third_{k}"), _r(f"max(x) {w}", f"max_third_{k}")]
    for k, (s, n) in enumerate(parts(64, 5), 1):
        w = f"FILTER (WHERE i >= {s} AND i < {s + n})"
        out += [_r(f"avg(x) {w}", f"mean_w{k}"), _r(f"stddev_pop(x) {w}", f"std_w{k}"), _r(f"max(x) {w}", f"max_w{k}")]
    return f"WITH {_VEC} SELECT vec_id, {', '.join(out)} FROM cell GROUP BY 1"


@query(_segment_sql())
def q_features_segments(spark, d):
    return _vectors(spark, d, [n for n in X.feature_names() if "_third_" in n or n[-3:-1] == "_w"])


_DX = f"WITH {_VEC}, dx AS (SELECT vec_id, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS x FROM cell)"


@query(f"{_DX} SELECT vec_id, {_r('avg(x)', 'mean_diff')}, {_r('stddev_pop(x)', 'std_diff')}, {_r('max(x)', 'max_diff')}, {_r('min(x)', 'min_diff')}, {_r('count(*) FILTER (WHERE x > 0)', 'n_positive_diff')}, {_r('count(*) FILTER (WHERE x < 0)', 'n_negative_diff')}, {_r('count(*) FILTER (WHERE x = 0)', 'n_zero_diff')} FROM dx WHERE x IS NOT NULL GROUP BY 1")
def q_features_diff(spark, d):
    return _vectors(spark, d, [n for n in X.feature_names() if n.endswith("_diff") and "center" not in n])


def _lag_sql() -> str:
    lags = ", ".join(f"lead(x, {k}) OVER (PARTITION BY vec_id ORDER BY i) AS x{k}" for k in (1, 2, 3))
    return f"WITH {_VEC}, l AS (SELECT vec_id, x, {lags} FROM cell) SELECT vec_id, " + ", ".join(_r(f"corr(x, x{k})", f"autocorr_lag{k}") for k in (1, 2, 3)) + " FROM l GROUP BY 1"


@query(_lag_sql())
def q_features_autocorr(spark, d):
    return _vectors(spark, d, ["autocorr_lag1", "autocorr_lag2", "autocorr_lag3"])


@query(f"WITH {_VEC}, k AS (SELECT unnest(range(32)) AS k), f AS (SELECT vec_id, k, sqrt(power(sum(x*cos(2*pi()*k*i/64)),2) + power(sum(x*sin(2*pi()*k*i/64)),2)) AS f FROM cell, k GROUP BY 1, 2), t AS (SELECT vec_id, max(f) AS top FROM f GROUP BY 1) SELECT f.vec_id, {_r('min(CASE WHEN f = top THEN k END)', 'fft_peak_freq')}, {_r('max(f)', 'fft_max')}, {_r('quantile_cont(f, 0.5)', 'fft_median')}, {_r('avg(f)', 'fft_mean')} FROM f JOIN t ON t.vec_id = f.vec_id GROUP BY 1")
def q_features_fft(spark, d):
    return _vectors(spark, d, ["fft_peak_freq", "fft_max", "fft_median", "fft_mean"])


def _region_sql() -> str:
    where = {r: f"i // 8 >= {a[0]} AND i // 8 < {a[1]} AND i % 8 >= {b[0]} AND i % 8 < {b[1]}" for r, (a, b) in X.region_bounds(8, 8).items()}
    rows = " UNION ALL ".join(f"SELECT vec_id, '{r}' AS g, r AS v FROM cell WHERE {w}" for r, w in where.items())
    return (
        f"{_VEC}, a AS ({rows}), b AS (SELECT vec_id, g, avg(v) AS m, sum(v) AS s, sum(v + 1e-10) AS e, count(*) AS n FROM a GROUP BY ALL), "
        "o AS (SELECT a.vec_id, a.g, v, m, s, e, n, row_number() OVER (PARTITION BY a.vec_id, a.g ORDER BY v) AS k FROM a JOIN b ON a.vec_id = b.vec_id AND a.g = b.g), "
        "st AS (SELECT vec_id, g, any_value(m) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median, max(v) - min(v) AS range, "
        "avg(power(v-m,3)) / power(avg(power(v-m,2)),1.5) AS skew, avg(power(v-m,4)) / power(avg(power(v-m,2)),2) - 3 AS kurtosis, -sum((v+1e-10)/e*ln((v+1e-10)/e)) AS entropy, sum((2*k-n-1)*v) / (any_value(n)*any_value(s)) AS gini FROM o GROUP BY ALL)"
    )


_PICK = {(r, s): f"max({s}) FILTER (WHERE g = '{r}')" for r in X.REGIONS for s in X.REGION_STATS}


@query(f"WITH {_region_sql()} SELECT vec_id, {', '.join(_r(e, f'{r}_{s}') for (r, s), e in _PICK.items())} FROM st GROUP BY 1")
def q_features_regions(spark, d):
    return _vectors(spark, d, [f"{r}_{s}" for r in X.REGIONS for s in X.REGION_STATS])


@query(f"WITH {_region_sql()} SELECT vec_id, " + ", ".join(_r(f"{_PICK[r, s]} - {_PICK['center', s]}", f"{r}_center_{s}_diff") for r in X.REGIONS[:4] for s in X.DIFF_STATS) + " FROM st GROUP BY 1")
def q_features_region_diffs(spark, d):
    return _vectors(spark, d, [f"{r}_center_{s}_diff" for r in X.REGIONS[:4] for s in X.DIFF_STATS])


@query(f"WITH {_VEC}, v AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM cell GROUP BY 1) SELECT (SELECT count(*) FROM embeddings) AS n, count(*) FILTER (isfinite(m) AND isfinite(lo) AND isfinite(hi) AND m > 0 AND s > 0) AS n_finite, {len(X.feature_names())} AS n_features FROM v")
def q_finite_mask(spark, d):
    names = X.feature_names()
    f = X.features(tables.vectors(spark, d), "ddm", ["vec_id"], 8, 8)
    left = X.only_finite(f, ["vec_id"], names).agg(F.count("*").alias("n_finite"))
    return tables.vectors(spark, d).agg(F.count("*").alias("n")).join(left, how="cross").withColumn("n_features", F.lit(len(names)))  # a row each


@query(f"WITH {_VEC}, v AS (SELECT vec_id, CASE WHEN coalesce(any_value(code),0) BETWEEN 1 AND 7 THEN 1 ELSE 0 END AS y, avg(x) AS m, stddev_pop(x) AS s, max(x) AS p FROM cell GROUP BY 1) SELECT y, count(*) AS n, {_r('avg(m)', 'mean')}, {_r('avg(s)', 'std')}, {_r('stddev_pop(p)', 'peak_spread')} FROM v GROUP BY 1")
def q_feature_table(spark, d):
    """The flagship: valid vectors, label, features, finite rows, and a summary by label."""
    v = tables.vectors(spark, d).where(quality.valid_vector("ddm", 64)).withColumn("y", quality.binary_label(F.col("code")))
    wanted = ["mean", "std", "min", "max", "median", "range", "skew", "kurtosis", "entropy", "gini", "peak_index", "peak_value", "center_of_mass", "inertia"]
    f = X.only_finite(X.features(v, "ddm", ["vec_id", "y"], 8, 8, wanted), ["vec_id", "y"], wanted)
    return f.groupBy("y").agg(F.count("*").alias("n"), six(F.avg("mean"), "mean"), six(F.avg("std"), "std"), six(F.stddev_pop("peak_value"), "peak_spread"))


# ---- statistics -------------------------------------------------------------------------------------------------------


def _vec_stat(spark, d) -> DataFrame:
    return tables.observations(spark, d).withColumn("land", F.col("l_linestatus") == "O")


@query(f"WITH {_OBS} SELECT {_r('avg(snr)', 'mean_all')}, {_r('stddev_pop(snr)', 'std_all')}, " + ", ".join(_r(f"{f}(snr) FILTER (WHERE l_linestatus {o} 'O')", f"{n}_{k}") for k, o in (("land", "="), ("sea", "<>")) for f, n in (("avg", "mean"), ("stddev_pop", "std"))) + " FROM obs")
def q_snr_by_surface(spark, d):
    o = _vec_stat(spark, d)
    of = lambda f, land: f(F.when(F.col("land") == land, F.col("snr")))
    return o.agg(six(F.avg("snr"), "mean_all"), six(F.stddev_pop("snr"), "std_all"), six(of(F.avg, True), "mean_land"), six(of(F.stddev_pop, True), "std_land"), six(of(F.avg, False), "mean_sea"), six(of(F.stddev_pop, False), "std_sea"))


_PAIRS = (("copol", "xpol"), ("copol", "snr"), ("snr", "distance"))


@query(f"WITH {_OBS}, a AS (SELECT 'all' AS part, * FROM obs UNION ALL SELECT CASE WHEN l_linestatus = 'O' THEN 'land' ELSE 'water' END, * FROM obs) SELECT part, " + ", ".join(_r(f"corr({x}, {y})", f"{x}_{y}") for x, y in _PAIRS) + " FROM a GROUP BY 1")
def q_corr_by_surface(spark, d):
    o = _vec_stat(spark, d).withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col("land"), "land").otherwise("water"))))
    return o.groupBy("part").agg(*[six(stats.correlation(F.col(x), F.col(y)), f"{x}_{y}") for x, y in _PAIRS])


@query(f"WITH {_OBS}, p AS (SELECT quantile_cont(distance, 0.95) AS p FROM obs) SELECT {_KEY}, {_r('least(greatest(distance, 0), p)', 'd')} FROM obs, p")
def q_percentile_clip(spark, d):
    o = tables.observations(spark, d)
    p = stats.quantiles(o, "distance", {"p": 0.95})
    return o.join(F.broadcast(p)).select(*KEY, six(F.least(F.greatest("distance", F.lit(0.0)), "p"), "d"))  # one row


@query(f"SELECT {_KEY}, {_r('row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber)::double / count(*) OVER ()', 'cdf')} FROM lineitem")
def q_cdf(spark, d):
    t = tables.table(spark, d, "lineitem").select(*KEY)
    return stats.ecdf(t, "l_extendedprice", KEY[:-1]).select(*KEY, six("cdf"))


@query(f"WITH {_OBS}, p AS (SELECT quantile_cont(distance, 0.33) AS a, quantile_cont(distance, 0.66) AS b FROM obs) SELECT CASE WHEN distance <= a THEN 'green' WHEN distance <= b THEN 'orange' ELSE 'red' END AS colour, count(*) AS n FROM obs, p GROUP BY 1")
def q_tercile(spark, d):
    o = tables.observations(spark, d)
    p = stats.quantiles(o, "distance", {"low": 0.33, "high": 0.66})
    return o.join(F.broadcast(p)).groupBy(stats.terciles(F.col("distance"), F.col("low"), F.col("high")).alias("colour")).agg(F.count("*").alias("n"))  # one row


@query(f"WITH {_SERIES} SELECT channel, count(*) AS n, count(*) - count(v) AS n_nan, {_r('(count(*) - count(v)) * 100.0 / count(*)', 'pct')}, {_r('min(v)', 'lo')}, {_r('max(v)', 'hi')}, {_r('avg(v)', 'mean')}, count(*) FILTER (WHERE v > 0) AS n_pos, count(*) FILTER (WHERE v <= 0) AS n_not FROM e GROUP BY 1")
def q_nan_profile(spark, d):
    v = F.when(~F.isnan("v"), F.col("v"))
    return tables.series(spark, d).groupBy("channel").agg(F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("n_nan"), six((F.count("*") - F.count(v)) * 100 / F.count("*"), "pct"), six(F.min(v), "lo"), six(F.max(v), "hi"), six(F.avg(v), "mean"), F.count_if(v > 0).alias("n_pos"), F.count_if(v <= 0).alias("n_not"))


@query("SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT c_custkey % 360 - 180 AS x, c_nationkey::bigint * 7 - 90 AS y FROM customer UNION ALL SELECT s_suppkey % 360 - 180, s_nationkey::bigint * 7 - 90 FROM supplier)")
def q_bbox(spark, d):
    return _points(spark, d).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _points(spark, d) -> DataFrame:
    place = lambda k, n: ((F.col(k) % 360) - 180, (F.col(n).cast("long") * 7) - 90)
    parts = []
    for name, k, n in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        x, y = place(k, n)
        parts.append(tables.table(spark, d, name).select(F.lit(name).alias("kind"), F.col(k).alias("id"), x.alias("x"), y.alias("y")))
    return parts[0].unionByName(parts[1])


@query(f"WITH {_SERIES} SELECT hour, {_r('avg(v)', 'mean')}, count(v) AS n FROM e GROUP BY 1")
def q_mean_by_time(spark, d):
    v = F.when(~F.isnan("v"), F.col("v"))
    return tables.series(spark, d).groupBy(F.date_format("hour", "yyyy-MM-dd HH").alias("hour")).agg(six(F.avg(v), "mean"), F.count(v).alias("n"))


@query(f"WITH {_SERIES}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY event_id) AS a, row_number() OVER (PARTITION BY channel ORDER BY event_id DESC) AS b FROM e WHERE v IS NOT NULL) SELECT channel, max(event_id) FILTER (WHERE a = 1) AS first_id, max(event_id) FILTER (WHERE b = 1) AS last_id FROM o GROUP BY 1")
def q_first_last(spark, d):
    s = tables.series(spark, d).where(~F.isnan("v"))
    return s.groupBy("channel").agg(F.min_by("event_id", "event_id").alias("first_id"), F.max_by("event_id", "event_id").alias("last_id"))


@query(f"WITH {_SCORES}, e AS (SELECT min(p) AS lo, max(p) AS hi, count(*) AS n FROM s) SELECT least(floor((p - lo) / ((hi - lo) / 50.0)), 49)::int AS bin, count(*) AS n, {_r('count(*) / (any_value(e.n) * (any_value(hi) - any_value(lo)) / 50.0)', 'density')} FROM s, e GROUP BY 1")
def q_histogram(spark, d):
    return stats.histogram(tables.scores(spark, d), "p", 50).select("bin", "n", six("density"))


@query(f"WITH {_SCORES} SELECT y, {_r('quantile_cont(p, 0.25)', 'q1')}, {_r('quantile_cont(p, 0.5)', 'q2')}, {_r('quantile_cont(p, 0.75)', 'q3')}, {_r('quantile_cont(p, 0.25) - 1.5 * (quantile_cont(p, 0.75) - quantile_cont(p, 0.25))', 'low')}, {_r('quantile_cont(p, 0.75) + 1.5 * (quantile_cont(p, 0.75) - quantile_cont(p, 0.25))', 'high')} FROM s GROUP BY 1")
def q_boxplot(spark, d):
    g = stats.quantiles(tables.scores(spark, d), "p", {"a": 0.25, "b": 0.5, "c": 0.75}, ["y"])
    q1, q2, q3 = F.col("a"), F.col("b"), F.col("c")
    return g.select("y", six(q1, "q1"), six(q2, "q2"), six(q3, "q3"), six(q1 - 1.5 * (q3 - q1), "low"), six(q3 + 1.5 * (q3 - q1), "high"))


@query(f"WITH {_SCORES}, b AS (SELECT unnest(range(5))::int AS bin) SELECT b.bin, count(s.y) AS n, {_r('coalesce(avg(CASE WHEN (p >= 500) <> (y = 1) THEN 1.0 ELSE 0.0 END) FILTER (WHERE s.y IS NOT NULL), 0)', 'error')} FROM b LEFT JOIN s ON p // 200 = b.bin GROUP BY 1")
def q_error_by_bin(spark, d):
    s = tables.scores(spark, d).groupBy(F.floor(F.col("p") / 200).cast("int").alias("b")).agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 500) != (F.col("y") == 1)).cast("double")).alias("e"))
    bins = spark.range(5).select(F.col("id").cast("int").alias("bin"))
    return bins.join(s, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), six(F.coalesce("e", F.lit(0.0)), "error"))


# ---- samples ----------------------------------------------------------------------------------------------------------

_IDS = KEY[:-1] + ["cents"]
_ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber, cents"
_T = f"t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice*100)::bigint AS cents, l_returnflag AS y FROM lineitem)"
_M = "md5(concat_ws(':', l_orderkey::varchar, l_partkey::varchar, l_suppkey::varchar, l_linenumber::varchar, cents::varchar, '42'))"
_RANK = f"r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_M}, {_ID}) AS k, count(*) OVER (PARTITION BY y) AS n FROM t)"


def _samples(spark, d) -> DataFrame:
    return tables.table(spark, d, "lineitem").select(*KEY[:-1], F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_returnflag").alias("y"))


def _quota(share: str, where: str = "true") -> str:
    return f"q0 AS (SELECT y, count(*) AS n FROM t WHERE {where} GROUP BY 1), q1 AS (SELECT y, n, ceil(round(sum(n) OVER () * {share}, 9)) AS total, n * ceil(round(sum(n) OVER () * {share}, 9)) / sum(n) OVER () AS ideal FROM q0), q2 AS (SELECT y, floor(ideal) AS base, row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, y) AS place, total - sum(floor(ideal)) OVER () AS more FROM q1), q AS (SELECT y AS qy, base + CASE WHEN place <= more THEN 1 ELSE 0 END AS quota FROM q2)"


@query(f"WITH {_T}, {_RANK} SELECT {_ID}, y FROM r WHERE k <= 500")
def q_balanced_sample(spark, d):
    return sampling.balanced(_samples(spark, d), _IDS, "y", 500)


@query(f"WITH {_T}, {_RANK}, {_quota('0.2::double')} SELECT {_ID}, y FROM r JOIN q ON qy = y WHERE k <= quota")
def q_stratified_sample(spark, d):
    return sampling.stratified_sample(_samples(spark, d), _IDS, "y", 0.2)


@query(f"WITH {_T}, c AS (SELECT y AS cy, count(*) AS n FROM t GROUP BY 1), rare AS (SELECT cy FROM c WHERE n = (SELECT min(n) FROM c)), {_RANK}, {_quota('0.1::double', 'y NOT IN (SELECT cy FROM rare)')} SELECT {_ID}, y FROM t WHERE y IN (SELECT cy FROM rare) UNION ALL SELECT {_ID}, y FROM r JOIN q ON qy = y WHERE k <= quota")
def q_rare_preserving(spark, d):
    return sampling.rare_preserving(_samples(spark, d), _IDS, "y", 0.1)


@query(f"WITH {_T} SELECT {_ID}, y FROM t ORDER BY {_M}, {_ID} LIMIT 1000")
def q_uniform_sample(spark, d):
    return sampling.uniform(_samples(spark, d), _IDS, 1000)


@query(f"WITH {_T}, {_RANK}, {_quota('0.2::double')} SELECT y, count(*) FILTER (WHERE k <= quota) AS n_test, count(*) FILTER (WHERE k > quota) AS n_train, sum(cents) FILTER (WHERE k <= quota)::bigint AS test_cents FROM r JOIN q ON qy = y GROUP BY 1")
def q_train_test_split(spark, d):
    s = sampling.stratified(_samples(spark, d), _IDS, "y", 0.2)
    return s.groupBy("y").agg(F.count_if("picked").alias("n_test"), F.count_if(~F.col("picked")).alias("n_train"), F.sum(F.when(F.col("picked"), F.col("cents"))).alias("test_cents"))


@query(f"WITH {_T}, {_RANK} SELECT {_ID}, y, ((k - 1) % 5)::int AS fold FROM r")
def q_kfold(spark, d):
    return sampling.kfold(_samples(spark, d), _IDS, "y")


_MS = _M.replace("'42'", "subset::varchar, '42'")


@query(f"WITH {_T}, u AS (SELECT t.*, s.subset FROM t, (SELECT unnest(range(1, 11))::int AS subset) s), r AS (SELECT *, row_number() OVER (PARTITION BY subset, y ORDER BY {_MS}, {_ID}) AS k FROM u) SELECT subset, y, count(*) AS n, sum(cents)::bigint AS cents FROM r WHERE k <= least(25000, (SELECT min(c) FROM (SELECT count(*) AS c FROM t GROUP BY y))) GROUP BY 1, 2")
def q_balanced_subsets(spark, d):
    return sampling.balanced_subsets(_samples(spark, d), _IDS, "y").groupBy("subset", "y").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def _poisson(mean: float) -> str:
    steps, term, total = [], math.exp(-mean), 0.0
    for k in range(1, 17):
        total += term
        steps.append(total)
        term *= mean / k
    return " + ".join(f"(u >= {s!r}::double)::int" for s in steps)


@query(f"WITH {_T}, m AS (SELECT *, ('0x' || substr({_M}, 1, 12))::bigint::double / {float(1 << 48)}::double AS u FROM t), n AS (SELECT *, {_poisson(0.5)} AS n FROM m) SELECT {_ID}, y, unnest(range(1, n + 1))::int AS copy FROM n")
def q_sample_with_replacement(spark, d):
    return sampling.with_replacement(_samples(spark, d), _IDS, 0.5)


# ---- scaling, encoding, joins, sets ---------------------------------------------------------------------------------------


@query(f"WITH {_OBS} SELECT {_KEY}, {_r('(copol - avg(copol) OVER ()) / stddev_pop(copol) OVER ()', 'copol')}, {_r('(snr - avg(snr) OVER ()) / stddev_pop(snr) OVER ()', 'snr')} FROM obs")
def q_standard_scale(spark, d):
    return sixes(stats.standard_scale(tables.observations(spark, d).select(*KEY, "copol", "snr"), ["copol", "snr"]), KEY, ["copol", "snr"])


@query(f"WITH {_OBS} SELECT {_KEY}, {_r('(copol - min(copol) OVER ()) / (max(copol) OVER () - min(copol) OVER ())', 'copol')} FROM obs")
def q_minmax_scale(spark, d):
    return sixes(stats.minmax_scale(tables.observations(spark, d).select(*KEY, "copol"), ["copol"]), KEY, ["copol"])


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::int AS code FROM orders")
def q_label_encode(spark, d):
    return stats.label_encode(tables.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query(f"WITH {_SERIES}, m AS (SELECT quantile_cont(v, 0.5) AS m FROM e) SELECT event_id, {_r('coalesce(v, m)', 'v')} FROM e, m")
def q_median_impute(spark, d):
    return stats.median_impute(tables.series(spark, d).select("event_id", "v"), "v").select("event_id", six("v"))


_IMP = "(SELECT p_partkey AS feature, p_retailprice AS base, p_size::double AS final FROM part)"


@query(f"SELECT feature, {_r('base', 'base')}, {_r('final', 'final')}, {_r('final - base', 'change')}, {_r('(final - base) / (base + 1e-8) * 100', 'pct')}, {_r('CASE WHEN base > 0 THEN (final - base) / base * 100 ELSE 0 END', 'relative')} FROM {_IMP}")
def q_importance_join(spark, d):
    p = tables.table(spark, d, "part")
    joined = p.select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("base")).join(p.select(F.col("p_partkey").alias("feature"), F.col("p_size").cast("double").alias("final")), "feature")
    change = F.col("final") - F.col("base")
    return joined.select("feature", six("base"), six("final"), six(change, "change"), six(change / (F.col("base") + 1e-8) * 100, "pct"), six(F.when(F.col("base") > 0, change / F.col("base") * 100).otherwise(0.0), "relative"))


@query(f"SELECT feature, {_r('final - base', 'change')} FROM {_IMP} ORDER BY abs(final - base) DESC, feature LIMIT 10")
def q_topk_change(spark, d):
    p = tables.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_size").cast("double") - F.col("p_retailprice")).alias("change"))
    return p.orderBy(F.desc(F.abs("change")), "feature").limit(10).select("feature", six("change"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def q_semi(spark, d):
    keep = tables.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(keep, "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def q_anti(spark, d):
    drop = tables.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(drop, "o_orderkey", "left_anti")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_custkey % 360 - 180 AS x, c_nationkey::bigint * 7 - 90 AS y FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_suppkey % 360 - 180, s_nationkey::bigint * 7 - 90 FROM supplier")
def q_union_all(spark, d):
    return _points(spark, d)


@query("SELECT c.c_custkey AS id, n_nationkey AS polygon FROM (SELECT c_custkey, c_custkey % 360 - 180 AS x, c_nationkey::bigint * 7 - 90 AS y FROM customer) c JOIN nation ON x > n_nationkey * 12 - 180 AND x < n_nationkey * 12 - 150 AND y > n_nationkey * 6 - 90 AND y < n_nationkey * 6 - 60")
def q_point_in_polygon(spark, d):
    n = tables.table(spark, d, "nation")
    x, y = F.col("n_nationkey") * 12.0 - 180, F.col("n_nationkey") * 6.0 - 90
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(30, 0), corner(30, 30), corner(0, 30), corner(0, 0))
    return geo.contained(_points(spark, d).where("kind = 'customer'"), n.select(F.col("n_nationkey").alias("id"), ring.alias("ring")), "id")


_HOLES = "shapes AS (SELECT n_nationkey AS id, n_nationkey * 12 - 180 AS x0, n_nationkey * 12 - 150 AS x1, n_nationkey * 6 - 90 AS y0, n_nationkey * 6 - 60 AS y1, n_nationkey * 12 - 170 AS hx0, n_nationkey * 12 - 157 AS hx1, n_nationkey * 6 - 80 AS hy0, n_nationkey * 6 - 69 AS hy1 FROM nation UNION ALL SELECT 100 + r_regionkey, -175 - r_regionkey, 170, -85, 85 - r_regionkey, -100, 10 * r_regionkey, -40, 40 FROM region)"


@query(f"WITH {_HOLES} SELECT c_custkey AS id, s.id AS polygon FROM (SELECT c_custkey, c_custkey % 360 - 180 AS x, c_nationkey::bigint * 7 - 90 AS y FROM customer) c JOIN shapes s ON x > x0 AND x < x1 AND y > y0 AND y < y1 AND NOT (x BETWEEN hx0 AND hx1 AND y BETWEEN hy0 AND hy1)")
def q_points_in_shapes(spark, d):
    """Customers in shapes with holes, from a nation's to nearly the whole map."""
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), *[(F.col("n_nationkey") * m + a).alias(c) for c, m, a in (("x0", 12, -180), ("x1", 12, -150), ("y0", 6, -90), ("y1", 6, -60), ("hx0", 12, -170), ("hx1", 12, -157), ("hy0", 6, -80), ("hy1", 6, -69))])
    k = F.col("r_regionkey")
    r = tables.table(spark, d, "region").select((k + 100).cast("int").alias("id"), *[v.alias(c) for c, v in (("x0", -175 - k), ("x1", F.lit(170)), ("y0", F.lit(-85)), ("y1", 85 - k), ("hx0", F.lit(-100)), ("hx1", 10 * k), ("hy0", F.lit(-40)), ("hy1", F.lit(40)))])
    corner = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    ring = lambda p: F.array(corner(f"{p}x0", f"{p}y0"), corner(f"{p}x1", f"{p}y0"), corner(f"{p}x1", f"{p}y1"), corner(f"{p}x0", f"{p}y1"), corner(f"{p}x0", f"{p}y0"))
    shapes = n.unionByName(r).select("id", F.array(ring(""), ring("h")).alias("rings"))
    return geo.within(_points(spark, d).where("kind = 'customer'"), shapes, "id")


# ---- scores ---------------------------------------------------------------------------------------------------------------

_CM = "count(*) FILTER (WHERE y=1 AND h=1) AS tp, count(*) FILTER (WHERE y=0 AND h=0) AS tn, count(*) FILTER (WHERE y=0 AND h=1) AS fp, count(*) FILTER (WHERE y=1 AND h=0) AS fn"
_AT = "a AS (SELECT *, CASE WHEN p >= 500 THEN 1 ELSE 0 END AS h FROM s)"


def _at_half(spark, d) -> DataFrame:
    return tables.scores(spark, d).withColumn("yhat", (F.col("p") >= 500).cast("int"))


@query(f"WITH {_SCORES}, {_AT} SELECT {_CM} FROM a")
def q_confusion(spark, d):
    return metrics.confusion(_at_half(spark, d), "y", "yhat")


@query(f"WITH {_SCORES}, {_AT} SELECT y, h AS yhat, {_r('count(*)::double / sum(count(*)) OVER (PARTITION BY y)', 'share')} FROM a GROUP BY 1, 2")
def q_confusion_norm(spark, d):
    from pyspark.sql import Window

    n = _at_half(spark, d).groupBy("y", "yhat").agg(F.count("*").alias("n"))
    return n.select("y", "yhat", six(F.col("n") / F.sum("n").over(Window.partitionBy("y")), "share"))


_THRESHOLDS = [10 * i for i in range(1, 100)]


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::double / ({b}) END"


def _metric_sql() -> dict[str, str]:
    out = {"accuracy": _div("tp+tn", "tp+tn+fp+fn"), "precision": _div("tp", "tp+fp"), "recall": _div("tp", "tp+fn"), "specificity": _div("tn", "tn+fp"), "npv": _div("tn", "tn+fn")}
    out["balanced_accuracy"] = f"({out['recall']} + {out['specificity']}) / 2"
    for k, b in metrics.BETAS.items():
        out[k] = _div(f"{1 + b * b}::double*tp", f"({1 + b * b}::double*tp + {b * b}::double*fn + fp)")
    out["mcc"] = _div("tp::double*tn - fp::double*fn", "(sqrt((tp+fp)::double)*sqrt((tp+fn)::double)*sqrt((tn+fp)::double)*sqrt((tn+fn)::double))")
    return out


_METRIC = _metric_sql()
_SWEEP = f"WITH {_SCORES}, g AS (SELECT unnest(range(10, 1000, 10))::int AS threshold), d AS (SELECT p, y, count(*) AS n FROM s GROUP BY 1, 2), cm AS (SELECT threshold, coalesce(sum(n) FILTER (WHERE y=1 AND p>=threshold),0) AS tp, coalesce(sum(n) FILTER (WHERE y=0 AND p<threshold),0) AS tn, coalesce(sum(n) FILTER (WHERE y=0 AND p>=threshold),0) AS fp, coalesce(sum(n) FILTER (WHERE y=1 AND p<threshold),0) AS fn FROM g, d GROUP BY 1), m AS (SELECT threshold, tp::bigint AS tp, tn::bigint AS tn, fp::bigint AS fp, fn::bigint AS fn, " + ", ".join(f"({e}) AS {k}" for k, e in _METRIC.items()) + " FROM cm)"
_COLS = list(_METRIC)


def _swept(spark, d) -> DataFrame:
    return metrics.sweep(tables.scores(spark, d), "y", "p", _THRESHOLDS)


@query(f"{_SWEEP} SELECT threshold, tp, tn, fp, fn, " + ", ".join(_r(c, c) for c in _COLS) + " FROM m")
def q_threshold_sweep(spark, d):
    return sixes(_swept(spark, d), ["threshold", "tp", "tn", "fp", "fn"], _COLS)


@query(f"{_SWEEP} SELECT threshold, {_r('f1', 'f1')} FROM m ORDER BY round(m.f1, 9) DESC, threshold LIMIT 1")
def q_threshold_optimum(spark, d):
    return metrics.optimum(_swept(spark, d), "f1").select("threshold", six("f1"))


_CUSTOM = "precision*0.5::double + recall*0.3::double + specificity*0.2::double - (fp*0.1::double + fn*0.2::double)/(tp+tn+fp+fn)"


@query(f"{_SWEEP} SELECT threshold, {_r(_CUSTOM, 'custom')} FROM m")
def q_custom_metric(spark, d):
    c = metrics.custom_metric({"precision": 5.0, "recall": 3.0, "specificity": 2.0}, 0.1, 0.2)
    return _swept(spark, d).select("threshold", six(c, "custom"))


_SIX = ["accuracy", "precision", "recall", "specificity", "f1", "mcc"]


@query(_SWEEP + " " + " UNION ALL ".join(f"(SELECT '{s}' AS strategy, threshold, {', '.join(_r(c, c) for c in _SIX)} FROM m ORDER BY round(m.{k}, 9) DESC, threshold LIMIT 1)" for s, k in metrics.STRATEGIES.items()))
def q_strategies(spark, d):
    from functools import reduce

    swept = _swept(spark, d)
    each = [metrics.optimum(swept, k).select(F.lit(s).alias("strategy"), "threshold", *[six(c) for c in _SIX]) for s, k in metrics.STRATEGIES.items()]
    return reduce(DataFrame.unionByName, each)


_BETAS = list(metrics.BETAS)


@query(f"{_SWEEP}, u AS (" + " UNION ALL ".join(f"SELECT '{b}' AS beta, threshold, {b} AS v FROM m" for b in _BETAS) + f"), o AS (SELECT *, row_number() OVER (PARTITION BY beta ORDER BY round(v, 9) DESC, threshold) AS k FROM u) SELECT beta, threshold, {_r('v', 'v')} FROM o WHERE k = 1")
def q_beta_sensitivity(spark, d):
    from pyspark.sql import Window

    u = _swept(spark, d).unpivot(["threshold"], _BETAS, "beta", "v")
    best = Window.partitionBy("beta").orderBy(F.desc(F.round("v", 9)), "threshold")
    return u.withColumn("k", F.row_number().over(best)).where("k = 1").select("beta", "threshold", six("v"))


@query(f"{_SWEEP} SELECT threshold, {_r('tp*1::double + tn*0.5::double - fp*2::double - fn*4::double', 'cost')} FROM m")
def q_business_cost(spark, d):
    return _swept(spark, d).select("threshold", six(metrics.business_cost(1, 0.5, -2, -4), "cost"))


_ROC = f"WITH {_SCORES}, d AS (SELECT p, sum(y)::bigint AS pos, (count(*) - sum(y))::bigint AS neg FROM s GROUP BY 1), c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC)::double AS tp, sum(neg) OVER (ORDER BY p DESC)::double AS fp, sum(pos) OVER ()::double AS np, sum(neg) OVER ()::double AS nn FROM d)"


@query(f"{_ROC} SELECT {_r('sum(pos*((nn - fp) + neg/2.0::double))/(sum(pos)*sum(neg))', 'roc_auc')} FROM c")
def q_roc_auc(spark, d):
    return metrics.roc_auc(tables.scores(spark, d), "y", "p").select(six("roc_auc"))


@query(f"{_ROC} SELECT {_r('sum(pos/np*(tp/(tp+fp)))', 'average_precision')} FROM c")
def q_average_precision(spark, d):
    return metrics.average_precision(tables.scores(spark, d), "y", "p").select(six("average_precision"))


@query(f"{_ROC}, l AS (SELECT tp/np AS r, tp/(tp+fp) AS pr, coalesce(lag(tp/np) OVER (ORDER BY p DESC),0) AS r0, coalesce(lag(tp/(tp+fp)) OVER (ORDER BY p DESC),1) AS p0 FROM c) SELECT {_r('sum((r-r0)*(pr+p0)/2)', 'pr_area')} FROM l")
def q_pr_area(spark, d):
    return metrics.pr_area(tables.scores(spark, d), "y", "p").select(six("pr_area"))


@query(f"{_ROC} SELECT p AS threshold, {_r('tp/np', 'tpr')}, {_r('fp/nn', 'fpr')}, {_r('tp/(tp+fp)', 'precision')} FROM c")
def q_roc_points(spark, d):
    return sixes(metrics.roc_points(tables.scores(spark, d), "y", "p"), ["threshold"], ["tpr", "fpr", "precision"])


@query(f"{_ROC} SELECT p AS threshold, {_r('tp/np - fp/nn', 'j')} FROM c ORDER BY round(tp/np - fp/nn, 9) DESC, p DESC LIMIT 1")
def q_youden(spark, d):
    return metrics.youden(tables.scores(spark, d), "y", "p").select("threshold", six("j"))


@query(f"WITH {_SCORES} SELECT (CASE WHEN p = 0 THEN 0 ELSE (p - 1) // 100 END)::int AS bin, {_r('avg(p)/1000', 'mean_p')}, {_r('avg(y)', 'share')}, count(*) AS n FROM s GROUP BY 1")
def q_calibration(spark, d):
    return metrics.calibration(tables.scores(spark, d), "y", "p").select("bin", six("mean_p"), six("share"), "n")


@query(f"WITH {_SCORES} SELECT {_KEY}, greatest(p, p2) AS p_vote, CASE WHEN p >= p2 THEN 'p' ELSE 'p2' END AS model FROM s")
def q_voting(spark, d):
    return metrics.voting(tables.scores(spark, d), "p", "p2").select(*KEY, "p_vote", "model")


def _report_sql() -> str:
    each = f"e AS (SELECT c::varchar AS label, {_div('hit', 'said')} AS precision, {_div('hit', 'support')} AS recall, {_div('2*hit', 'said+support')} AS f1, support FROM (SELECT c, count(*) FILTER (WHERE y=c) AS support, count(*) FILTER (WHERE h=c) AS said, count(*) FILTER (WHERE y=c AND h=c) AS hit FROM a, (SELECT unnest([0,1]) AS c) GROUP BY 1))"
    cols = "precision", "recall", "f1"
    rows = [f"SELECT label, {', '.join(_r(c, c) for c in cols)}, support::bigint AS support FROM e", f"SELECT 'accuracy', NULL, NULL, {_r('sum(recall*support)/sum(support)', 'f1')}, sum(support)::bigint FROM e", f"SELECT 'macro avg', {', '.join(_r(f'avg({c})', c) for c in cols)}, sum(support)::bigint FROM e", f"SELECT 'weighted avg', {', '.join(_r(f'sum({c}*support)/sum(support)', c) for c in cols)}, sum(support)::bigint FROM e"]
    return f"WITH {_SCORES}, {_AT}, {each} " + " UNION ALL ".join(rows)


@query(_report_sql())
def q_class_report(spark, d):
    return metrics.class_report(_at_half(spark, d), "y", "yhat").select("label", six("precision"), six("recall"), six("f1"), "support")


@query(f"WITH {_SCORES}, v AS (SELECT y, greatest(p, p2) AS p FROM s), t AS (SELECT unnest([500, 550]) AS threshold), a AS (SELECT threshold, y, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS h FROM v, t), cm AS (SELECT threshold, {_CM} FROM a GROUP BY 1) SELECT threshold, " + ", ".join(_r(_METRIC[c], c) for c in _SIX) + " FROM cm")
def q_compare_thresholds(spark, d):
    v = metrics.voting(tables.scores(spark, d), "p", "p2")
    return metrics.sweep(v, "y", "p_vote", [500, 550]).select("threshold", *[six(c) for c in _SIX])


@query(_SWEEP + " " + " UNION ALL ".join(f"(SELECT '{n}' AS best, threshold FROM m ORDER BY round({e}, 9) DESC, threshold LIMIT 1)" for n, e in (("recall", "recall"), ("f1", "f1"), ("product", "precision*recall"))))
def q_best_of(spark, d):
    from functools import reduce

    swept = _swept(spark, d).withColumn("product", F.col("precision") * F.col("recall"))
    return reduce(DataFrame.unionByName, [metrics.optimum(swept, c).select(F.lit(c).alias("best"), "threshold") for c in ("recall", "f1", "product")])


@query(f"WITH {_SCORES}, {_AT}, b AS (SELECT l_linenumber AS subset, avg(CASE WHEN y = h THEN 1.0::double ELSE 0 END) AS acc, {_CM} FROM a GROUP BY 1) SELECT {_r('avg(acc)', 'mean')}, {_r('stddev_pop(acc)', 'spread')}, floor(avg(tp))::bigint AS tp, floor(avg(tn))::bigint AS tn, floor(avg(fp))::bigint AS fp, floor(avg(fn))::bigint AS fn FROM b")
def q_subset_accuracy(spark, d):
    c = metrics.confusion(_at_half(spark, d), "y", "yhat", ["l_linenumber"])
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.agg(six(F.avg(acc), "mean"), six(F.stddev_pop(acc), "spread"), *[F.avg(k).cast("long").alias(k) for k in ("tp", "tn", "fp", "fn")])


@query(f"WITH {_SCORES}, {_AT}, x AS (SELECT y AS c, count(*) AS actual FROM a GROUP BY 1), z AS (SELECT h AS c, count(*) AS predicted FROM a GROUP BY 1) SELECT coalesce(x.c, z.c) AS c, coalesce(actual, 0) AS actual, coalesce(predicted, 0) AS predicted FROM x FULL JOIN z ON x.c = z.c")
def q_actual_predicted(spark, d):
    a = _at_half(spark, d)
    x, z = a.groupBy(F.col("y").alias("c")).agg(F.count("*").alias("actual")), a.groupBy(F.col("yhat").alias("c")).agg(F.count("*").alias("predicted"))
    return x.join(z, "c", "full").fillna(0)


@query(f"SELECT {_r('abs(corr(p_size, p_retailprice))', 'size_price')}, {_r('count(DISTINCT p_brand)::double / count(*)', 'brand_share')} FROM part")
def q_param_importance(spark, d):
    p = tables.table(spark, d, "part")
    return p.agg(six(F.abs(stats.correlation(F.col("p_size").cast("double"), F.col("p_retailprice"))), "size_price"), six(F.countDistinct("p_brand") / F.count("*"), "brand_share"))


# ---- models: results depend on the library's own fits, so rows only -----------------------------------------------------------

_FIT = ["mean", "std", "skew", "kurtosis", "entropy", "gini", "peak_index", "center_of_mass", "autocorr_lag1"]


def _training(spark, d) -> DataFrame:
    v = tables.vectors(spark, d).withColumn("y", quality.binary_label(F.col("code")))
    f = X.features(v, "ddm", ["vec_id", "y"], 8, 8, _FIT)
    return stats.standard_scale(written.write(X.only_finite(f, ["vec_id", "y"], _FIT), "training"), _FIT).withColumn("y", F.col("y").cast("double"))


@query()
def q_pca(spark, d):
    out, _ = learning.pca(_training(spark, d), _FIT)
    return out.select("vec_id", "pc1", "pc2")


@query()
def q_rf(spark, d):
    t = learning.assembled(_training(spark, d), _FIT)
    return learning.scored(learning.forest(numTrees=20).fit(t), t).select("vec_id", "y", "yhat", "p1")


@query()
def q_gbt(spark, d):
    t = sampling.stratified(_training(spark, d), ["vec_id"], "y", 0.2).withColumnRenamed("picked", "validation")
    t = learning.assembled(t, _FIT)
    return learning.scored(learning.boosted(early_stop=True, maxIter=10, maxDepth=3).fit(t), t).select("vec_id", "y", "yhat", "p1")


@query()
def q_cv_search(spark, d):
    t = learning.assembled(sampling.kfold(_training(spark, d), ["vec_id"], "y", 3), _FIT)
    est = learning.forest()
    tried = learning.random_params(est, {"numTrees": ("int", 5, 20), "maxDepth": ("int", 2, 6), "subsamplingRate": ("uniform", 0.5, 0.5)}, 3)
    best = learning.search(t, est, tried)
    rows = [(i, float(a), {p.name: float(v) for p, v in c.items()}) for i, (a, c) in enumerate(zip(best.avgMetrics, tried, strict=True))]
    return spark.createDataFrame(rows, "candidate int, auc double, params map<string, double>")


@query()
def q_finalize(spark, d):
    """A model is tuned on half of the rows and saved with its parameters; these are read back and fitted on all rows."""
    t = _training(spark, d)
    half = sampling.stratified(t, ["vec_id"], "y", 0.5).where("picked")
    path = f"{written.folder(spark)}/glint-model-{uuid.uuid4().hex}"
    fit = stats.scale_fit(half, _FIT)
    learning.save(learning.forest(numTrees=10, maxDepth=4).fit(learning.assembled(stats.scaled(half, fit, _FIT), _FIT)), path, fit)
    return learning.finalise_saved(path, learning.forest(), t, _FIT)[1]
