"""Registered queries on delay-Doppler maps and on the frames made of them, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glint.operators import maps, quality, sampling
from glint.plans import features as X
from glint.plans.queries import _OBS, _VEC, _r, query, six
from glint.sources import tables

_CELLS = "c0 AS (SELECT vec_id, vec_id // 20 AS t, (vec_id % 20)::int AS channel, label, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT t, channel, label, i, CASE WHEN vec_id % 7 = 3 OR t % 11 = 5 OR (vec_id % 13 = 1 AND i = 0) THEN NULL ELSE abs(e) END AS v FROM c0)"


@query(f"WITH {_CELLS} SELECT t, channel, any_value(label) AS code, t * 10 AS ac_alt, count(*)::int AS n_cells, {_r('coalesce(max(v) FILTER (WHERE i = 0), 0)', 'first')}, {_r('coalesce(max(v) FILTER (WHERE i = 63), 0)', 'last')}, {_r('coalesce(sum(v), 0)', 'total')} FROM c GROUP BY t, channel")
def q_map_channels(spark, d):
    rows = maps.by_channel(tables.tracks(spark, d), per_channel=("code",)).withColumn("ddm", maps.nan_to_zero("ddm"))
    total = F.aggregate("ddm", F.lit(0.0), lambda a, v: a + v)
    return rows.select("t", "channel", "code", "ac_alt", F.size("ddm").alias("n_cells"), six(F.col("ddm")[0], "first"), six(F.col("ddm")[63], "last"), six(total, "total"))


_FILLED = f"{_CELLS}, m AS (SELECT t, i, avg(v) AS m FROM c GROUP BY t, i), g AS (SELECT t, channel, count(v) = 0 AS filled FROM c GROUP BY t, channel), k AS (SELECT t FROM c GROUP BY t HAVING count(v) > 0)"


@query(f"WITH {_FILLED}, w AS (SELECT c.t, c.channel, g.filled, CASE WHEN g.filled THEN m.m ELSE c.v END AS v FROM c JOIN g ON c.t = g.t AND c.channel = g.channel JOIN m ON c.t = m.t AND c.i = m.i WHERE c.t IN (SELECT t FROM k)) SELECT t, channel, filled, (count(*) - count(v))::int AS n_nan, {_r('coalesce(sum(v), 0)', 'total')} FROM w GROUP BY 1, 2, 3")
def q_fill_maps(spark, d):
    kept, _ = maps.fill_and_filter(tables.tracks(spark, d))
    rows = kept.select("t", F.posexplode(F.arrays_zip("ddm", "filled")).alias("channel", "of")).select("t", "channel", "of.*")
    total = F.aggregate(maps.nan_to_zero("ddm"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("t", "channel", "filled", F.size(F.filter("ddm", lambda v: F.isnan(v))).alias("n_nan"), six(total, "total"))


@query(f"WITH {_CELLS} SELECT t FROM c GROUP BY t HAVING count(v) = 0")
def q_lost_times(spark, d):
    return maps.fill_and_filter(tables.tracks(spark, d))[1].select("t")


_VARIABLES = {
    "ddm_timestamp_utc": "strftime(l_shipdate + INTERVAL (l_orderkey % 3600) SECOND, '%Y-%m-%d %H:%M:%S')", "ddm": "l_linenumber", "ddm_ant": "l_suppkey % 4", "ac_alt": "trunc(l_quantity)::bigint", "ac_lat": "l_discount", "ac_lon": "l_tax",
    "sp_alt": "l_extendedprice", "sp_lat": "-l_discount", "sp_lon": "-l_tax", "sp_inc_angle": "l_quantity", "sp_surface_type": "l_partkey % 9 - 1",
    "fresnel_major": "l_extendedprice / 2", "fresnel_minor": "l_extendedprice / 4", "fresnel_orientation": "l_partkey % 180", "ddm_snr": "l_discount", "ddm_noise_floor": "l_tax",
}


@query("SELECT " + ", ".join(f'{e} AS "{maps.EDA_COLUMNS[c]}"' for c, e in _VARIABLES.items()) + " FROM lineitem")
def q_eda_frame(spark, d):
    return maps.eda_frame(tables.variables(spark, d))


@query(f"WITH {_VEC}, f AS (SELECT vec_id AS id, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS max FROM cell GROUP BY 1) SELECT vec_id, " + ", ".join(_r(f"abs(embedding[{i + 1}]::double)", f"cell_{i}") for i in range(64)) + f", {_r('mean', 'mean')}, {_r('std', 'std')}, {_r('max', 'max')} FROM vec JOIN f ON id = vec_id")
def q_raw_and_features(spark, d):
    both = X.features(tables.vectors(spark, d), "ddm", ["vec_id", "ddm"], 8, 8, ["mean", "std", "max"])
    return both.select("vec_id", *[six(F.col("ddm")[i], f"cell_{i}") for i in range(64)], six("mean"), six("std"), six("max"))


_FORMAT = "'%Y-%m-%d %H:%M:%S'"


@query(f"WITH t AS (SELECT l_quantity AS copol, l_tax*100 AS xpol, l_discount AS snr, l_extendedprice/10 AS distance, l_shipdate AS ts FROM lineitem) SELECT strftime(min(ts), {_FORMAT}) AS coverage_start, strftime(max(ts), {_FORMAT}) AS coverage_end, count(*) AS n FROM t WHERE copol >= 5 AND xpol >= 5 AND distance BETWEEN 2000 AND 10000 AND snr > 0 AND ts IS NOT NULL")
def q_coverage(spark, d):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return maps.coverage(quality.quality(tables.observations(spark, d), "with_lat_lons_time")).select(at("coverage_start"), at("coverage_end"), "n")


@query(f"WITH {_OBS}, o AS (SELECT CASE WHEN copol = 13 THEN 'inf'::double ELSE copol::double END AS copol, snr::double AS snr FROM obs), f AS (SELECT coalesce(bool_or(isinf(copol) OR abs(copol) >= 1.7976931348623157e308), false) AS copol, coalesce(bool_or(isinf(snr) OR abs(snr) >= 1.7976931348623157e308), false) AS snr FROM o) SELECT copol, snr, copol OR snr AS found FROM f")
def q_overflows(spark, d):
    o = tables.observations(spark, d).withColumn("copol", F.when(F.col("copol") == 13, F.lit(float("inf"))).otherwise(F.col("copol")))
    return maps.overflows(o, ["copol", "snr"])


@query('SELECT count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS "both", count(*) FILTER (WHERE b.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE a.doc_id IS NULL) AS only_right, count(*) FILTER (WHERE a.doc_id IS NULL OR b.doc_id IS NULL) = 0 AND coalesce(max(greatest(na, nb)), 1) <= 1 AS one_to_one FROM (SELECT doc_id, count(*) AS na FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS nb FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id')
def q_alignment(spark, d):
    return maps.alignment(tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels").select("doc_id"), "doc_id")


@query(f"WITH {_VEC}, v AS (SELECT vec_id, embedding FROM vec ORDER BY vec_id LIMIT 3000000), w AS (SELECT vec_id, unnest(embedding)::double AS e FROM v) SELECT vec_id, {_r('sum(abs(e))', 'total')} FROM w GROUP BY 1")
def q_first_rows(spark, d):
    first = sampling.first(tables.vectors(spark, d), ["vec_id"], 3_000_000)  # the first rows are what is asked for
    return first.select("vec_id", six(F.aggregate("ddm", F.lit(0.0), lambda a, v: a + v), "total"))
