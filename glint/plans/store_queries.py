"""Registered queries on stored moments, run logs, file ledgers, chunk manifests and record files, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glint.operators import moments
from glint.plans.queries import _FIT, _r, _training, query, six
from glint.sources import ledger, tables, written

_COLUMNS = {"quantity": "l_quantity", "discount": "round(l_discount * 100)", "tax": "round(l_tax * 100)", "price": "l_extendedprice / 1000"}
_OF = list(_COLUMNS)
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def _new(spark, name: str) -> str:
    return f"{written.folder(spark)}/glint-{name}-{uuid.uuid4().hex}"


@query(f"WITH t AS (SELECT {', '.join(f'({e})::double AS {c}' for c, e in _COLUMNS.items())} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{_OF[i]}' AS a, '{_OF[j]}' AS b, count(*) AS n, {_r(f'avg({_OF[i]})', 'mean_a')}, {_r(f'avg({_OF[j]})', 'mean_b')}, {_r(f'covar_pop({_OF[i]}, {_OF[j]})', 'covariance')} FROM t" for i, j in _PAIRS))
def q_moments(spark, d):
    """Means and covariances added up from the moments of chunks (the line numbers)."""
    t = tables.table(spark, d, "lineitem").select("l_linenumber", *[F.expr(e).alias(c) for c, e in _COLUMNS.items()])
    shift = [25.0, 5.0, 4.0, 50.0]
    m = moments.merged(moments.moments(t, _OF, "l_linenumber", shift), len(_OF), shift)
    rows = [(_OF[i], _OF[j], m.n, float(m.mean[i]), float(m.mean[j]), float(m.scatter[i, j] / max(1, m.n))) for i, j in _PAIRS]
    return spark.createDataFrame(rows, "a string, b string, n long, mean_a double, mean_b double, covariance double").select("a", "b", "n", six("mean_a"), six("mean_b"), six("covariance"))  # a row for each pair of columns


@query()
def q_incremental_pca(spark, d):
    """Components of features that come in four chunks, one of them twice."""
    t, root = _training(spark, d), _new(spark, "moments")
    for k in (0, 1, 2, 3, 1):
        moments.update(spark, root, t.where(F.col("vec_id") % 4 == k), _FIT, f"part{k}")
    m, cols = moments.stored(spark, root)
    return moments.projected(t, moments.components(m, cols, 2)).select("vec_id", "pc1", "pc2")


@query("SELECT user_id::varchar AS run, event_type AS key, arg_max(value, event_id)::varchar AS value, max(event_id)::bigint AS step FROM (SELECT user_id, event_type, event_id, round(value * 100)::bigint AS value FROM events) GROUP BY 1, 2")
def q_run_log_latest(spark, d):
    """Events as a run log: the last value of each key of each run."""
    e = tables.table(spark, d, "events")
    entries = e.select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("key"), F.round(F.col("value") * 100).cast("long").cast("string").alias("value"), F.col("event_id").cast("long").alias("step"))
    return ledger.latest(entries)


_NAMES = ("nation", "region", "supplier", "customer", "part", "orders", "events")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, 'ok' AS status, count(*)::bigint AS rows FROM {n}" for n in _NAMES))
def q_file_ledger(spark, d):
    """Status and rows of the files of seven tables, read to their ends."""
    name = F.regexp_extract("path", r"/(\w+)\.parquet(/[^/]*)?$", 1)
    rows = ledger.read_ledger(spark, f"{d}/{{{','.join(f'{n}.parquet' for n in _NAMES)}}}", together=16)
    return rows.select(name.alias("name"), "status", "rows").groupBy("name", "status").agg(F.sum("rows").alias("rows"))


@query("SELECT p_size % 3 AS chunk, count(*) AS n, sum(p_partkey)::bigint AS keys FROM part GROUP BY 1")
def q_chunked_write(spark, d):
    """Parts written in three chunks, one of them twice, and read by the manifest."""
    p, root = tables.table(spark, d, "part").select("p_partkey", "p_size"), _new(spark, "chunks")
    for k in (0, 1, 2, 1):
        ledger.write_chunk(p.where(F.col("p_size") % 3 == k), root, f"c{k}")
    ledger.clean(spark, root)
    return ledger.read_chunks(spark, root, p.schema).groupBy((F.col("p_size") % 3).alias("chunk")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))
