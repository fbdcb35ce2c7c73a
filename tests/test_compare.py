"""Out-of-fold tables, ranking, blending and voting."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from glint.operators import learning, sampling, stats

COLS = ["a", "b"]


def rows(spark, n=240):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.7 * rng.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame([(i, float(v), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(y, x, strict=True))], "id long, y double, a double, b double")
    return sampling.kfold(df, ["id"], "y", 3)


def test_out_of_fold_scores_come_from_the_other_folds_and_rank_as_sql_says(spark):
    df = learning.assembled(rows(spark), COLS).select("id", "y", "fold", "features")
    models = {"logistic": LogisticRegression(labelCol="y", regParam=0.1), "stump": DecisionTreeClassifier(labelCol="y", maxDepth=1), "tree": DecisionTreeClassifier(labelCol="y", maxDepth=4)}
    oof = learning.out_of_fold(df, ["id"], models)
    assert oof.count() == 240 * 3 and oof.select("id", "model").distinct().count() == 720
    one = {r["id"]: r["p1"] for r in learning.scored(models["logistic"].fit(df.where("fold <> 1")), df.where("fold = 1")).collect()}
    got = {r["id"]: r["p1"] for r in oof.where("model = 'logistic' and fold = 1").collect()}
    assert got.keys() == one.keys() and all(np.isclose(got[i], one[i]) for i in one)
    table = oof.toPandas()  # noqa: F841 - read by the SQL
    place = """SELECT model, row_number() OVER (ORDER BY round(a, 9) DESC, model) AS place FROM
      (SELECT model, avg(acc) AS a FROM (SELECT model, fold, avg(((p1 >= 0.5)::int = y::int)::int) AS acc FROM table_ GROUP BY 1, 2) GROUP BY 1)"""
    table_ = table  # noqa: F841
    best = learning.ranking(oof)
    assert {(r["model"], r["place"]) for r in best.collect()} == set(duckdb.sql(place).fetchall())
    blend = learning.blended(oof, ["id"], best, 2)
    want = dict(duckdb.sql(f"SELECT id, avg(p1) FROM table_ JOIN ({place}) p USING (model) WHERE place <= 2 GROUP BY 1").fetchall())
    said = {r["id"]: r["p1"] for r in blend.collect()}
    assert said.keys() == want.keys() and all(np.isclose(said[i], want[i]) for i in want)


def test_bucket_rates_leave_out_the_rows_own_fold(spark):
    df = spark.createDataFrame([(0, 1, "x", 0), (1, 0, "x", 0), (2, 1, "x", 1), (3, 1, None, 1), (4, 0, None, 0), (5, 1, "lone", 1)], "id long, y int, v string, fold int")
    got = {r["id"]: r["p1"] for r in learning.bucket_rates(df, ["id"], "y", ["v"]).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.0, 4: 1.0, 5: 0.5}
    assert learning.bucket_rates(df.limit(0), ["id"], "y", ["v"]).count() == 0


def test_blend_equals_its_sql_with_rows_that_share_their_keys(spark, tmp_path):
    from glint.plans import model_queries  # noqa: F401
    from glint.plans.queries import ORACLES, QUERIES

    one = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM '/root/testdata/sf0.001/lineitem.parquet'"""
    # 23 copies of some rows (one key and value, so that it's all the same which copy is in which fold), and keys that are missing
    duckdb.sql(f"COPY ({one} UNION ALL SELECT a.* FROM ({one} WHERE l_orderkey % 40 = 3) a, range(22) UNION ALL SELECT NULL, * EXCLUDE (l_orderkey) FROM ({one} LIMIT 50)) TO '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"select fold, n, mean_p, brier from ({ORACLES['q_blend']})").fetchall()}
    got = {r["fold"]: (r["n"], r["mean_p"], r["brier"]) for r in QUERIES["q_blend"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=2e-6) for f in want)
    assert sum(v[0] for v in want.values()) < con.execute("select count(*) from lineitem").fetchone()[0]


def test_narrow_folds_are_those_of_kfold(spark):
    df = spark.createDataFrame([(i, i % 7, i % 3 == 0) for i in range(400)], "a long, b int, y boolean")
    want = sorted(tuple(r) for r in sampling.kfold(df, ["a", "b"], "y").select("y", "a", "b", "fold").collect())
    got = sampling.narrow_folds(df, ["a", "b"], "y", ["a", "b"])
    assert sorted(tuple(r)[:4] for r in got.collect()) == want and got.where("twin is not null").count() == 0


def test_a_blend_moves_and_writes_no_row_for_each_model(spark, monkeypatch):
    from glint.plans import model_queries  # noqa: F401
    from glint.plans.queries import QUERIES
    from glint.sources import written

    write, rows = written.write, {}

    def counted(df, name):
        out = write(df, name)
        rows[name] = (out.count(), out.columns)
        return out

    monkeypatch.setattr(written, "write", counted)
    QUERIES["q_blend"](spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert max(r[0] for r in rows.values()) == n and not any("l_orderkey" in r[1] for r in rows.values())


def test_vote_takes_the_largest_probability_of_models_with_their_own_scalers(spark):
    df = rows(spark).withColumn("b", F.col("b") * 1000)
    fit = stats.scale_fit(df.where("fold = 0"), COLS)
    one = LogisticRegression(labelCol="y").fit(learning.assembled(stats.scaled(df, fit, COLS), COLS))
    two = DecisionTreeClassifier(labelCol="y", maxDepth=2).fit(learning.assembled(df, COLS))
    p = [{r["id"]: r["p1"] for r in learning.scored(m, learning.assembled(d, COLS)).collect()} for m, d in ((one, stats.scaled(df, fit, COLS)), (two, df))]
    for r in learning.soft_vote([(one, fit), (two, None)], df, ["id"], COLS).collect():
        a, b = p[0][r["id"]], p[1][r["id"]]
        assert (np.isclose(r["p1"], max(a, b)), r["model"], r["yhat"]) == (True, int(b > a), int(max(a, b) >= 0.5))
    same = learning.soft_vote([(two, None), (two, None)], df, ["id"], COLS)
    assert {r["model"] for r in same.collect()} == {0}
    assert learning.soft_vote([(two, None)], df, ["id"], COLS).count() == 240
    with pytest.raises(ValueError, match="no models"):
        learning.soft_vote([], df, ["id"], COLS)
