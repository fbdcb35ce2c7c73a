import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import geo, metrics, quality, sampling, stats

NAN = float("nan")


def test_quality_boundaries(spark):
    rows = [(5.0, 5.0, 1e-9, 2000.0), (4.999, 5.0, 1.0, 3000.0), (5.0, 5.0, 0.0, 3000.0), (NAN, 5.0, 1.0, 3000.0), (5.0, 5.0, NAN, 3000.0), (5.0, 5.0, 1.0, 10000.001), (5.0, None, 1.0, 3000.0), (9.0, 9.0, 2.0, 10000.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, copol double, xpol double, snr double, distance double")
    assert {r.id for r in quality.quality(df).collect()} == {0, 7}
    assert {r.id for r in quality.quality(df, "unfiltered").collect()} == {0, 2, 4, 7}
    with pytest.raises(ValueError):
        quality.quality(df, "other")


def test_labels(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (1,), (3,), (7,), (8,)], "c int")
    assert [r.y for r in df.select(quality.binary_label(F.col("c")).alias("y")).collect()] == [0, 0, 0, 1, 1, 1, 0]
    assert [r.y for r in df.select(quality.multiclass_label(F.col("c")).alias("y")).collect()][:3] == [0, 0, 0]


def test_valid_vectors_and_filling(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [NAN, 1.0]), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [1.0])], "id int, v array<double>")
    assert [r.id for r in df.where(quality.valid_vector("v", 2)).collect()] == [1]
    s = spark.createDataFrame([(1, "a", 1.0), (2, "a", NAN), (3, "b", NAN), (4, "b", None), (5, "a", 3.0)], "id int, g string, v double")
    assert {r.id: r.v for r in quality.fill_and_filter(s, ["g"], "v").collect()} == {1: 1.0, 2: 2.0, 5: 3.0}


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    picked = sampling.balanced(df, ["id"], "y", 50)
    assert {r.y: r["count"] for r in picked.groupBy("y").count().collect()} == {0: 50, 1: 50}
    assert {r.id for r in picked.collect()} == {r.id for r in sampling.balanced(df.repartition(7), ["id"], "y", 50).collect()}
    with pytest.raises(ValueError):
        sampling.balanced(df, ["id"], "y", 101)
    assert sampling.balanced(df, ["id"], "y", 0).count() == 1000
    s = sampling.stratified(df, ["id"], "y", 0.25).where("picked").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in s} == {0: 225, 1: 25}
    folds = sampling.kfold(df, ["id"], "y").groupBy("fold", "y").count().collect()
    assert {(r.y, r["count"]) for r in folds} == {(0, 180), (1, 20)}
    assert sampling.rare_preserving(df, ["id"], "y", 0.1).where("y = 1").count() == 100
    assert {r["count"] for r in sampling.balanced_subsets(df, ["id"], "y", 3, 40).groupBy("subset", "y").count().collect()} == {40}


def scored(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    y, p = rng.integers(0, 2, n), rng.integers(0, 40, n)
    return y, p, spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, p int")


def test_scores_against_numpy(spark):
    y, p, df = scored(spark)
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    flipped = df.withColumn("p", 100 - F.col("p"))
    assert metrics.roc_auc(flipped, "y", "p").first()[0] == pytest.approx(1 - auc)
    grid = [0, 10, 20, 39, 41]
    for r in metrics.sweep(df, "y", "p", grid).collect():
        h = p >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == ((h & (y == 1)).sum(), (h & (y == 0)).sum(), (~h & (y == 1)).sum(), (~h & (y == 0)).sum())
        assert r.tp + r.fp + r.fn + r.tn == len(y)
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        h = p >= t
        recall = (h & (y == 1)).sum() / (y == 1).sum()
        ap, last = ap + (recall - last) * (h & (y == 1)).sum() / h.sum(), recall
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(ap)
    with pytest.raises(ValueError):
        metrics.optimum(metrics.sweep(df, "y", "p", grid), "nothing")


def test_single_class_scores(spark):
    df = spark.createDataFrame([(1, 5), (1, 7)], "y int, p int")
    r = metrics.sweep(df, "y", "p", [6]).first()
    assert (r.specificity, r.mcc, r.balanced_accuracy, r.recall) == (0.0, 0.0, 0.5, 0.5)


def test_point_in_polygon_has_no_boundary(spark):
    ring = [(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(1, ring)], "id int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 25.0, 5.0), (4, 19.9, 9.9), (5, 20.0, 10.0)], "k int, x double, y double")
    assert {r.k for r in geo.contained(points, polygons, "k").collect()} == {1, 4}


def test_scalers_and_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 3.0, 7.0)], "id int, a double, b double")
    assert [tuple(r) for r in stats.standard_scale(df, ["a", "b"]).orderBy("id").collect()] == [(1, -1.0, 0.0), (2, 1.0, 0.0)]
    assert [tuple(r) for r in stats.minmax_scale(df, ["a", "b"]).orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.0)]
    m = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, 4.0)], "id int, v double")
    assert {r.id: r.v for r in stats.median_impute(m, "v").collect()} == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}


def test_ecdf_and_histogram(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 1, 2, 9])], "id int, x double")
    assert [r.cdf for r in stats.ecdf(df, "x", ["id"]).orderBy("x", "id").collect()] == [0.2, 0.4, 0.6, 0.8, 1.0]
    assert {r.bin: r.n for r in stats.histogram(df, "x", 4).collect()} == {0: 3, 1: 1, 3: 1}
