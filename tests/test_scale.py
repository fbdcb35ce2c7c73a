"""Exact order statistics within ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import metrics, sampling, stats


def values(n=3000):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    x[: n // 3] = 0.25  # one value holds a third
    x[-1] = 1e9
    return x


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    x = values()
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan"))], "g int, x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.987, "e": 1.0}
    assert list(stats.quantiles(df, "x", probs).first()) == pytest.approx(np.quantile(x, list(probs.values())))
    for r in stats.quantiles(df, "x", probs, ["g"]).collect():
        assert list(r)[1:] == pytest.approx(np.quantile(x[r.g :: 2], list(probs.values())))
    assert stats.quantiles(df.where("false"), "x", {"m": 0.5}).first().m is None
    assert stats.quantiles(spark.createDataFrame([(4.5,)], "x double"), "x", {"m": 0.3}).first().m == 4.5


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_prefix_sums_and_steps(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    x = values(600)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    counted = df.groupBy("x").agg(F.count("*").alias("n"))
    for r in stats.prefixed(counted, "x", ["n"], ranges=7).collect():
        assert (r.below_n, r.all_n) == ((x < r.x).sum(), len(x))
    steps = [r.cdf for r in stats.ecdf(df, "x", ["id"], ranges=7).orderBy("x", "id").collect()]
    assert steps == pytest.approx((np.arange(len(x)) + 1) / len(x))
    names = spark.createDataFrame([(v,) for v in ["b", "a", "abcd", "abce", "", "b"]], "v string")
    assert {r.v: r.code for r in stats.label_encode(names, "v", "code").collect()} == {"": 0, "a": 1, "abcd": 2, "abce": 3, "b": 4}


def test_real_valued_scores(spark):
    rng = np.random.default_rng(6)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    curve = metrics.pr_curve(df, "y", "p").collect()
    for r in curve:
        h = p >= r.threshold
        assert (r.recall, r.precision, r.baseline) == pytest.approx(((h & (y == 1)).sum() / y.sum(), (h & (y == 1)).sum() / h.sum(), y.mean()))
    assert metrics.nearest_threshold(metrics.pr_curve(df, "y", "p"), 5.0).first().threshold == p.max()
    assert metrics.roc_auc(df.where("y = 1"), "y", "p").first()[0] is None


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {(r.part, r.y): r["count"] for r in sampling.three_way(df, ["id"], "y").groupBy("part", "y").count().collect()}
    assert got == {("test", 0): 180, ("test", 1): 20, ("val", 0): 144, ("val", 1): 16, ("train", 0): 576, ("train", 1): 64}
    assert sampling.holdout(df, ["id"], "y").where("picked").count() == 100
    assert sampling.holdout(df.limit(100), ["id"], "y").where("picked").count() == 0
    drawn = sampling.balanced_subsets(df, ["id"], "y", 3, 40)
    assert not any(r.same for r in sampling.identical_subsets(drawn, ["id"]).collect())
    twice = drawn.where("subset = 1").select("id", "y", F.explode(F.array(F.lit(1), F.lit(2))).alias("subset"))
    assert [tuple(r) for r in sampling.identical_subsets(twice, ["id"]).collect()] == [(1, 2, True)]
    many = sampling.with_replacement(df, ["id"], 1.0)
    assert sorted((r.id, r.copy) for r in many.collect()) == sorted((r.id, r.copy) for r in sampling.with_replacement(df.repartition(7), ["id"], 1.0).collect())
    assert 900 < many.count() < 1100 and many.agg(F.max("copy")).first()[0] > 1


def test_voting_optimum_takes_the_first_or_last_of_equals(spark):
    swept = spark.createDataFrame([(500, 0.9), (525, 0.9), (550, 0.1)], "threshold int, recall double")
    assert metrics.voting_optimum(swept, "recall", True).first().threshold == 500
    assert metrics.voting_optimum(swept, "recall").first().threshold == 525
    with pytest.raises(ValueError):
        metrics.voting_optimum(swept, "accuracy")
    gaps = spark.createDataFrame([(0.9, 0.8), (0.9, 0.895), (0.9, 0.87)], "train double, val double")
    assert [r.verdict for r in metrics.overfit_gap(gaps).collect()] == ["overfit", "balanced", "moderate"]
