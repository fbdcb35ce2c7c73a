"""Sources, sinks, streams and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint import streaming
from glint.operators import learning, stats
from glint.sources import tables


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    tables.write_parquet(df, f"{tmp_path}/p")
    tables.write_json(df, f"{tmp_path}/j")
    tables.write_csv(df, f"{tmp_path}/c")
    for got in (spark.read.parquet(f"{tmp_path}/p"), tables.read_json(spark, f"{tmp_path}/j", "id int, s string"), spark.read.option("header", True).schema("id int, s string").csv(f"{tmp_path}/c")):
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    assert tables.columns_like(df, "i") == ["id"]


def test_files_are_picked_and_broken_ones_skipped(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    (tmp_path / "in" / "bad.parquet").write_bytes(b"nothing")
    one = tables.read_files(spark, f"{tmp_path}/in/0", pick=1)
    assert one.count() == 10
    assert spark.read.schema("id long").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in").count() == 40
    with pytest.raises(ValueError):
        tables.check_integrity(one)
    tables.check_integrity(one.withColumn("raw_counts", F.array("id")), {"raw_counts"})


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(100).withColumn("ts", F.timestamp_seconds(F.col("id") * 600))
    df.write.parquet(f"{tmp_path}/in")
    stream = streaming.arriving(spark, f"{tmp_path}/in", df.schema)
    streaming.ingest(stream, lambda s: s.where("id % 2 = 0"), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    q = streaming.hourly(streaming.arriving(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n for r in spark.table("hours").collect()} <= {4, 6} and spark.table("hours").agg(F.sum("n")).first()[0] == 100


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        y = i % 2
        rows.append((i, float(y), float(y * 3 + rng.normal()), float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "id int, y double, a double, b double, c double").cache()


COLS = ["a", "b", "c"]


def test_components_and_selection(training):
    x = np.array([[r.a, r.b, r.c] for r in training.collect()])
    x = (x - x.mean(0)) / x.std(0)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = learning.cumulative_variance(training, COLS).orderBy("component").collect()
    assert [r.cumulative for r in got] == pytest.approx(np.cumsum(want / want.sum()))
    assert learning.selected(training, COLS, 0.4) == ["a"]


def test_saved_models(spark, training, tmp_path):
    fit = stats.scale_fit(training, COLS)
    data = learning.assembled(stats.scaled(training, fit, COLS), COLS)
    est = learning.forest(numTrees=3, maxDepth=2)
    model = est.fit(data)
    learning.save(model, f"{tmp_path}/m", fit)
    again, params = learning.load(f"{tmp_path}/m")
    assert params["numTrees"] == 3 and params["maxDepth"] == 2
    p = lambda m: [r.p1 for r in learning.scored(m, data).orderBy("id").collect()]
    assert p(again) == p(model)
    assert learning.load_scale(f"{tmp_path}/m").first() == fit.first()
    new, change = learning.finalise_saved(f"{tmp_path}/m", learning.forest(), training.unionByName(training), COLS)
    assert new.getNumTrees == 3 and {r.feature for r in change.collect()} == set(COLS)
    assert all(d <= 2 and leaves <= 4 for _, d, leaves in learning.tree_stats(new))


def test_search(training):
    est = learning.forest()
    tried = learning.random_params(est, {"numTrees": ("int", 2, 4), "subsamplingRate": ("uniform", 0.5, 0.5)}, 2)
    assert tried == learning.random_params(est, {"numTrees": ("int", 2, 4), "subsamplingRate": ("uniform", 0.5, 0.5)}, 2)
    folds = learning.assembled(training, COLS).withColumn("fold", (F.col("id") % 4 / 2).cast("int"))
    assert min(learning.search(folds, est, tried).avgMetrics) > 0.8
    assert len(learning.grid(est, {"numTrees": [2, 3], "maxDepth": [1, 2]})) == 4
