import numpy as np

from glint.operators import maps

NAN = float("nan")
SCHEMA = "t int, ddm array<array<array<double>>>, code array<int>"


def filled(arr):
    """By numpy: maps without a valid cell get the mean of the time's others; times without any are lost."""
    none = np.isnan(arr).all(axis=(2, 3))
    out = arr.copy()
    for i in np.flatnonzero(~none.all(axis=1)):
        out[i, none[i]] = np.nanmean(arr[i, ~none[i]], axis=0)
    return out, np.flatnonzero(none.all(axis=1))


def test_filling_equals_numpy(spark):
    rng = np.random.default_rng(3)
    arr = rng.gamma(2.0, size=(6, 4, 3, 2))
    arr[0, 1] = arr[2, 0] = arr[2, 3] = arr[4] = np.nan
    arr[1, 2, 0, 0] = arr[2, 1, 1, 1] = np.nan
    df = spark.createDataFrame([(i, a.tolist(), [0, 1, 2, 3]) for i, a in enumerate(arr)], SCHEMA)
    kept, lost = maps.fill_and_filter(df)
    want, gone = filled(arr)
    assert [r.t for r in lost.collect()] == list(gone)
    got = {r.t: r for r in kept.collect()}
    assert set(got) == set(range(6)) - set(gone)
    for t, r in got.items():
        np.testing.assert_allclose(np.array(r.ddm), want[t].reshape(4, 6))
        assert r.filled == np.isnan(arr[t]).all(axis=(1, 2)).tolist()


def test_channels_keep_row_order_and_scalars(spark):
    df = spark.createDataFrame([(7, [[[1.0, 2.0], [3.0, NAN]], [[5.0, 6.0], [7.0, 8.0]]], [4, None]), (8, [], []), (9, None, None)], SCHEMA)
    rows = maps.by_channel(df, per_channel=("code",)).withColumn("ddm", maps.nan_to_zero("ddm")).orderBy("channel").collect()
    assert [(r.t, r.channel, r.ddm, r.code) for r in rows] == [(7, 0, [1.0, 2.0, 3.0, 0.0], 4), (7, 1, [5.0, 6.0, 7.0, 8.0], None)]
    assert maps.fill_and_filter(df)[1].count() == 2


def test_overflow_and_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0), (NAN, float("-inf")), (None, 3.0)], "a double, b double")
    assert tuple(maps.overflows(df, ["a", "b"]).first()) == (False, True, True)
    assert tuple(maps.overflows(df.where("false"), ["a", "b"]).first()) == (False, False, False)
    left, right = spark.range(5), spark.range(3, 8)
    assert tuple(maps.alignment(left, right, "id").first()) == (2, 3, 3, False)
    assert tuple(maps.alignment(left, left, "id").first()) == (5, 0, 0, True)
    assert maps.alignment(left, left.union(left.limit(1)), "id").first().one_to_one is False


def test_frame_has_sixteen_columns(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(16))], list(maps.EDA_COLUMNS))
    out = maps.eda_frame(df)
    assert len(out.columns) == 16 and out.columns[0] == "Timestamp" and out.first()["Aircraft altitude"] == 3


def test_first_rows_are_three_million(spark, tmp_path):
    from glint.plans import map_queries, queries

    n = 5000
    vectors = spark.range(n).selectExpr("id as vec_id", "array_repeat(cast(id % 5 as float), 64) as embedding", "cast(id % 10 as int) as label")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.total for r in map_queries.q_first_rows(spark, str(tmp_path)).collect()}
    assert got == {i: 64.0 * (i % 5) for i in range(n)}
    assert "LIMIT 3000000)" in queries.ORACLES["q_first_rows"]
