"""File ledgers, run logs, chunk manifests and the store of moments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import moments
from glint.sources import ledger


def test_ledger_names_what_could_not_be_read(spark, tmp_path):
    for i in range(6):
        spark.range(10 + i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    (tmp_path / "in/broken.parquet").write_bytes(b"PAR1 not really")
    (tmp_path / "in/empty.parquet").write_bytes(b"")
    cut = next((tmp_path / "in/0").glob("*.parquet"))
    cut.write_bytes(cut.read_bytes()[:-20])
    (tmp_path / "in/other.txt").write_text("x")
    everything = ledger.read_ledger(spark, str(tmp_path / "in"), together=3).collect()
    assert sorted(r["rows"] for r in everything if r["status"] == "ok") == [11, 12, 13, 14, 15]
    assert {r["path"].rsplit("/", 1)[1] for r in everything if r["status"] == "broken"} == {"broken.parquet", "empty.parquet", cut.name}
    assert all((r["error"] is None) == (r["status"] == "ok") for r in everything) and len(everything) == 8
    for enough in (0, 2, 5, 9):
        some = ledger.read_ledger(spark, str(tmp_path / "in"), enough=enough, together=3).orderBy("place").collect()
        assert [r["path"] for r in some] == [r["path"] for r in sorted(everything, key=lambda r: r["place"])]
        ok = [r["place"] for r in some if r["status"] == "ok"]
        assert len(ok) == min(enough, 5)
        last = max(ok, default=-1) if len(ok) == enough else len(some)
        assert all((r["status"] == "unread") == (r["place"] > last) for r in some)


def test_listing_does_not_open_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.parquet").write_bytes(b"no parquet")
    plan = ledger.listing(spark, str(tmp_path / "x"))
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in plan.collect()] == [("a.parquet", 10)]
    read = plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema: struct<")[1].split(">")[0]
    assert "content" not in read


def test_latest_entries(spark, tmp_path):
    path = str(tmp_path / "log")
    ledger.log(spark, path, "a", {"auc": 0.5, "note": None})
    ledger.log(spark, path, "a", {"auc": 0.7}, step=2)
    ledger.log(spark, path, "a", {"auc": 0.6}, step=1)
    ledger.log(spark, path, "b", {"auc": 0.1})
    ledger.log(spark, path, "b", {"auc": 0.2})
    got = {(r["run"], r["key"]): (r["value"], r["step"]) for r in ledger.latest(spark.read.parquet(path)).collect()}
    assert got == {("a", "auc"): ("0.7", 2), ("a", "note"): (None, 0), ("b", "auc"): ("0.2", 0)}


def test_repeated_and_failed_chunk_writes_leave_one_state(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda n: spark.range(n).withColumn("x", F.lit(n))
    ledger.write_chunk(rows(3), root, "one")
    ledger.write_chunk(rows(4), root, "two")
    fails = F.udf(lambda i: 1 // (2 - i), "int")
    with pytest.raises(Exception):  # noqa: B017
        ledger.write_chunk(rows(5).withColumn("x", fails("id")), root, "one")
    schema = rows(0).schema
    read = lambda *c: sorted(r["x"] for r in ledger.read_chunks(spark, root, schema, list(c) or None).collect())
    assert read() == [3] * 3 + [4] * 4 and read("two") == [4] * 4 and read("none") == []
    assert ledger.deletable(spark, root).count() == 0  # it may still be running
    last = ledger.write_chunk(rows(6), root, "one")
    assert read() == [4] * 4 + [6] * 6
    gone = ledger.deletable(spark, root).collect()
    assert [r["chunk"] for r in gone] == ["one", "one"] and last not in {r["attempt"] for r in gone}
    assert ledger.clean(spark, root) >= 1 and read() == [4] * 4 + [6] * 6
    assert {p.name for p in (tmp_path / "t/data").iterdir()} == {r["attempt"] for r in ledger.manifest(spark, root).where("counts").collect()}


def data(spark, n=500):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 4)) + np.array([1e6, 0, -5, 2])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(n, float("nan"), 1.0, 1.0, 1.0), (n + 1, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")


COLS = ["a", "b", "c", "d"]


def test_components_of_any_split_are_those_of_all_rows(spark, tmp_path):
    x, df = data(spark)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    rng = random.Random(1)
    for turn in range(2):
        root = str(tmp_path / f"store{turn}")
        edges = sorted(rng.sample(range(1, 500), 3))
        for k, (lo, hi) in enumerate(zip([0, *edges], [*edges, 600], strict=True)):
            moments.update(spark, root, df.where(F.col("id").between(lo, hi - 1)), COLS, f"part{k}")
        moments.update(spark, root, df.where(F.col("id").between(0, edges[0] - 1)), COLS, "part0")  # again
        m, cols = moments.stored(spark, root)
        assert m.n == 500 and cols == COLS and np.allclose(m.mean, x.mean(0)) and np.allclose(m.scatter, (x - x.mean(0)).T @ (x - x.mean(0)))
        c = moments.components(m, cols, 2)
        assert np.allclose(c.shares, values[::-1][:2] / 4, atol=1e-6)
        got = moments.projected(df.where("id < 500"), c).orderBy("id").select("pc1", "pc2").toPandas().to_numpy()
        for k in range(2):
            want = z @ vectors[:, -1 - k]
            assert np.allclose(np.abs(got[:, k]), np.abs(want), atol=1e-4) and c.directions[k][np.abs(c.directions[k]).argmax()] > 0
    with pytest.raises(ValueError, match="columns"):
        moments.update(spark, root, df, ["a"], "x")


def test_moments_by_chunk(spark):
    x, df = data(spark)
    parts = moments.moments(df.withColumn("k", F.col("id") % 3), COLS, "k", x.mean(0).tolist())
    m = moments.merged(parts, 4, x.mean(0).tolist())
    assert m.n == 500 and np.allclose(m.scatter, (x - x.mean(0)).T @ (x - x.mean(0)))
    one = moments.merged(parts.where("chunk = '1'"), 4, x.mean(0).tolist())
    assert np.allclose(one.mean, x[1::3].mean(0))
    none = moments.merged(moments.moments(df.limit(0), COLS), 4)
    assert none.n == 0 and moments.components(none, COLS).shares.tolist() == [0, 0]
