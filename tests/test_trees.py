"""Forests and boosting against plain numpy versions on the same bins."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import boosting, trees
from glint.operators.trees import Growth


def table(spark, n=300, seed=1, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    score = x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=n)
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes))
    rows = [(i, int(v), *[float(a) for a in r[:3]], None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(r[3])) for i, (v, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double, d double").repartition(5)


COLS = ["a", "b", "c", "d"]


def arrays(data, *more):
    rows = sorted(data.rows.collect(), key=lambda r: r["id"])
    b = np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(len(rows), -1)
    return b, np.array([r["y"] for r in rows]), *[np.array([r[m] for r in rows], float) for m in more]


def plain_tree(b, w, how, tree=0):
    """Nested splits of rows with channel weights w, found by trying every cut."""

    def worth(s):
        if how.kind == "gini":
            return (s * s).sum() / s.sum() if s.sum() > 0 else 0.0
        return s[0] ** 2 / (s[1] + how.penalty)

    weight = lambda s: s.sum() if how.kind == "gini" else s[1]

    def grow(rows, level, i):
        s = w[rows].sum(axis=0)
        node = {"sums": s}
        if level == how.depth or weight(s) <= 0:
            return node
        tried = range(b.shape[1])
        if how.features and how.features < b.shape[1]:
            tried = sorted(np.random.default_rng([how.seed, tree, level, i]).choice(b.shape[1], how.features, replace=False).tolist())
        best = None
        for f in tried:
            for cut in range(32):
                left = rows[b[rows, f] <= cut]
                ls = w[left].sum(axis=0)
                rs = s - ls
                if weight(ls) < how.least or weight(rs) < how.least:
                    continue
                gain = round(worth(ls) + worth(rs) - worth(s), 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, f, cut
        if best:
            _, f, cut = best
            go = b[rows, f] <= cut
            node |= {"f": f, "cut": cut, "left": grow(rows[go], level + 1, 2 * i), "right": grow(rows[~go], level + 1, 2 * i + 1)}
        return node

    return grow(np.arange(len(b)), 0, 0)


def leaf(node, row):
    while "f" in node:
        node = node["left"] if row[node["f"]] <= node["cut"] else node["right"]
    return node["sums"]


def same(tree, node, at=0):
    assert np.allclose(tree.sums[at], node["sums"], atol=1e-9)
    if "f" not in node:
        assert tree.feature[at] < 0
        return
    assert (tree.feature[at], tree.cut[at]) == (node["f"], node["cut"])
    same(tree, node["left"], 2 * at + 1)
    same(tree, node["right"], 2 * at + 2)


def test_bins_hold_values_up_to_their_cut(spark):
    df = table(spark)
    data = trees.binned(df, ["id"], "label", COLS)
    got = {r["id"]: list(r["bins"]) for r in data.rows.collect()}
    for r in df.collect():
        for i, c in enumerate(COLS):
            v = -np.inf if r[c] is None or np.isnan(r[c]) else r[c]
            assert got[r["id"]][i] == sum(e < v for e in data.cuts[i])
    assert all(len(c) <= 31 for c in data.cuts)


@pytest.mark.parametrize("direct, balanced, classes", [(32, False, 2), (1, True, 3)])
def test_forest_equals_a_plain_one_and_its_votes_are_out_of_bag(spark, monkeypatch, direct, balanced, classes):
    monkeypatch.setattr(trees, "DIRECT", direct)
    df = table(spark, classes=classes).withColumn("drawn", trees.bootstrap(["id"], 7))
    data = trees.binned(df, ["id"], "label", COLS, ("drawn",))
    how = Growth(depth=3, least=2.0, features=2)
    model = trees.forest(data, 7, how, balanced)
    b, y, drawn = arrays(data, "drawn")
    share = np.bincount(y.astype(int)) / len(y)
    weight = 1 / (classes * share) if balanced else np.ones(classes)
    hot = np.eye(classes)[y.astype(int)] * weight
    plain = [plain_tree(b, drawn[:, t, None] * hot, how, t) for t in range(7)]
    for tree, node in zip(model.trees, plain, strict=True):
        same(tree, node)
    for r in trees.votes(model).collect():
        i = r["id"]
        own = [leaf(plain[t], b[i]) for t in range(7) if drawn[i, t] == 0]
        assert r["n_votes"] == len(own)
        if own:
            mean = np.mean([s / s.sum() for s in own], axis=0)
            assert np.allclose(r["votes"], mean) and r["yhat"] == np.round(mean, 9).argmax()
        else:
            assert r["yhat"] is None
    everyone = trees.votes(model, out_of_bag=False)
    assert {r["n_votes"] for r in everyone.collect()} == {7}


def test_bootstrap_counts_are_poisson_and_agree_between_runs(spark):
    rows = spark.range(4000).withColumn("drawn", trees.bootstrap(["id"], 10))
    one, two = ([r["drawn"] for r in rows.orderBy("id").repartition(n).orderBy("id").collect()] for n in (3, 7))
    assert one == two
    counts = np.array(one)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.04 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(counts.T) - np.eye(10)).max() < 0.07


def test_out_of_bag_score_is_near_a_held_out_one(spark):
    df = table(spark, 3000, seed=4)
    held = df.where("id % 3 = 0")
    train = df.where("id % 3 <> 0").withColumn("drawn", trees.bootstrap(["id"], 20))
    model = trees.forest(trees.binned(train, ["id"], "label", COLS, ("drawn",)), 20, Growth(depth=5, features=2))
    score = trees.oob_score(trees.votes(model)).first()
    assert score["n"] + score["without_vote"] == 2000 and score["without_vote"] < 10
    x = np.array([[-np.inf if v is None or np.isnan(v) else v for v in (r[c] for c in COLS)] for r in held.collect()])
    b = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(model.data.cuts)], axis=1)
    shares = sum((s := t.sums[t.leaves(b)]) / s.sum(axis=1, keepdims=True) for t in model.trees)
    accuracy = (shares.argmax(axis=1) == np.array([r["label"] for r in held.collect()])).mean()
    assert abs(accuracy - score["accuracy"]) < 0.03 and score["accuracy"] > 0.8


def boosted(spark, monkeypatch, drop, rounds=13, patience=50):
    monkeypatch.setattr(boosting, "CHUNK", 4)
    df = table(spark).withColumn("valid", F.col("id") % 4 == 0)
    data = trees.binned(df, ["id"], "label", COLS, ("valid",))
    how = Growth("newton", depth=2, least=1.0)
    return boosting.boost(data, rounds, how, 0.3, patience, drop, seed=9), data, how


@pytest.mark.parametrize("drop", [0.0, 0.4])
def test_boosting_equals_a_plain_version(spark, monkeypatch, drop):
    model, data, how = boosted(spark, monkeypatch, drop)
    b, y, valid = arrays(data, "valid")
    train = valid == 0
    share = y[train].mean()
    start, outs, w, margins = np.log(share / (1 - share)), np.zeros((len(y), 0)), np.zeros(0), []
    for r in range(13):
        margins.append(start + outs @ w)
        gone = np.random.default_rng([9, r]).random(r) < drop
        p = 1 / (1 + np.exp(-(start + outs[:, ~gone] @ w[~gone])))
        g = np.stack((p - y, p * (1 - p)), axis=1) * train[:, None]
        node = plain_tree(b, g, how)
        same(model.trees[r], node)
        outs = np.column_stack((outs, [-(s := leaf(node, row))[0] / (s[1] + 1.0) for row in b]))
        k = gone.sum()
        w = np.append(np.where(gone, w * k / (k + 0.3), w), 0.3 / (k + 0.3) if k else 0.3)
    margins.append(start + outs @ w)
    loss = [boosting.log_loss(y, m)[~train].mean() for m in margins]
    assert np.allclose([v for _, v in model.losses], loss)
    assert model.best == int(np.round(loss, 12).argmin())
    stages = boosting.staged(model, only_valid=False)
    got = {(r["id"], r["iteration"]): r["margin"] for r in stages.collect()}
    assert len(got) == 300 * 14
    assert all(np.isclose(got[i, r], margins[r][i]) for i in range(300) for r in range(14))
    assert drop == 0.0 or (np.diff(model.weights, axis=0)[:, 0] != 0).any()


def test_best_iteration_equals_sql_over_the_staged_table(spark, monkeypatch):
    model, _, _ = boosted(spark, monkeypatch, 0.0, rounds=200, patience=6)
    assert model.best + 6 == len(model.trees) < 200
    staged = boosting.staged(model).toPandas()  # noqa: F841 - read by the SQL
    sql = "SELECT iteration, avg(ln(1 + exp(-abs(margin))) + greatest(margin, 0) - y * margin) AS v FROM staged GROUP BY 1 ORDER BY round(v, 12), iteration LIMIT 1"
    want = duckdb.sql(sql).fetchall()[0]
    got = boosting.best_iteration(boosting.evaluated(boosting.staged(model))).first()
    assert (got["iteration"], round(got["value"], 9)) == (want[0], round(want[1], 9)) == (model.best, round(want[1], 9))
    final = boosting.scored(model).toPandas()
    assert len(final) == 300 and ((final.p1 >= 0.5) == (final.yhat == 1)).all()
    auc = boosting.best_iteration(boosting.evaluated(boosting.staged(model)), "roc_auc").first()
    assert 0 < auc["iteration"] <= len(model.trees) and auc["value"] > 0.9


def test_importances_are_those_of_the_trees(spark, monkeypatch):
    model, data, _ = boosted(spark, monkeypatch, 0.0)
    table_ = trees.nodes(spark, model.used, data)
    got = {r["feature"]: (r["splits"], r["gain"]) for r in trees.importances(table_).collect()}
    for i, c in enumerate(COLS):
        own = [g for t in model.used for f, g in zip(t.feature, t.gain, strict=True) if f == i]
        assert got.get(c, (0, 0.0)) == (len(own), pytest.approx(sum(own)))
    leaves = table_.where("feature is null").groupBy("tree").count().collect()
    assert len(leaves) == model.best


@pytest.mark.parametrize("direct, l2, l1", [(32, 0.0, 0.0), (1, 1.0, 5.0)])
def test_linear_booster_ends_where_no_weight_can_be_improved(spark, monkeypatch, direct, l2, l1):
    monkeypatch.setattr(trees, "DIRECT", direct)
    df = table(spark).withColumn("e", F.col("a") + 0.01 * F.col("c")).withColumn("zero", F.lit(0.0))
    cols = ["a", "b", "c", "e", "zero"]
    bias, weights, losses = boosting.linear(df, "label", cols, 15, 1.0, l2, l1)
    rows = df.toPandas()
    x, y, w = np.column_stack((np.ones(len(rows)), rows[cols].to_numpy())), rows.label.to_numpy(), np.array([bias, *weights])
    assert np.isclose(losses[0], np.log(2)) and np.isclose(losses[-1], boosting.log_loss(y, x @ w).mean())
    slope = (1 / (1 + np.exp(-x @ w)) - y) @ x + np.append(0, l2 * w[1:])
    assert abs(slope[0]) < 1e-4
    for v, s in zip(w[1:], slope[1:], strict=True):
        assert abs(s + l1 * np.sign(v)) < 1e-4 if v else abs(s) <= l1 + 1e-4
    assert weights[-1] == 0 and (not l1 or 0 in weights[:-1])


def test_empty_and_single_valued_tables(spark):
    empty = table(spark).limit(0).withColumn("valid", F.lit(True)).withColumn("drawn", trees.bootstrap(["id"], 3))
    data = trees.binned(empty, ["id"], "label", COLS, ("valid", "drawn"))
    assert trees.votes(trees.forest(data, 3)).count() == 0
    assert boosting.boost(data, 2).best == 2
    one = table(spark, 5).withColumn("a", F.lit(1.0)).withColumn("label", F.lit(1)).withColumn("valid", F.lit(False))
    data = trees.binned(one.select("id", "label", "a", "valid"), ["id"], "label", ["a"], ("valid",))
    model = boosting.boost(data, 3)
    assert model.best == 3 and {r["yhat"] for r in boosting.scored(model).collect()} == {1}
