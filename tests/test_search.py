"""Candidates that grow together against single fits, and the Parzen draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import boosting, metrics, sampling, search, trees
from glint.operators.trees import Growth
from tests.test_trees import COLS, table

SPACE = {"depth": ("int", 1, 4), "rate": ("log", 0.05, 0.5), "penalty": ("uniform", 0.5, 2.0), "least": ("choice", 0.5, 1.0, 3.0), "rounds": ("int", 1, 5)}


@pytest.mark.parametrize("together, direct", [(160, 32), (4, 1)])
def test_areas_of_candidates_are_those_of_their_own_fits(spark, monkeypatch, together, direct):
    monkeypatch.setattr(search, "TOGETHER", together)
    monkeypatch.setattr(trees, "DIRECT", direct)
    df = sampling.kfold(table(spark), ["id"], "label", 3)
    data = trees.binned(df, ["id"], "label", COLS, ("fold",))
    some = search.drawn(SPACE, 4)
    got = {(r["candidate"], r["fold"]): r["roc_auc"] for r in search.fitted(data, some, 3).collect()}
    assert len(got) == 12
    for i, p in enumerate(some[:2]):
        one = data.rows.withColumn("valid", F.col("fold") == 1)
        model = boosting.boost(trees.Binned(one, data.keys, data.cols, data.cuts), p["rounds"], Growth("newton", p["depth"], p["least"], p["penalty"]), p["rate"])
        last = boosting.staged(model).where(F.col("iteration") == p["rounds"])
        assert got[i, 1] == pytest.approx(metrics.roc_auc(last, "y", "margin").first()["roc_auc"], abs=1e-9)


def test_draws_stay_in_their_space_and_near_good_trials():
    some = search.drawn(SPACE, 200)
    trials = [(p, -abs(np.log(p["rate"] / 0.2)) - (p["depth"] - 2) ** 2 + (p["least"] == 3.0)) for p in some]
    again = search.parzen(SPACE, trials, 100, seed=1)
    assert again == search.parzen(SPACE, trials, 100, seed=1) and search.parzen(SPACE, [], 5) == search.drawn(SPACE, 5)
    for p in [*some, *again]:
        assert p["depth"] in (1, 2, 3) and 0.05 <= p["rate"] <= 0.5 and 0.5 <= p["penalty"] <= 2.5 and p["least"] in (0.5, 1.0, 3.0) and p["rounds"] in (1, 2, 3, 4)
    value = lambda ps: np.mean([abs(np.log(p["rate"] / 0.2)) + (p["depth"] - 2) ** 2 + (p["least"] != 3.0) for p in ps])
    assert value(again) < 0.6 * value(some)


def test_density_is_one_over_its_range():
    x = np.linspace(-1, 3, 20001)
    d = search.density([-1.0, 0.1, 0.11, 2.9], -1.0, 3.0, x)
    assert np.trapezoid(d, x) == pytest.approx(1, abs=1e-3) and d.min() > 0


def test_search_learns_from_its_trials(spark):
    df = sampling.kfold(table(spark), ["id"], "label", 3)
    data = trees.binned(df, ["id"], "label", COLS, ("fold",))
    trials = search.searched(data, SPACE, [6, 4], 3)
    assert [b for b, *_ in trials] == [0] * 6 + [1] * 4 and all(0.5 < a <= 1 for *_, a in trials)
