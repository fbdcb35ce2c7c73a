import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_registry_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    assert entry.llm is None and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)


@pytest.mark.parametrize("name", ["q_quality_filtered", "q_features_regions", "q_threshold_sweep", "q_stratified_sample", "q_roc_auc", "q_fill_and_filter", "q_class_report", "q_hypotenuse", "q_finite_mask", "q_feature_table", "q_fill_maps", "q_map_channels", "q_train_val_test", "q_overfit_gap", "q_one_vs_rest", "q_voting_optimum", "q_sample_with_replacement", "q_boxplot"])
def test_query_equals_its_sql(spark, name):
    from glint.plans import map_queries, model_queries, queries  # noqa: F401

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]}) q").fetchall()
    number = lambda v: round(float(v), 5) if isinstance(v, (int, float)) else v
    key = lambda rows: sorted(tuple(number(v) for v in r) for r in rows)
    assert key(got.select(cols).collect()) == key(want)


def test_finite_rows_are_picked_without_the_features_in_the_filter(spark):
    from glint.plans import queries

    plan = queries.q_feature_table(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("aggregate(") for line in plan.split("\n") if "Filter" in line) <= 1


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
