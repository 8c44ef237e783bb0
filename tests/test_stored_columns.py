"""Queries store only the columns that they look at, and scoring is dealt over tasks by the number of records."""
import datetime

import pytest

from sparkaudit.checks import queries
from sparkaudit.operators import iforest


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, k % 7, "O", 100_000.0 + 13 * k, datetime.datetime(1995, 1, 1 + k % 28), "1-URGENT") for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                                "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def stored_by(monkeypatch, module):
    stored, real = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df: stored.append(set(df.columns)) or real(df))
    return stored


def test_price_queries_store_no_other_columns(spark, folder, monkeypatch):
    stored = stored_by(monkeypatch, queries)
    queries.top_outliers(spark, folder)
    assert stored == [{"rid", "price", "house_size", "zip_code", "state"}]
    stored.clear()
    queries.folded_metrics(spark, folder)
    # the listings, the labels with their folds, and the scores of each variant
    assert stored == [{"rid", "price", "house_size", "zip_code", "state"}, {"rid", "family", "subtype", "fold"},
                      *[{"rid", "score", "fold"}] * 2]


def test_baselines_store_what_splits_twins_and_means_look_at(spark, folder, monkeypatch):
    stored = stored_by(monkeypatch, queries)
    queries.baseline_predictions(spark, folder, 1, [1.0])
    queries.naive_baseline(spark, folder)
    assert not any({"brokered_by", "prev_sold_date", "acre_lot"} <= columns and "y" in columns for columns in stored)


def test_forests_store_the_features_alone_and_deal_records_over_tasks(table, monkeypatch):
    monkeypatch.setattr(iforest, "SCORED_ROWS", 10, raising=False)
    stored = stored_by(monkeypatch, iforest)
    scores = iforest.isolation_forest(table(*[{"price": 1000.0 * i} for i in range(1, 26)]))
    assert not any("city" in columns for columns in stored)
    assert scores.rdd.getNumPartitions() == 3 and scores.count() == 25
