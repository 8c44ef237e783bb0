"""Registered queries against their SQL on the smallest tables."""
import math
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as registry  # noqa: E402

CHECKED = ["scan_listings", "replace_partition_results", "contract_coercion", "contract_categories",
           "expectation_report", "invalid_dates", "listing_duplicates", "duplicate_links", "modified_z", "price_robust_z", "audit_report",
           "full_audit", "report_lines", "legacy_price_manipulation", "plant_all", "flag_metrics", "average_precision",
           "r_precision", "matched_training_rows", "regression_metrics", "twin_anatomy", "grouped_split",
           "lifecycle_pairs", "broker_rollup", "review_tallies", "spearman_customers", "iforest_features"]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (str, bool)):
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and set(CHECKED) <= set(registry.oracle_sql())


@pytest.mark.skipif(not FOLDER.exists(), reason="tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, str(FOLDER))
    names = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*names).collect())
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())


def test_csv_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from sparkaudit.checks import queries
    from sparkaudit.session import checkpoint_dir
    rows = [(i, i % 7, "O", 1000.0 + i, datetime(1997, 1, 1 + i % 28), "5-LOW") for i in range(90)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                                "o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    few = sorted(tuple(r) for r in queries.scan_listings(spark, str(tmp_path)).collect())
    monkeypatch.setattr(queries, "CSV_ROWS", 10)
    before = set(Path(checkpoint_dir(spark).removeprefix("file:")).glob("csv/*"))
    many = queries.scan_listings(spark, str(tmp_path))
    made, = set(Path(checkpoint_dir(spark).removeprefix("file:")).glob("csv/*")) - before
    assert len(list(made.glob("part-*"))) >= 7
    assert sorted(tuple(r) for r in many.collect()) == few and len(few) == 90
