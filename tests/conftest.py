import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkaudit.schema import LISTING_COLUMNS, listing_struct  # noqa: E402
from sparkaudit.session import build_session  # noqa: E402

HOME = {"brokered_by": 42.0, "status": "for_sale", "price": 480000.0, "bed": 4.0, "bath": 3.0, "acre_lot": 0.75,
        "street": 907.0, "city": "Reno", "state": "Nevada", "zip_code": 89501.0, "house_size": 2240.0,
        "prev_sold_date": "2009-11-23"}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Listings from variations of one home; the record id is the position."""
    def build(*changes):
        rows = [(i, *[{**HOME, **c}[name] for name in LISTING_COLUMNS]) for i, c in enumerate(changes)]
        return spark.createDataFrame(rows, listing_struct())
    return build


@pytest.fixture
def small_limits(monkeypatch):
    """Limits so low that every path for large tables runs."""
    from sparkaudit.operators import scale
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(scale, "HEAVY_KEYS", 2)
    monkeypatch.setattr(scale, "DIRECT_VALUES", 3)


def rids(df):
    return sorted(r["rid"] for r in df.select("rid").collect())
