"""Plantings examined by what they touch against running every detector over the whole planted table."""
from pathlib import Path

import numpy as np
import pytest

from sparkaudit.operators.plant import Spec, plant
from sparkaudit.operators.robust import price_stats
from sparkaudit.plans import validation
from sparkaudit.plans.audit import audit
from sparkaudit.schema import LISTING_COLUMNS, listing_struct
from sparkaudit.session import checkpoint_dir, materialise, scratch, side_by_side

SPEC = Spec(sentinel_dates=12, typo_years=8, exact_duplicates=6, near_duplicates=8, price_factors={10: 4, 100: 4, 1000: 4, 0.001: 4})


@pytest.fixture(scope="module")
def listings(spark):
    """A third of the homes at one address, several records of a home, zip codes with and without enough records."""
    rows = []
    for i in range(900):
        home = 0 if i % 3 == 0 else i % 150
        year = 2012 + (i * 7) % 14
        rows.append({"brokered_by": float(home % 7), "status": ("sold", "for_sale")[i % 2], "price": 1000.0 * (100 + (home * 37) % 60 + i % 5),
                     "bed": 1.0 + home % 4, "bath": None if i % 11 == 0 else 2.0, "acre_lot": 0.25, "street": float(home),
                     "city": f"C{home % 9}", "state": f"S{home % 3}", "zip_code": None if home % 31 == 1 else 100.0 + home % 12,
                     "house_size": None if home % 17 == 2 else 900.0 + 10 * (home % 40), "prev_sold_date": None if i % 13 == 0 else f"{year}-03-0{1 + i % 9}"})
    table = [(i, *[r[c] for c in LISTING_COLUMNS]) for i, r in enumerate(rows)]
    return materialise(spark.createDataFrame(table, listing_struct()))


@pytest.mark.parametrize("large", [False, True])
def test_what_a_planting_touches_gives_the_flags_of_the_whole_table(spark, listings, large, request):
    if large:
        request.getfixturevalue("small_limits")
    base = validation.base_run(listings, forests=False)
    planted = plant(listings, 3, SPEC)
    whole = materialise(planted.table)
    flags, scores = validation.detectors_after(base, planted, 3, forests=False)
    want_flags, want_scores = validation.run_detectors(whole, 3, forests=False, stats=price_stats(whole))
    for name, rows in want_flags.items():
        got = [r["rid"] for r in flags[name].collect()]
        assert sorted(got) == sorted(r["rid"] for r in rows.collect()), name
    for name, rows in want_scores.items():
        assert {tuple(r) for r in scores[name].collect()} == {tuple(r) for r in rows.collect()}, name
    changed = {r["rid"] for r in flags["corrected: listing duplicates"].collect()} ^ {
        r["rid"] for r in base.flags.where("detector = 'corrected: listing duplicates'").collect()}
    assert changed and len(want_flags) == 7


def test_jobs_side_by_side_keep_their_order_and_stop_at_a_failure(spark):
    assert side_by_side(spark, [lambda i=i: spark.range(i).count() for i in range(7)], 3) == list(range(7))
    started = []

    def job(i):
        started.append(i)
        if i == 1:
            raise ValueError("no")
        return spark.range(50).count()

    with pytest.raises(ValueError, match="no"):
        side_by_side(spark, [lambda i=i: job(i) for i in range(40)], 1)
    assert started == [0, 1]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    def tables():
        return sorted(p.name for p in Path(checkpoint_dir(spark).removeprefix("file:"), "tables").glob("*"))

    before = tables()
    with scratch(spark):
        gone = materialise(spark.range(3))
        with scratch(spark):
            inner, lifted = materialise(spark.range(4)), materialise(spark.range(5), kept=True)
            assert side_by_side(spark, [lambda: materialise(gone.union(inner)).count()] * 3, 2) == [7] * 3
        assert lifted.count() == 5
        with pytest.raises(Exception, match="(?i)not.*exist"):
            inner.collect()
        stays = materialise(lifted.union(gone), kept=True)
    with pytest.raises(ValueError), scratch(spark):
        materialise(spark.range(2))
        raise ValueError
    assert len(tables()) == len(before) + 1 and stays.count() == 8


def test_an_audit_and_a_validation_leave_their_results_alone(spark, listings):
    def tables():
        return len(list(Path(checkpoint_dir(spark).removeprefix("file:"), "tables").glob("*")))

    before = tables()
    result = audit(listings, stored=True)
    assert tables() == before + 2 and result.report.count() > 0 and result.summary.count() > 5
    metrics, recalls = validation.validate(listings, SPEC, n_seeds=2, forests=False)
    assert tables() == before + 4 and metrics.count() == 14 and recalls.count() > 0


def test_path_lengths_equal_a_walk_down_every_tree():
    from sparkaudit.operators import iforest
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 5, 300), np.ones(300)]).astype(float)
    grown = [sorted(iforest.build_tree(t, x[rng.choice(300, 64, replace=False)], 1), key=lambda n: n[1]) for t in range(5)]
    grown.append(iforest.build_tree(9, x[:1], 1))      # a root that is a leaf
    x[7, 0] = np.nan
    want = np.zeros(300)
    for i in range(300):
        for tree in grown:
            node = tree[0]
            while node[2] >= 0:
                node = tree[node[4] if x[i, node[2]] <= node[3] else node[5]]
            want[i] += node[6]
    assert (iforest.path_lengths(x, [tuple(np.array(c) for c in list(zip(*tree, strict=True))[2:]) for tree in grown]) == want).all()
