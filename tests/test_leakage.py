import random

import numpy as np
import pytest
from conftest import HOME
from pyspark.sql import functions as F

from sparkaudit.operators import models, splits
from sparkaudit.operators.iforest import draw, isolation_forest
from sparkaudit.operators.leakage import HOME as PHYSICAL
from sparkaudit.operators.leakage import mechanism_table, regression_metrics, twin_flags
from sparkaudit.operators.properties import with_property
from sparkaudit.operators.rootcause import group_mixes, spearman
from sparkaudit.plans.leakage import naive_comparison, store_leakage
from sparkaudit.schema import LISTING_COLUMNS, MODEL_FEATURES, PROPERTY_KEY, listing_struct
from sparkaudit.session import materialise
from sparkaudit.sources.versions import latest


@pytest.fixture(scope="module")
def listings(spark):
    """About a quarter of the records share a property; one address has a third of all records."""
    rng = random.Random(0)
    rows = []
    for i in range(900):
        home = {**HOME, "street": None if i < 20 else 5000.0 if i % 3 == 0 else float(rng.randrange(500)),
                "price": float(rng.choice([200, 250, 300, 5])) * 1000, "status": rng.choice(["for_sale", "sold"]),
                **{c: rng.choice([None, 1.0, 2.0]) for c in PHYSICAL},
                "prev_sold_date": rng.choice(["2015-06-01", "2016-06-01", None])}
        rows.append((i, *[home[c] for c in LISTING_COLUMNS]))
    return spark.createDataFrame(rows, listing_struct())


@pytest.fixture(scope="module")
def split(listings):
    return materialise(splits.with_twins(splits.random_split(splits.prepare(listings), 1)))


def test_property_ids(listings):
    ids = {r["rid"]: (r["street"], r["pid"]) for r in with_property(listings).collect()}
    known = {}
    for street, pid in ids.values():
        if street is not None:
            known.setdefault(street, set()).add(pid)
    alone = [pid for street, pid in ids.values() if street is None]
    assert all(len(p) == 1 for p in known.values()) and len(set(alone)) == 20
    assert not set(alone) & {p for s in known.values() for p in s}


def test_prepare_filters_then_codes(split):
    rows = split.collect()
    assert all(10_000 <= r["price"] <= 50_000_000 for r in rows) and len(rows) < 900
    assert {r["status"]: r["status_code"] for r in rows} == {"for_sale": 0, "sold": 1}
    assert {r["sold_year"] for r in rows} == {2015, 2016, None}


def test_twins_are_the_training_rows_whose_property_is_tested(split):
    rows = split.collect()
    test = {r["street"] for r in rows if r["is_test"] and r["street"] is not None}
    train = {r["street"] for r in rows if not r["is_test"] and r["street"] is not None}
    assert 0.1 < sum(r["is_test"] for r in rows) / len(rows) < 0.3
    assert all(r["twin"] == (not r["is_test"] and r["street"] in test) for r in rows)
    assert all(r["seen"] == (r["is_test"] and r["street"] in train) for r in rows)


def test_training_size_is_constant(split):
    rows = split.collect()
    twins = {r["rid"] for r in rows if r["twin"]}
    train = {r["rid"] for r in rows if not r["is_test"]}
    for share, kept in splits.training_rows(split, [0.0, 0.25, 0.5, 1.0], 1).items():
        ids = [r["rid"] for r in kept.collect()]
        assert len(ids) == len(set(ids)) == len(train) - len(twins) and set(ids) <= train
        assert len(twins & set(ids)) == round(share * len(twins))


def test_grouped_split_keeps_properties_together(listings):
    rows = splits.grouped_split(splits.prepare(listings), 3).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r["pid"], set()).add(r["is_test"])
    assert all(len(s) == 1 for s in sides.values())
    assert sum(True in s for s in sides.values()) == int(np.ceil(0.2 * len(sides)))


def test_filled_design_matrix(split):
    rows = split.collect()
    median = np.median([r["bed"] for r in rows if r["bed"] is not None])
    x = {r["rid"]: r for r in splits.design_matrix(split).collect()}
    assert all(x[r["rid"]]["bed_missing"] == (r["bed"] is None) for r in rows)
    assert all(x[r["rid"]]["bed"] == (median if r["bed"] is None else r["bed"]) for r in rows)


@pytest.mark.parametrize("large", [False, True])
def test_twin_anatomy_equals_comparing_all_pairs(split, large, request):
    if large:
        request.getfixturevalue("small_limits")
    rows = split.collect()
    twins = [r for r in rows if r["twin"]]

    def equal(a, b, columns, gaps):
        return all((a[c] == b[c]) if a[c] is not None and b[c] is not None
                   else gaps or (a[c] is None and b[c] is None) for c in columns)

    want = {}
    for r in rows:
        if r["seen"]:
            mine = [t for t in twins if all(t[c] == r[c] for c in PROPERTY_KEY)]
            want[r["rid"]] = (len(mine), any(equal(r, t, PHYSICAL, True) for t in mine),
                              any(r["price"] == t["price"] for t in mine),
                              any(equal(r, t, MODEL_FEATURES, False) for t in mine))
    got = {r["rid"]: tuple(r)[1:] for r in twin_flags(split.drop("pid")).collect()}
    assert got == want and len({w[1:] for w in want.values()}) > 2


def test_metrics_and_mechanism(spark):
    rng = np.random.default_rng(0)
    y, noise = rng.normal(12, 1, 200), rng.normal(0, 0.3, 200)
    df = spark.createDataFrame([("m", float(a), float(a + e)) for a, e in zip(y, noise)], "model string, y double, p double")
    got = regression_metrics(df, ["model"]).first()
    assert got["r2"] == pytest.approx(1 - (noise ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["mae_log"] == pytest.approx(abs(noise).mean())
    assert got["median_ape"] == pytest.approx(np.median(abs(np.exp(noise) - 1)))
    records = spark.createDataFrame([("m", s, i, i == 0, 0.5 - 0.1 * s * (i + 1)) for s in (0.0, 1.0) for i in range(3)],
                                    "model string, keep_share double, row long, seen boolean, abs_err double")
    got = {r["seen"]: (r["n"], round(r["change"], 6)) for r in mechanism_table(records).collect()}
    assert got == {"twin in training": (1, -0.1), "no twin": (2, -0.25)}


@pytest.mark.parametrize(("model", "settings"), [
    (models.RIDGE, {}), (models.BOOSTING, {"iterations": 3}), (models.FOREST, {"trees": 3, "depth": 5})])
def test_models_predict_every_test_row(split, model, settings):
    data = materialise(models.matrix(split, model))
    test = data.where("is_test")
    rows = models.fit_predict(data.where("not is_test"), test, model, **settings).collect()
    assert len(rows) == test.count() and all(np.isfinite(r["p"]) for r in rows)
    assert abs(np.mean([r["p"] - r["y"] for r in rows])) < 0.5


@pytest.mark.parametrize("n,trees", [(40_000, 30), (300, 20), (100, 5)])
def test_trees_draw_from_the_whole_table(spark, n, trees):
    df = spark.range(n).select(F.col("id").alias("rid"), F.array(F.col("id").cast("double")).alias("x"))
    drawn = {}
    for r in draw(df, 4, trees, 256, n).collect():
        drawn.setdefault(r["tree"], set()).add(r["rid"])
    assert len(drawn) == trees and all(len(rows) == min(256, n) for rows in drawn.values())
    shared = [len(drawn[a] & drawn[b]) for a in drawn for b in drawn if a < b]
    expected = min(256, n) ** 2 / n      # of two independent draws
    assert abs(sum(shared) / len(shared) - expected) < 0.15 * expected + 0.1
    assert abs(sum(sum(rows) for rows in drawn.values()) / sum(map(len, drawn.values())) - (n - 1) / 2) < 0.02 * n


def test_isolation_forest_ranks_planted_prices_high(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        home = {**HOME, "price": float(rng.lognormal(12.6, 0.2)), "house_size": float(rng.normal(1800, 200)),
                "zip_code": float(i % 5)}
        if i < 15:
            home["price"] *= 1000
        rows.append((i, *[home[c] for c in LISTING_COLUMNS]))
    df = spark.createDataFrame(rows, listing_struct())
    got = {r["rid"]: r["score"] for r in isolation_forest(df, 0, price_only=True).collect()}
    again = {r["rid"]: r["score"] for r in isolation_forest(df.repartition(5), 0, price_only=True).collect()}
    assert len(got) == 1500 and all(0 < s <= 1 for s in got.values())
    assert got == pytest.approx(again)
    assert min(got[i] for i in range(15)) > np.quantile([got[i] for i in range(15, 1500)], 0.95)


def test_mixes_of_small_and_huge_groups(spark):
    df = spark.createDataFrame([("a", "sold"), ("a", "for_sale"), (None, "sold")] + [("big", "sold")] * 1500,
                               "k string, status string")
    got = {r["k"]: (r["records"], r["mix"]) for r in group_mixes(df, ["k"]).collect()}
    assert got == {"a": (2, "for_sale + sold"), None: (1, "sold"), "big": (1500, "sold x 1500")}


def test_spearman_with_ties(spark):
    a, b = [1, 2, 2, 3, 5, 5], [2.0, 1.0, 4.0, 4.0, 9.0, 3.0]
    ranks = [np.array([sum(v < x for v in s) + (sum(v == x for v in s) + 1) / 2 for x in s]) for s in (a, b)]
    got = spearman(spark.createDataFrame(list(zip(a, b)), "a int, b double"), "a", "b").first()
    assert got["rho"] == pytest.approx(np.corrcoef(*ranks)[0, 1])


SMALL = {models.FOREST: {"trees": 2, "depth": 3}}


def test_leakage_conditions_and_stored_results(spark, listings, tmp_path):
    prepared = materialise(splits.prepare(listings))
    options = {"n_seeds": 1, "shares": [0.0, 1.0], "settings": SMALL}
    store_leakage(prepared, str(tmp_path), only=(models.RIDGE, models.FOREST), **options)
    before = {tuple(r[c] for c in ("model", "keep_share", "subset")): (r["n_test"], r["n_train"], r["r2"])
              for r in latest(spark, str(tmp_path / "leakage"))["leakage_metrics"].collect()}
    assert len(before) == 2 * 2 * 3
    part = splits.with_twins(splits.random_split(prepared, 0)).collect()
    for (_, _, subset), (n_test, n_train, _) in before.items():
        seen = {"all test rows": (True, False), "property seen in train": (True,), "property not seen": (False,)}[subset]
        assert n_test == sum(r["is_test"] and r["seen"] in seen for r in part)
        assert n_train == sum(not r["is_test"] and not r["twin"] for r in part)
    store_leakage(prepared, str(tmp_path), only=(models.RIDGE,), **{**options, "n_seeds": 2})
    after = latest(spark, str(tmp_path / "leakage"))["leakage_metrics"]
    assert {r["model"]: r["count"] for r in after.groupBy("model").count().collect()} == {models.RIDGE: 12, models.FOREST: 6}
    table = latest(spark, str(tmp_path / "leakage"))["leakage_mechanism"]
    assert table.count() == 4 and {r["model"] for r in table.collect()} == {models.RIDGE, models.FOREST}


def test_naive_comparison_of_both_splits(listings):
    rows = naive_comparison(materialise(splits.prepare(listings)), n_seeds=2, models=(models.RIDGE,)).collect()
    assert {(r["seed"], r["split"]) for r in rows} == {(s, p) for s in (0, 1) for p in ("random", "grouped")}
    assert all(r["n_test"] > 0 and r["r2"] is not None for r in rows)


def test_metrics_of_one_row_or_one_price_have_no_r2(spark):
    rows = spark.createDataFrame([("one", 1.0, 1.5), ("same", 2.0, 2.0), ("same", 2.0, 2.5), ("two", 1.0, 1.0), ("two", 2.0, 2.0)], "g string, y double, p double")
    got = {r["g"]: (r["n_test"], r["r2"]) for r in regression_metrics(rows, ["g"]).collect()}
    assert got == {"one": (1, None), "same": (2, None), "two": (2, 1.0)}
