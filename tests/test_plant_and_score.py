import numpy as np
import pytest
from conftest import HOME
from pyspark.sql import functions as F

from sparkaudit.operators.dates import invalid_dates
from sparkaudit.operators.duplicates import duplicates
from sparkaudit.operators.plant import Spec, plant, sample
from sparkaudit.operators.score import (confidence_interval, flag_metrics, recall_by_subtype, score_metrics,
                                        t_critical)
from sparkaudit.plans.validation import FAMILIES, run_detectors, validate
from sparkaudit.schema import LISTING_COLUMNS, listing_struct
from sparkaudit.session import materialise

SPEC = Spec(sentinel_dates=7, typo_years=13, exact_duplicates=9, near_duplicates=16, price_factors={100: 6, 0.01: 5, 7: 4})
COPIES = SPEC.exact_duplicates + SPEC.near_duplicates
HOMES = 1400


@pytest.fixture(scope="module")
def small(spark):
    """One home per address, every value a formula of its number; all years can be misread by a swap of digits or not."""
    rows = []
    for i in range(HOMES):
        home = {**HOME, "street": 5000.0 + 3 * i, "price": 90_000.0 + 1_250 * (i * 37 % 611), "bed": 1.0 + i % 6,
                "zip_code": 89_400.0 + i % 11, "house_size": 700.0 + (i * 53) % 1900,
                "prev_sold_date": f"{2003 + i % 18}-{1 + i % 12:02d}-{1 + i % 28:02d}"}
        rows.append((i, *[home[c] for c in LISTING_COLUMNS]))
    return spark.createDataFrame(rows, listing_struct())


def test_planting_is_reproducible_and_disjoint(small):
    first, second = plant(small, 3, SPEC), plant(small.repartition(7), 3, SPEC)
    labels = sorted(map(tuple, first.labels.collect()))
    rows = sorted(map(tuple, first.table.collect()), key=lambda r: r[0])
    assert labels == sorted(map(tuple, second.labels.collect()))
    assert rows == sorted(map(tuple, second.table.collect()), key=lambda r: r[0])
    assert [r[0] for r in rows] == list(range(HOMES + COPIES))
    dates, prices = SPEC.sentinel_dates + SPEC.typo_years, sum(SPEC.price_factors.values())
    assert len({r[0] for r in labels}) == len(labels) == dates + 2 * COPIES + prices
    wrong = {r["rid"] for r in invalid_dates(first.table).collect()}
    assert wrong == {r[0] for r in labels if r[1] == "invalid_date"} and len(wrong) == dates
    planted = {r[0] for r in labels if r[1] == "duplicate"}
    assert planted <= {r["rid"] for r in duplicates(first.table).collect()}
    assert labels != sorted(map(tuple, plant(small, 4, SPEC).labels.collect()))


def test_changes_of_each_stage(small):
    before = {r["rid"]: r for r in small.collect()}
    for r in plant(small, 0, SPEC).changes.collect():
        source = before[r["source_rid"]]
        if r["stage"] == "year_plus_1000":
            assert int(r["prev_sold_date"][:4]) == int(source["prev_sold_date"][:4]) + 1000
        elif r["stage"] == "transposed_year":
            y = source["prev_sold_date"][:4]
            assert r["prev_sold_date"] == y[:2] + y[3] + y[2] + source["prev_sold_date"][4:] and int(r["prev_sold_date"][:4]) > 2026
        elif r["stage"] == "blanked_duplicates":
            assert sum(r[c] is None for c in ("bed", "bath", "acre_lot", "house_size")) == 1
        elif r["stage"] == "repriced_duplicates":
            assert 0.0009 <= abs(r["price"] / source["price"] - 1) <= 0.0051
        elif r["stage"].startswith("price_x"):
            assert r["price"] / source["price"] == pytest.approx(float(r["stage"][7:]))


def test_too_small_a_pool_is_an_error(small):
    with pytest.raises(ValueError, match="exact_duplicates"):
        plant(small, 0, Spec(exact_duplicates=HOMES + 1, sentinel_dates=0, typo_years=0, near_duplicates=0, price_factors={}))


def test_sample(small):
    picked = {r["rid"] for r in sample(small, 31, 1, F.col("rid") % 2 == 1).collect()}
    assert len(picked) == 31 and all(r % 2 for r in picked)


def labelled(spark, *rows):
    return spark.createDataFrame(list(rows), "rid long, family string, subtype string")


def test_flag_metrics(spark):
    """Nine records: five flagged, of which three are labelled; four labelled ones in all."""
    flags = spark.createDataFrame([(i, i in (1, 2, 4, 6, 8)) for i in range(9)], "rid long, flag boolean")
    labels = labelled(spark, (1, "x", "s"), (4, "x", "s"), (8, "x", "s"), (5, "x", "t"), (2, "y", "s"))
    m = flag_metrics(flags, labels, "x", flags.where("rid in (1, 6)")).first()
    assert (m["flagged"], m["tp"], m["fp"], m["fn"]) == (5, 3, 2, 1)
    assert (m["precision"], m["recall"], m["f1"]) == (0.6, 0.75, pytest.approx(2 / 3))
    assert (m["fp_preexisting"], m["precision_upper"]) == (1, 0.75)
    none = flag_metrics(flags.withColumn("flag", F.lit(False)), labels, "x").first()
    assert none["precision"] is None and none["recall"] == 0 and none["f1"] is None
    assert {r["subtype"]: r["recall"] for r in recall_by_subtype(flags, labels, "x").collect()} == {"s": 1.0, "t": 0.0}


def test_score_metrics_against_the_definition(spark):
    rng = np.random.default_rng(2)
    scores = [float(v) for v in rng.integers(0, 40, 500)] + [float("inf")] * 5
    positive = [bool(v < 0.1) for v in rng.random(500)] + [True] * 5
    df = spark.createDataFrame(list(enumerate(scores)), "rid long, score double")
    labels = labelled(spark, *[(i, "x", "s") for i, p in enumerate(positive) if p])
    got = score_metrics(df, labels, "x").first()
    ap, tp, n, k = 0.0, 0, 0, sum(positive)
    for value in sorted(set(scores), reverse=True):
        here = [p for s, p in zip(scores, positive) if s == value]
        tp, n = tp + sum(here), n + len(here)
        ap += sum(here) / k * tp / n
    assert got["average_precision"] == pytest.approx(ap)
    above = [p for s, p in zip(scores, positive)]
    order = sorted(scores, reverse=True)[k - 1]
    sure = sum(p for s, p in zip(scores, above) if s > order)
    tied = [p for s, p in zip(scores, above) if s == order]
    room = k - sum(s > order for s in scores)
    assert got["r_precision"] == pytest.approx((sure + sum(tied) * room / len(tied)) / k)


def test_t_interval(spark):
    assert t_critical(4) == pytest.approx(2.7764451, abs=1e-6) and t_critical(1) == pytest.approx(12.7062047, abs=1e-5)
    values = [0.1, 0.4, 0.2, 0.3, 0.5]
    row = spark.createDataFrame([(v,) for v in values], "v double").agg(*confidence_interval(F.col("v"))).first()
    assert row["mean"] == pytest.approx(0.3)
    assert row["half_width"] == pytest.approx(2.7764451 * np.std(values, ddof=1) / 5 ** 0.5, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 61, 62, 200, 5000])
def test_t_interval_of_any_number_of_runs(spark, n):
    values = [((i * 37) % 101) / 7 for i in range(n)]
    row = spark.createDataFrame([(v,) for v in values], "v double").agg(*confidence_interval(F.col("v"))).first()
    if n == 1:
        assert row["half_width"] is None
    else:
        want = t_critical(n - 1) * np.std(values, ddof=1) / n ** 0.5
        assert row["half_width"] == pytest.approx(want, rel=1e-8)


def test_validation_equals_scoring_one_by_one(small):
    """Two seeds and seven detectors in one aggregate against counting by hand."""
    df = materialise(small)
    metrics, recalls = validate(df, SPEC, n_seeds=2, forests=False)
    got = {(r["seed"], r["detector"]): r for r in metrics.collect()}
    names, _ = run_detectors(df, forests=False)
    assert set(got) == {(s, n) for s in (0, 1) for n in names}
    planted = plant(df, 1, SPEC)
    labels = {(r["rid"], r["family"]) for r in planted.labels.collect()}
    before = {n: {r["rid"] for r in f.collect()} for n, f in names.items()}
    for name, found in run_detectors(materialise(planted.table), 1, forests=False)[0].items():
        hits, family = {r["rid"] for r in found.collect()}, FAMILIES[name]
        true = {r for r, f in labels if f == family}
        row = got[1, name]
        assert (row["tp"], row["fp"], row["fn"]) == (len(hits & true), len(hits - true), len(true - hits))
        assert row["fp_preexisting"] == len((hits - true) & before[name]) and row["flagged"] == len(hits)
        assert (row["average_precision"] is None) == (family != "price_unit")
    assert {r["recall"] for r in recalls.where("detector = 'corrected: invalid dates'").collect()} == {1.0}
