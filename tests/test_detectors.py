import random

import numpy as np
import pytest
from conftest import HOME, rids
from pyspark.sql import functions as F

from sparkaudit.operators import legacy, robust
from sparkaudit.operators.dates import invalid_dates
from sparkaudit.operators.duplicates import duplicates, key_sizes, mark_duplicates, may_share, multi_key_records
from sparkaudit.operators.robust import price_robust_z
from sparkaudit.schema import COMPARED, LISTING_COLUMNS, LISTING_KEY, PROPERTY_KEY, listing_struct
from sparkaudit.session import materialise

# the sentinels and both ends of the range, other forms of a date, and texts
BAD = ["1970-01-01", "1900-01-01", "1899-12-31", "2027-01-01", "5202-07-19", "0000-01-00", "2021-13-05", "2019-02-29",
       "2009-11-23 ", "23-11-2009", "20091123", "+2009-11-23", "n.n.", "soon"]
GOOD = [None, "1900-01-02", "2026-12-31", "1969-12-31", "2020-02-29", "2009-1-3"]


def test_invalid_dates(table):
    df = table(*[{"prev_sold_date": d} for d in BAD + GOOD])
    assert rids(invalid_dates(df)) == list(range(len(BAD)))


def test_older_date_rule_flags_every_missing_date(table):
    df = table({}, {"prev_sold_date": "20####"}, {"status": "sold"}, {"prev_sold_date": None}, {"prev_sold_date": "Unknown"})
    assert rids(legacy.placeholder_dates(df)) == [1, 3, 4]


SOLD = {"status": "sold", "prev_sold_date": "2018-05-07"}


@pytest.mark.parametrize(("changes", "found", "older"), [
    ([SOLD, {"zip_code": 89502.0}, {}], [], [0, 2]),
    ([{}, {"city": "Elko"}, {}, {}], [0, 2, 3], []),
    ([{"acre_lot": None}, {"brokered_by": 43.0}, {}], [0, 2], []),
    ([{"price": 484800.0}, {"price": 495000.0}, {}], [0, 2], []),
    ([{"house_size": None, **SOLD}, {"house_size": None}], [], []),
    ([{"price": -5.0}, {"price": -5.0}], [], []),
    ([{"price": 0.0}, {"price": 0.0}, {"price": 1.0}], [0, 1], []),
    ([{"street": None}, {"street": None}], [], []),
    ([{"bed": None, "bath": 1.0}, {"bath": None, "bed": 2.0}, {"bed": 4.0, "bath": 5.0}], [0, 1], []),
])
def test_row_cases(table, changes, found, older):
    df = table(*changes)
    assert rids(duplicates(df)) == found
    assert rids(legacy.same_price_different_dates(df)) == older


def test_date_outside_the_clock_range_gives_no_span(table):
    df = table({"status": "sold", "prev_sold_date": "2909-11-23"}, {})
    assert rids(legacy.same_price_different_dates(df)) == []
    assert rids(legacy.price_manipulation(df)) == []


def brute_force(records):
    found = set()
    for i, a in enumerate(records):
        for j, b in enumerate(records):
            if i == j or any(a[k] is None or a[k] != b[k] for k in LISTING_KEY):
                continue
            pa, pb = a["price"], b["price"]
            close = pa is None or pb is None or abs(pa - pb) <= 0.01 * max(pa, pb)
            if close and all(a[c] is None or b[c] is None or a[c] == b[c] for c in COMPARED):
                found.add(i)
    return sorted(found)


@pytest.mark.parametrize("large", [False, True])
def test_duplicates_equal_comparing_all_pairs(spark, large, request):
    """A third of the records share one key; gaps everywhere; prices around every edge of the tolerance."""
    if large:
        request.getfixturevalue("small_limits")
    rng = random.Random(3)
    records = []
    for i in range(600):
        base = 1000.0 * 1.0101 ** rng.randrange(12)
        records.append({
            **HOME, "street": 1.0 if i % 3 == 0 else float(i % 90), "brokered_by": rng.choice([42.0, 42.0, 42.0, None]),
            "price": rng.choice([None, 0.0, -1.0, base, base * 0.99, base * 0.9899, base / 0.99, base * 1.0099]),
            **{c: rng.choice([None, 1.0, 2.0, 3.0]) for c in COMPARED if c != "prev_sold_date"},
            "prev_sold_date": rng.choice([None, "2015-06-01", "2016-06-01"])})
    df = spark.createDataFrame([(i, *[r[c] for c in LISTING_COLUMNS]) for i, r in enumerate(records)], listing_struct())
    expected = brute_force(records)
    found = duplicates(df)
    assert rids(found) == expected and 50 < len(expected) < 590
    assert found.columns == df.columns
    marked = mark_duplicates(df)
    assert marked.count() == 600 and rids(marked.where("listing_duplicate")) == expected


def test_key_sizes_and_shared_keys(table):
    df = table({}, {}, {}, {"street": 2.0}, {"street": None})
    assert rids(multi_key_records(df)) == [0, 1, 2]
    assert {tuple(r) for r in key_sizes(df, LISTING_KEY).collect()} == {(3, 1, 3, 3), (1, 1, 1, 0)}


def z_of(df, **options):
    return {r["rid"]: r["price_z"] for r in price_robust_z(df, **options).collect()}


def test_unit_error_stands_out(table):
    """Forty evenly spread prices, and the middle one a hundred times too large and too small."""
    z = z_of(table({"price": 48_000_000.0}, *[{"price": 400_000.0 + 4_000 * i} for i in range(40)], {"price": 4_800.0}))
    assert z[0] > 3.5 < z[41] and all(z[i] < 3.5 for i in range(1, 41))


@pytest.mark.parametrize("large", [False, True])
def test_floor_tames_a_group_of_equal_prices(table, large, request):
    if large:
        request.getfixturevalue("small_limits")
    """One zip code with prices a hair apart and one 15% above; eight others with wide and even prices."""
    tight = [{"price": 640_000.0 + 64 * (i % 12)} for i in range(36)]
    wide = [{"price": 300_000.0 * 1.02 ** (k % 50), "zip_code": 89_600.0 + k // 50, "state": "Utah"} for k in range(400)]
    df = table({"price": 736_000.0}, *tight, *wide)
    assert z_of(df, quantile=None)[0] > 50
    assert z_of(df)[0] < 3.5


def reference_z(records, floor_quantile):
    """The definition, record by record."""
    def log(v):
        return np.log(v) if v is not None and v > 0 else np.nan

    lp = np.array([log(r["price"]) for r in records])
    per_size = lp - np.array([log(r["house_size"]) for r in records])
    zips = [-1.0 if r["zip_code"] is None else r["zip_code"] for r in records]
    states = ["?" if r["state"] is None else r["state"] for r in records]

    def scores(v):
        def stats(groups):
            out = {}
            for g in set(groups):
                x = np.array([a for a, b in zip(v, groups) if b == g and not np.isnan(a)])
                med = np.median(x) if len(x) else np.nan
                out[g] = (len(x), med, np.median(abs(x - med)) if len(x) else np.nan)
            return out

        by_zip, by_state = stats(zips), stats(states)
        mads = [mad for n, _, mad in by_zip.values() if n >= 20]
        floor = np.quantile(mads, floor_quantile) if mads and floor_quantile is not None else 0.0
        out = []
        for a, z, s in zip(v, zips, states):
            n, med, mad = by_zip[z]
            if n < 20 or mad == 0 or np.isnan(mad):
                _, med, mad = by_state[s]
            mad = max(mad, floor)
            gap = a - med
            out.append(np.nan if np.isnan(gap) or (mad == 0 and gap == 0) else
                       np.inf if mad == 0 else abs(0.6745 * gap / mad))
        return out

    first, second = scores(per_size), scores(lp)
    out = []
    for r, a, b in zip(records, first, second):
        z = b if np.isnan(a) else a
        out.append(np.inf if r["price"] is not None and r["price"] <= 0 else 0.0 if np.isnan(z) else z)
    return out


@pytest.mark.parametrize(("large", "quantile"), [(False, 0.05), (True, 0.05), (True, None)])
def test_price_z_equals_the_definition(spark, large, quantile, request):
    if large:
        request.getfixturevalue("small_limits")
    rng = random.Random(5)
    records = [{**HOME, "zip_code": rng.choice([None, 1.0, 1.0, 1.0, 2.0, 3.0, float(rng.randrange(50, 60))]),
                "state": rng.choice([None, "A", "B"]),
                "price": rng.choice([None, 0.0, -3.0, *[float(rng.randrange(1000, 9000)) for _ in range(9)]]),
                "house_size": rng.choice([None, 0.0, *[float(rng.randrange(10, 90)) for _ in range(7)]])}
               for _ in range(400)]
    df = spark.createDataFrame([(i, *[r[c] for c in LISTING_COLUMNS]) for i, r in enumerate(records)], listing_struct())
    got = z_of(df, quantile=quantile)
    assert np.allclose([got[i] for i in range(400)], reference_z(records, quantile), rtol=1e-9)


def test_zero_price_is_infinitely_unusual(table):
    z = z_of(table({"price": 0.0}, *[{"street": float(i)} for i in range(25)], {"price": None}))
    assert z[0] == float("inf") and z[26] == 0.0


def test_no_price_pairs_or_cross_joins_in_the_plan(table):
    plan = duplicates(table({}, {}))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan and F is not None


def test_statistics_of_small_groups_need_no_counts_of_values(spark, monkeypatch):
    rows = [(i, f"k{i % 25}" if i % 11 else None, "f", float(i * i % 53) - 20 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, k string, f string, x double")
    groups = {robust.GROUP: F.col("k"), robust.FALLBACK: F.col("f")}
    measures = {"x": F.col("x"), "minus": -F.col("x")}
    want = {tuple(r) for r in robust.stats_of_counts(
        materialise(robust.measure_counts(df.where("k is not null"), measures, {robust.GROUP: F.col("k")}))).collect()}
    counted = []
    counts = robust.measure_counts
    monkeypatch.setattr(robust, "measure_counts", lambda *a: counted.append(counts(*a)) or counted[-1])
    monkeypatch.setattr(robust.scale, "GROUP_ROWS", 50)
    got = {tuple(r) for r in robust.robust_stats(df, measures, groups).collect()}
    # only the group of all records is counted
    assert {r["key"] for t in counted for r in t.where("key is not null").select("key").distinct().collect()} == {"f"}
    assert {r for r in got if r[0] == robust.GROUP} == want
    values = np.array([r[3] for r in rows if r[3] is not None])
    med, mad = next((r[4], r[5]) for r in got if r[:3] == (robust.FALLBACK, "f", "x"))
    assert (med, mad) == (np.median(values), np.median(np.abs(values - np.median(values))))


def test_keys_are_looked_for_by_their_hash(spark, table, small_limits):
    """Both zeros are one key, and records with a part of the key missing have none."""
    df = table({"street": 0.0}, {"street": -0.0}, {"street": 5.0}, {"street": None}, {"street": None}, {"zip_code": 1.0}, {"zip_code": 1.0, "bed": 9.0})
    assert rids(may_share(df, PROPERTY_KEY)) == [0, 1, 5, 6]
    assert may_share(df, PROPERTY_KEY).columns == df.columns
    assert rids(duplicates(df)) == [0, 1]


def test_rules_on_keys_look_only_at_records_that_may_share_an_address(spark, table, monkeypatch):
    from sparkaudit.plans import validation
    seen = []
    for name, (key, rule) in list(validation.KEY_RULES.items()):
        monkeypatch.setitem(validation.KEY_RULES, name, (key, lambda df, rule=rule: (seen.append(df.count()), rule(df))[1]))
    df = table({}, {"prev_sold_date": None}, *[{"street": float(i)} for i in range(20)])
    flagged, _ = validation.run_detectors(df, forests=False)
    assert seen == [2, 2, 2]
    assert rids(flagged["corrected: listing duplicates"]) == [0, 1]


def test_values_of_large_groups_are_counted_once_per_measure(spark, table, small_limits, monkeypatch):
    from sparkaudit.operators import robust
    monkeypatch.setattr(robust, "measure_counts", None)     # it would put out a row per level and measure again
    df = table(*[{"price": float(100 + i), "zip_code": float(i % 2)} for i in range(12)])
    got = {(r["level"], r["key"], r["measure"]): (r["n"], r["mad"] > 0) for r in robust.price_stats(df).collect()}
    assert got == {**{("group", z, m): (6, True) for z in ("0.0", "1.0") for m in ("per_size", "price")},
                   **{("fallback", "Nevada", m): (12, True) for m in ("per_size", "price")}}
