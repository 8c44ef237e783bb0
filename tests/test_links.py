"""Numbers of duplicates and their groups against forming all pairs."""
import math
import random

import pytest
from conftest import HOME
from pyspark.sql import functions as F

from sparkaudit.operators import scale
from sparkaudit.operators.links import components, duplicate_links, exact_limits
from sparkaudit.schema import COMPARED, LISTING_COLUMNS, LISTING_KEY, listing_struct


def by_pairs(records):
    links = {i: set() for i in range(len(records))}
    for i, a in enumerate(records):
        for j, b in enumerate(records):
            if i == j or any(a[k] is None or a[k] != b[k] for k in LISTING_KEY):
                continue
            pa, pb = a["price"], b["price"]
            close = pa is None or pb is None or (math.inf not in (pa, pb) and abs(pa - pb) <= 0.01 * max(pa, pb))
            if close and all(a[c] is None or b[c] is None or a[c] == b[c] for c in COMPARED):
                links[i].add(j)
    group = {}
    for i in links:
        if links[i] and i not in group:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            group |= {j: min(seen) for j in seen}
    return {(i, len(js), group[i]) for i, js in links.items() if js}


def listings_of(spark, records):
    return spark.createDataFrame([(i, *[r[c] for c in LISTING_COLUMNS]) for i, r in enumerate(records)], listing_struct())


@pytest.mark.parametrize("large", [False, True])
def test_links_equal_forming_all_pairs(spark, large, request, monkeypatch):
    """A third of the records share one key; gaps everywhere; prices at every edge of the tolerance, and chains of them."""
    if large:
        request.getfixturevalue("small_limits")
        monkeypatch.setattr(scale, "CELL_VALUES", 60)
    rng = random.Random(8)
    records = []
    for i in range(420):
        base = 1000.0 * 1.0101 ** rng.randrange(14)
        records.append({
            **HOME, "street": 1.0 if i % 3 == 0 else float(i % 70), "brokered_by": rng.choice([42.0, 42.0, 42.0, None]),
            "price": rng.choice([None, 0.0, -0.0, -1.0, math.inf, base, base, base * 0.99, base * 0.9899, base / 0.99, base * 1.0099]),
            **{c: rng.choice([None, 1.0, 2.0, 3.0]) for c in COMPARED if c != "prev_sold_date"},
            "prev_sold_date": rng.choice([None, "2015-06-01", "2016-06-01"])})
    want = by_pairs(records)
    assert {tuple(r) for r in duplicate_links(listings_of(spark, records)).collect()} == want
    assert len(want) > 60 and len({g for _, _, g in want}) > 5


def test_chains_ties_and_unpriced_records(spark):
    chain = [{**HOME, "price": round(100.0 * 1.009 ** i, 2)} for i in range(60)]
    lone = [{**HOME, "street": 5.0, "price": p} for p in (100.0, 200.0)]
    hub = [{**HOME, "street": 6.0, "price": p} for p in (100.0, 200.0, None, 300.0, None)]
    cases = [*chain, *lone, *hub, {**HOME, "street": 7.0}, {**HOME, "street": None}]
    df = listings_of(spark, cases)
    got = {tuple(r) for r in duplicate_links(df).collect()}
    assert got == by_pairs(cases)
    assert {g for i, _, g in got if i < 60} == {0} and {r for r in got if r[0] in (60, 61)} == set()
    assert duplicate_links(df.where("false")).collect() == []


def test_limits_are_the_outermost_doubles(spark):
    rng = random.Random(2)
    prices = [1.0, 99.0, 100.0, 0.1, 2.0 ** 40, 1e-5, 123456.78, 990000.0] + [rng.uniform(1, 1e7) for _ in range(300)]
    low, high = exact_limits(F.col("p"), 0.01)
    for r in spark.createDataFrame([(p,) for p in prices], "p double").select("p", low.alias("low"), high.alias("high")).collect():
        def close(q, p=r["p"]):
            return abs(p - q) <= 0.01 * max(p, q)
        assert close(r["low"]) and not close(math.nextafter(r["low"], 0))
        assert close(r["high"]) and not close(math.nextafter(r["high"], math.inf))


@pytest.mark.parametrize("large", [False, True])
def test_components_of_paths_stars_and_loops(spark, large, request):
    if large:
        request.getfixturevalue("small_limits")
    rng = random.Random(1)
    path = list(range(100, 190))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (301, 300)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 100) for i in path} | {(i, 7) for i in [7, *range(200, 260)]} | {(i, 300) for i in (300, 301, 302)}
