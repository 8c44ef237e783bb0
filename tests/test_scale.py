import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkaudit.operators import scale
from sparkaudit.operators.scale import attach, group_quantiles, kth_smallest, running_totals, smallest_of_groups, value_counts


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows in one group, a third of them one value."""
    rng = np.random.default_rng(0)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{i % 40}"
        value = 5.0 if i % 9 == 0 else float(rng.normal(0, 100))
        data.append((group, value if i % 50 else None))
    return spark.createDataFrame(data, "g string, x double"), data


@pytest.mark.parametrize("large", [False, True])
def test_quantiles_of_every_group_are_exact(rows, large, request):
    if large:
        request.getfixturevalue("small_limits")
    df, data = rows
    found = group_quantiles(value_counts(df, ["g"], F.col("x")), ["g"], [0.05, 0.5, 1.0], stored=True).collect()
    assert len(found) == len({g for g, _ in data})
    for r in found:
        values = np.array([x for g, x in data if g == r["g"] and x is not None])
        assert r["n"] == len(values)
        assert np.allclose([r["q0"], r["q1"], r["q2"]], np.quantile(values, [0.05, 0.5, 1.0]), atol=1e-9)


def test_both_ways_of_quantiles_agree_to_the_last_bit(rows, small_limits):
    counts = value_counts(rows[0], ["g"], F.col("x"))
    probs, names = [0.05, 0.3, 0.77], ["a", "b", "c"]
    by_cells = {tuple(r) for r in group_quantiles(counts, ["g"], probs, names=names, stored=True).collect()}
    direct = {tuple(r) for r in group_quantiles(counts, ["g"], probs, names=names, stored=True, small=True).collect()}
    assert by_cells == direct


DOUBLES = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1074 * 7, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.0, 1.0 - 2 ** -53, 1.0 + 2 ** -52,
           -1.0, 8.0, 8.0 - 2 ** -50, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1e-300, 0.1, 3.0]


@given(st.lists(st.floats(allow_nan=False), max_size=30))
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
def test_ordering_keys_are_the_bits_of_the_doubles(spark, some):
    values = DOUBLES + some
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scale.ordering_key(F.col("v")).alias("k")).collect()
    for r in got:
        size = struct.unpack(">q", struct.pack(">d", abs(r["v"])))[0]
        assert r["k"] == (-size if r["v"] < 0 else size)


def test_a_large_table_of_small_groups_is_not_descended(spark, monkeypatch):
    monkeypatch.setattr(scale, "DIRECT_VALUES", 50)
    monkeypatch.setattr(scale, "GROUP_ROWS", 20)
    data = [(f"g{i % 30}", float(i * i % 97), 1 + i % 3) for i in range(240)]
    hot = [("hot", float(i), 1) for i in range(60)]
    rows = [(g, v, sum(n for h, w, n in data if (h, w) == (g, v))) for g, v in {(g, v) for g, v, _ in data}] + hot
    df = spark.createDataFrame(rows, "g string, v double, n long")
    seen, by_cells = [], scale.quantiles_by_cells
    monkeypatch.setattr(scale, "quantiles_by_cells", lambda t, *a: seen.extend(r["g"] for r in t.select("g").distinct().collect())
                        or by_cells(t, *a))
    got = {tuple(r) for r in group_quantiles(df, ["g"], [0.5], stored=True).collect()}
    assert seen == ["hot"]
    assert got == {tuple(r) for r in group_quantiles(df, ["g"], [0.5], stored=True, small=True).collect()}


def test_ordering_keys_put_nan_last(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,)], "v double")
    assert [str(r["v"]) for r in df.orderBy(scale.ordering_key(F.col("v"))).collect()] == ["-1.0", "inf", "nan"]


def packed_values():
    """All but two of the values lie in a billionth of the range."""
    return [0.5 + i * 1e-12 for i in range(3000)] + [-1e9, 1e9]


@pytest.mark.parametrize("cell_values", [40, 1_000_000])
def test_packed_values_do_not_meet_in_one_task(spark, small_limits, monkeypatch, cell_values):
    monkeypatch.setattr(scale, "CELL_VALUES", cell_values)
    values = packed_values()
    df = spark.createDataFrame([(g, v, 1 + i % 3) for g in ("a", "b") for i, v in enumerate(values)], "g string, v double, n long")
    held = []
    stored = scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda t: held.append(stored(t)) or held[-1])
    probs = [0.05, 0.5, 1.0]
    got = {tuple(r) for r in group_quantiles(df, ["g"], probs, stored=True).collect()}
    cells = [t for t in held if "_rows" in t.columns]
    assert len(cells) == (1 if cell_values > 3000 else 4 if cells[-1].agg(F.max("_rows")).first()[0] == 1 else len(cells))
    assert cells[-1].agg(F.max("_rows")).first()[0] <= max(cell_values, 1)
    assert got == {tuple(r) for r in group_quantiles(df, ["g"], probs, stored=True, small=True).collect()}
    one = df.where("g = 'a'").select("v", "n")
    held.clear()
    sums, total = {}, 0
    for v, n in sorted((v, 1 + i % 3) for i, v in enumerate(values)):
        total += n
        sums[v] = total
    assert {r["v"]: r["cum_n"] for r in running_totals(one, "v", ["n"]).collect()} == sums
    if cell_values == 40:       # ranges follow the values: none holds many times its share
        sizes = held[-1].groupBy("_cell").count().agg(F.max("count"), F.count("*")).first()
        assert sizes[0] <= 6 * cell_values and sizes[1] > 30


def test_smallest_of_several_groups_at_once(spark):
    rng = np.random.default_rng(3)
    values = {g: sorted(int(v) for v in rng.integers(0, 2 ** 60, n)) for g, n in ((True, 40), (False, 300))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g boolean, u long")
    got = smallest_of_groups(df, "u", "g", {True: [0, 1, 40, 41], False: [7, 150, 150, 300]})
    assert got == {(True, 0): -1, (True, 41): None, **{(g, k): values[g][k - 1] for g, k in (
        (True, 1), (True, 40), (False, 7), (False, 150), (False, 300))}}


def test_quantile_of_a_whole_table_and_of_none(rows, small_limits):
    df, data = rows
    whole = group_quantiles(value_counts(df, [], F.col("x")), [], [0.25], stored=True).first()
    assert whole["q0"] == pytest.approx(np.quantile([x for _, x in data if x is not None], 0.25))
    none = group_quantiles(value_counts(df.where("false"), [], F.col("x")), [], [0.25], stored=True).first()
    assert none["q0"] is None


def test_running_totals_follow_the_order_of_values(spark):
    values = [-5.5, 0.0, 0.25, 3.0, 1e9, float("inf"), -1e-9, 12.0]
    df = spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "v double, n long")
    for descending in (False, True):
        got = {r["v"]: r["cum_n"] for r in running_totals(df, "v", ["n"], descending).collect()}
        total, want = 0, {}
        for v, n in sorted(((v, i + 1) for i, v in enumerate(values)), reverse=descending):
            total += n
            want[v] = total
        assert got == want


@pytest.mark.parametrize("k", [1, 2, 57, 500])
def test_kth_smallest_by_prefixes_equals_sorting(spark, k):
    rng = np.random.default_rng(1)
    values = sorted(int(v) for v in rng.integers(0, 2 ** 60, 499)) + [2 ** 60 - 1]
    df = spark.createDataFrame([(v,) for v in values], "u long")
    assert kth_smallest(df, "u", k) == kth_smallest(df, "u", k, bounded=True) == values[k - 1]
    assert kth_smallest(df, "u", 501) is kth_smallest(df, "u", 501, bounded=True) is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_gives_the_same_rows_on_every_path(spark, rows, how, small_limits, monkeypatch):
    df = rows[0].withColumn("id", F.monotonically_increasing_id())
    stats = df.where("g <> 'g1'").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"))
    large = sorted(attach(df, stats, ["g"], "n", how).collect(), key=lambda r: r["id"])
    plan = attach(df, stats, ["g"], "n", how)._jdf.queryExecution().optimizedPlan().toString()
    assert "_spread" in plan
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 10_000)
    small = sorted(attach(df, stats, ["g"], "n", how).collect(), key=lambda r: r["id"])
    assert large == small and len(small) == (3000 if how == "left" else df.where("g <> 'g1'").count())
