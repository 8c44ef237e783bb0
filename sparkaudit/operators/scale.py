"""Exact building blocks that never put one key's rows into one task.

Every helper works on pre-aggregated rows or spreads a key over many partitions, so a key that holds a third of
the table costs no more than many small ones.
"""
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialise, stored_rows

# the task function travels with its helpers, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a key-value table that may be broadcast. About 10 MB at 100 bytes a row.
BROADCAST_ROWS = 100_000
# Keys whose rows are matched without a shuffle: those with more than 1/1000 of all rows, so fewer than 1000.
HEAVY_KEYS = 1_000
# Value-count rows of a whole table that one task could hold, should they all belong to one group.
DIRECT_VALUES = 4_000_000
# Bits of an ordering key that one round of a descent settles, and distinct values that one task may put in order.
RADIX_BITS = 16
CELL_VALUES = 1_000_000
# Rows of one group that may meet in one row or buffer of an aggregate.
GROUP_ROWS = 100_000


def attach(rows, stats, keys, weight, how="inner", stored=False):
    """Add the columns of ``stats`` (one row per key, keys never missing) to the rows of each key.

    ``weight`` names a column of ``stats`` that grows with the key's number of rows. ``stats`` is stored unless it
    already is, and broadcast when it has at most ``BROADCAST_ROWS`` rows. Beyond that the keys with more than a
    ``HEAVY_KEYS``-th of the whole weight, fewer than ``HEAVY_KEYS``, are broadcast; their rows pass the shuffle join
    scattered over all partitions instead of meeting in one.
    """
    extra = [c for c in stats.columns if c not in keys]
    stats = stats if stored else materialise(stats)
    if stored_rows(stats) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stats), keys, how).select(*rows.columns, *extra)
    packed = stats.select(*keys, F.col(weight).alias("_weight"), F.struct(*extra).alias("_stat"))
    total = packed.agg(F.sum("_weight")).scalar()
    heavy = packed.where(F.col("_weight") * HEAVY_KEYS > total).select(*keys, F.col("_stat").alias("_heavy"))
    light = packed.select(*keys, F.lit(0).alias("_spread"), F.col("_stat").alias("_light"))
    scattered = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int") + 1
    marked = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_spread", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(scattered))
    found = marked.join(light, [*keys, "_spread"], "left").withColumn("_stat", F.coalesce("_heavy", "_light"))
    if how == "inner":
        found = found.where(F.col("_stat").isNotNull())
    return found.select(*rows.columns, *[F.col("_stat")[c].alias(c) for c in extra])


def keep_matching(rows, groups, keys, weight, stored=False):
    """Rows whose key occurs in ``groups``: a semi-join that is safe for heavy keys."""
    return attach(rows, groups.select(*keys, F.col(weight).alias("_found")), keys, "_found",
                  stored=stored).drop("_found")


def beside(rows, *one_rows):
    """The columns of one-row tables next to every row of ``rows``, as scalar subqueries."""
    for one in one_rows:
        packed = one.select(F.struct("*").alias("_one")).scalar()
        rows = rows.withColumn("_one", packed).select(*rows.columns, *[F.col("_one")[c].alias(c) for c in one.columns])
    return rows


def ordering_key(value):
    """A bigint that orders doubles as they are ordered, one per value: the bits of the magnitude, with its sign.

    Both zeros are 0, NaN comes last. Computed on Arrow batches: as an expression it is too long for compiled code.
    """
    @F.pandas_udf(LongType())
    def key(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=np.float64)
        bits = np.abs(v).view(np.int64)
        return pd.Series(np.where(v < 0, -bits, bits))

    return key(value)


def group_quantiles(counts, keys, probs, value="v", weight="n", names=None, stored=False, small=None):
    """Exact quantiles (linear interpolation) of every group, with the group's size as ``n``.

    ``counts`` has one row per group and distinct value and its number of occurrences; keys are never missing.
    ``stored`` says that it is cheap to read more than once, ``small`` that its size was checked before. When the
    whole of it has at most ``DIRECT_VALUES`` rows, no
    group can be too large for Spark's own ``percentile``; beyond that the groups of more than ``group_limit`` values are
    looked for, and only their quantiles are found by cells.
    """
    names = names or [f"q{i}" for i in range(len(probs))]
    counts = counts if stored else materialise(counts)
    if small or (small is None and stored_rows(counts) <= DIRECT_VALUES):
        return percentiles(counts, keys, probs, value, weight, names)
    if not keys:
        return quantiles_by_cells(counts, keys, probs, value, weight, names)
    large = materialise(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > group_limit()))
    if not stored_rows(large):
        return percentiles(counts, keys, probs, value, weight, names)
    marked = attach(counts, large, keys, "_values", how="left", stored=True)
    return (percentiles(marked.where("_values is null"), keys, probs, value, weight, names)
            .unionByName(quantiles_by_cells(marked.where("_values is not null"), keys, probs, value, weight, names)))


def group_limit():
    return min(GROUP_ROWS, DIRECT_VALUES)


def percentiles(counts, keys, probs, value, weight, names):
    """``group_quantiles`` of groups that are each small enough for one buffer."""
    found = counts.groupBy(*keys).agg(
        F.sum(weight).alias("n"),
        F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), F.col(weight)).alias("_q"))
    return found.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)])


def quantiles_by_cells(counts, keys, probs, value, weight, names):
    """``group_quantiles`` of groups of any size, whatever their values.

    Descends over ordering keys, ``RADIX_BITS`` a round, all groups and ranks at once: the totals of at most 2**RADIX_BITS
    cells say which cell holds a wanted rank, and only the values of those cells are looked at again. It ends when every
    such cell has at most ``CELL_VALUES`` distinct values (after four rounds a cell is one value); these are ordered.
    """
    bounds = [a.alias(n) for p, name in zip(probs, names, strict=True)
              for a, n in zip(rank_ends(p), (f"_at_{name}", f"_lo_{name}", f"_hi_{name}"), strict=True)]
    ranks = [f"_{end}_{name}" for name in names for end in ("lo", "hi")]
    totals = counts.groupBy(*keys).agg(F.sum(weight).alias("_total")).select(*keys, "_total", *bounds)
    # the ranks of a group travel with its cells, at most two per quantile
    # stored, so that the ordering keys of a round are not computed again in the next
    plain = materialise(counts.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"),
                                      ordering_key(F.col(value)).alias("_k")))
    held, within = None, plain.withColumns({"_cell": F.lit(0).cast("bigint"), "_start": F.lit(0).cast("bigint")})
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        fine = F.shiftright("_k", shift)
        cells = (within.groupBy(*keys, "_cell", "_start", fine.alias("_next"))
                 .agg(F.sum("_w").alias("_in"), F.count(F.lit(1)).alias("_rows")))
        upto = (Window.partitionBy(*keys, "_cell").orderBy("_next")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("_end", F.col("_start") + F.sum("_in").over(upto))
        wanted = cells.withColumn("_start", F.col("_end") - F.col("_in")).drop("_cell")
        ends = totals.select(*keys, *ranks) if held is None else held.select(*keys, *ranks).distinct()
        joined = wanted.join(ends, keys) if keys else beside(wanted, ends)
        hit = reduce(lambda a, b: a | b, [(F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end")) for r in ranks])
        held = materialise(joined.where(hit).select(*keys, F.col("_next").alias("_cell"), "_start", "_rows", *ranks))
        within = attach(plain.withColumn("_cell", fine), held.select(*keys, "_cell", "_start", "_rows"), [*keys, "_cell"],
                        "_rows", stored=True).drop("_rows")
        if (held.agg(F.max("_rows")).first()[0] or 0) <= CELL_VALUES:
            break
    inside = (Window.partitionBy(*keys, "_cell").orderBy("_k")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (within.withColumn("_end", F.col("_start") + F.sum("_w").over(inside))
              .withColumn("_first", F.col("_end") - F.col("_w")))
    ranked = ranked.join(totals, keys) if keys else beside(ranked, totals)

    def at(rank):
        return F.max(F.when((F.col("_first") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_v")))

    picks = [at(r).alias(f"_v{r}") for r in ranks] + [F.max(c).alias(c) for c in (
        "_total", *[f"_{end}_{name}" for name in names for end in ("at", "lo", "hi")])]
    out = []
    for name in names:
        position, low, high = (F.col(f"_{end}_{name}") for end in ("at", "lo", "hi"))
        low_v, high_v = F.col(f"_v_lo_{name}"), F.col(f"_v_hi_{name}")
        # the same sum as Spark's ``percentile``, so that both ways agree to the last bit
        out.append(F.when((low == high) | (low_v == high_v), low_v)
                   .otherwise((high - position) * low_v + (position - low) * high_v).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, F.col("_total").alias("n"), *out)


def rank_ends(p):
    """Where a quantile lies among ``_total`` ordered values, counted from 0, and the whole ranks around it."""
    position = (F.col("_total") - 1) * F.lit(float(p))
    return position, F.floor(position), F.ceil(position)


def value_counts(rows, keys, value):
    """Stored rows for ``group_quantiles``: occurrences of each non-missing value per group, combined before the
    shuffle."""
    return materialise(rows.select(*keys, value.cast("double").alias("v")).where(F.col("v").isNotNull())
            .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")))


def in_ranges(rows, order):
    """``rows`` stored in ranges of about ``CELL_VALUES`` rows along the columns ``order``, numbered by ``_cell``.

    The boundaries are taken from the rows themselves, so no range is large however the values are packed; rows that are
    equal in ``order`` share a range.
    """
    rows = materialise(rows)
    parts = max(1, -(-stored_rows(rows) // CELL_VALUES))
    if parts == 1:
        return rows.withColumn("_cell", F.lit(0))
    # stored, as the boundaries are sampled anew each time they are asked for
    return materialise(rows.repartitionByRange(parts, *order).withColumn("_cell", F.spark_partition_id()))


def running_totals(df, order, sums, descending=False):
    """Cumulative sums of the columns ``sums`` along the column or columns ``order``, whose values hardly repeat.

    Adds ``cum_<column>``. Totals of ranges are accumulated first, then each range on its own from the total before it, so
    the order is global but no task sorts more than one range.
    """
    order = [order] if isinstance(order, str) else order
    celled = in_ranges(df, order)
    way = F.desc if descending else F.asc
    before = (Window.partitionBy(F.lit(0)).orderBy(way("_cell"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = celled.groupBy("_cell").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    # one row per range: a millionth of the values
    offsets = cells.select("_cell", *[(F.sum(f"_sum_{c}").over(before) - F.col(f"_sum_{c}")).alias(f"_before_{c}")
                                      for c in sums])
    inside = (Window.partitionBy("_cell").orderBy(*map(way, order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (celled.join(offsets, "_cell")
            .select(*df.columns, *[(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums]))


def smallest_of_groups(df, column, group, ranks, bits=60):
    """{(group, k): the k-th smallest value of a non-negative integer column in that group}, for ``ranks`` {group: [k]}.

    A rank of 0 gives -1, one beyond the group's size None. Descends 12 bits at a time, all groups and ranks in one job,
    through counts of at most 4096 prefixes each: no task gathers values. Groups are a few, named by the caller.
    """
    out = {(g, k): -1 for g, ks in ranks.items() for k in ks if k <= 0}
    todo = {(g, k): (0, k) for g, ks in ranks.items() for k in ks if k > 0}      # prefix so far, rank within it
    for shift in range(bits - 12, -1, -12):
        known = sorted({(g, prefix) for (g, _), (prefix, _) in todo.items()}, key=str)
        if not known:
            break
        hit = reduce(lambda a, b: a | b, [(F.col(group) == g) & (F.shiftright(column, shift + 12) == F.lit(p)) for g, p in known])
        counts = {}
        for g, p, n in (df.where(hit).groupBy(group, F.shiftright(column, shift)).count()).collect():
            counts.setdefault((g, p >> 12), []).append((p, n))
        for at, (prefix, rank) in list(todo.items()):
            for p, n in sorted(counts.get((at[0], prefix), [])):
                if rank <= n:
                    todo[at] = (p, rank)
                    break
                rank -= n
            else:
                out[at] = None
                del todo[at]
    return out | {at: prefix for at, (prefix, _) in todo.items()}


def kth_smallest(df, column, k, bits=60, bounded=False):
    """The ``k``-th smallest value of a non-negative integer column as a Python int; None when there are fewer.

    Descends 12 bits at a time through counts of at most 4096 prefixes: no task gathers values. ``bounded`` says that
    the caller has cut the table down to little more than ``k`` rows, which may then be put in order at once.
    """
    if k <= 0:
        return -1
    if bounded:
        row = df.select(column).orderBy(column).limit(k).agg(F.count(F.lit(1)), F.max(column)).first()
        return row[1] if row[0] == k else None
    prefix, remaining = 0, k
    for shift in range(bits - 12, -1, -12):
        counts = (df.where(F.shiftright(column, shift + 12) == F.lit(prefix))
                  .groupBy(F.shiftright(column, shift).alias("p")).count().orderBy("p").collect())
        for row in counts:
            if remaining <= row["count"]:
                prefix = row["p"]
                break
            remaining -= row["count"]
        else:
            return None
    return prefix
