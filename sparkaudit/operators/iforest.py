"""Isolation forest (Liu, Ting & Zhou 2008) on price features.

A tree needs 256 records whatever the table's size; each draws its own from the whole table and is built by one task.
The forest is at most 100 x 511 nodes. Scoring is a map over the table.
"""
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import hash60, unit
from ..schema import RID
from ..session import materialise, stored_rows
from .robust import GROUP, attach_stats, price_groups, price_measures, price_stats
from .scale import group_quantiles, value_counts

# the two task functions travel with their helpers, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, SAMPLE = 100, 256
# Records that a task scores; each passes all trees, so they are dealt over more tasks than their size asks for.
SCORED_ROWS = 25_000
EULER = 0.5772156649015329
PRICE_FEATURES = ["lp", "lppsf", "lp_rel", "lppsf_rel"]
FEATURES = [*PRICE_FEATURES, "bed", "bath", "lacre"]
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


def features(df, price_only=False, stats=None):
    """Adds the model features, gaps marked (``<name>_na``) and filled with the median of the whole table."""
    stats = price_stats(df) if stats is None else stats
    measures = price_measures()
    zips = {GROUP: price_groups()[GROUP]}
    wide = attach_stats(df, stats, measures, zips, min_n=0, constant=True)
    raw = {"lp": measures["price"], "lppsf": measures["per_size"],
           "lp_rel": measures["price"] - F.col(f"{GROUP}_med_price"),
           "lppsf_rel": measures["per_size"] - F.col(f"{GROUP}_med_per_size"),
           "bed": F.col("bed"), "bath": F.col("bath"), "lacre": F.log1p("acre_lot")}
    names = PRICE_FEATURES if price_only else FEATURES
    rest = [c for c in df.columns if c not in names]
    kept = [f"_raw_{c}" for c in names]
    # stored, as it is read for the medians and again for the rows
    staged = materialise(wide.select(*rest, *[raw[c].alias(f"_raw_{c}") for c in names]))
    long = staged.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_raw_{c}").alias("x"))
                                             for c in names])).alias("r")).select("r.*")
    medians = {r["feature"]: r["median"] for r in group_quantiles(
        value_counts(long, ["feature"], F.col("x")), ["feature"], [0.5], names=["median"], stored=True).collect()}
    return staged.select(*rest, *[F.coalesce(k, F.lit(medians.get(c))).alias(c) for k, c in zip(kept, names)],
                         *[F.col(k).isNull().cast("double").alias(f"{c}_na") for k, c in zip(kept, names)])


def expected_length(n):
    """Mean depth of an unsuccessful search among n records."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def build_tree(tree, x, seed):
    """Nodes of one tree: rows (tree, node, feature, threshold, left, right, length); leaves have feature -1."""
    rng = np.random.default_rng([seed, tree])
    limit, nodes, todo = int(np.ceil(np.log2(max(len(x), 2)))), [], [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + expected_length(len(rows))))
            continue
        feature = int(rng.choice(spread))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= threshold
        nodes.append((tree, node, feature, threshold, free, free + 1, 0.0))
        todo += [(free, rows[goes_left], depth + 1), (free + 1, rows[~goes_left], depth + 1)]
        free += 2
    return nodes


def trees_of(seed, trees, share):
    """The trees that a record is offered to, each with probability ``share``, as an array.

    The distance to the record's next tree is geometric, so a record takes one hash and one more for each of its trees, not
    one for every tree of the forest.
    """
    if share >= 1:
        return F.sequence(F.lit(0), F.lit(trees - 1))

    def skip(turn):
        u = unit(hash60("forest", seed, turn, F.col(RID)))
        return F.least(F.coalesce(F.floor(F.ln(u) / F.lit(math.log1p(-share))), F.lit(trees)), F.lit(trees)).cast("int")

    def onwards(found, turn):
        last = F.element_at(found, -1)
        return F.when(last >= trees, found).otherwise(F.concat(found, F.array(last + 1 + skip(turn.cast("string")))))

    # most records have no tree, and the fold is left to the others
    first = skip("0")
    return F.when(first < trees, F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(trees)), F.array(first), onwards), lambda t: t < trees))


def draw(df, seed, trees, sample, n):
    """(tree, rank, rid, x): the ``sample`` records of each tree, drawn from the whole table of ``n`` records without
    replacement: those of the smallest hashes among the few more that a tree is offered."""
    share = min(1.0, (sample + 6 * sample ** 0.5) / max(n, 1))
    offered = df.withColumn("_trees", trees_of(seed, trees, share)).where(F.size("_trees") > 0)
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed), "tree", RID), RID)
    return (offered.select(RID, "x", F.explode("_trees").alias("tree"))
            .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample))


def fit(df, columns, seed=0, trees=TREES, sample=SAMPLE):
    """The forest as a small table of nodes. Every tree draws its own records from the whole table, in one pass for all."""
    drawn = draw(df.select(RID, F.array(*[F.col(c) for c in columns]).alias("x")), seed, trees, sample, df.count())

    def grow(key, rows):
        # at most ``sample`` rows per tree
        x = np.array(rows.sort_values("_rank")["x"].tolist(), dtype=float)
        return pd.DataFrame(build_tree(int(key[0]), x, seed),
                            columns=["tree", "node", "feature", "threshold", "left", "right", "length"])

    # a fixed number of partitions, so that the small tree inputs are not merged into one task
    return (drawn.select("tree", "_rank", "x").repartition(trees, "tree").groupBy("tree")
            .applyInPandas(grow, NODE_SCHEMA))


def path_lengths(x, forest):
    """The sum of a record's path lengths over all trees. All records go down a tree level by level; a leaf leads to itself."""
    total, flat, row = np.zeros(len(x)), x.ravel(), np.arange(len(x)) * x.shape[1]
    for feature, threshold, left, right, length in forest:
        leaf, own = feature < 0, np.arange(len(feature))
        # places 2i and 2i + 1: where node i leads, to the right and to the left
        ways = np.column_stack([np.where(leaf, own, right), np.where(leaf, own, left)]).ravel()
        looked_at, at = np.where(leaf, 0, feature), np.zeros(len(x), dtype=np.int64)
        while not leaf.take(at).all():
            at = ways.take(2 * at + (flat.take(row + looked_at.take(at)) <= threshold.take(at)))
        total += length.take(at)
    return total


def score(df, columns, nodes, sample=SAMPLE, name="anomaly"):
    """Adds 2^(-mean path length / expected length): near 1 isolated early, below 0.5 ordinary."""
    table = nodes.toPandas().sort_values(["tree", "node"])      # at most 511 nodes per tree
    forest = [tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "length"))
              for _, t in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = expected_length(sample)

    @F.pandas_udf(DoubleType())
    def anomaly(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        return pd.Series(2.0 ** (-path_lengths(x, shared.value) / len(shared.value) / norm))

    return df.withColumn(name, anomaly(*[F.col(c) for c in columns]))


def model_columns(price_only):
    names = PRICE_FEATURES if price_only else FEATURES
    return [*names, *[f"{c}_na" for c in names]]


def feature_table(df, price_only, stats):
    """Stored rid and model columns, from the columns that these are made of alone."""
    used = [c for c in (RID, "price", "house_size", "zip_code", "state", "bed", "bath", "acre_lot") if c in df.columns]
    return materialise(features(df.select(*used), price_only, stats).select(RID, *model_columns(price_only)))


def spread(stored):
    return stored.repartition(max(1, -(-stored_rows(stored) // SCORED_ROWS)), RID)


def isolation_forest(df, seed=0, price_only=False, stats=None):
    """(rid, score) of every record."""
    columns = model_columns(price_only)
    x = feature_table(df, price_only, stats)
    size = min(SAMPLE, stored_rows(x))
    return score(spread(x), columns, fit(x, columns, seed), size, "score").select(RID, "score")


def both_forests(df, seed=0, stats=None):
    """Stored (rid, all_features, price_features): the scores of both forests, from features stored once and in one pass."""
    x = feature_table(df, False, stats)
    size, scored = min(SAMPLE, stored_rows(x)), spread(x)
    for name, price_only in (("all_features", False), ("price_features", True)):
        columns = model_columns(price_only)
        scored = score(scored, columns, fit(x, columns, seed), size, name)
    return materialise(scored.select(RID, "all_features", "price_features"))
