"""Train/test splits that know which records describe the same property, and model inputs."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import all_present, hash60, parse_date, unit
from ..schema import MODEL_FEATURES, MODEL_PRICE_RANGE, PROPERTY_KEY, RID
from ..session import materialise
from .properties import property_text, with_property
from .scale import attach, group_quantiles, kth_smallest, smallest_of_groups, value_counts


def add_code(df, column, name):
    """Position of a value among the sorted distinct values, -1 when missing.

    The list of distinct values is the width of a one-hot encoding, so it is short by purpose; it is joined by size.
    """
    levels = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_code", F.row_number().over(Window.orderBy(column)) - 1))
    return (attach(df, levels, [column], "_n", how="left")
            .withColumn(name, F.coalesce("_code", F.lit(-1))).drop("_n", "_code"))


def prepare(df):
    """Records with a price in the modelled range, with ``pid``, ``y`` = ln(price) and coded features."""
    kept = with_property(df.where(F.col("price").between(*MODEL_PRICE_RANGE))).withColumn("y", F.ln("price"))
    coded = add_code(add_code(kept, "state", "state_code"), "status", "status_code")
    return coded.withColumn("sold_year", F.year(parse_date(F.col("prev_sold_date"))))


def population(prepared):
    """One row: records, properties, share of records that share a property."""
    sizes = prepared.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("properties"),
                     (F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("sharing"))


def random_split(df, seed, test_share=0.2):
    """Adds ``is_test``; a record's side depends on its id and the seed only."""
    return df.withColumn("is_test", unit(hash60("split", seed, F.col(RID))) < test_share)


def with_twins(split):
    """Adds ``twin`` (training record whose property is in the test set too) and ``seen`` (the mirror image)."""
    known = split.where(all_present(PROPERTY_KEY))
    mixed = (known.groupBy(*PROPERTY_KEY).agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_test").alias("_t"))
             .where((F.col("_t") > 0) & (F.col("_t") < F.col("_n"))).drop("_t"))
    both = F.col("_n").isNotNull()
    return (attach(split, mixed, PROPERTY_KEY, "_n", how="left")
            .withColumn("twin", both & ~F.col("is_test")).withColumn("seen", both & F.col("is_test")).drop("_n"))


def training_rows(split, shares, seed):
    """{share: training records}. Each keeps ``share`` of the twins and drops as many other records, so the size is
    always that of the training set without twins. Kept records are those with the smallest hashes, up to a cutoff."""
    train = split.where(~F.col("is_test")).withColumn("_u", hash60("keep", seed, F.col(RID)))
    hashes = materialise(train.select("twin", "_u"))
    n_twins, n_others = hashes.agg(F.count_if("twin"), F.count_if(~F.col("twin"))).first()
    kept = {share: (round(share * n_twins), max(n_others - round(share * n_twins), 0)) for share in shares}
    cutoff = smallest_of_groups(hashes, "_u", "twin", {True: [k for k, _ in kept.values()], False: [k for _, k in kept.values()]})
    return {share: train.where(F.when(F.col("twin"), F.col("_u") <= cutoff[True, twins])
                               .otherwise(F.col("_u") <= cutoff[False, others])).drop("_u")
            for share, (twins, others) in kept.items()}


def grouped_split(df, seed, test_share=0.2):
    """Adds ``is_test`` for a share of the properties, with all their records."""
    u = hash60("group", seed, property_text())
    groups = materialise(df.select("pid").distinct().select(u.alias("_u")))
    cutoff = kth_smallest(groups, "_u", math.ceil(test_share * groups.count()))
    return df.withColumn("is_test", u <= cutoff)


def feature_medians(df, features=MODEL_FEATURES):
    """{feature: median} over the whole table."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("r"))
    found = group_quantiles(value_counts(long.select("r.*"), ["feature"], F.col("x")), ["feature"], [0.5],
                            names=["median"], stored=True)
    return {r["feature"]: r["median"] for r in found.collect()}     # one row per feature


def design_matrix(df, kind="forest", features=MODEL_FEATURES):
    """Model features as columns: gaps filled with the median and marked. ``raw`` leaves the gaps; ``ridge`` also takes
    sizes on a log scale and leaves the codes to be one-hot encoded."""
    if kind == "raw":
        return df
    medians = feature_medians(df, features)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in features}
    if kind == "ridge":
        for c in ("bed", "bath", "acre_lot", "house_size"):
            filled[c] = F.log1p(filled[c])
    gaps = [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in features]
    return df.select(*[c for c in df.columns if c not in features],
                     *[filled[c].alias(c) for c in features], *gaps)
