"""Robust z-scores: distance from a group's median in units of its median absolute deviation (MAD)."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAD_FLOOR_QUANTILE, MIN_GROUP_SIZE, MODIFIED_Z_SCALE, MODIFIED_Z_THRESHOLD
from ..session import materialise, stored_rows
from . import scale
from .scale import attach, group_quantiles

GROUP, FALLBACK = "group", "fallback"
# Stand-ins for a missing group, so that records without one form a group of their own.
NO_ZIP, NO_STATE = -1.0, "?"


def price_measures():
    """Log price per unit of size, and log price; only positive prices and sizes count."""
    log_price = F.when(F.col("price") > 0, F.ln("price"))
    return {"per_size": log_price - F.when(F.col("house_size") > 0, F.ln("house_size")), "price": log_price}


def price_groups():
    return {GROUP: F.coalesce(F.col("zip_code"), F.lit(NO_ZIP)).cast("string"),
            FALLBACK: F.coalesce(F.col("state"), F.lit(NO_STATE))}


def measure_counts(df, measures, groups):
    """Occurrences of each value per (level, key, measure): one pass for all levels and measures."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), key.cast("string").alias("key"), F.lit(m).alias("measure"),
                 value.cast("double").alias("v"))
        for level, key in groups.items() for m, value in measures.items()])).alias("r")).select("r.*")
    return long.where(F.col("v").isNotNull()).groupBy("level", "key", "measure", "v").agg(
        F.count(F.lit(1)).alias("n"))


STATS_KEY = ["level", "key", "measure"]


def robust_stats(df, measures, groups) -> DataFrame:
    """Stored (level, key, measure, n, med, mad), exact.

    The values of a group of at most ``scale.group_limit()`` rows meet in one row, which gives median and MAD at once. Larger
    groups, few beside the rows, go through counts of their values. Missing keys have no statistics.
    """
    rows = materialise(df.select(*[key.cast("string").alias(f"_key_{level}") for level, key in groups.items()],
                                 *[(value.cast("double") + 0.0).alias(f"_value_{m}") for m, value in measures.items()]))
    values = [f"_value_{m}" for m in measures]
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"_key_{level}").alias("key")) for level in groups])
    keyed = rows.select(F.explode(levels).alias("_at"), *values).select("_at.*", *values).where(F.col("key").isNotNull())
    large = materialise(keyed.groupBy("level", "key").agg(F.count(F.lit(1)).alias("_rows"))
                        .where(F.col("_rows") > scale.group_limit()).withColumn("_g", F.monotonically_increasing_id()))
    if not stored_rows(large):
        return materialise(stats_of_small(keyed, measures))
    marked = attach(keyed, large, ["level", "key"], "_rows", how="left", stored=True)
    few = stats_of_small(marked.where("_rows is null"), measures)
    many = marked.where("_rows is not null")
    if large.agg(F.sum("_rows")).first()[0] <= scale.DIRECT_VALUES:
        # so few rows that their values may carry the names of their groups
        named = reduce(DataFrame.unionByName, (measure_counts(many.where(F.col("level") == level), {m: F.col(f"_value_{m}") for m in measures}, {level: F.col("key")})
                                               for level in groups))
        return materialise(few.unionByName(stats_of_counts(materialise(named))))
    # values are counted by the numbers of their groups; a large group has many rows, so there are few names to bring back
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_value_{m}").alias("v")) for m in measures])
    counts = (many.select("_g", F.explode(each).alias("r")).select("_g", "r.*")
              .where(F.col("v").isNotNull()).groupBy("_g", "measure", "v").agg(F.count(F.lit(1)).alias("n")))
    named = counts.join(F.broadcast(large.select("_g", "level", "key")), "_g").select(*STATS_KEY, "v", "n")
    return materialise(few.unionByName(stats_of_counts(materialise(named))))


def stats_of_small(keyed, measures):
    """(level, key, measure, n, med, mad) of groups whose values may meet in one row each."""
    def middle(ordered, name):
        low, high = F.get(ordered, F.expr(f"(size({name}) - 1) div 2")), F.get(ordered, F.expr(f"size({name}) div 2"))
        # the same sum as Spark's ``percentile``
        return F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)

    met = keyed.groupBy("level", "key").agg(*[F.sort_array(F.collect_list(f"_value_{m}")).alias(f"_of_{m}") for m in measures])
    each = met.select("level", "key", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"_of_{m}").alias("_vs")) for m in measures])).alias("r")).select(
            "level", "key", "r.*").where(F.size("_vs") > 0).withColumn("med", middle(F.col("_vs"), "_vs"))
    gaps = F.sort_array(F.transform("_vs", lambda v: F.abs(v - F.col("med"))))
    return (each.withColumn("_gaps", gaps)
            .select(*STATS_KEY, F.size("_vs").cast("bigint").alias("n"), "med", middle(F.col("_gaps"), "_gaps").alias("mad")))


def stats_of_counts(counts):
    """``robust_stats`` from stored counts of each value."""
    by = STATS_KEY
    medians = materialise(group_quantiles(counts, by, [0.5], names=["med"], stored=True))
    centred = attach(counts.withColumnRenamed("n", "w"), medians, by, "n", stored=True)
    deviations = centred.groupBy(*by, F.abs(F.col("v") - F.col("med")).alias("v")).agg(F.sum("w").alias("n"))
    small = stored_rows(counts) <= scale.DIRECT_VALUES      # there are no more deviations than values
    mads = group_quantiles(deviations, by, [0.5], names=["mad"], stored=small, small=small).drop("n")
    return materialise(medians.join(mads, by))


def updated_stats(counts, stats, gone, come, measures, groups):
    """The statistics of a table after the records ``gone`` have left it and the records ``come`` have entered.

    ``counts`` and ``stats`` are the stored ones of the table before. Only groups that lose or gain a record are computed
    anew, from their counts less those gone and plus those come.
    """
    by = STATS_KEY
    change = measure_counts(come, measures, groups).unionByName(
        measure_counts(gone, measures, groups).withColumn("n", -F.col("n")))
    change = materialise(change.groupBy(*by, "v").agg(F.sum("n").alias("n")).where(F.col("n") != 0))
    # a group's weight: how often its counts change
    touched = materialise(change.groupBy(*by).agg(F.count(F.lit(1)).alias("_touched")))
    before = attach(counts, touched, by, "_touched", stored=True).drop("_touched")
    after = before.unionByName(change).groupBy(*by, "v").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    kept = stats.join(touched, by, "left_anti")
    return materialise(kept.unionByName(stats_of_counts(materialise(after))))


def mad_floors(stats, quantile=MAD_FLOOR_QUANTILE, min_n=MIN_GROUP_SIZE):
    """(measure, mad_floor): a low quantile of the MADs of all groups of a fair size. No such group, no row."""
    mads = (stats.where((F.col("level") == GROUP) & (F.col("n") >= min_n))
            .groupBy("measure", F.col("mad").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    return group_quantiles(mads, ["measure"], [quantile], names=["mad_floor"], stored=True,
                           small=stored_rows(stats) <= scale.DIRECT_VALUES).drop("n")


def modified_z(value, median, mad):
    """0.6745 (v - median) / mad; nothing over nothing is missing, something over nothing is infinite."""
    gap = value - median
    return (F.when(mad != 0, F.lit(MODIFIED_Z_SCALE) * gap / mad)
            .when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf"))))


def wide_stats(stats, level, measures, floors=None, min_n=MIN_GROUP_SIZE, constant=False):
    """One row per key of a level, with the median and the floored MAD of every measure.

    A group that is small or, unless ``constant``, without any spread in a measure has neither: both then come from
    the fallback.
    """
    floor = F.lit(None).cast("double")
    for m, value in (floors or {}).items():
        floor = F.when(F.col("measure") == m, F.lit(value)).otherwise(floor)
    usable = (F.col("n") >= min_n) & ((F.col("mad") != 0) | F.lit(constant)) if level == GROUP else F.lit(True)
    chosen = stats.where((F.col("level") == level) & usable).withColumn("mad", F.greatest("mad", floor))
    picked = [F.max(F.when(F.col("measure") == m, F.col(s))).alias(f"{level}_{s}_{m}")
              for m in measures for s in ("med", "mad")]
    return chosen.groupBy(F.col("key").alias("_key")).agg(F.max("n").alias(f"_size_{level}"), *picked)


def attach_stats(df, stats, measures, groups, floors=None, min_n=MIN_GROUP_SIZE, constant=False):
    """Adds ``<level>_med_<measure>`` and ``<level>_mad_<measure>`` of a record's group and fallback."""
    for level, key in groups.items():
        wide = wide_stats(stats, level, measures, floors, min_n, constant)
        keyed = df.withColumn("_key", key.cast("string"))
        if stored_rows(stats) <= scale.BROADCAST_ROWS:      # the wide form has fewer rows still
            found = keyed.join(F.broadcast(wide), "_key", "left")
        else:
            found = attach(keyed, wide, ["_key"], f"_size_{level}", how="left")
        df = found.drop("_key", f"_size_{level}")
    return df


def chosen_stats(measure):
    """(median, mad, whether the fallback is used)."""
    median, mad = f"{GROUP}_med_{measure}", f"{GROUP}_mad_{measure}"
    return (F.coalesce(median, f"{FALLBACK}_med_{measure}"), F.coalesce(mad, f"{FALLBACK}_mad_{measure}"),
            F.col(mad).isNull())


def robust_z(df, measures, groups, quantile=MAD_FLOOR_QUANTILE, min_n=MIN_GROUP_SIZE, stats=None, prefix="z_"):
    """Adds ``z_<measure>`` for every measure. ``quantile=None`` applies no floor to the MAD."""
    stats = robust_stats(df, measures, groups) if stats is None else stats
    # one floor per measure
    floors = {} if quantile is None else {
        r["measure"]: r["mad_floor"] for r in mad_floors(stats, quantile, min_n).collect()}
    wide = attach_stats(df, stats, measures, groups, floors, min_n)
    # one projection per step, so that no expression is written out more than once
    parts = wide.select(*df.columns, *[c for m, v in measures.items() for c in (
        (v - chosen_stats(m)[0]).alias(f"_gap_{m}"), chosen_stats(m)[1].alias(f"_mad_{m}"))])
    return parts.select(*df.columns, *[
        modified_z(F.col(f"_gap_{m}"), F.lit(0.0), F.col(f"_mad_{m}")).alias(f"{prefix}{m}") for m in measures])


def price_stats(df):
    """Statistics that every price score of one table shares."""
    return robust_stats(df.select("price", "house_size", "zip_code", "state"), price_measures(), price_groups())


def price_robust_z(df, quantile=MAD_FLOOR_QUANTILE, stats=None, name="price_z"):
    """Adds the absolute z of a record's price: per size within the zip code (or the state), else of the price alone.

    A price that is not positive is infinitely unusual; a missing one is not unusual.
    """
    scored = robust_z(df, price_measures(), price_groups(), quantile, stats=price_stats(df) if stats is None else stats)
    z = F.coalesce(F.abs("z_per_size"), F.abs("z_price"), F.lit(0.0))
    return scored.select(*df.columns, F.when(F.col("price") <= 0, F.lit(float("inf"))).otherwise(z).alias(name))


def is_price_outlier(z):
    return z > MODIFIED_Z_THRESHOLD
