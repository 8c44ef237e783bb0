"""Why the older rules flag what they flag: status mixes, lifecycle pairs, broker volume."""
from pyspark.sql import functions as F

from ..functions.columns import parse_date
from ..schema import COMPARED, LEGACY_HOME_KEY, LEGACY_PROPERTY_KEY, LISTING_KEY, STATUSES
from ..session import materialise
from .duplicates import duplicates
from .legacy import (placeholder_date, price_manipulation, price_manipulation_groups, same_price_different_dates,
                     same_price_groups)
from .scale import attach, beside, group_quantiles, running_totals, value_counts

PAIR = "for_sale + sold"
DAY = "prev_sold_date"


def headline_share(df):
    """One row: records of the two older date rules over all records."""
    records = df.agg(F.count(F.lit(1)).alias("records"),
                     F.count_if(placeholder_date(F.col(DAY))).alias("placeholder_records"))
    groups = same_price_groups(df).agg(F.count(F.lit(1)).alias("same_price_groups"),
                                       F.coalesce(F.sum("records"), F.lit(0)).alias("same_price_records"))
    manipulated = price_manipulation_groups(df).agg(F.count(F.lit(1)).alias("manipulation_groups"))
    return beside(records, groups, manipulated).withColumn(
        "share", (F.col("placeholder_records") + F.col("same_price_records")) / F.col("records"))


def nonnull_placeholder_hits(df):
    return df.agg(F.count_if(placeholder_date(F.col(DAY)) & F.col(DAY).isNotNull()).alias("nonnull_hits"))


def missing_by_status(df):
    gap = F.col(DAY).isNull()
    return (df.groupBy("status").agg(F.avg(gap.cast("double")).alias("share"), F.count_if(gap).alias("missing"),
                                     F.count(F.lit(1)).alias("records")).orderBy("share", "status"))


def group_mixes(df, key):
    """Per key (missing equals missing): number of records and the sorted statuses of its members, joined by ' + '.

    Members are counted per status before a group comes together, so a group is a handful of rows here. A status held
    by several members is written once, as 'status x count', in groups of every size.
    """
    per_status = df.groupBy(*key, "status").agg(F.count(F.lit(1)).alias("_n")) if "status" not in key else \
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    members = F.sort_array(F.collect_list(F.struct("status", "_n")))
    grouped = per_status.groupBy(*key).agg(F.sum("_n").alias("records"), members.alias("_members"))
    written = F.transform("_members", lambda m: F.when(m["_n"] == 1, m["status"])
                          .otherwise(F.concat(m["status"], F.lit(" x "), m["_n"].cast("string"))))
    return grouped.withColumn("mix", F.array_join(written, " + ")).drop("_members")


def status_mix(df, key):
    """How many groups have each status mix."""
    return group_mixes(df, key).groupBy("mix").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("groups"), "mix")


def same_price_mix(df):
    return status_mix(same_price_different_dates(df), LEGACY_PROPERTY_KEY)


def manipulation_mix(df):
    return status_mix(price_manipulation(df), LEGACY_HOME_KEY)


def duplicate_group_mixes(df):
    """Mixes of all groups of several records, missing key parts included."""
    return group_mixes(df, LEGACY_PROPERTY_KEY).where("records > 1")


def lifecycle_dates(df):
    """Per flagged same-price group with both statuses dated: the last date of each, and the gap in years."""
    day = parse_date(F.col(DAY))
    flagged = same_price_different_dates(df)

    def last(status):
        return F.max(F.when(F.col("status") == status, day))

    return (flagged.groupBy(*LEGACY_PROPERTY_KEY).agg(last("for_sale").alias("for_sale"), last("sold").alias("sold"))
            .where(F.col("for_sale").isNotNull() & F.col("sold").isNotNull())
            .withColumn("years", F.datediff("sold", "for_sale") / F.lit(365.25)))


def sale_window(df):
    day = F.when(F.col("status") == "sold", parse_date(F.col(DAY)))
    return df.agg(F.min(day).alias("first_sale"), F.max(day).alias("last_sale"))


def lifecycle_pairs(df):
    """One row about the pairs: inside the sale window, for_sale older, median gap."""
    pairs = materialise(lifecycle_dates(df))
    median = group_quantiles(value_counts(pairs, [], F.col("years")), [], [0.5], names=["median_years"], stored=True)
    window = sale_window(df)

    def share(condition):
        return F.avg(condition.cast("double"))

    summary = beside(pairs, window).agg(
        F.count(F.lit(1)).alias("pairs"),
        share(F.col("sold").between(F.col("first_sale"), F.col("last_sale"))).alias("sold_in_window"),
        share(F.col("for_sale") < F.col("sold")).alias("for_sale_older"))
    return beside(summary, median.select("median_years"))


def holding_histogram(df, last=40):
    """Pairs per year of holding, from 1; the last bin holds everything from ``last`` - 1 on."""
    clipped = F.least(F.col("years"), F.lit(float(last)))
    return (lifecycle_dates(df).where(clipped >= 1)
            .groupBy(F.least(F.floor(clipped), F.lit(last - 1)).cast("int").alias("years_from"))
            .agg(F.count(F.lit(1)).alias("pairs")))


def silently_dropped(df):
    """One row: records in groups of several, those whose key is complete, and the difference."""
    complete = F.lit(True)
    for c in LEGACY_PROPERTY_KEY:
        complete = complete & F.col(c).isNotNull()
    groups = df.groupBy(*LEGACY_PROPERTY_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_groups"),
                      F.coalesce(F.sum(F.when(complete, F.col("n"))), F.lit(0)).alias("visible")).withColumn(
        "dropped", F.col("in_groups") - F.col("visible"))


def lifecycle_records(df):
    """Records in groups of exactly one for_sale and one sold record."""
    return duplicate_group_mixes(df).where(F.col("mix") == PAIR).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def detector_overlap(df):
    """Share of the price-manipulation records that the same-price rule flags too."""
    first, second = price_manipulation(df).select("rid"), same_price_different_dates(df).select("rid")
    joined = first.join(second.withColumn("_also", F.lit(1)), "rid", "left")
    return joined.agg(F.count(F.lit(1)).alias("records"), F.count("_also").alias("also_same_price"),
                      F.avg(F.when(F.col("_also").isNotNull(), 1.0).otherwise(0.0)).alias("share"))


def broker_rollup(df):
    """Brokers with a flagged group: flagged groups, sold and all listings, flags per sale."""
    flagged = same_price_groups(df).groupBy("brokered_by").agg(F.count(F.lit(1)).alias("flagged_pairs"))
    listings = df.where(F.col("brokered_by").isNotNull()).groupBy("brokered_by").agg(
        F.count_if(F.col("status") == "sold").alias("sold_listings"), F.count(F.lit(1)).alias("all_listings"))
    return flagged.join(listings, "brokered_by").withColumn(
        "flags_per_sale", F.when(F.col("sold_listings") != 0, F.col("flagged_pairs") / F.col("sold_listings")))


def with_average_rank(rows, value, name):
    """Adds the rank of ``value``; equal values share the mean of their ranks."""
    counts = materialise(rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n")))
    ranks = running_totals(counts, value, ["_n"]).select(
        value, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(name), F.col("_n").alias("_weight"))
    return attach(rows, ranks, [value], "_weight").drop("_weight")


def spearman(rows, a, b):
    """Rank correlation of two columns."""
    ranked = with_average_rank(with_average_rank(rows.select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))


def top_brokers(df, k=3):
    """The ``k`` brokers with the most flagged groups, and whether they are the ``k`` with the most listings."""
    rollup = materialise(broker_rollup(df))
    listed = df.where(F.col("brokered_by").isNotNull()).groupBy("brokered_by").agg(F.count(F.lit(1)).alias("_n"))
    largest = listed.orderBy(F.desc("_n"), "brokered_by").limit(k).select("brokered_by", F.lit(True).alias("_big"))
    top = rollup.orderBy(F.desc("flagged_pairs"), "brokered_by").limit(k)
    return top.join(F.broadcast(largest), "brokered_by", "left").withColumn(
        "among_largest", F.coalesce("_big", F.lit(False))).drop("_big")


def review_tallies(df):
    """What is left to review once the artefacts are set aside."""
    day = parse_date(F.col(DAY))
    mixes = duplicate_group_mixes(df)
    both = F.col("mix").contains("sold") & F.col("mix").contains("for_sale")
    groups = mixes.agg(F.count_if(F.col("mix") == PAIR).alias("lifecycle_groups"),
                       F.count_if(~both).alias("same_status_groups"))
    dates = beside(df, sale_window(df)).agg(
        F.count_if(F.col(DAY).isNotNull() & day.isNull()).alias("unparseable"),
        F.count_if(day < F.lit("1950-01-01").cast("date")).alias("before_1950"),
        F.count_if(day > F.col("last_sale")).alias("after_window"))
    return beside(groups, dates)


def duplicate_review(df):
    """One row about the flagged duplicates: records, groups, exact copies, filled fields, records per status."""
    flagged = materialise(duplicates(df))
    compared = [*[c for c in COMPARED if c != DAY], "price", DAY]
    filled = sum((F.col(c).isNotNull().cast("bigint") for c in compared), F.lit(0))
    exact = (flagged.groupBy(*LISTING_KEY, *compared).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("exact_copies")))
    groups = flagged.groupBy(*LISTING_KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("groups"))
    tallies = flagged.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled_fields"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return beside(tallies, exact, groups)


def zero_price_by_status(df):
    return df.where(F.col("price") == 0).groupBy("status").agg(F.count(F.lit(1)).alias("records"))


def top_price_outliers(scored, k=5):
    """The ``k`` positive prices with the highest z."""
    return scored.where(F.col("price") > 0).orderBy(F.desc("price_z"), "rid").limit(k)
