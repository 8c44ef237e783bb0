"""The older rules, kept with their faults so that they can be compared."""
from pyspark.sql import functions as F

from ..functions.columns import all_present, parse_date
from ..schema import LEGACY_HOME_KEY, LEGACY_PLACEHOLDERS, LEGACY_PROPERTY_KEY, LEGACY_SPAN_DAYS
from .scale import keep_matching


def placeholder_date(text):
    """A missing date reads 'nan', which is in the list: so every missing date is flagged."""
    lowered = F.lower(F.coalesce(text, F.lit("nan")))
    return lowered.isin(LEGACY_PLACEHOLDERS) | lowered.contains("####")


def placeholder_dates(df):
    return df.where(placeholder_date(F.col("prev_sold_date")))


def span_groups(df, key, aggregates=(), condition=None):
    """Complete keys with several records whose dates lie more than a year apart."""
    day = parse_date(F.col("prev_sold_date"))
    groups = df.where(all_present(key)).groupBy(*key).agg(
        F.count(F.lit(1)).alias("records"), F.count(day).alias("dated"),
        F.datediff(F.max(day), F.min(day)).alias("span_days"), *aggregates)
    wide = (F.col("records") > 1) & (F.col("dated") > 1) & (F.col("span_days") > LEGACY_SPAN_DAYS)
    return groups.where(wide if condition is None else wide & condition)


def same_price_groups(df):
    return span_groups(df, LEGACY_PROPERTY_KEY)


def same_price_different_dates(df):
    return keep_matching(df.where(all_present(LEGACY_PROPERTY_KEY)), same_price_groups(df), LEGACY_PROPERTY_KEY,
                         "records")


def price_manipulation_groups(df):
    """One price, never missing, on all dated records of a home."""
    dated = parse_date(F.col("prev_sold_date")).isNotNull()
    price = F.col("price")
    aggregates = [F.min(F.when(dated, price)).alias("low"), F.max(F.when(dated, price)).alias("high"),
                  F.count_if(dated & price.isNull()).alias("unpriced")]
    return span_groups(df, LEGACY_HOME_KEY, aggregates,
                       (F.col("low") == F.col("high")) & (F.col("unpriced") == 0))


def price_manipulation(df):
    return keep_matching(df.where(all_present(LEGACY_HOME_KEY)), price_manipulation_groups(df), LEGACY_HOME_KEY,
                         "records")
