"""Invalid dates."""
from pyspark.sql import functions as F

from ..functions.columns import day_or_null
from ..schema import MAX_DATE, MIN_DATE, SENTINEL_DATES


def invalid_date(text):
    """Present, and: not a date, a well-known default, or outside the plausible range."""
    plausible = (day_or_null(text).between(F.lit(MIN_DATE).cast("date"), F.lit(MAX_DATE).cast("date"))
                 & ~text.isin(SENTINEL_DATES))
    return text.isNotNull() & ~F.coalesce(plausible, F.lit(False))


def invalid_dates(df, column="prev_sold_date"):
    return df.where(invalid_date(F.col(column)))
