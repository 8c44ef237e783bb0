"""Small column helpers shared by every operator."""
from functools import reduce

from pyspark.sql import functions as F

HASH_BITS = 60


def day_or_null(text):
    """Strict year-month-day date. The pattern keeps out signs, spaces and short forms that the cast would accept."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def parse_date(text):
    """Strict date; anything else, or a day outside the range of a signed 64-bit nanosecond clock, is missing."""
    # First and last whole day of that clock.
    first, last = F.lit("1677-09-22").cast("date"), F.lit("2262-04-11").cast("date")
    return F.when(day_or_null(text).between(first, last), text.try_cast("date"))


# Decimal numbers with an optional exponent, and the names of the special values. The cast alone would also take
# texts like '12d' or '7f'.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*(nan|[+-]?inf(inity)?)\s*$"


def number_or_null(text):
    """A text as a double; missing when it is no number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def not_nan(column):
    return F.when(~F.isnan(column), column)


def all_present(columns):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)


def hash60(*parts):
    """Uniform integer in [0, 2**60) from the text of ``parts``: the same on every engine, run and partitioning."""
    text = F.concat_ws(":", *[p if not isinstance(p, (str, int)) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def unit(hashed):
    """A ``hash60`` value as a fraction in [0, 1)."""
    return hashed / F.lit(float(2 ** HASH_BITS))


def count_where(condition):
    return F.count_if(condition)
