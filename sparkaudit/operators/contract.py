"""The data contract: a structure that must hold, and expectations whose violations are counted."""
from pyspark.sql import functions as F

from ..schema import DATE_PATTERN, LISTING_COLUMNS, LISTING_TYPES, RID, STATUSES
from ..sources.listings import as_listing_type, cast_listings

ROW = "(row)"


class ContractError(ValueError):
    """The input does not have the listings structure."""


def counted_checks(checks):
    """Aggregates ``c0``, ``c1``, ... of the records that violate each check."""
    return [F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)]


def listed_checks(counts, checks):
    """(column, check, violations) rows of a one-row table of such counts; checks without violations are left out."""
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(column).alias("column"), F.lit(check).alias("check"), F.col(f"c{i}").alias("violations"))
        for i, (column, check, _) in enumerate(checks)])).alias("r")).select("r.*").where("violations > 0")


def _ordered(report):
    return report.orderBy(F.desc("violations"), "column", "check")


def coercion_checks(columns):
    """A value that is present as given and missing after the cast to its declared type."""
    return [(c, "coerce_dtype('float64')", F.col(c).isNotNull() & as_listing_type(F.col(c), c).isNull())
            for c in columns if LISTING_TYPES[c] == "double"]


def category_checks():
    listed = ", ".join(f"'{s}'" for s in STATUSES)
    return [("status", "not_nullable", F.col("status").isNull()),
            ("status", f"isin([{listed}])", F.col("status").isNotNull() & ~F.col("status").isin(STATUSES))]


def structure_report(df):
    """Every violation of the structure, fatal for an audit: columns, types, categories."""
    present = [c for c in LISTING_COLUMNS if c in df.columns]
    constants = [(c, "column_in_dataframe", 1) for c in LISTING_COLUMNS if c not in df.columns]
    constants += [(c, "column_in_schema", 1) for c in df.columns if c not in (*LISTING_COLUMNS, RID)]
    # a value of the declared type stays what it is, so only the others are parsed
    kinds = dict(df.dtypes)
    checks = (coercion_checks([c for c in present if kinds[c] != LISTING_TYPES[c]])
              + (category_checks() if "status" in present else []))
    report = df.sparkSession.createDataFrame(constants, "column string, check string, violations bigint")
    if checks:
        counted = listed_checks(df.agg(*counted_checks(checks)), checks)
        report = report.unionByName(counted) if constants else counted
    return _ordered(report)


def is_typed(df):
    """Whether a table has the listing columns, each with its declared type."""
    kinds = dict(df.dtypes)
    return sorted(c for c in df.columns if c != RID) == sorted(LISTING_COLUMNS) and all(kinds[c] == t for c, t in LISTING_TYPES.items())


def enforce_structure(df):
    """The table with its declared types; raises ``ContractError`` with every violation counted."""
    violations = structure_report(df).collect()     # at most a few rows per column of the schema
    if violations:
        lines = "\n".join(f"{v['column']}  {v['check']}  {v['violations']}" for v in violations)
        raise ContractError(f"input does not match the listings structure:\n{lines}")
    return cast_listings(df)


def range_checks():
    # Allowed ranges, both ends included unless the name says otherwise.
    def gt(c, low):
        return c, f"greater_than({low})", ~(F.col(c) > low)

    def ge(c, low):
        return c, f"greater_than_or_equal_to({low})", ~(F.col(c) >= low)

    def le(c, high):
        return c, f"less_than_or_equal_to({high})", ~(F.col(c) <= high)

    def between(c, low, high):
        return c, f"in_range({low}, {high})", ~F.col(c).between(low, high)

    return [gt("price", 0), le("price", 1e9), between("bed", 0, 50), between("bath", 0, 50), ge("acre_lot", 0),
            gt("house_size", 0), le("house_size", 100_000), between("zip_code", 0, 99_999)]


def pattern_checks():
    return [("prev_sold_date", f"str_matches('{DATE_PATTERN}')", ~F.col("prev_sold_date").rlike(DATE_PATTERN))]


def row_checks():
    status, date = F.col("status"), F.col("prev_sold_date")
    return [(ROW, "sold record has a sale date", (status == "sold") & date.isNull()),
            (ROW, "ready_to_build record has no previous sale", (status == "ready_to_build") & date.isNotNull())]


def expectations():
    return range_checks() + pattern_checks() + row_checks()


def violation_counts(df, checks):
    """One row per check of ``checks`` that some record violates. A missing value violates no range or pattern."""
    return _ordered(listed_checks(df.agg(*counted_checks(checks)), checks))


def expectation_report(df):
    """How many records violate each expectation, most violated first; all counted in one pass."""
    return violation_counts(df, expectations())
