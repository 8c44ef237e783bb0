"""The whole audit of one table: contract, flags, report, summary."""
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of
from ..operators.contract import counted_checks, enforce_structure, expectations, is_typed, listed_checks
from ..operators.dates import invalid_date
from ..operators.duplicates import duplicates, mark_duplicates, may_share
from ..operators.properties import records_sharing_address, with_property
from ..operators.robust import is_price_outlier, price_robust_z, price_stats
from ..schema import RID
from ..session import materialise, scratch
from ..sources.listings import cast_listings

# Names and meanings of the flags and the columns of the report.
FLAGS = {
    "invalid_date": "prev_sold_date is unparseable, a known sentinel, or outside 1900-01-02 .. 2026-12-31",
    "listing_duplicate": "same address, broker and status as another record, with compatible attributes",
    "zero_price": "price is 0",
    "price_outlier": "price per sq ft (or price) is extreme for its zip code (absolute modified z > 3.5, MAD floored)",
}
REPORT_COLUMNS = ["status", "price", "bed", "bath", "house_size", "acre_lot", "city", "state", "zip_code",
                  "prev_sold_date"]


@dataclass(frozen=True)
class Audit:
    """``report``: one row per flagged record. ``summary``: (part, item, detail, value) rows."""
    report: DataFrame
    summary: DataFrame


def with_rule_flags(df, z_stats=None):
    """The flags that need no other record's fields at hand: everything but duplicates. One map over the table."""
    price = F.col("price")
    scored = price_robust_z(df, stats=z_stats)
    zero = F.coalesce(price == 0, F.lit(False))
    return (scored.withColumn("invalid_date", invalid_date(F.col("prev_sold_date"))).withColumn("zero_price", zero)
            .withColumn("price_outlier", is_price_outlier(F.col("price_z")) & ~zero))


def audit_flags(df):
    """Every record with its four flags and ``price_z``."""
    return mark_duplicates(with_rule_flags(df)).select(RID, *FLAGS, "price_z")


def sharing_records(df):
    """Records that may share their property with another one, all columns: a superset of those that do, and of all duplicates."""
    return may_share(with_property(df), ["pid"]).drop("pid")


def flagged_records(df, sharing=None):
    """Records with any flag, all columns, the flags and ``price_z``.

    Duplicates are looked for in ``sharing``, the stored ``sharing_records`` where the caller has them. They bring their
    columns along and are stored, so their other flags are evaluated for them alone. The few flagged rows of both branches are
    brought together; the table itself is neither shuffled by record id nor joined to the duplicates.
    """
    stats = price_stats(df)
    ruled = with_rule_flags(df, stats)
    rules = [f for f in FLAGS if f != "listing_duplicate"]
    hits = ruled.where(any_of([F.col(f) for f in rules])).withColumn("listing_duplicate", F.lit(False))
    found = materialise(duplicates(df if sharing is None else sharing).where(F.col(RID).isNotNull()))
    pairs = with_rule_flags(found, stats).withColumn("listing_duplicate", F.lit(True))
    rest = [c for c in ruled.columns if c not in (RID, *FLAGS)]
    both = hits.unionByName(pairs).groupBy(RID).agg(
        F.any_value(F.struct(*rest)).alias("_r"), *[F.bool_or(f).alias(f) for f in FLAGS])
    return both.select(RID, *[F.col("_r")[c].alias(c) for c in rest], *FLAGS)


def audit_report(flagged):
    """Flag names joined by ';' in fixed order, the context columns, and z to two decimals (half to even)."""
    names = F.concat_ws(";", *[F.when(F.col(f), F.lit(f)) for f in FLAGS])
    z = F.when(F.abs("price_z") == float("inf"), F.col("price_z")).otherwise(F.bround("price_z", 2))
    return flagged.select(F.col(RID).alias("row"), names.alias("flags"), *REPORT_COLUMNS, z.alias("price_z"))


def missing_rate_by_status(df):
    return df.groupBy("status").agg(
        F.bround(F.avg(F.col("prev_sold_date").isNull().cast("double")), 4).alias("missing_rate"))


def flag_counts(flagged):
    """One row: records with any flag, and with each."""
    return flagged.agg(F.count(F.lit(1)).alias("records_flagged"), *[F.count_if(f).alias(f) for f in FLAGS])


def summary_rows(df, flagged, sharing):
    """The summary as (part, item, detail, value) rows: counts per flag, expectation and context.

    Records, expectations and missing dates are counted per status in one pass over the table, shared addresses among
    ``sharing``, the ``sharing_records``.
    """
    def rows(source, part, item, detail, value):
        return source.select(F.lit(part).alias("part"), item.alias("item"), detail.alias("detail"),
                             value.cast("double").alias("value"))

    none, checks = F.lit(""), expectations()
    profile = materialise(df.groupBy("status").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("prev_sold_date").isNull()).alias("missing"),
        *counted_checks(checks)))
    violated = listed_checks(profile.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(checks))]), checks)
    per_flag = flag_counts(flagged).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in ("records_flagged", *FLAGS)])).alias("r"))
    per_flag = per_flag.select("r.*")
    part = F.when(F.col("item") == "records_flagged", F.lit("records")).otherwise(F.lit("flags"))
    return (rows(profile.agg(F.sum("records").alias("n")), "records", F.lit("records"), none, F.col("n"))
            .unionByName(per_flag.select(part.alias("part"), "item", none.alias("detail"),
                                         F.col("value").cast("double").alias("value")))
            .unionByName(rows(violated, "expectations", F.col("column"), F.col("check"), F.col("violations")))
            .unionByName(rows(records_sharing_address(sharing), "context", F.lit("records_sharing_an_address"), none,
                              F.col("records")))
            .unionByName(rows(profile, "missing_prev_sold_date_by_status", F.col("status"), none,
                              F.bround(F.col("missing") / F.col("records"), 4))))


def audit(raw, stored=False) -> Audit:
    """Raises ``ContractError`` before any record is judged when the table does not have the listings structure.

    ``stored`` says that ``raw`` is a columnar table; other input, which every pass would parse or derive again, is stored,
    before the checks when it has its types. Nothing but the flagged records and the summary is left in the checkpoint folder.
    """
    with scratch(raw.sparkSession):
        if is_typed(raw) and not stored:
            df = materialise(cast_listings(raw))
            enforce_structure(df)
        else:
            df = enforce_structure(raw)
            df = df if stored else materialise(df)
        sharing = materialise(sharing_records(df))
        flagged = materialise(flagged_records(df, sharing), kept=True)
        summary = materialise(summary_rows(df, flagged, sharing), kept=True)
    return Audit(audit_report(flagged), summary)


def summary_document(summary, generated_at):
    """One row shaped like the summary JSON."""
    def as_map(part, value):
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("item", value)))))

    def single(item):
        return F.max(F.when(F.col("item") == item, F.col("value"))).cast("bigint")

    count = F.col("value").cast("bigint").alias("value")
    checks = F.sort_array(F.collect_list(F.when(F.col("part") == "expectations", F.struct(
        (-F.col("value")).alias("order"), F.col("item").alias("column"), F.col("detail").alias("check"),
        F.col("value").cast("bigint").alias("violations")))))
    return summary.agg(
        F.lit(generated_at).alias("generated_at"), single("records").alias("records"),
        single("records_flagged").alias("records_flagged"), as_map("flags", count).alias("flags"),
        F.transform(checks, lambda c: F.struct(c["column"].alias("column"), c["check"].alias("check"),
                                               c["violations"].alias("violations"))).alias("expectations"),
        F.struct(single("records_sharing_an_address").alias("records_sharing_an_address"),
                 as_map("missing_prev_sold_date_by_status", F.col("value").alias("value"))
                 .alias("missing_prev_sold_date_by_status")).alias("context"))


def percent(share, digits):
    """A share as text like 21.4%. Python rounds the binary value, the JVM its shortest decimal, so the few numbers of
    a report are formatted in Python."""
    return F.udf(lambda value: None if value is None else f"{value:.{digits}%}", "string")(share)


def report_lines(summary, source, generated_at):
    """The Markdown report as (line_no, line), made from the summary rows only."""
    summary = summary.withColumn("share", percent(F.when(
        F.col("part") == "missing_prev_sold_date_by_status", F.col("value")), 1))
    value = F.col("value")
    number = F.format_number(value.cast("bigint"), 0)
    doc = summary.agg(
        F.max(F.when(F.col("item") == "records", value)).alias("n"),
        F.max(F.when(F.col("item") == "records_flagged", value)).alias("k"),
        F.max(F.when(F.col("item") == "records_sharing_an_address", value)).alias("shared"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
            F.col("part") == "missing_prev_sold_date_by_status", F.struct("item", "share")))),
            lambda m: F.concat(m["item"], F.lit(" "), m["share"])), ", ").alias("missing"),
        F.sort_array(F.collect_list(F.when(F.col("part") == "expectations", F.struct(
            (-value).alias("order"), F.col("item").alias("item"), F.col("detail").alias("detail"))))).alias("checks"),
        F.map_from_entries(F.collect_list(F.when(F.col("part") == "flags", F.struct("item", number.alias("v")))))
        .alias("flags"))

    doc = doc.withColumn("flagged_share", percent(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0), 2))

    def whole(column):
        return F.format_number(column.cast("bigint"), 0)

    head = [F.lit(f"# Data quality audit: `{source}`"), F.lit(""),
            F.concat(whole(F.col("n")), F.lit(" records · "), whole(F.col("k")), F.lit(" flagged ("),
                     F.col("flagged_share"), F.lit(f") · generated {generated_at}")),
            F.lit(""), F.lit("## Flags"), F.lit(""), F.lit("| Flag | Records | Meaning |"), F.lit("|---|---:|---|"),
            *[F.concat(F.lit(f"| `{f}` | "), F.col("flags")[f], F.lit(f" | {meaning} |")) for f, meaning in FLAGS.items()],
            F.lit(""), F.lit("## Contract expectations"), F.lit("")]
    table = F.concat(
        F.array(F.lit("| Column | Check | Violations |"), F.lit("|---|---|---:|")),
        F.transform("checks", lambda c: F.concat(F.lit("| "), c["item"], F.lit(" | `"), c["detail"], F.lit("` | "),
                                                 F.format_number((-c["order"]).cast("bigint"), 0), F.lit(" |"))))
    holds = F.array(F.lit("All expectations hold."))
    tail = [F.lit(""), F.lit("## Context (not errors)"), F.lit(""),
            F.concat(F.lit("- "), whole(F.col("shared")),
                     F.lit(" records share their address with another record, usually a `for_sale` and a `sold` "
                           "record of the same home. Group by address before property-level modelling.")),
            F.concat(F.lit("- Share of records with no `prev_sold_date`, by status (missing is expected for unsold "
                           "homes): "), F.col("missing"))]
    lines = F.concat(F.array(*head), F.when(F.size("checks") > 0, table).otherwise(holds), F.array(*tail))
    return doc.select(F.posexplode(lines).alias("line_no", "line"))
