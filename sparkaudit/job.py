"""Batch audit: listings in; flagged records, summary and report out.

    spark-submit --py-files sparkaudit.zip run_audit.py <listings.csv or .parquet> <output folder>
"""
import sys
from datetime import UTC, datetime
from pathlib import PurePosixPath

from .operators.contract import ContractError
from .operators.plant import Spec
from .operators.splits import prepare
from .plans.audit import FLAGS, audit, report_lines, summary_document
from .plans.leakage import store_leakage, store_naive
from .plans.validation import store_validation
from .schema import RID
from .session import build_session, materialise
from .sources.listings import read_raw_csv, with_row_ids
from .sources.sinks import write_csv, write_json, write_lines


def run(spark, path, out):
    """Returns 0, or 2 when the input does not have the listings structure."""
    name = PurePosixPath(path).name
    stem = name.split(".")[0]
    raw = spark.read.parquet(path) if path.endswith(".parquet") else read_raw_csv(spark, path)
    try:
        result = audit(raw, stored=True) if RID in raw.columns else audit(with_row_ids(raw))
    except ContractError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    now = datetime.now(UTC).isoformat(timespec="seconds")
    write_csv(result.report, f"{out}/{stem}_flags.csv")
    write_json(summary_document(result.summary, now), f"{out}/{stem}_summary.json")
    write_lines(report_lines(result.summary, name, now), f"{out}/{stem}_report.md")
    values = {r["item"]: int(r["value"]) for r in result.summary.where("part in ('records', 'flags')").collect()}
    print(f"{values['records']:,} records, {values['records_flagged']:,} flagged -> {out}/{stem}_report.md")
    for flag in FLAGS:
        print(f"  {flag:18s} {values[flag]:>8,}")
    return 0


def experiment(spark, kind, path, out, models=None, **options):
    """Runs ``validation``, ``leakage`` or ``naive`` over a Parquet table of listings and stores the results.

    ``models`` reruns some models of a leakage experiment and keeps the stored results of the others.
    """
    listings = spark.read.parquet(path)
    chosen = {"only": tuple(models)} if models else {}
    if kind == "validation":
        store_validation(materialise(listings), options.pop("spec", Spec()), out, **options)
    elif kind == "leakage":
        store_leakage(materialise(prepare(listings)), out, **chosen, **options)
    elif kind == "naive":
        store_naive(materialise(prepare(listings)), out, **chosen, **options)
    else:
        raise ValueError(f"unknown experiment {kind!r}")


def main(argv):
    path, out = argv
    return run(build_session(), path, out)
