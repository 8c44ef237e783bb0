"""Every operator as a query over a folder of tables."""
import uuid
from functools import partial

from pyspark.sql import functions as F

from ..functions.columns import hash60, parse_date
from ..operators import contract, duplicates, leakage, legacy, plant, properties, robust, rootcause, score, splits
from ..operators import iforest, links, models
from ..operators.dates import invalid_date, invalid_dates
from ..operators.scale import attach
from ..plans import audit, validation
from ..plans import leakage as leakage_plan
from ..schema import LISTING_KEY, MODEL_FEATURES, PROPERTY_KEY, RID
from ..session import checkpoint_dir, materialise, stored_rows
from ..sources import versions
from ..sources.listings import cast_listings, listings_from_orders, normalise, read_raw_csv, with_row_ids
from .tables import LABELS_SQL, QUOTED_SQL, RAW_SQL, RECENT_SQL

SPEC = plant.Spec(sentinel_dates=60, typo_years=40, exact_duplicates=30, near_duplicates=40,
                  price_factors={10: 15, 100: 15, 1000: 15, 0.001: 15})
SEED = 7
SEEDS = 3
SHARES = [0.0, 0.5, 1.0]
FOLDS = 5
# Records of one of the CSV files that ``scan_listings`` writes; a task sorts one file. It writes three files at least.
CSV_ROWS = 500_000


def listings(spark, folder):
    return normalise(listings_from_orders(spark, folder))


def stored_listings(spark, folder):
    """For queries that read the listings several times: the join that derives them runs once."""
    return materialise(listings(spark, folder))


def stored_prices(spark, folder):
    """The columns that a price score looks at: nothing else of the listings is derived or stored."""
    return materialise(listings(spark, folder).select(RID, *validation.SCORED))


def recent(spark, folder):
    return spark.sql(RECENT_SQL, listings=listings(spark, folder))


def labels(spark, folder):
    return spark.sql(LABELS_SQL, orders=spark.read.parquet(f"{folder}/orders.parquet"))


def raw(spark, folder):
    return spark.sql(RAW_SQL, listings=listings(spark, folder))


def rounded(df, *columns, digits=6):
    return df.select(*[F.when(F.abs(c) == float("inf"), F.col(c)).otherwise(F.round(c, digits)).alias(c)
                       if c in columns else F.col(c) for c in df.columns])


def on_listings(function, *keep, rounds=()):
    def query(spark, folder):
        out = function(listings(spark, folder))
        return rounded(out.select(*keep) if keep else out, *rounds)
    return query


# --- lineitem as a table of priced records: parts are the groups, suppliers the fallback --------------------------

def lineitem(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def line_measures():
    return {"unit_price": F.ln("l_extendedprice") - F.ln("l_quantity")}


def line_groups():
    return {robust.GROUP: F.col("l_partkey"), robust.FALLBACK: F.col("l_suppkey")}


def line_robust_z(spark, folder):
    rows = lineitem(spark, folder)
    z = robust.robust_z(rows, line_measures(), line_groups())
    return rounded(z.select("l_orderkey", "l_linenumber", "l_partkey", F.col("z_unit_price").alias("z")), "z")


def line_group_stats(spark, folder):
    stats = robust.robust_stats(lineitem(spark, folder), line_measures(), line_groups())
    return rounded(stats.select("level", "key", "n", "med", "mad"), "med", "mad")


def stats_fallback(spark, folder):
    df = stored_prices(spark, folder)
    measures, groups = robust.price_measures(), robust.price_groups()
    wide = robust.attach_stats(df, robust.price_stats(df), measures, groups)
    median, mad, fallback = robust.chosen_stats("per_size")
    return rounded(wide.select(RID, median.alias("med"), mad.alias("mad"), fallback.alias("fallback")), "med", "mad")


def mad_floor(spark, folder):
    return rounded(robust.mad_floors(robust.price_stats(listings(spark, folder))), "mad_floor")


def robust_z(spark, folder, quantile):
    z = robust.price_robust_z(stored_prices(spark, folder), quantile)
    return rounded(z.select(RID, "price_z"), "price_z")


def price_outliers(spark, folder):
    z = robust.price_robust_z(stored_prices(spark, folder))
    return z.where(robust.is_price_outlier(F.col("price_z")) & (F.col("price") != 0)).select(RID, "price")


def forest_features(spark, folder):
    names = [*iforest.FEATURES, *[f"{c}_na" for c in iforest.FEATURES]]
    return rounded(iforest.features(stored_listings(spark, folder)).select(RID, *names), *iforest.FEATURES)


def isolation_forest_summary(spark, folder):
    """What holds of any run: every record has a score in (0, 1], and prices in the wrong unit stand out on average."""
    df = stored_listings(spark, folder)
    wrong = labels(spark, folder).where("subtype = 'x1000'").select(RID, F.lit(True).alias("wrong"))
    scored = materialise(iforest.isolation_forest(df, price_only=True)).join(wrong, RID, "left")
    middle = F.percentile("score", F.lit(0.5))
    return scored.agg(F.count(F.lit(1)).alias("records"), F.count_if((F.col("score") > 0) & (F.col("score") <= 1)).alias("in_range"),
                      (F.avg(F.when(F.col("wrong"), F.col("score"))) > middle).alias("wrong_units_stand_out"))


def isolation_forest(spark, folder):
    return iforest.isolation_forest(stored_listings(spark, folder))


# --- sources, sinks, contract --------------------------------------------------------------------------------------

def scan_listings(spark, folder):
    """The listings written as several CSV files in the order of their keys, and read back with ids in file order."""
    path = f"{checkpoint_dir(spark)}/csv/{uuid.uuid4().hex}"
    df = stored_listings(spark, folder)
    text = spark.sql(QUOTED_SQL, listings=df)
    (text.repartitionByRange(max(3, -(-stored_rows(df) // CSV_ROWS)), RID).sortWithinPartitions(RID).drop(RID).write.option("header", True)
     .option("escape", '"').csv(path))
    return cast_listings(with_row_ids(read_raw_csv(spark, path)))


def parsed_listings(spark, folder):
    return cast_listings(raw(spark, folder)).select("price", "bed", "house_size", "zip_code")


def replace_results(spark, folder):
    """Flag counts per detector and state stored per detector; one detector is run again on recent dates."""
    def counts(df, name, hits):
        return df.where(hits).groupBy("state").agg(F.count(F.lit(1)).alias("flags")).withColumn("model", F.lit(name))

    first, again = listings(spark, folder), recent(spark, folder)
    date = F.col("prev_sold_date")
    old = counts(first, "corrected", invalid_date(date)).unionByName(
        counts(first, "original", legacy.placeholder_date(date)))
    place = f"{checkpoint_dir(spark)}/results/{uuid.uuid4().hex}"
    versions.publish({"flag_counts": old}, place)
    versions.publish_over({"flag_counts": counts(again, "corrected", invalid_date(date) | date.startswith("200"))}, place)
    return versions.latest(spark, place)["flag_counts"]


def contract_coercion(spark, folder):
    columns = [c for c in raw(spark, folder).columns if c in contract.LISTING_TYPES]
    return contract.violation_counts(raw(spark, folder), contract.coercion_checks(columns))


def contract_categories(spark, folder):
    return contract.violation_counts(raw(spark, folder), contract.category_checks())


def checks_on_listings(checks):
    return lambda spark, folder: contract.violation_counts(listings(spark, folder), checks())


# --- audit -----------------------------------------------------------------------------------------------------------

def full_audit(spark, folder):
    return rounded(audit.audit(listings(spark, folder)).summary, "value")


def report_lines(spark, folder):
    summary = audit.audit(listings(spark, folder)).summary
    return audit.report_lines(summary, "orders.parquet", "2026-01-01T00:00:00+00:00")


def audit_report(spark, folder):
    return audit.audit_report(audit.flagged_records(stored_listings(spark, folder)))


def audit_summary(spark, folder):
    df = stored_listings(spark, folder)
    return audit.flag_counts(audit.flagged_records(df))


# --- planting ----------------------------------------------------------------------------------------------------------

def planted(spark, folder):
    return plant.plant(recent(spark, folder), SEED, SPEC)


def plant_stage(*stages):
    def query(spark, folder):
        changes = planted(spark, folder).changes.where(F.col("stage").isin(*stages))
        return changes.select(RID, "source_rid", "subtype", "price", "bed", "bath", "acre_lot", "house_size",
                              "prev_sold_date")
    return query


def plant_sample(spark, folder):
    return plant.sample(recent(spark, folder), 100, SEED, F.col("price") > 0).select(RID, "price")


def plant_all(spark, folder):
    both = planted(spark, folder)
    return both.table.join(both.labels, RID, "left")


# --- scoring --------------------------------------------------------------------------------------------------------------

def flags_on(df, condition):
    return df.select(RID, condition.alias("flag"))


def price_scores(df, quantile=robust.MAD_FLOOR_QUANTILE, stats=None):
    return robust.price_robust_z(df, quantile, stats, "score")


def date_flags(spark, folder):
    return flags_on(listings(spark, folder), invalid_date(F.col("prev_sold_date")))


def flag_metrics(spark, folder):
    df = listings(spark, folder)
    hits = duplicates.mark_duplicates(df, "flag")
    return rounded(score.flag_metrics(hits, labels(spark, folder), "duplicate"), "precision", "recall", "f1")


def flag_metrics_upper(spark, folder):
    """Flags on recent dates, with the flags of the older rule standing for those raised before."""
    df = recent(spark, folder)
    date = F.col("prev_sold_date")
    before = flags_on(df, legacy.placeholder_date(date))
    now = flags_on(df, invalid_date(date) | date.isNull())
    return rounded(score.flag_metrics(now, labels(spark, folder), "invalid_date", before),
                   "precision", "recall", "f1", "precision_upper")


def document_scores(spark, folder):
    """Documents scored by the robust z of their length within their language; low quality is the positive class."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    groups = {robust.GROUP: F.col("lang"), robust.FALLBACK: F.lit("all")}
    z = robust.robust_z(documents.select("doc_id", "lang", "n_chars"), {"length": F.ln("n_chars")}, groups, None)
    scores = z.select(F.col("doc_id").alias(RID), F.round(F.coalesce(F.abs("z_length"), F.lit(0.0)), 6).alias("score"))
    marked = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").select(
        F.col("doc_id").alias(RID), F.lit("quality").alias("family"))
    return scores, marked, "quality"


def average_precision(spark, folder):
    return rounded(score.average_precision(*document_scores(spark, folder)), "average_precision")


def r_precision(spark, folder):
    return rounded(score.r_precision(*document_scores(spark, folder)), "r_precision")


def recall_by_subtype(spark, folder):
    hits = duplicates.mark_duplicates(listings(spark, folder), "flag")
    return rounded(score.recall_by_subtype(hits, labels(spark, folder), "duplicate"), "recall")


def base_flag_counts(spark, folder, forests=False):
    """The seven detectors that SQL can restate; ``forests`` adds the two isolation forests."""
    flags, _ = validation.run_detectors(materialise(listings(spark, folder)), forests=forests)
    return validation.base_flag_counts(flags)


def validation_run(spark, folder):
    return validation.validate(materialise(recent(spark, folder)), SPEC)[0]


def folded_metrics(spark, folder):
    """Metrics and subtype recalls of both robust z variants against the labels of the derived listings, for five
    parts of the whole table that stand for five runs."""
    df = stored_prices(spark, folder)
    stats = robust.price_stats(df)
    fold_of = hash60("fold", F.col(RID)) % FOLDS
    known = materialise(labels(spark, folder).where("family = 'price_unit'").join(df.select(RID, fold_of.alias("fold")), RID))
    metrics, recalls = [], []
    for name, quantile in ((validation.ROBUST, None), (validation.FLOORED, robust.MAD_FLOOR_QUANTILE)):
        scored = materialise(price_scores(df, quantile, stats).select(
            RID, F.round("score", 6).alias("score"), fold_of.alias("fold")))
        for fold in range(FOLDS):
            part = scored.where(F.col("fold") == fold)
            flags = flags_on(part, robust.is_price_outlier(F.col("score")))
            known_here = known.where(F.col("fold") == fold).drop("fold")
            key = {"seed": fold, "detector": name, "family": "price_unit"}
            row = validation.beside(score.flag_metrics(flags, known_here, "price_unit", flags.where("false")),
                                    score.score_metrics(part, known_here, "price_unit"))
            metrics.append(validation.named(row, **key))
            recalls.append(validation.named(score.recall_by_subtype(flags, known_here, "price_unit"), **key))
    return validation.union(metrics), validation.union(recalls)


def validation_summary(spark, folder):
    return rounded(validation.summarise(folded_metrics(spark, folder)[0]), "precision", "precision_upper", "recall", "f1")


def subtype_pivot(spark, folder):
    names = [validation.ROBUST, validation.FLOORED]
    wide = validation.subtype_pivot(folded_metrics(spark, folder)[1], names)
    return rounded(wide.select("family", "subtype", *[F.col(f"`{n}`").alias(a) for n, a in zip(names, ("plain", "floored"))]),
                   "plain", "floored")


def seed_confidence_interval(spark, folder):
    return rounded(validation.seed_interval(folded_metrics(spark, folder)[0], "recall"), "mean", "half_width")


def compare_variants(spark, folder):
    out = validation.compare_variants(folded_metrics(spark, folder)[0], [validation.ROBUST, validation.FLOORED])
    return rounded(out, *[c for c in out.columns if c != "detector"])


def largest_z(spark, folder):
    return rounded(validation.largest_z(stored_prices(spark, folder)), "without_floor", "with_floor", digits=4)


# --- leakage -------------------------------------------------------------------------------------------------------------

def prepared(spark, folder):
    return splits.prepare(stored_listings(spark, folder))


def split_of(spark, folder, seed=0):
    return splits.with_twins(splits.random_split(prepared(spark, folder), seed))


def leakage_prepare(spark, folder):
    out = prepared(spark, folder).select(RID, "y", "state_code", "status_code", "sold_year")
    return rounded(out, "y")


def matched_training_rows(spark, folder):
    kept = splits.training_rows(materialise(split_of(spark, folder)), SHARES, 0)
    return validation.union([validation.named(rows.select(RID, "twin"), keep_share=share)
                             for share, rows in kept.items()])


def design_matrix_forest(spark, folder):
    x = splits.design_matrix(prepared(spark, folder))
    return rounded(x.select(RID, *MODEL_FEATURES, *[f"{c}_missing" for c in MODEL_FEATURES]), "house_size", "acre_lot")


def group_mean(train, test, by):
    """Predictions for the metric queries: the mean log price of the training records of the same group."""
    means = train.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("?")).alias("_g")).agg(
        F.avg("y").alias("p"), F.count(F.lit(1)).alias("_w"))
    found = attach(test.withColumn("_g", F.coalesce(F.col(by).cast("string"), F.lit("?"))), means, ["_g"], "_w")
    return found.drop("_g", "_w")


BASELINES = {"zip mean": "zip_code", "bed mean": "bed"}
# What the baselines, splits and twins look at.
BASELINE_COLUMNS = [RID, "y", "bed", *PROPERTY_KEY]


def baseline_predictions(spark, folder, seeds, shares):
    frames = []
    base = materialise(prepared(spark, folder).select(*BASELINE_COLUMNS))
    for seed in range(seeds):
        split = materialise(splits.with_twins(splits.random_split(base, seed)))
        for share, train in splits.training_rows(split, shares, seed).items():
            for model, by in BASELINES.items():
                predicted = group_mean(train, split.where("is_test"), by).select(RID, "seen", "y", "p")
                frames.append(validation.named(predicted, seed=seed, model=model, keep_share=share))
    return validation.union(frames)


def baseline_metrics(spark, folder, seeds=SEEDS, shares=SHARES):
    predictions = materialise(baseline_predictions(spark, folder, seeds, shares))
    return leakage.regression_metrics(leakage.by_subset(predictions), ["seed", "model", "keep_share", "subset"])


def regression_metrics(spark, folder):
    return rounded(baseline_metrics(spark, folder, 1), "r2", "mae_log", "median_ape")


def mechanism_table(spark, folder):
    records = baseline_predictions(spark, folder, 1, [0.0, 1.0]).select(
        "model", "keep_share", F.col(RID).alias("row"), "seen", F.abs(F.col("p") - F.col("y")).alias("abs_err"))
    return rounded(leakage.mechanism_table(records), "err_without", "err_with", "change")


def paired_inflation(spark, folder):
    out = leakage.paired_inflation(baseline_metrics(spark, folder, shares=[0.0, 1.0]))
    return rounded(out, *[c for c in out.columns if c != "model"], digits=5)


def dose_response(spark, folder):
    out = leakage.dose_response(baseline_metrics(spark, folder), "zip mean")
    return rounded(out, "gain", "half_width", "slope", "intercept")


def naive_baseline(spark, folder):
    frames = []
    base = materialise(prepared(spark, folder).select("pid", *BASELINE_COLUMNS))
    for seed in range(SEEDS):
        for name, split in (("random", splits.random_split(base, seed)), ("grouped", splits.grouped_split(base, seed))):
            for model, by in BASELINES.items():
                predicted = group_mean(split.where("not is_test"), split.where("is_test"), by).select("y", "p")
                frames.append(validation.named(predicted, seed=seed, model=model, split=name))
    return leakage.regression_metrics(validation.union(frames), ["seed", "model", "split"])


def design_comparison(spark, folder):
    out = leakage.design_comparison(naive_baseline(spark, folder), baseline_metrics(spark, folder, shares=[0.0, 1.0]))
    return rounded(out, *[c for c in out.columns if c != "model"], digits=5)


def twin_anatomy(spark, folder):
    out = leakage.twin_anatomy(materialise(split_of(spark, folder).drop("pid")))
    return rounded(out, *out.columns)


def model_query(model):
    def query(spark, folder):
        data = materialise(models.matrix(split_of(spark, folder), model))
        return models.fit_predict(data.where("not is_test"), data.where("is_test"), model).select(RID, "y", "p")
    return query


def leakage_run(spark, folder):
    return leakage_plan.leakage_run(prepared(spark, folder))[0]


def naive_comparison(spark, folder):
    return leakage_plan.naive_comparison(prepared(spark, folder))


# --- root causes -----------------------------------------------------------------------------------------------------------

def broker_spearman(spark, folder):
    rollup = materialise(rootcause.broker_rollup(listings(spark, folder)))
    return rounded(rootcause.spearman(rollup, "flagged_pairs", "sold_listings"), "rho")


def customer_spearman(spark, folder):
    """Order count against account balance over all customers: many ties on one side, none on the other."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    both = materialise(customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("orders", "c_acctbal"))
    return rounded(rootcause.spearman(both, "orders", "c_acctbal"), "rho")


def top_outliers(spark, folder):
    z = rounded(robust.price_robust_z(stored_prices(spark, folder)).select(RID, "price", "house_size", "price_z"), "price_z")
    return rootcause.top_price_outliers(z)


QUERIES = {
    "scan_listings": scan_listings,
    "parsed_listings": parsed_listings,
    "replace_partition_results": replace_results,
    "report_lines": report_lines,
    "contract_coercion": contract_coercion,
    "contract_categories": contract_categories,
    "contract_ranges": checks_on_listings(contract.range_checks),
    "contract_date_pattern": checks_on_listings(contract.pattern_checks),
    "contract_row_rules": checks_on_listings(contract.row_checks),
    "expectation_report": on_listings(contract.expectation_report),
    "invalid_dates": on_listings(invalid_dates, RID, "prev_sold_date"),
    "listing_duplicates": on_listings(duplicates.duplicates, RID),
    "duplicate_key_sizes": on_listings(partial(duplicates.key_sizes, key=LISTING_KEY)),
    "duplicate_links": on_listings(links.duplicate_links),
    "multi_key_records": on_listings(duplicates.multi_key_records, RID),
    "group_robust_stats": line_group_stats,
    "robust_stats_fallback": stats_fallback,
    "mad_floor": mad_floor,
    "modified_z": line_robust_z,
    "price_robust_z": partial(robust_z, quantile=robust.MAD_FLOOR_QUANTILE),
    "price_robust_z_nofloor": partial(robust_z, quantile=None),
    "price_outliers": price_outliers,
    "iforest_features": forest_features,
    "isolation_forest": isolation_forest,
    "isolation_forest_summary": isolation_forest_summary,
    "property_ids": on_listings(properties.size_distribution),
    "records_sharing_address": on_listings(properties.records_sharing_address),
    "audit_flags": on_listings(audit.audit_flags, rounds=("price_z",)),
    "audit_report": audit_report,
    "audit_summary": audit_summary,
    "missing_rate_by_status": on_listings(audit.missing_rate_by_status),
    "full_audit": full_audit,
    "legacy_placeholder_dates": on_listings(legacy.placeholder_dates, RID),
    "legacy_same_price_dates": on_listings(legacy.same_price_different_dates, RID),
    "legacy_price_manipulation": on_listings(legacy.price_manipulation, RID),
    "plant_sample": plant_sample,
    "plant_sentinel_dates": plant_stage("sentinel_dates"),
    "plant_year_plus_1000": plant_stage("year_plus_1000"),
    "plant_transposed_year": plant_stage("transposed_year"),
    "plant_exact_duplicates": plant_stage("exact_duplicates"),
    "plant_blanked_duplicates": plant_stage("blanked_duplicates"),
    "plant_repriced_duplicates": plant_stage("repriced_duplicates"),
    "plant_price_units": plant_stage("price_x10", "price_x100", "price_x1000", "price_x0.001"),
    "plant_all": plant_all,
    "flag_metrics": flag_metrics,
    "flag_metrics_upper": flag_metrics_upper,
    "average_precision": average_precision,
    "r_precision": r_precision,
    "recall_by_subtype": recall_by_subtype,
    "base_flag_counts": base_flag_counts,
    "base_flag_counts_forests": partial(base_flag_counts, forests=True),
    "validation_run": validation_run,
    "validation_summary": validation_summary,
    "subtype_pivot": subtype_pivot,
    "seed_confidence_interval": seed_confidence_interval,
    "compare_variants": compare_variants,
    "largest_z": largest_z,
    "leakage_prepare": leakage_prepare,
    "leakage_population": lambda spark, folder: rounded(splits.population(prepared(spark, folder)), "sharing"),
    "random_split": lambda spark, folder: splits.random_split(listings(spark, folder), 0).select(RID, "is_test"),
    "twin_mask": lambda spark, folder: split_of(spark, folder).select(RID, "is_test", "twin", "seen"),
    "matched_training_rows": matched_training_rows,
    "design_matrix_forest": design_matrix_forest,
    "model_ridge": model_query(models.RIDGE),
    "model_gbt": model_query(models.BOOSTING),
    "model_forest": model_query(models.FOREST),
    "regression_metrics": regression_metrics,
    "leakage_run": leakage_run,
    "mechanism_table": mechanism_table,
    "grouped_split": lambda spark, folder: splits.grouped_split(prepared(spark, folder), 0).select(RID, "is_test"),
    "naive_comparison": naive_comparison,
    "paired_inflation": paired_inflation,
    "dose_response": dose_response,
    "twin_anatomy": twin_anatomy,
    "design_comparison": design_comparison,
    "headline_share": on_listings(rootcause.headline_share, rounds=("share",)),
    "nonnull_placeholder_hits": on_listings(rootcause.nonnull_placeholder_hits),
    "missing_by_status": on_listings(rootcause.missing_by_status, rounds=("share",)),
    "status_mix": on_listings(rootcause.same_price_mix),
    "status_mix_manipulation": on_listings(rootcause.manipulation_mix),
    "lifecycle_pairs": on_listings(rootcause.lifecycle_pairs, rounds=("sold_in_window", "for_sale_older", "median_years")),
    "holding_histogram": on_listings(rootcause.holding_histogram),
    "silently_dropped": on_listings(rootcause.silently_dropped),
    "detector_overlap": on_listings(rootcause.detector_overlap, rounds=("share",)),
    "broker_rollup": on_listings(rootcause.broker_rollup, rounds=("flags_per_sale",)),
    "spearman": broker_spearman,
    "spearman_customers": customer_spearman,
    "top_brokers": on_listings(rootcause.top_brokers, rounds=("flags_per_sale",)),
    "review_tallies": on_listings(rootcause.review_tallies),
    "lifecycle_records": on_listings(rootcause.lifecycle_records),
    "duplicate_review": on_listings(rootcause.duplicate_review),
    "zero_price_by_status": on_listings(rootcause.zero_price_by_status),
    "top_price_outliers": top_outliers,
}
