"""Measuring detectors on planted errors."""
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_present
from ..operators.dates import invalid_date
from ..operators.duplicates import duplicate_ids, may_share
from ..operators.iforest import both_forests
from ..operators.legacy import placeholder_date, price_manipulation, same_price_different_dates
from ..operators.plant import plant
from ..operators.robust import (
    is_price_outlier,
    measure_counts,
    price_groups,
    price_measures,
    price_robust_z,
    price_stats,
    stats_of_counts,
    updated_stats,
)
from ..operators.scale import beside, keep_matching
from ..operators.score import confidence_interval, score_metrics, sparse_metrics, sparse_recalls
from ..schema import LEGACY_HOME_KEY, LEGACY_PROPERTY_KEY, LISTING_KEY, PROPERTY_KEY, RID
from ..session import materialise, scratch, side_by_side
from ..sources.versions import publish

FOREST_THRESHOLD = 0.5
# Plantings that are examined at the same time, and the columns that a price score looks at.
PLANTINGS = 3
SCORED = ["price", "house_size", "zip_code", "state"]
# Detector names of the result tables, with the error family each is scored on.
ROBUST, FLOORED = "corrected: robust z (|z| > 3.5)", "corrected v2: robust z + MAD floor"
FOREST, FOREST_PRICE = "ML baseline: isolation forest", "ML baseline: isolation forest (price features)"
FAMILIES = {
    "original: placeholder dates": "invalid_date",
    "corrected: invalid dates": "invalid_date",
    "original: same price, different dates": "duplicate",
    "original: price manipulation": "duplicate",
    "corrected: listing duplicates": "duplicate",
    ROBUST: "price_unit",
    FLOORED: "price_unit",
    FOREST: "price_unit",
    FOREST_PRICE: "price_unit",
}


# Detectors that look at a record alone, and detectors that look at all records of a complete key.
RECORD_RULES = {"original: placeholder dates": placeholder_date, "corrected: invalid dates": invalid_date}
KEY_RULES = {
    "original: same price, different dates": (LEGACY_PROPERTY_KEY, same_price_different_dates),
    "original: price manipulation": (LEGACY_HOME_KEY, price_manipulation),
    "corrected: listing duplicates": (LISTING_KEY, duplicate_ids),
}


def score_table(df, stats, seed, forests):
    """({detector: (rid, score) of all records}, {detector: rid of the flagged}) of the detectors that score."""
    plain = price_robust_z(df.select(RID, *SCORED), None, stats, "plain")
    z = materialise(price_robust_z(plain, stats=stats, name="floored").select(RID, "plain", "floored"))
    scores = {ROBUST: z.select(RID, F.col("plain").alias("score")), FLOORED: z.select(RID, F.col("floored").alias("score"))}
    flagged = {name: s.where(is_price_outlier(F.col("score"))).select(RID) for name, s in scores.items()}
    if forests:
        both = both_forests(df, seed, stats)
        for name, column in ((FOREST, "all_features"), (FOREST_PRICE, "price_features")):
            scores[name] = both.select(RID, F.col(column).alias("score"))
            flagged[name] = scores[name].where(F.col("score") > FOREST_THRESHOLD).select(RID)
    return scores, flagged


def run_detectors(df, seed=0, forests=True, stats=None):
    """({detector: rid of the flagged records}, {detector: (rid, score) of all records}).

    The keys of all rules hold the address, so they are looked for among the records that may share theirs.
    """
    flagged = {name: df.where(rule(F.col("prev_sold_date"))).select(RID) for name, rule in RECORD_RULES.items()}
    near = materialise(may_share(df, PROPERTY_KEY))
    flagged |= {name: rule(near).select(RID) for name, (_, rule) in KEY_RULES.items()}
    scores, outlying = score_table(df, price_stats(df) if stats is None else stats, seed, forests)
    return flagged | outlying, scores


@dataclass(frozen=True)
class Base:
    """The unmodified table, its flags (detector, family, rid), and the counts and statistics of its prices, all stored."""
    rows: DataFrame
    flags: DataFrame
    counts: DataFrame
    stats: DataFrame


def base_run(df, forests=True):
    counts = materialise(measure_counts(df, price_measures(), price_groups()))
    stats = stats_of_counts(counts)
    return Base(df, flag_table(run_detectors(df, 0, forests, stats)[0]), counts, stats)


def rule_after(base, name, gone, come):
    """Ids that a detector flags after the rows ``gone`` have left the table and the rows ``come`` have entered.

    Flags of records that are neither touched nor share a key with a touched one stay as they are.
    """
    earlier = base.flags.where(F.col("detector") == name).select(RID)
    if name in RECORD_RULES:
        now = come.where(RECORD_RULES[name](F.col("prev_sold_date")))
        return earlier.join(gone.select(RID), RID, "left_anti").unionByName(now.select(RID))
    key, rule = KEY_RULES[name]

    def keyed(rows):
        return rows.where(all_present(key))

    touched = materialise(keyed(gone).select(*key).unionByName(keyed(come).select(*key))
                          .groupBy(*key).agg(F.count(F.lit(1)).alias("_touched")))
    members = materialise(keep_matching(keyed(base.rows), touched, key, "_touched", stored=True))
    now = members.join(gone.select(RID), RID, "left_anti").unionByName(keyed(come))
    return earlier.join(members.select(RID), RID, "left_anti").unionByName(rule(materialise(now)).select(RID))


def detectors_after(base, planted, seed=0, forests=True):
    """``run_detectors`` of the planted table, from the base run and the planted records alone where a rule allows it.

    The scores are maps over the table, given the statistics; the forests are drawn anew for every seed.
    """
    gone, come = materialise(planted.before), materialise(planted.changes.select(planted.table.columns))
    flagged = {name: rule_after(base, name, gone, come) for name in (*RECORD_RULES, *KEY_RULES)}
    stats = updated_stats(base.counts, base.stats, gone, come, price_measures(), price_groups())
    scores, outlying = score_table(planted.table, stats, seed, forests)
    return flagged | outlying, scores


def flag_table(flagged, **values):
    """All flagged ids as one stored table (the given values, detector, family, rid)."""
    return materialise(union([named(rows, **values, detector=name, family=FAMILIES[name]) for name, rows in flagged.items()]))


def named(df, **values):
    return df.select(*[F.lit(v).alias(k) for k, v in values.items()], "*")


def union(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def base_flag_counts(flagged):
    """Per detector: records flagged, none included."""
    spark = next(iter(flagged.values())).sparkSession
    names = spark.createDataFrame([(name, FAMILIES[name]) for name in flagged], "detector string, family string")
    counts = flag_table(flagged).groupBy("detector").agg(F.count(F.lit(1)).alias("flags"))
    return F.broadcast(names).join(counts, "detector", "left").select("detector", "family", F.coalesce("flags", F.lit(0)).alias("flags"))


def wanted_table(labels, names, seed):
    """The labels of each detector's family (seed, detector, family, rid, subtype)."""
    spark = labels.sparkSession
    keys = spark.createDataFrame([(seed, name, FAMILIES[name]) for name in names], "seed int, detector string, family string")
    return labels.join(F.broadcast(keys), "family").select("seed", "detector", "family", RID, "subtype")


def validate(df, spec, n_seeds=5, forests=True):
    """(metrics, recall by subtype): every detector on ``n_seeds`` plantings. ``df`` is a stored table.

    The detectors run in full once, on the unmodified table; a planting only costs what the planted records touch, plus
    the scores. Only ids of flagged and of labelled records are kept; the flags of all detectors and seeds are scored in
    one aggregate. Plantings run side by side, at most ``PLANTINGS`` at a time.
    """
    with scratch(df.sparkSession):
        return scored_plantings(df, spec, n_seeds, forests)


def scored_plantings(df, spec, n_seeds, forests):
    key = ["seed", "detector", "family"]
    base = base_run(df, forests)

    def one(seed):
        planted = plant(df, seed, spec)
        labels = materialise(planted.labels)
        flagged, scores = detectors_after(base, planted, seed, forests)
        ranked = [named(score_metrics(s, labels, FAMILIES[name]), seed=seed, detector=name) for name, s in scores.items()]
        return flag_table(flagged, seed=seed), wanted_table(labels, flagged, seed), materialise(union(ranked))

    done = side_by_side(df.sparkSession, [partial(one, seed) for seed in range(n_seeds)], PLANTINGS)
    flags, wanted, ranked = (union(part) for part in zip(*done, strict=True))
    wanted = materialise(wanted)
    earlier = base.flags.select(F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))).alias("seed"), "detector", "family", RID)
    metrics = sparse_metrics(flags, wanted.select(*key, RID).distinct(), key, earlier)
    metrics = metrics.join(F.broadcast(ranked), ["seed", "detector"], "left")
    return materialise(metrics, kept=True), materialise(sparse_recalls(flags, wanted, key), kept=True)


def summarise(metrics):
    """Mean of every metric per family and detector."""
    return metrics.groupBy("family", "detector").agg(*[
        F.avg(c).alias(c) for c in ("precision", "precision_upper", "recall", "f1")])


def subtype_pivot(recalls, detectors):
    return recalls.groupBy("family", "subtype").pivot("detector", detectors).agg(F.avg("recall"))


def seed_interval(metrics, metric):
    mean, half = confidence_interval(F.col(metric))
    return metrics.groupBy("family", "detector").agg(mean, half)


def compare_variants(metrics, variants):
    """Variants of one detector next to each other, a row per variant."""
    return metrics.where(F.col("detector").isin(variants)).groupBy("detector").agg(
        F.avg("flagged").alias("flags"), F.avg("recall").alias("recall"),
        F.avg("precision_upper").alias("precision_upper"), F.avg("average_precision").alias("average_precision"),
        F.avg("r_precision").alias("r_precision"))


def largest_z(df, stats=None):
    """One row: the largest z of a positive price without and with the floor."""
    stats = price_stats(df) if stats is None else stats
    both = price_robust_z(price_robust_z(df, None, stats, "z_plain"), stats=stats, name="z_floor")
    return both.where(F.col("price") > 0).agg(F.max("z_plain").alias("without_floor"), F.max("z_floor").alias("with_floor"))


def store_validation(df, spec, folder, **options):
    """Publishes the metrics and the recalls by subtype of a validation under ``folder``/validation."""
    metrics, recalls = validate(df, spec, **options)
    publish({"validation_metrics": metrics, "validation_recall_by_subtype": recalls}, f"{folder}/validation")
