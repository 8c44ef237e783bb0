"""Scoring flags and anomaly scores against labelled errors."""
import math
from functools import lru_cache, reduce

from pyspark.sql import functions as F

from ..schema import RID
from ..session import materialise
from .scale import running_totals


def ratio(a, b):
    return F.when(b != 0, a / b)


def positives(labels, family):
    return labels.where(F.col("family") == family).select(RID).distinct()


def sparse_metrics(flagged, wanted, by=(), before=None):
    """One row per ``by``: flagged, tp, fp, fn, precision, recall, f1, from the ids that matter alone.

    ``flagged``, ``wanted`` (labelled) and ``before`` (flagged in the unmodified table) hold the columns ``by`` and rid,
    only of records that are flagged or labelled; every other record is a true negative and never looked at. With
    ``before`` also an upper bound of the precision that does not count those flags as errors. An undefined ratio is
    missing. Any number of detectors and seeds is one aggregate.
    """
    kinds = [("_f", flagged), ("_y", wanted)] + ([("_b", before)] if before is not None else [])
    marks = reduce(lambda a, b: a.unionByName(b), [
        rows.select(*by, RID, *[F.lit(name == k).alias(k) for k, _ in kinds]) for name, rows in kinds])
    each = marks.groupBy(*by, RID).agg(*[F.bool_or(k).alias(k) for k, _ in kinds])
    f, y = F.col("_f"), F.col("_y")
    counts = [F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn")]
    if before is not None:
        counts.append(F.count_if(f & ~y & F.col("_b")).alias("fp_preexisting"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p, r = F.col("precision"), F.col("recall")
    out = (each.groupBy(*by).agg(*counts).withColumn("flagged", tp + fp).withColumn("precision", precision)
           .withColumn("recall", recall)
           .withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r != 0, p + r))))
    names = [*by, "flagged", "tp", "fp", "fn", "precision", "recall", "f1"]
    if before is not None:
        clean = tp + fp - F.col("fp_preexisting")
        out = out.withColumn("precision_upper", ratio(tp, clean))
        names += ["fp_preexisting", "precision_upper"]
    return out.select(names)


def flag_metrics(flags, labels, family, preexisting=None):
    """``sparse_metrics`` of the flags (rid, flag) of one detector; labels are of records of the flagged table."""
    before = None if preexisting is None else preexisting.where("flag")
    return sparse_metrics(flags.where("flag"), positives(labels, family), before=before)


def ranking(scores, labels, family):
    """Per distinct score: records ``n``, positives ``tp``, and both accumulated from the highest score down."""
    rows = scores.select(RID, "score").join(positives(labels, family).withColumn("_y", F.lit(1)), RID, "left")
    counts = materialise(rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"),
                                                   F.coalesce(F.sum("_y"), F.lit(0)).alias("tp")))
    return running_totals(counts, "score", ["n", "tp"], descending=True)


def score_metrics(scores, labels, family):
    """One row: average precision, and R-precision (share of positives among as many top scores as there are positives).

    Equal scores are one step of the precision-recall curve. When the last of the top scores is shared, each of its
    records counts with the share of them that fits, so the result depends on no order of ties.
    """
    ranked = materialise(ranking(scores, labels, family))
    k = ranked.agg(F.sum("tp")).first()[0]
    above = F.col("cum_n") - F.col("n")
    fitting = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - above)) / F.col("n")
    total = F.lit(float(k)) if k else F.lit(None).cast("double")
    return ranked.agg(F.sum(F.col("tp") / total * F.col("cum_tp") / F.col("cum_n")).alias("average_precision"),
                      (F.sum(F.col("tp") * fitting) / total).alias("r_precision"))


def average_precision(scores, labels, family):
    return score_metrics(scores, labels, family).select("average_precision")


def r_precision(scores, labels, family):
    return score_metrics(scores, labels, family).select("r_precision")


def sparse_recalls(flagged, wanted, by=()):
    """Share of the labelled records of each (``by``, subtype) that are flagged; both tables hold ids that matter alone."""
    hits = flagged.select(*by, RID, F.lit(1.0).alias("_hit"))
    return (wanted.join(hits, [*by, RID], "left").groupBy(*by, "subtype")
            .agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall")))


def recall_by_subtype(flags, labels, family):
    """Share of each subtype's labelled records that are flagged."""
    return sparse_recalls(flags.where("flag"), labels.where(F.col("family") == family))


@lru_cache
def t_critical(df, confidence=0.95):
    """Two-sided critical value of Student's t: the density integrated after t = sqrt(df) tan(a)."""
    def share_within(limit, steps=400):
        width = math.atan(limit / math.sqrt(df)) / steps
        total = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(i * width) ** (df - 1)
                    for i in range(steps + 1)) * width / 3
        return 2 * total * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if share_within(middle) < confidence else (low, middle)
    return low


# Degrees of freedom whose critical value is integrated; beyond, the expansion below is exact to ten digits.
INTEGRATED = 60
NORMAL_95 = 1.959963984540054


def t_quantile(df):
    """``t_critical`` as a column, for any number of degrees of freedom.

    Up to ``INTEGRATED`` from a table; beyond it the Cornish-Fisher expansion around the normal quantile.
    """
    z = NORMAL_95
    terms = [(z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
             (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
             (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160]
    far = sum((F.lit(c) / F.pow(df.cast("double"), F.lit(float(k))) for k, c in enumerate(terms, 1)), F.lit(z))
    table = F.array(*[F.lit(t_critical(d)) for d in range(1, INTEGRATED + 1)])
    return F.when(df <= INTEGRATED, F.get(table, (df - 1).cast("int"))).otherwise(far)


def confidence_interval(value):
    """Aggregates ``mean`` and ``half_width`` of a 95% t-interval of any number of runs; one run has no interval."""
    n = F.count(value)
    return [F.avg(value).alias("mean"),
            F.when(n > 1, t_quantile(n - 1) * F.stddev_samp(value) / F.sqrt(n)).alias("half_width")]
