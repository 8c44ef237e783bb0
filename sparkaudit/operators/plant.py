"""Planting labelled errors.

Every record gets one uniform hash of (seed, rid). A stage takes the n eligible records with the smallest hash that
no earlier stage took, so a stage is described by one number, its cutoff, and planting is a map over the table: no
record is shuffled or joined, whatever the sample sizes.
"""
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HASH_BITS, all_present, hash60, unit
from ..schema import DATE_PATTERN, LISTING_KEY, MAX_DATE, RID
from ..session import materialise
from .scale import kth_smallest, running_totals

# Planted default dates and the attributes a near copy may lose.
SENTINELS = ["1900-01-01", "0000-00-00", "1970-01-01", "unknown", "N/A", "9999-12-31"]
BLANKED = ["bed", "bath", "acre_lot", "house_size"]
REPRICE_LOW, REPRICE_HIGH, REPRICE_MIN_PRICE = 0.001, 0.005, 1000


@dataclass(frozen=True)
class Spec:
    """How many errors of each kind to plant."""
    # The sizes of the experiments.
    sentinel_dates: int = 3000
    typo_years: int = 3000
    exact_duplicates: int = 2000
    near_duplicates: int = 4000
    price_factors: dict = field(default_factory=lambda: {10: 1000, 100: 1000, 1000: 1000, 0.001: 1000})


@dataclass(frozen=True)
class Stage:
    name: str
    family: str
    subtype: str
    n: int
    eligible: object
    copies: bool = False
    changes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Planted:
    """The corrupted table, its labels (rid, family, subtype), the rows that each stage wrote, and the edited records as
    they were."""
    table: DataFrame
    labels: DataFrame
    changes: DataFrame
    before: DataFrame


def date_stages(spec, seed):
    date = F.col("prev_sold_date")
    dated = date.rlike(DATE_PATTERN)
    year, rest = F.substring(date, 1, 4), F.substring(date, 5, 100)
    swapped = F.concat(F.substring(date, 1, 2), F.substring(date, 4, 1), F.substring(date, 3, 1))
    default = F.get(F.array(*[F.lit(s) for s in SENTINELS]),
                    (hash60("sentinel", seed, F.col(RID)) % len(SENTINELS)).cast("int"))
    plus = spec.typo_years // 2
    return [
        Stage("sentinel_dates", "invalid_date", "sentinel", spec.sentinel_dates, dated,
              changes={"prev_sold_date": default}),
        Stage("year_plus_1000", "invalid_date", "year +1000", plus, dated,
              changes={"prev_sold_date": F.concat((year.try_cast("int") + 1000).cast("string"), rest)}),
        Stage("transposed_year", "invalid_date", "transposed year", spec.typo_years - plus,
              dated & (swapped.try_cast("int") > int(MAX_DATE[:4])),
              changes={"prev_sold_date": F.concat(swapped, rest)}),
    ]


def duplicate_stages(spec, seed):
    keyed = all_present(LISTING_KEY)
    lost = hash60("blank", seed, F.col(RID)) % len(BLANKED)
    up = hash60("sign", seed, F.col(RID)) % 2 == 1
    size = REPRICE_LOW + (REPRICE_HIGH - REPRICE_LOW) * unit(hash60("size", seed, F.col(RID)))
    blanked = spec.near_duplicates // 2
    return [
        Stage("exact_duplicates", "duplicate", "exact copy", spec.exact_duplicates, keyed, True),
        Stage("blanked_duplicates", "duplicate", "one attribute blanked", blanked, keyed, True,
              {c: F.when(lost != i, F.col(c)) for i, c in enumerate(BLANKED)}),
        Stage("repriced_duplicates", "duplicate", "price re-keyed (<=0.5%)", spec.near_duplicates - blanked,
              keyed & (F.col("price") >= REPRICE_MIN_PRICE), True,
              {"price": F.rint(F.col("price") * (1 + F.when(up, size).otherwise(-size)))}),
    ]


def price_stages(spec):
    return [Stage(f"price_x{factor:g}", "price_unit", f"x{factor:g}", n, F.col("price") > 0,
                  changes={"price": F.col("price") * F.lit(float(factor))})
            for factor, n in spec.price_factors.items()]


def stages(spec, seed):
    return date_stages(spec, seed) + duplicate_stages(spec, seed) + price_stages(spec)


def cutoffs(df, plan, seed):
    """(largest hash each stage takes, largest record id). Raises when a pool is too small.

    Only records below a threshold that surely holds all samples are kept for the search; one count of the pools
    gives the threshold.
    """
    flags = [F.coalesce(s.eligible, F.lit(False)).alias(f"e{i}") for i, s in enumerate(plan)]
    hashed = df.select(RID, hash60(seed, F.col(RID)).alias("u"), *flags)
    *pools, top = hashed.agg(*[F.count_if(f"e{i}") for i in range(len(plan))], F.max(RID)).first()
    drawn, share = 0, 0.0
    for stage, pool in zip(plan, pools, strict=True):
        drawn += stage.n
        share = max(share, 1.5 * (drawn + 50) / max(pool, 1))
    for attempt in (share, 1.0):
        threshold = 2 ** HASH_BITS if attempt >= 1 else int(attempt * 2 ** HASH_BITS)
        near = materialise(hashed.where(F.col("u") < threshold).drop(RID))
        found, free = [], F.lit(True)
        for i, stage in enumerate(plan):
            cutoff = kth_smallest(near.where(free & F.col(f"e{i}")), "u", stage.n, bounded=attempt < 1)
            if cutoff is None:
                break
            found.append(cutoff)
            free = free & ~(F.col(f"e{i}") & (F.col("u") <= cutoff))
        if len(found) == len(plan):
            return found, top
        if threshold == 2 ** HASH_BITS:
            break
    raise ValueError(f"not enough records to plant {plan[len(found)].n} x {plan[len(found)].name}")


def stage_of(plan, found):
    """The position in ``plan`` of the stage that takes a record with hash ``_u``, else missing."""
    stage = F.when(F.lit(False), F.lit(0))
    for i, (step, cutoff) in enumerate(zip(plan, found, strict=True)):
        stage = stage.when((F.col("_u") <= cutoff) & step.eligible, F.lit(i))
    return stage


def picked(df, plan, found, seed):
    """The records that the stages take, with ``_u`` and ``_stage``. Most records fail the first, cheap comparison."""
    few = df.withColumn("_u", hash60(seed, F.col(RID))).where(F.col("_u") <= max(found))
    return few.withColumn("_stage", stage_of(plan, found)).where(F.col("_stage").isNotNull())


def sample(df, n, seed, eligible=None):
    """``n`` records of the eligible pool, the same for the same seed on any partitioning."""
    plan = [Stage("sample", "", "", n, F.lit(True) if eligible is None else eligible)]
    return picked(df, plan, cutoffs(df, plan, seed)[0], seed).drop("_u", "_stage")


def changed(df, plan, copies):
    """The values the stages write: to copies, or to the records themselves."""
    columns = {}
    for i, stage in enumerate(plan):
        if stage.copies == copies:
            for name, value in stage.changes.items():
                before = columns.get(name)
                hit = F.col("_stage") == i
                columns[name] = F.when(hit, value) if before is None else before.when(hit, value)
    return df.select(*[columns[c].otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def of_plan(plan, attribute):
    return F.get(F.array(*[F.lit(getattr(s, attribute)) for s in plan]), F.col("_stage"))


def plant(df, seed, spec=None) -> Planted:
    """Every record is in at most one stage. Copies get the ids above the largest one; of a planted duplicate both
    the copy and its source are labelled."""
    spec = spec or Spec()
    plan = stages(spec, seed)
    found, top = cutoffs(df, plan, seed)
    hits = materialise(picked(df, plan, found, seed))
    is_copy = F.col("_stage").isin([i for i, s in enumerate(plan) if s.copies])
    sources = hits.where(is_copy)
    ranks = running_totals(sources.select(F.col("_u"), F.lit(1).alias("one")), "_u", ["one"])
    copies = (changed(sources, plan, True).withColumn("_source", F.col(RID))
              .join(ranks.select("_u", "cum_one"), "_u")
              .withColumn(RID, F.lit(top) + F.col("cum_one")).drop("cum_one"))
    copies = materialise(copies)
    edited = changed(hits, plan, False).withColumn("_source", F.col(RID))
    labelled = edited.unionByName(copies.select(edited.columns))
    subtype = F.when(F.col("_stage") == 0, F.concat(F.lit("sentinel "), F.col("prev_sold_date"))).otherwise(
        of_plan(plan, "subtype"))
    labels = labelled.select(RID, of_plan(plan, "family").alias("family"), subtype.alias("subtype"))
    written = labelled.where(~is_copy | (F.col(RID) != F.col("_source")))
    changes = written.select(RID, F.col("_source").alias("source_rid"), of_plan(plan, "name").alias("stage"),
                             subtype.alias("subtype"), *[c for c in df.columns if c != RID])
    marked = df.withColumn("_u", hash60(seed, F.col(RID))).withColumn("_stage", stage_of(plan, found))
    table = changed(marked, plan, False).select(df.columns).unionByName(copies.select(df.columns))
    return Planted(table, labels, changes, hits.where(~is_copy).select(df.columns))
