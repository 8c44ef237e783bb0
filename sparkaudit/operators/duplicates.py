"""Records that are compatible with another record of the same key, found without forming pairs.

Two records are compatible when every compared attribute is equal or missing on a side. The test runs per *mask*,
the set of attributes a record has: records with masks A and B can only disagree on the attributes of both, so
they are compatible exactly when their values on A∩B, their signature, are equal. A record is therefore matched
by counting the other side of its signature instead of looking at its partners; the work grows with the number
of records times the masks its key really has, whatever the size of a key.
"""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import all_present
from ..schema import COMPARED, LISTING_KEY, PRICE_TOLERANCE, RID
from ..session import materialise
from .scale import attach, keep_matching

# Price positions that never meet another one within a tolerance step.
NO_PRICE, NEVER_CLOSE, ZERO = -(1 << 40), -(1 << 40) + 1000, -(1 << 40) + 2000


def mask_of(attributes):
    """Bit i is set when attribute i is present."""
    return sum((F.when(F.col(a).isNotNull(), 1 << i).otherwise(0) for i, a in enumerate(attributes)), F.lit(0))


def masks_of_group(mask):
    """Aggregate: bit m is set when a record of the group has mask m."""
    return F.bit_or(F.shiftleft(F.lit(1).cast("bigint"), mask) if isinstance(mask, int)
                    else F.call_function("shiftleft", F.lit(1).cast("bigint"), mask))


def each_mask(bitmap, attributes):
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << len(attributes)) - 1)),
                              lambda m: F.getbit(bitmap, m) == 1))


def signature(df, overlap, attributes):
    """Columns with the values of the attributes in ``overlap`` and a fixed value elsewhere; never missing."""
    kinds = dict(df.dtypes)
    columns = []
    for i, name in enumerate(attributes):
        blank = F.lit("") if kinds[name] == "string" else F.lit(0).cast(kinds[name])
        in_overlap = overlap.bitwiseAND(F.lit(1 << i)) != 0
        columns.append(F.when(in_overlap, F.col(name)).otherwise(blank).alias(f"_s{i}"))
    return columns


def may_share(df, key):
    """Records with a complete key, less most of those that hold it alone: a superset of ``multi_key_records``.

    Keys are counted by their 64-bit hash, so little is shuffled. A record whose hash meets another's by chance stays, which
    changes nothing for rules that compare the keys themselves. Any key that holds these columns may be looked for in the result.
    """
    keyed = df.where(all_present(key)).withColumn("_h", F.xxhash64(*key))
    groups = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keep_matching(keyed, groups, ["_h"], "_n").drop("_h")


def multi_key_records(df, key=LISTING_KEY):
    """Records whose complete key is held by more than one record."""
    keyed = df.where(all_present(key))
    groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keep_matching(keyed, groups, key, "_n")


def key_sizes(df, key):
    """How many keys hold n records, and the candidate pairs in them (a count; no pair is formed)."""
    n = F.col("group_size")

    def whole(x):
        return x.cast("bigint").cast("decimal(19,0)")

    return (df.where(all_present(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"))
            .groupBy("group_size").agg(F.count(F.lit(1)).alias("keys"))
            .select("group_size", "keys", (n * F.col("keys")).alias("records"),
                    # of n and n - 1 the even one is halved, so every step is a whole number
                    (F.when(n % 2 == 0, whole(n / 2) * whole(n - 1)).otherwise(whole(n) * whole((n - 1) / 2)) * whole(F.col("keys")))
                    .cast("decimal(38,0)").alias("candidate_pairs")))


def duplicates(df, key=LISTING_KEY, compared=COMPARED, price="price", tolerance=PRICE_TOLERANCE, rid=RID):
    """Records of ``df`` that have a duplicate: same complete key, compatible attributes, and prices that differ by
    at most ``tolerance`` of the larger one or are missing on a side.

    Prices are placed in steps of ln(1+tolerance): two in one step are always close enough, and a close price is at
    most ``reach`` steps away. So a record needs only the number of prices in its own step and the nearest price
    in the steps around, all of them aggregates.
    """
    step = math.log1p(tolerance)
    reach = math.ceil(-math.log1p(-tolerance) / step)
    p = F.col(price)
    position = (F.when(p.isNull(), F.lit(NO_PRICE)).when((p < 0) | (p == float("inf")), F.lit(NEVER_CLOSE))
                .when(p == 0, F.lit(ZERO)).otherwise(F.floor(F.ln(p) / step).cast("bigint")))
    # masks are gathered by the hash of the key: a mask or record too many, from two keys of one hash, finds no partner below
    keyed = df.where(all_present(key)).withColumn("_mask", mask_of(compared)).withColumn("_h", F.xxhash64(*key))
    groups = (keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), masks_of_group(F.col("_mask")).alias("_masks"))
              .where("_n > 1"))
    multi = materialise(attach(keyed, groups, ["_h"], "_n").drop("_h", "_n").withColumn("_step", position))
    sided = multi.withColumn("_partner", each_mask(F.col("_masks"), compared))
    overlap = F.col("_mask").bitwiseAND(F.col("_partner"))
    sided = sided.select(*df.columns, "_step", F.least("_mask", "_partner").alias("_lo"),
                         F.greatest("_mask", "_partner").alias("_hi"),
                         (F.col("_mask") > F.col("_partner")).alias("_is_hi"), *signature(sided, overlap, compared))
    group = [*key, "_lo", "_hi", *[f"_s{i}" for i in range(len(compared))]]

    sides = {"lo": ~F.col("_is_hi"), "hi": F.col("_is_hi")}
    steps = sided.groupBy(*group, "_step").agg(*[a for s, mine in sides.items() for a in (
        F.count_if(mine).alias(f"n_{s}"), F.min(F.when(mine, p)).alias(f"min_{s}"),
        F.max(F.when(mine, p)).alias(f"max_{s}"))])
    # a group has one row per price step here, so these windows are bounded by the range of prices
    whole = Window.partitionBy(*group)
    down = whole.orderBy("_step").rangeBetween(-reach, -1)
    up = whole.orderBy("_step").rangeBetween(1, reach)
    around = steps.select(*group, "_step", (F.col("n_lo") + F.col("n_hi")).alias("_size"), *[c for s in sides for c in (
        F.col(f"n_{s}").alias(f"here_{s}"), F.sum(f"n_{s}").over(whole).alias(f"all_{s}"),
        F.sum(F.when(F.col("_step") == NO_PRICE, F.col(f"n_{s}")).otherwise(0)).over(whole).alias(f"unpriced_{s}"),
        F.max(f"max_{s}").over(down).alias(f"below_{s}"), F.min(f"min_{s}").over(up).alias(f"above_{s}"))])

    # a pair of equal masks has one side only; a record is then not its own partner
    same = F.col("_lo") == F.col("_hi")
    own = F.when(same, 1).otherwise(0)

    def other(name):
        return F.when(same | F.col("_is_hi"), F.col(f"{name}_lo")).otherwise(F.col(f"{name}_hi"))

    def close(q):
        return F.coalesce(F.abs(p - q) <= tolerance * F.greatest(p, q), F.lit(False))

    hit = F.when(F.col("_step") == NO_PRICE, other("all") - own >= 1).otherwise(
        (other("unpriced") >= 1) | ((F.col("_step") != NEVER_CLOSE) & (other("here") - own >= 1))
        | close(other("below")) | close(other("above")))
    found = attach(sided, around, [*group, "_step"], "_size").where(hit)
    rest = [c for c in df.columns if c != rid]
    # one row per record; a record can be found under several masks
    return (found.groupBy(rid).agg(F.any_value(F.struct(*rest)).alias("_r"))
            .select(*[F.col(c) if c == rid else F.col("_r")[c].alias(c) for c in df.columns]))


def duplicate_ids(df, key=LISTING_KEY, compared=COMPARED, price="price", tolerance=PRICE_TOLERANCE, rid=RID):
    narrow = df.select(rid, *key, *compared, price)
    return duplicates(narrow, key, compared, price, tolerance, rid).select(rid)


def mark_duplicates(df, name="listing_duplicate", **rules):
    """All records with a boolean column."""
    hits = duplicate_ids(df, **rules).withColumn(name, F.lit(True))
    return df.join(hits, RID, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mark_compatible(left, right, key, attributes, name, rid=RID):
    """Adds to ``left`` whether ``right`` has a record of the same key with compatible attributes.

    The same counting by mask and signature as for duplicates, between two tables.
    """
    def masked(df):
        return df.where(all_present(key)).withColumn("_mask", mask_of(attributes))

    def bitmap(df, weight, bits):
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(weight), masks_of_group(F.col("_mask")).alias(bits))

    def signed(df, bits, mine, partner):
        spread = df.withColumn("_partner", each_mask(F.col(bits), attributes))
        overlap = F.col("_mask").bitwiseAND(F.col("_partner"))
        return spread.select(*[c for c in df.columns if c == rid], *key, F.col("_mask").alias(mine),
                             F.col("_partner").alias(partner), *signature(spread, overlap, attributes))

    l, r = masked(left.select(rid, *key, *attributes)), masked(right.select(*key, *attributes))
    keys = materialise(bitmap(l, "_nl", "_masks_l").join(bitmap(r, "_nr", "_masks_r"), key)
                       .withColumn("_n", F.col("_nl") + F.col("_nr")))
    group = [*key, "_ml", "_mr", *[f"_s{i}" for i in range(len(attributes))]]
    offered = (signed(attach(r, keys.select(*key, "_n", "_masks_l"), key, "_n", stored=True), "_masks_l", "_mr", "_ml")
               .groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    wanted = signed(attach(l, keys.select(*key, "_n", "_masks_r"), key, "_n", stored=True), "_masks_r", "_ml", "_mr")
    hits = keep_matching(wanted, offered, group, "_n").select(rid).distinct().withColumn(name, F.lit(True))
    return left.join(hits, rid, "left").withColumn(name, F.coalesce(name, F.lit(False)))
