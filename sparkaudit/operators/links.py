"""How many duplicates every record has, and the groups that duplicates form, without forming pairs.

Partners of a record share its signature group (see ``duplicates``) and have a price in a range around its own, so
their number is a difference of two prefix sums over all prices in the order of (group, price). That order is dealt out
in ranges of bounded size, whatever the size of a key. For the groups, a price is joined to the nearest partner prices
below and above only: whatever lies between two close prices is close to both, so these few links connect the same
records as all links do.
"""
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import all_present
from ..schema import COMPARED, LISTING_KEY, PRICE_TOLERANCE, RID
from ..session import materialise
from .duplicates import each_mask, mask_of, masks_of_group, signature
from .scale import attach, in_ranges, running_totals

# Doubles around a computed limit that are tried to find the exact one.
TRIED = 16
LOW, POINT, HIGH = 0, 1, 2


def exact_limits(p, tolerance):
    """(lowest, highest) double that is close to the positive price ``p``: abs(p - q) <= tolerance * greatest(p, q).

    Both differences are exact near p, and whether they are small enough changes once along q; so a limit is the
    outermost of the doubles around a computed one that still fits.
    """
    def outermost(middle, fits, pick):
        last_place = F.pow(F.lit(2.0), F.floor(F.log2(middle)) - 53)
        near = F.transform(F.sequence(F.lit(-TRIED), F.lit(TRIED)), lambda k: middle + k * last_place)
        return F.coalesce(pick(F.filter(near, fits)), p)

    low = outermost(p - tolerance * p, lambda q: p - q <= tolerance * p, F.array_min)
    high = outermost(p / (1 - tolerance), lambda q: q - p <= tolerance * q, F.array_max)
    return F.least(low, p), F.greatest(high, p)


def sided_records(df, key, compared, price, rid):
    """Stored rows, one per record and mask of its key: its own signature group ``_own``, the group ``_other`` of its
    partners (the same one when the masks are equal: ``_same``), its price ``_p``, and its price ``_q`` if others can be close.

    A group is named by two independent 64-bit hashes of its key, masks and signature.
    """
    keyed = df.where(all_present(key)).withColumn("_mask", mask_of(compared))
    groups = (keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), masks_of_group(F.col("_mask")).alias("_masks"))
              .where("_n > 1"))
    sided = attach(keyed, groups, key, "_n").withColumn("_partner", each_mask(F.col("_masks"), compared))
    overlap = F.col("_mask").bitwiseAND(F.col("_partner"))
    signed = sided.select(rid, *key, "_mask", "_partner", *signature(sided, overlap, compared), F.col(price).cast("double").alias("_p"))
    shared = [*key, *[f"_s{i}" for i in range(len(compared))]]

    def named(mine, theirs):
        return F.struct(*[F.xxhash64(F.lit(i), *shared, mine, theirs).alias(f"h{i}") for i in (1, 2)])

    p = F.col("_p")
    return materialise(signed.select(
        F.col(rid).alias("_rid"), named("_mask", "_partner").alias("_own"), named("_partner", "_mask").alias("_other"),
        (F.col("_mask") == F.col("_partner")).alias("_same"), "_p",
        F.when((p >= 0) & (p < F.lit(float("inf"))), p + F.lit(0.0)).alias("_q")))


def priced_partners(points, tolerance):
    """(_own, _q, _priced): for each distinct price of a group, how many records of the other group are close to it."""
    low, high = exact_limits(F.col("_q"), tolerance)
    zero = F.col("_q") == 0
    bounds = {LOW: F.when(zero, F.lit(0.0)).otherwise(low), HIGH: F.when(zero, F.lit(0.0)).otherwise(high)}
    rows = [points.select(F.col("_own").alias("_group"), F.col("_q").alias("_at"), F.lit(POINT).alias("_kind"), "_n", "_own", "_q")]
    rows += [points.select(F.col("_other").alias("_group"), bound.alias("_at"), F.lit(kind).alias("_kind"),
                           F.lit(0).cast("bigint").alias("_n"), "_own", "_q") for kind, bound in bounds.items()]
    # limits of a price that equal a point lie before and after it, so both ends are counted
    totals = running_totals(reduce(lambda a, b: a.unionByName(b), rows), ["_group", "_at", "_kind"], ["_n"])
    return (totals.where(F.col("_kind") != POINT).groupBy("_own", "_q")
            .agg(F.sum(F.when(F.col("_kind") == HIGH, F.col("cum__n")).otherwise(-F.col("cum__n"))).alias("_priced")))


def nearest_partners(points, tolerance):
    """Edges (u, v) between the first records of prices: from every price to the nearest one of the partners' group on
    both sides, where it is close."""
    first = F.col("_own") < F.col("_other")
    pair = F.when(first, F.struct("_own", "_other")).otherwise(F.struct(F.col("_other").alias("_own"), F.col("_own").alias("_other")))
    # prices of a group that is its own partner stand on both sides
    side = F.when(F.col("_same"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(first, F.lit(0)).otherwise(F.lit(1))))
    order = ["_pair", "_q", "_side"]
    celled = in_ranges(points.select(pair.alias("_pair"), "_q", F.explode(side).alias("_side"), "_rep"), order)
    edges = []
    for turn, latest in ((F.asc, F.max), (F.desc, F.min)):
        inside = Window.partitionBy("_cell").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = Window.partitionBy(F.lit(0)).orderBy(turn("_cell")).rowsBetween(Window.unboundedPreceding, -1)

        def point(s):
            return F.when(F.col("_side") == s, F.struct("_pair", "_q", "_rep"))  # noqa: B023

        # what an earlier range ends with; a window over one row per range
        ends = celled.groupBy("_cell").agg(*[latest(point(s)).alias(f"_end{s}") for s in (0, 1)])
        before = ends.select("_cell", *[F.last(f"_end{s}", ignorenulls=True).over(earlier).alias(f"_before{s}") for s in (0, 1)])
        seen = celled.select("*", *[F.last(point(s), ignorenulls=True).over(inside).alias(f"_last{s}") for s in (0, 1)])
        other = [F.coalesce(f"_last{s}", f"_before{s}") for s in (0, 1)]
        met = seen.join(before, "_cell").withColumn("_o", F.when(F.col("_side") == 0, other[1]).otherwise(other[0]))
        close = F.abs(F.col("_q") - F.col("_o._q")) <= tolerance * F.greatest(F.col("_q"), F.col("_o._q"))
        edges.append(met.where((F.col("_o._pair") == F.col("_pair")) & close)
                     .select(F.col("_rep").alias("u"), F.col("_o._rep").alias("v")))
    return edges[0].unionByName(edges[1])


def components(edges):
    """(node, group): the smallest node that the edges (u, v) connect a node to.

    Edges are turned towards smaller neighbours in alternating rounds, of larger neighbours and of smaller ones, until
    only stars are left: a number of rounds that grows with the logarithm of the size. Neighbours of a node meet its
    smallest one through ``attach``, so a node may have any number of them.
    """
    def towards_least(pairs):
        least = pairs.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
        return attach(pairs, least, ["u"], "_n"), least

    def plain(pairs):
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges, known = materialise(plain(edges)), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == known:
            break
        known = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = towards_least(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v"))
        smaller, least = towards_least(materialise(plain(larger)))
        edges = materialise(plain(smaller.select(F.col("v").alias("u"), F.col("_m").alias("v"))
                                  .unionByName(least.select("u", F.col("_m").alias("v")))))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.toDF("node", "group").unionByName(roots.select("node", F.col("node").alias("group")))


def duplicate_links(df, key=LISTING_KEY, compared=COMPARED, price="price", tolerance=PRICE_TOLERANCE, rid=RID):
    """rid, n_links, group of every record that has a duplicate: how many it has, and the smallest record id that a chain
    of duplicates leads to. Duplicates are those of ``duplicates``; record ids are unique bigints."""
    sided = sided_records(df, key, compared, price, rid)
    sizes = sided.groupBy("_own").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_p").isNull()).alias("_unpriced"),
        F.min("_rid").alias("_one"), F.min(F.when(F.col("_p").isNull(), F.col("_rid"))).alias("_one_unpriced"))
    points = materialise(sided.where(F.col("_q").isNotNull()).groupBy("_own", "_other", "_same", "_q").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_rep")))
    priced = points.select("_own", "_q", "_n", "_rep").join(priced_partners(points, tolerance), ["_own", "_q"])
    beside = attach(sided, sizes.withColumnRenamed("_own", "_other"), ["_other"], "_all", how="left")
    whole = materialise(attach(beside.withColumn("_none", F.col("_q").isNull()), priced.withColumn("_none", F.lit(False)),
                               ["_own", "_q", "_none"], "_n", how="left"))
    itself = F.col("_same").cast("int")
    unpriced = F.col("_p").isNull()
    near = F.coalesce(F.col("_priced") - itself, F.lit(0))
    of_unpriced = F.coalesce(F.col("_unpriced"), F.lit(0)) - F.when(unpriced, itself).otherwise(0)
    links = F.when(unpriced, F.coalesce(F.col("_all"), F.lit(0)) - itself).otherwise(of_unpriced + near)
    counted = whole.select("*", links.alias("_links")).where("_links > 0")
    to = F.array_compact(F.array(F.when(near > 0, F.col("_rep")), F.when(of_unpriced > 0, F.col("_one_unpriced")),
                                 F.when(unpriced, F.col("_one"))))
    edges = counted.select(F.col("_rid").alias("u"), F.explode(to).alias("v"))
    groups = components(edges.unionByName(nearest_partners(points, tolerance)))
    totals = counted.groupBy("_rid").agg(F.sum("_links").alias("n_links"))
    return totals.join(groups.withColumnRenamed("node", "_rid"), "_rid").select(F.col("_rid").alias(rid), "n_links", "group")
