"""N-gram Jaccard join: bands of MinHash values propose pairs, their word shingles are compared exactly.

Documents with the same shingles form a class. Every class enters one bucket of each band. Bands have a fixed depth, the
greatest that reaches the target recall, where an LSH forest would let it follow the matches. Members of a bucket are
compared in one pass that reports counts and a spanning forest, so no list of pairs is ever written.
"""
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from ..session import materialise
from .shingles import mixed, shingle_set

WIDTH = 5
THRESHOLD = 0.8
TREES = 24
LONGEST_PREFIX = 12
RECALL = 0.9999
# Classes that one task compares with one another; a leaf that has more is split into blocks, block pair by block pair.
BLOCK = 4096
# Incidence columns and pairs handled at once inside a task.
COLUMNS, PAIRS = 2048, 500_000


def prefix_length(threshold=THRESHOLD, trees=TREES, recall=RECALL, longest=LONGEST_PREFIX):
    """The greatest depth of a band at which a pair at the threshold meets in some band with probability ``recall``."""
    length = longest
    while length > 1 and 1 - (1 - threshold ** length) ** trees < recall:
        length -= 1
    return length


def min_hashes(shingles, count):
    """Minima of ``count`` fixed permutations of the shingle hashes."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, count, dtype=np.uint64)
    low = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), COLUMNS):
        np.minimum(low, (np.multiply.outer(shingles[i:i + COLUMNS], a) + b).min(axis=0), out=low)
    return low


def prefix_keys(shingles, trees, length):
    """One key per band: of the band and its minima."""
    minima = min_hashes(shingles, trees * length).reshape(trees, length)
    key = np.arange(1, trees + 1, dtype=np.uint64)
    for j in range(length):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, j])
    return key.view(np.int64)


def _signed(width, trees, length):
    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf.pop("_text"):
                s = shingle_set(text, width)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), prefix_keys(s, trees, length)) if len(s) else (None, None))
            yield pdf.assign(_class=[r[0] for r in rows], _keys=[r[1] for r in rows])
    return run


def _packed(width):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(_set=[shingle_set(t, width).tobytes() for t in pdf.pop("_text")])
    return run


def common_counts(sets):
    """Matrix of the number of shingles that each two sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    owner, column = owner[shared], column[shared]
    total = np.zeros((m, m), dtype=np.float32)
    dense = df > max(64, m // 64)
    rare = ~dense[column]
    # shingles of few sets: pairs of neighbours in the list of each shingle's owners, distance by distance
    order = np.lexsort((owner[rare], column[rare]))
    o, c = owner[rare][order], column[rare][order]
    step = 1
    while step < len(c):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        pairs = np.bincount(o[same] * m + o[same + step], minlength=m * m) if len(same) > m * m // 8 else None
        if pairs is not None:
            total += pairs.reshape(m, m)
        else:
            np.add.at(total, (o[same], o[same + step]), 1)
        step += 1
    total += total.T
    # shingles of many sets: matrix products over blocks of columns
    place = np.cumsum(dense) - 1
    o, c = owner[~rare], place[column[~rare]]
    order = np.argsort(c, kind="stable")
    o, c = o[order], c[order]
    for k in range(0, int(dense.sum()), COLUMNS):
        i, j = np.searchsorted(c, (k, k + COLUMNS))
        block = np.zeros((m, COLUMNS), dtype=np.float32)
        block[o[i:j], c[i:j] - k] = 1
        total += block @ block.T
    return total


def compare(key, group, threshold, cross):
    """Links of one leaf, or of two blocks of it: for each class the documents linked to it and a root it is joined to.

    A pair counts in the first tree whose key both share, so it is counted once. ``cross``: only pairs of different blocks.
    """
    group = group[~group["_class"].duplicated()]
    if len(group) < 2 or (cross and group["_side"].nunique() < 2):
        return None
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["_set"]]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    side, n = group["_side"].to_numpy(), group["_n"].to_numpy()
    keys = np.stack(group["_keys"].to_numpy())
    m = len(sets)
    common = common_counts(sets)
    left, right = [], []
    for i in range(m - 1):
        near = common[i, i + 1:] >= threshold * (size[i] + size[i + 1:] - common[i, i + 1:]) - 1e-9
        if cross:
            near &= side[i + 1:] != side[i]
        j = np.flatnonzero(near) + i + 1
        left.append(np.full(len(j), i, dtype=np.int32))
        right.append(j.astype(np.int32))
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return None
    links = np.zeros(m, dtype=np.int64)
    for i in range(0, len(a), PAIRS):
        x, y = a[i:i + PAIRS], b[i:i + PAIRS]
        first = (keys[x] == keys[y]).argmax(axis=1)
        here = keys[x, first] == key
        np.add.at(links, x[here], n[y[here]])
        np.add.at(links, y[here], n[x[here]])
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    linked = np.unique(np.concatenate([a, b]))
    classes = group["_class"].to_numpy()
    return pd.DataFrame({"_class": classes[linked], "_links": links[linked], "_root": classes[root[linked]]})


def _compared(threshold):
    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            marks = pdf[["_key", "_i", "_j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                found = compare(marks[s, 0], pdf.iloc[s:e], threshold, marks[s, 1] != marks[s, 2])
                if found is not None:
                    yield found
            held = pdf.iloc[starts[-1]:]
        if held is not None and len(held):
            k, i, j = held[["_key", "_i", "_j"]].iloc[0]
            found = compare(k, held, threshold, i != j)
            if found is not None:
                yield found
    return run


def components(edges):
    """The smallest class of each connected component as ``_top`` beside every class of ``edges`` (_class, _root).

    Labels of neighbours are taken over and then followed one step further, until none changes. Every round is written.
    """
    both = materialise(edges.where("_class <> _root").distinct()
                       .select(F.explode(F.array(F.struct(F.col("_class").alias("_a"), F.col("_root").alias("_b")),
                                                 F.struct(F.col("_root").alias("_a"), F.col("_class").alias("_b")))).alias("_e"))
                       .select("_e.*").distinct())
    labels = materialise(both.groupBy(F.col("_a").alias("_class")).agg(F.min("_b").alias("_b"))
                         .select("_class", F.least("_class", "_b").alias("_top")))
    while True:
        near = (both.join(labels.withColumnRenamed("_class", "_b"), "_b").groupBy(F.col("_a").alias("_class"))
                .agg(F.min("_top").alias("_near")))
        lower = labels.join(near, "_class").select("_class", F.least("_top", "_near").alias("_mid"), F.col("_top").alias("_old"))
        onward = labels.select(F.col("_class").alias("_mid"), F.col("_top").alias("_far"))
        moved = materialise(lower.join(onward, "_mid", "left")
                            .select("_class", F.least("_mid", "_far").alias("_top"), "_old"))
        if not moved.where("_top <> _old").take(1):
            return moved.select("_class", "_top")
        labels = moved.select("_class", "_top")


def similar_documents(docs, id_col="doc_id", text="text", width=WIDTH, threshold=THRESHOLD, trees=TREES, recall=RECALL):
    """One row per input row: ``id_col``, ``_hash`` (of the text), ``class_id``, ``copy_of``, ``n_links``, ``_best``.

    Two documents are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``threshold``. ``n_links`` counts the documents linked to a row, copies included. ``copy_of`` is the smallest id
    with the same shingles, ``class_id`` the smallest id in the group that links reach, ``_best`` the (id, hash) of the
    one row of the group that deduplication keeps. Texts of fewer words are one shingle; a missing text or one without
    words is linked to nothing and is its own class. Repeated rows are documents of their own, linked to each other.
    An empty table gives an empty result.
    """
    length = prefix_length(threshold, trees, recall)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = materialise(source.mapInPandas(_signed(width, trees, length), f"_id {kind}, _hash long, _class binary, _keys array<long>"))
    classes = materialise(signed.where("_class is not null").groupBy("_class")
                          .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_hash")).alias("_rep"), F.first("_keys").alias("_keys")))
    leaves = classes.select("_class", F.explode("_keys").alias("_key"))
    full = leaves.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    live = materialise(leaves.join(full, "_key").groupBy("_class")
                       .agg(F.collect_list(F.struct("_key", "_size")).alias("_leaves")))
    reps = live.join(classes, "_class").select("_class", "_n", "_keys", "_leaves", F.col("_rep._id").alias("_rid"), F.col("_rep._hash").alias("_rhash"))
    packed = (source.join(materialise(reps), F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_hash") == F.col("_rhash")))
              .select("_class", "_n", "_keys", "_leaves", "_text")
              .mapInPandas(_packed(width), "_class binary, _n long, _keys array<long>, _leaves array<struct<_key:long,_size:long>>, _set binary"))
    blocks = F.ceil(F.col("_leaf._size") / F.lit(BLOCK)).cast("int")
    rows = (packed.select("_class", "_n", "_keys", "_set", F.explode("_leaves").alias("_leaf"))
            .withColumn("_side", F.pmod(F.xxhash64("_class"), blocks).cast("int"))
            .select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
            .select(F.col("_leaf._key").alias("_key"), F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"),
                    "_side", "_class", "_n", "_keys", "_set"))
    links = materialise(rows.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")
                        .mapInPandas(_compared(threshold), "_class binary, _links long, _root binary"))
    tops = components(links.select("_class", "_root"))
    counts = links.groupBy("_class").agg(F.sum("_links").alias("_links"))
    linked = counts.join(tops, "_class")
    grouped = classes.select("_class", "_n", "_rep").join(linked, "_class", "left").where("_n > 1 or _links > 0")
    best = grouped.groupBy(F.coalesce("_top", "_class").alias("_top")).agg(F.min("_rep").alias("_best"))
    info = materialise(grouped.withColumn("_top", F.coalesce("_top", "_class")).join(best, "_top")
                       .select("_class", "_rep", "_best", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links")))
    own = F.struct("_id", "_hash")
    return (signed.select("_id", "_hash", "_class").join(info, "_class", "left")
            .select(F.col("_id").alias(id_col), "_hash", F.coalesce(F.col("_best._id"), F.col("_id")).alias("class_id"),
                    F.coalesce(F.col("_rep._id"), F.col("_id")).alias("copy_of"),
                    F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("_best", own).alias("_best")))


def keep_one_of_each(docs, id_col="doc_id", text="text", **options):
    """``docs`` without all but one document of each group of linked ones: the one with the smallest id stays.

    Columns stay as they are. Of repeated rows one stays.
    """
    found = similar_documents(docs, id_col, text, **options)
    grouped = materialise(found.where("n_links > 0")
                          .select(F.col(id_col).alias("_gid"), F.col("_hash").alias("_ghash"), "_best"))
    best = F.col("_best._id").eqNullSafe(F.col("_gid")) & (F.col("_best._hash") == F.col("_ghash"))
    gone = grouped.where(~best).select("_gid", "_ghash").distinct()
    repeated = grouped.where(best).groupBy("_gid", "_ghash").count().where("count > 1").select("_gid", "_ghash")
    same = F.col(id_col).eqNullSafe(F.col("_gid")) & (F.xxhash64(text) == F.col("_ghash"))
    once = docs.join(materialise(repeated), same, "left_semi").dropDuplicates([id_col, text])
    rest = materialise(gone.union(repeated))
    return docs.join(rest, same, "left_anti").unionByName(once)
