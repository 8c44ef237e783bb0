"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Nodes are visited by falling upper bound of the inner product, and a query leaves a shard once the bound falls below
the k-th score it already knows. A first look at a bounded part of the rows gives every query a score that its k-th
best cannot be below; all shards start from it.
"""
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise, stored_rows

K = 5
# Vectors of one shard (a ball tree in one task) and queries of one block, which meet block by block.
SHARD, BLOCK = 8192, 1024
# Rows of the first look, whose k-th scores all shards share. The answer does not depend on it.
FIRST_LOOK = 4096
LEAF = 256


class BallTree:
    """Nodes in arrays: centre, radius, smallest id, and the two children of a node or the place of a leaf's rows.

    A node is split at the median along the direction between two far ends of it.
    """

    def __init__(self, x, ids):
        placed, leaves = 0, []
        centres, self.radius, self.smallest, self.below = [], [], [], []
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if parent is not None:
                self.below[parent][side] = len(centres)
            part = x[rows]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            centres.append(centre)
            self.radius.append(np.sqrt(away.max()))
            self.smallest.append(int(ids[rows].min()))
            if len(rows) <= LEAF:
                self.below.append(slice(placed, placed + len(rows)))
                leaves.append(rows)
                placed += len(rows)
                continue
            far = part[away.argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            order = rows[np.argsort(part @ (far - other), kind="stable")]
            self.below.append([0, 0])
            half = len(order) // 2
            todo += [(order[:half], len(centres) - 1, 0), (order[half:], len(centres) - 1, 1)]
        self.centres, self.radius = np.stack(centres), np.array(self.radius)
        # leaf by leaf, so that the rows of a leaf lie together
        order = np.concatenate(leaves)
        self.x, self.ids = np.ascontiguousarray(x[order]), ids[order]

    def search(self, query, own, k, floor):
        """The best ``k`` rows for one query as (score, -id), at least ``floor``; rows with id ``own`` are left out.

        Nodes wait in the order of their upper bounds; scores are whole numbers, so a bound is cut to one after a margin
        for rounding. At equal bounds the node with the smallest id comes first.
        """
        length = np.sqrt(query @ query)
        bounds = self.centres @ query + length * self.radius
        bounds = np.floor(bounds + 1e-6 * (1 + length * (self.radius + 1))).tolist()
        best = []
        queue = [(-bounds[0], self.smallest[0], 0)]
        while queue:
            top, smallest, node = heapq.heappop(queue)
            if -top < floor:
                break
            if len(best) == k and (-top, -smallest) < best[0]:
                continue
            below = self.below[node]
            if isinstance(below, list):
                for child in below:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], self.smallest[child], child))
                continue
            scores = self.x[below] @ query
            for i in np.flatnonzero(scores >= floor):
                found = (int(scores[i]), -int(self.ids[below.start + i]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def _searched(k):
    def run(key, rows, queries):
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if rows.empty or queries.empty:
            return none
        x, ids = np.stack(rows["_v"].to_numpy()).astype(np.float64), rows["_id"].to_numpy()
        tree = BallTree(x, ids)
        found = [(q, -b[1], b[0]) for q, v, low in zip(queries["_id"], queries["_v"], queries["_floor"], strict=True)
                 for b in tree.search(np.asarray(v, dtype=np.float64), q, k, low)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64") if found else none
    return run


def best_of(found, k):
    """The ``k`` best of every query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_vectors(vectors, id_col, vec_col):
    """Vectors as whole numbers floor(256 * x); those that are missing or hold a missing or non-finite part are left out."""
    part = F.transform(vec_col, lambda x: x.cast("double"))
    sound = F.col(vec_col).isNotNull() & F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & sound)
            .select(F.col(id_col).cast("bigint").alias("_id"), F.transform(part, lambda x: F.floor(x * 256).cast("double")).alias("_v"))
            .withColumn("_dim", F.size("_v")))


def blocks_of(rows, name, size, count):
    """Spreads ``count`` rows over blocks of about ``size`` by the hash of their id."""
    return rows.withColumn(name, F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-count // size)))).cast("int"))


def meet(rows, queries, shards, query_blocks, k):
    """Every query block searches every shard: both sides are copied by block number and meet in one task per pair."""
    left = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["_dim", "_shard", "_block"]
    return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInPandas(_searched(k), "query_id long, vec_id long, score long"))


def top_k(vectors, queries, k=K, id_col="vec_id", vec_col="embedding"):
    """For every row of ``queries`` its ``k`` rows of ``vectors`` with the highest inner product, exactly.

    Components are floor(256 * x). Columns: query_id, rank (from 1), vec_id, score. Rows with the id of the query are
    its own and no candidates; ties go to the smaller id; fewer candidates give fewer rows. Missing ids, and vectors
    that are missing or hold a missing or non-finite component, take no part. Vectors of different length never meet.
    Rows equal in id and vector count once; rows that share an id but not the vector are candidates each, and as queries
    share one ranking. Whole numbers below 2**53 are exact in every sum, so
    components may reach 2**23 at 64 parts. Rows are spread by id: a vector that many rows share fills no single shard.
    """
    rows = materialise(whole_vectors(vectors, id_col, vec_col).dropDuplicates(["_id", "_v"]))
    asked = materialise(whole_vectors(queries, id_col, vec_col).dropDuplicates(["_id", "_v"]))
    n, q = stored_rows(rows), stored_rows(asked)
    query_blocks = max(1, -(-q // BLOCK))
    asked = blocks_of(asked, "_block", BLOCK, q)
    # the first look: a hash cutoff, so about FIRST_LOOK rows whatever the size of the table
    share = min(1.0, FIRST_LOOK / max(n, 1))
    part = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    first = meet(rows.where(part).withColumn("_shard", F.lit(0)), asked.withColumn("_floor", F.lit(-2.0**62)), 1, query_blocks, k)
    floors = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("_low"))
    asked = materialise(asked.join(floors.withColumnRenamed("query_id", "_id"), "_id", "left")
                        .select("_id", "_v", "_dim", "_block", F.coalesce(F.col("_low").cast("double"), F.lit(-2.0**62)).alias("_floor")))
    shards = max(1, -(-n // SHARD))
    found = meet(blocks_of(rows, "_shard", SHARD, n), asked, shards, query_blocks, k)
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
