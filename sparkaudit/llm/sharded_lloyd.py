"""Centroid clustering by Lloyd's rounds, sharded by dimension, in whole numbers.

Vectors are cut into column blocks. A task of a block knows the slice of the centroids that belongs to it and computes
exact partial distances; partial distances of a vector are added by key and the nearest centroid is taken; each block
then updates its own slice from the vectors it holds.
"""
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.scale import beside
from ..session import materialise

DIMS, CLUSTERS, ROUNDS = 64, 40, 5
# Components of a column block, and vectors of a chunk, which travel together.
WIDTH, CHUNK = 32, 1024
# Components stay below this, so that a squared distance of 64 parts fits a long.
LARGEST = 1 << 27
SCALE = 256


def whole_vectors(vectors, id_col, vec_col, dims):
    """(_id, _v): sound vectors of ``dims`` components as whole numbers floor(256 * x)."""
    part = F.transform(vec_col, lambda x: x.cast("double"))
    fits = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST / SCALE))))
    return (vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dims) & fits)
            .select(F.col(id_col).cast("string").alias("_id"), F.transform(part, lambda x: F.floor(x * SCALE).cast("int")).alias("_v")))


def first_centroids(rows, k, salt):
    """The ``k`` vectors whose salted ids have the smallest hashes, as a matrix; rows without id come last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id")), 256)
    first = rows.select(key.alias("_key"), "_v").orderBy(F.asc_nulls_last("_key"), "_v").limit(k).collect()
    return np.array([r["_v"] for r in first], dtype=np.int64)


def column_blocks(rows, dims):
    """Rows (chunk, block, ids, x): up to ``CHUNK`` vectors and ``WIDTH`` of their columns; ids go with block 0."""
    def run(frames):
        from pyspark import TaskContext
        task, made = TaskContext.get().partitionId(), 0
        for frame in frames:
            x = np.stack(frame["_v"].to_numpy()).astype(np.int32)
            for start in range(0, len(frame), CHUNK):
                here = x[start:start + CHUNK]
                chunk = (task << 32) + made
                made += 1
                blocks = range(0, dims, WIDTH)
                yield pd.DataFrame({
                    "chunk": chunk, "block": range(len(blocks)), "n": len(here),
                    "ids": [frame["_id"].iloc[start:start + CHUNK].tolist() if b == 0 else None for b in blocks],
                    "x": [np.ascontiguousarray(here[:, b:b + WIDTH]).tobytes() for b in blocks]})
    # a task holds a range of chunks of one block, so it needs only that block's slice of the centroids
    return (rows.mapInPandas(run, "chunk bigint, block int, n int, ids array<string>, x binary")
            .repartitionByRange("block", "chunk"))


def block_of(row):
    return np.frombuffer(row["x"], dtype=np.int32).reshape(row["n"], -1).astype(np.int64)


def product(a, b):
    """The exact matrix product of whole numbers; by floating point where no sum can reach 2**53."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def partial_distances(slices):
    """A function of block rows: (chunk, squared distances of its vectors to every centroid, within the block)."""
    def run(rows):
        for row in rows:
            x, c = block_of(row), slices[row["block"]]
            # whole numbers below 2**63: the expanded square is exact
            away = (x ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1)[None, :] - 2 * product(x, c.T)
            # half the shuffle where the sum over all blocks fits 32 bits
            yield row["chunk"], away.astype(np.int32) if int(away.max()) * len(slices) < 1 << 31 else away
    return run


def assign(blocks, slices):
    """Stored rows (chunk, label, distance): the nearest centroid of every vector of a chunk, by adding its blocks."""
    def nearest(total):
        label = total.argmin(axis=1)        # the first of equals, so the smaller number
        return label.tolist(), total[np.arange(len(label)), label].tolist()

    parts = blocks.select("chunk", "block", "n", "x").rdd.mapPartitions(partial_distances(slices))
    found = parts.reduceByKey(np.add).map(lambda kv: (kv[0], *nearest(kv[1])))
    return materialise(blocks.sparkSession.createDataFrame(found, "chunk bigint, label array<int>, distance array<bigint>", verifySchema=False))


def updated(blocks, labels, slices):
    """The slices after their blocks have moved them: {block: slice}. A centroid without vectors stays."""
    k = len(slices[0])

    def sums(frames):
        held = {}
        for frame in frames:
            for row in frame.to_dict("records"):
                x, label = block_of(row), np.asarray(row["label"])
                total, count = held.setdefault(row["block"], (np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)))
                total += product((label == np.arange(k)[:, None]).astype(np.int64), x)
                count += np.bincount(label, minlength=k)
        if held:
            yield pd.DataFrame({"block": list(held), "total": [t.tobytes() for t, _ in held.values()],
                                "count": [c.tobytes() for _, c in held.values()]})

    def move(key, frame):
        block = int(key[0])
        total = sum(np.frombuffer(t, np.int64) for t in frame["total"]).reshape(k, -1)
        count = sum(np.frombuffer(c, np.int64) for c in frame["count"])[:, None]
        new = np.where(count > 0, total // np.maximum(count, 1), slices[block])
        return pd.DataFrame({"block": [block], "slice": [new.tobytes()]})

    met = blocks.select("chunk", "block", "n", "x").join(labels.select("chunk", "label"), "chunk")
    moved = (met.mapInPandas(sums, "block int, total binary, count binary")
             .groupBy("block").applyInPandas(move, "block int, slice binary"))
    # one row per column block, of as many numbers as the centroids have there
    return {r["block"]: np.frombuffer(r["slice"], np.int64).reshape(k, -1) for r in moved.collect()}


def cluster(vectors, k=CLUSTERS, rounds=ROUNDS, id_col="vec_id", vec_col="embedding", dims=DIMS, salt="2"):
    """Lloyd's clustering of the vectors of ``dims`` components: vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256 per vector, and ``centroid`` (its components).

    Components are whole numbers floor(256 * x), and all arithmetic is exact. Centroids 0, 1, ... start as the ``k``
    vectors whose salted ids have the smallest sha256 (equal ids: the smaller vector; missing ids last). Ties go to the
    smaller number; a centroid without vectors stays. Missing vectors, those of another length, and those with a missing,
    non-finite or, at |x| >= 2**19, immeasurable component (its square fits no long) take no part. Repeated rows count
    each. Fewer vectors than ``k`` give fewer centroids, none an empty table. Other columns are not looked at.

    Chunks are cut inside the tasks that read them, so an id or vector that many rows share gathers nowhere. The
    partial distances cross the shuffle once a round: 8 * k bytes per vector and block.
    """
    rows = whole_vectors(vectors, id_col, vec_col, dims)
    blocks = materialise(column_blocks(rows, dims))
    start = first_centroids(rows, k, salt)
    slices = {b: start[:, i:i + WIDTH] for b, i in enumerate(range(0, dims, WIDTH))} if len(start) else {}
    labels = None
    for turn in range(rounds + 1 if slices else 0):
        if turn:
            slices = updated(blocks, labels, slices)
        labels = assign(blocks, slices)
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    if labels is None:
        labels = spark.createDataFrame([], "chunk bigint, label array<int>, distance array<bigint>")
    centroids = np.hstack([slices[b] for b in sorted(slices)]).tolist() if slices else []
    described = spark.createDataFrame(
        [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), x) for c, x in enumerate(centroids)],
        "cluster int, centroid_sha256 string, centroid array<bigint>")
    zipped = F.inline(F.arrays_zip("ids", "label", "distance"))
    found = (blocks.where("block = 0").select("chunk", "ids").join(labels, "chunk").select(zipped)
             .toDF("vec_id", "cluster", "distance").select(F.col("vec_id").cast(kind), "cluster", "distance"))
    # totals come from the labels alone; one row per cluster
    per_cluster = labels.select(F.inline(F.arrays_zip("label", "distance"))).toDF("cluster", "distance") \
        .groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    about = beside(described.join(per_cluster, "cluster"), total)
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
