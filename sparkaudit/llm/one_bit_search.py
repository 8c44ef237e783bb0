"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is kept as the signs of its rotated, normalised distance from the centre of its cell, packed into bits, and two
correction scalars. A query estimates its inner product with every code of a cell from the bits; an error bound around
the estimate says which vectors can be among the nearest, and only those are measured in full.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise, stored_rows

K = 10
# Bits of a code per component, and how many standard errors of the estimate the bound allows.
BITS, SURE = 4, 2.5
# Vectors of a cell, and cells; cells are fitted on about SAMPLE rows, whatever the size of the table.
CELL, MOST_CELLS, SAMPLE, FIT_ROUNDS = 4096, 4096, 16384, 6
# Vectors that one task holds, queries of one stream of a task, queries compared at once.
PART, STREAM, BATCH = 4096, 262_144, 128
FAR = float("inf")


def rotation(dim):
    """A fixed random matrix of orthonormal rows: it turns a vector and spreads it over ``BITS`` times its components."""
    wide = -(-BITS * dim // 8) * 8
    q, _ = np.linalg.qr(np.random.default_rng(dim).normal(size=(wide, dim)))
    return q.T.astype(np.float32)


def fit_cells(x, count):
    """Centres of ``count`` cells over the sample ``x``, by a few rounds of k-means from its first rows."""
    centres = x[:count].copy()
    for _ in range(FIT_ROUNDS if count > 1 else 1):
        near = closest(x, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def closest(x, centres):
    """The number of the nearest centre for every row."""
    half = (centres ** 2).sum(axis=1) / 2
    return np.concatenate([(half - x[i:i + 2048] @ centres.T).argmin(axis=1) for i in range(0, len(x), 2048)])


class Code:
    """One-bit codes about one centre."""

    def __init__(self, centre, turn):
        self.centre, self.turn = centre, turn

    def encode(self, x):
        """(packed signs, distance from the centre, inner product of the code with the direction it stands for)."""
        away = x - self.centre
        length = np.sqrt((away ** 2).sum(axis=1))
        turned = (away / np.where(length > 0, length, 1)[:, None]).astype(np.float32) @ self.turn
        fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)

    def bounds(self, signs, length, fit, q):
        """(lower, upper) bounds of the squared distance of every code (rows) and every query (columns)."""
        away = q - self.centre
        far = np.sqrt((away ** 2).sum(axis=1))
        turned = (away / np.where(far > 0, far, 1)[:, None]).astype(np.float32) @ self.turn
        wide = turned.shape[1]
        near = (signs @ turned.T) / (np.sqrt(wide) * fit)[:, None]
        error = SURE * np.sqrt(np.maximum(1 - fit ** 2, 0) / max(wide - 1, 1)) / fit + 1e-5
        scale = 2 * length[:, None] * far[None, :]
        middle = length[:, None] ** 2 + far[None, :] ** 2 - scale * near
        return middle - scale * error[:, None], middle + scale * error[:, None]


def sound_vectors(vectors, id_col, vec_col):
    """Distinct (id, vector) rows; vectors that are missing, all zero or hold a missing or non-finite part are left out."""
    part = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(FAR)))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & F.exists(part, lambda x: x != 0)
    return (vectors.where(sound).select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).alias("_v"))
            .groupBy("_id", "_v").agg(F.lit(0).alias("_zero")).select("_id", "_v"))


def vector_classes(rows, k):
    """One row per distinct vector with the ``k`` + 1 smallest of its ids: the others can be no query's nearest."""
    order = Window.partitionBy("_v").orderBy("_id")
    first = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    return first.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))


def matrix_of(column):
    return np.stack(column.to_numpy()).astype(np.float64)


class Cells:
    """Fitted cells of every vector length: {length: centres}. A length that the sample missed has one cell about zero."""

    def __init__(self, centres):
        self.centres, self.turns = centres, {}

    def of(self, dim):
        if dim not in self.turns:
            self.turns[dim] = rotation(dim)
        return self.centres.get(dim, np.zeros((1, dim))), self.turns[dim]

    def code(self, dim, cell):
        centres, turn = self.of(dim)
        return Code(centres[cell], turn)


def split_by_length(frame):
    """(length, rows) of a frame of vectors, rows of one length each."""
    dims = frame["_v"].map(len)
    return [(int(d), frame[dims == d]) for d in dims.unique()]


def indexed(classes, cells):
    """Every vector class with its length, cell, code and scalars."""
    def run(frames):
        for frame in frames:
            for dim, part in split_by_length(frame):
                x, (centres, turn) = matrix_of(part["_v"]), cells.of(dim)
                near = closest(x, centres)
                for cell in np.unique(near):
                    rows = np.flatnonzero(near == cell)
                    bits, length, fit = Code(centres[cell], turn).encode(x[rows])
                    yield part.iloc[rows].assign(_dim=dim, _cell=int(cell), _bits=[b.tobytes() for b in bits],
                                                 _length=length, _fit=fit)
    kind = classes.schema["_v"].dataType.simpleString()
    return classes.mapInPandas(run, f"_v {kind}, _ids array<bigint>, _dim int, _cell int, _bits binary, _length double, _fit double")


def routed(asked, cells, reach, home):
    """A row per query and cell to search. ``home``: the cell it lies in. Otherwise all others that its best distance
    ``_best`` so far reaches, by the distance from the centre less the cell's radius ``reach``."""
    def run(frames):
        for frame in frames:
            for dim, part in split_by_length(frame):
                x, (centres, _) = matrix_of(part["_v"]), cells.of(dim)
                near = closest(x, centres)
                for cell in range(len(centres)):
                    if home:
                        hit = near == cell
                    else:
                        away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
                        best = part["_best"].to_numpy()
                        hit = (near != cell) & (away - reach.get((dim, cell), -FAR) <= best * (1 + 1e-9) + 1e-9)
                    if hit.any():
                        yield part[hit].assign(_dim=dim, _cell=cell)
    kind = asked.schema["_v"].dataType.simpleString()
    return asked.mapInPandas(run, f"_id bigint, _v {kind}, _best double, _dim int, _cell int")


class Part:
    """The codes and vectors of one part of a cell, ready for queries."""

    def __init__(self, code, rows):
        self.code = code
        bits = np.frombuffer(b"".join(rows["_bits"]), dtype=np.uint8).reshape(len(rows), -1)
        self.signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
        self.length, self.fit = rows["_length"].to_numpy(), rows["_fit"].to_numpy()
        self.x, self.ids = matrix_of(rows["_v"]), rows["_ids"].to_numpy()

    def search(self, ids, q, best, k):
        """(query, row id, distance) of at most ``k`` rows a query; none beyond ``best``."""
        low, high = self.code.bounds(self.signs, self.length, self.fit, q)
        if len(high) > k + 1:
            limit = np.partition(high, k + 1, axis=0)[k + 1]
            best = np.minimum(best ** 2, limit)
        else:
            best = best ** 2
        for j, own in enumerate(ids):
            rows = np.flatnonzero(low[:, j] <= best[j] * (1 + 1e-9) + 1e-9)
            away = np.sqrt(((self.x[rows] - q[j]) ** 2).sum(axis=1))
            if len(rows) > k + 1:
                near = away <= np.partition(away, k)[k]
                rows, away = rows[near], away[near]
            found = sorted((d, int(i)) for r, d in zip(rows, away, strict=True) for i in self.ids[r] if i != own)
            yield from ((own, i, d) for d, i in found[:k])


def searched(index, asked, cells, parts, k):
    """Rows (query_id, vec_id, score): what every routed query finds in the parts of its cell.

    Codes and queries of a part of a cell come to one task, codes first; queries pass by in small batches.
    """
    streams = max(1, -(-stored_rows(asked) // STREAM))
    sizes = F.broadcast(parts)      # a row per cell
    key = ["_dim", "_cell", "_part", "_stream"]
    rows = (index.join(sizes, ["_dim", "_cell"])
            .withColumn("_part", F.pmod(F.xxhash64("_v"), F.col("_parts")).cast("int"))
            .withColumn("_stream", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))))
            .select(*key, F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_id"), "_v", "_ids", "_bits", "_length",
                    "_fit", F.lit(None).cast("double").alias("_best")))
    queries = (asked.join(sizes, ["_dim", "_cell"])
               .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1)))
               .withColumn("_stream", F.pmod(F.xxhash64("_id"), F.lit(streams)).cast("int"))
               .select(*key, F.lit(1).alias("_kind"), "_id", "_v", F.lit(None).cast("array<bigint>").alias("_ids"),
                       F.lit(None).cast("binary").alias("_bits"), F.lit(None).cast("double").alias("_length"),
                       F.lit(None).cast("double").alias("_fit"), "_best"))

    def run(frames):
        at, waiting, part = None, [], None
        for frame in frames:
            for where, some in frame.groupby([*key, "_kind"], sort=False):
                if where[:4] != at:
                    at, waiting, part = where[:4], [], None
                if where[4] == 0:
                    waiting.append(some)
                elif waiting or part:
                    if part is None:
                        part, waiting = Part(cells.code(at[0], at[1]), pd.concat(waiting)), []
                    for i in range(0, len(some), BATCH):
                        few = some.iloc[i:i + BATCH]
                        found = list(part.search(few["_id"].tolist(), matrix_of(few["_v"]), few["_best"].to_numpy(), k))
                        if found:
                            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = rows.unionByName(queries).repartition(*key).sortWithinPartitions(*key, "_kind")
    return met.mapInPandas(run, "query_id bigint, vec_id bigint, score double")


def best_of(found, k):
    """The ``k`` nearest of every query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors, queries, k=K, id_col="vec_id", vec_col="embedding"):
    """For every row of ``queries`` its ``k`` rows of ``vectors`` at the smallest Euclidean distance, nearly always.

    Columns: query_id, rank (from 1), vec_id, score (the distance, from the original vectors in double precision). Rows
    with the id of the query are its own and no candidates; ties go to the smaller id; fewer candidates give fewer rows.
    Missing ids, and vectors that are missing, all zero, or hold a missing or non-finite component, take no part.
    Vectors of different length never meet. Rows equal in id and vector count once; rows that share an id but not the
    vector are candidates each, and as queries share one ranking. Other columns are not looked at.

    Every vector is indexed. The cells only say where a code lies: a query first searches its own cell, then every cell
    that its best distance so far reaches, so nothing is lost to a number of probes. What may be lost is a vector whose
    estimate is off by more than ``SURE`` standard errors. On vectors without structure all cells are reached, and the
    codes of all are compared.
    """
    rows = materialise(vector_classes(sound_vectors(vectors, id_col, vec_col), k))
    asked = sound_vectors(queries, id_col, vec_col).withColumn("_best", F.lit(FAR))
    n = stored_rows(rows)
    cells = Cells(fitted(rows, n))
    index = materialise(indexed(rows, cells))
    found_cells = index.groupBy("_dim", "_cell").agg(F.max("_length").alias("reach"), F.count(F.lit(1)).alias("n")).collect()
    reach = {(c["_dim"], c["_cell"]): c["reach"] for c in found_cells}
    parts = index.sparkSession.createDataFrame([(c["_dim"], c["_cell"], -(-c["n"] // PART)) for c in found_cells],
                                               "_dim int, _cell int, _parts bigint")
    home = materialise(routed(asked, cells, reach, True))
    first = materialise(best_of(searched(index, home, cells, parts, k), k))
    best = first.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_known"))
    # a query id with several vectors has one ranking but no one distance that holds for all of them
    single = home.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_id")
    asked = (home.select("_id", "_v").join(best.join(single, "_id"), "_id", "left")
             .select("_id", "_v", F.coalesce("_known", F.lit(FAR)).alias("_best")))
    others = materialise(routed(asked, cells, reach, False))
    found = first.select("query_id", "vec_id", "score").unionByName(searched(index, others, cells, parts, k))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")


def fitted(rows, n):
    """{vector length: cell centres}, fitted on about ``SAMPLE`` distinct vectors chosen by hash."""
    cutoff = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)) + 1
    sample = rows.where(F.pmod(F.xxhash64("_v", F.lit(7)), F.lit(1 << 30)) < cutoff)
    # about SAMPLE rows reach the driver, whatever the size of the table
    taken = sample.select("_v", F.xxhash64("_v").alias("_h")).orderBy("_h").toPandas()
    out = {}
    for dim, part in split_by_length(taken):
        share = len(part) / len(taken)
        out[dim] = fit_cells(matrix_of(part["_v"]), int(min(MOST_CELLS, len(part), max(1, -(-n * share // CELL)))))
    return out
