"""Nearest neighbours by low-dimensional stable projections, a kd-tree, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import materialize

#: Dimensions of the projection; probability of the stopping test; rows that a block holds; rows the
#: tree's cuts are taken from; candidates verified at a time; leaves that a query visits first. The test
#: stops before a given neighbour with probability 1 - CERTAINTY at most. That is a sixteenth of what
#: passes at 0.99 in 8 dimensions for clustered vectors, and 40 % of it for vectors without structure.
PROJECTED, CERTAINTY, BLOCK_ROWS, TREE_SAMPLE, STEP, FIRST_LEAVES = 16, 0.88, 1024, 16_384, 64, 3
QUERY_BLOCK = 4096


def chi_square_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    lo, hi = 0.0, 50.0 * dof
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return (lo + hi) / 2


def projection(dim: int) -> np.ndarray:
    """Gaussian (2-stable) directions: squared projected distances of two vectors are their squared
    distance times a chi-square variable with PROJECTED degrees of freedom."""
    return np.random.default_rng(dim).standard_normal((dim, PROJECTED))


class KdTree:
    """Cuts of the projected space into leaves; each leaf is a box."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int] | None] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.leaf: dict[int, int] = {}
        self._split(sample, max(1, leaves), np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf))

    def _split(self, points: np.ndarray, leaves: int, lo: np.ndarray, hi: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) > 1 else 0
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        left = points[:, axis] < cut
        if leaves < 2 or not left.any() or left.all():
            self.leaf[me] = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            return me
        upper, lower = hi.copy(), lo.copy()
        upper[axis] = lower[axis] = cut
        a = self._split(points[left], leaves // 2, lo, upper)
        b = self._split(points[~left], leaves - leaves // 2, lower, hi)
        self.nodes[me] = (axis, cut, a, b)
        return me

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if (cut := self.nodes[node]) is None:
                out[rows] = self.leaf[node]
            else:
                left = points[rows, cut[0]] < cut[1]
                todo += [(cut[2], rows[left]), (cut[3], rows[~left])]
        return out

    def box_distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        lo, hi = np.array(self.lo), np.array(self.hi)
        return (np.maximum(0, np.maximum(lo - point, point - hi)) ** 2).sum(axis=1)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _nearest(k: int):
    """For a block of candidates and its queries: the k best of each query by the stopping rule, and (on the
    first of them, for measuring) how many candidates were verified."""
    limit = chi_square_quantile(CERTAINTY, PROJECTED)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        if rows.num_rows and asked.num_rows:
            ids, x = rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
            norms, flat = np.sqrt((x * x).sum(axis=1)), projection(x.shape[1])
            p, q = _unit(x) @ flat, _matrix(asked["embedding"])
            bounds = asked["bound"].to_numpy()
            for i, (query, at) in enumerate(zip(asked["query_id"].to_numpy(), _unit(q) @ flat, strict=True)):
                far, norm = ((p - at) ** 2).sum(axis=1), math.sqrt(float((q[i] * q[i]).sum()))
                order = np.flatnonzero((far <= limit * bounds[i] + 1e-9) & (ids != query))
                order = order[np.argsort(far[order], kind="stable")]
                best, score, begin = np.zeros(0, np.int64), np.zeros(0), 0
                while begin < len(order):
                    # Distances of unit vectors follow from cosines: d^2 = 2 - 2 cos.
                    if len(best) == k and far[order[begin]] > limit * (2 - 2 * score[-1]) + 1e-9:
                        break
                    part = order[begin : begin + STEP]
                    best, score = np.concatenate((best, part)), np.concatenate((score, (x[part] * q[i]).sum(axis=1) / (norms[part] * norm)))
                    top = np.lexsort((ids[best], -score))[:k]
                    best, score, begin = best[top], score[top], begin + len(part)
                if len(best):
                    out.append((query, ids[best], score, begin))
        sizes = [len(v) for _, v, _, _ in out]
        some = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        verified = some([np.array([n, *[0] * (size - 1)]) for (*_, n), size in zip(out, sizes, strict=True)], np.int64)
        return pa.table({"query_id": np.repeat(np.array([o[0] for o in out], np.int64), sizes), "vec_id": some([o[1] for o in out], np.int64), "score": some([o[2] for o in out], np.float64), "verified": verified})

    return run


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each of ``queries(vec_id, embedding)``.

    Nearness is the cosine on the given vectors in double precision; a query's own id is left out;
    ties go to the smaller id. Vectors are projected to PROJECTED Gaussian dimensions; a kd-tree over a
    bounded sample of projections cuts that space into leaves, every row is put into its leaf, and
    leaves are split into blocks of bounded size. A query first visits its nearest leaves; the k-th
    best distance then bounds which other leaves can matter: a nearer vector lies outside of
    chi2(CERTAINTY) times that squared distance with a probability of 1 - CERTAINTY at most, and blocks
    verify candidates in order of projected distance until the same test holds.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
    ids; vectors of different lengths are never compared. Of equal vectors the k + 1 smallest ids
    can be answers; the others are left out of the index, which changes no result. Rows that share an id
    count once, with the least of their vectors. An empty table gives an empty result.
    """
    clean = _usable(embeddings)
    results = None
    for dim in [r.dim for r in clean.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect()]:
        found = _search(clean.where(F.size("embedding") == dim), _usable(queries).where(F.size("embedding") == dim), k, block_rows)
        results = found if results is None else results.union(found)
    if results is None:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists(x, lambda v: v != 0)
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & some)
    return usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Without copies of a vector beyond its ``keep`` smallest ids; hot vectors are cut in salted parts first."""
    key = F.xxhash64("embedding")
    for salt in (F.pmod(F.xxhash64("vec_id"), F.lit(64)), F.lit(0)):
        order = Window.partitionBy("key", "embedding", "salt").orderBy("vec_id")
        rows = rows.withColumns({"key": key, "salt": salt}).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).select("vec_id", "embedding")
    return rows


def _search(rows: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    rows = materialize(_distinct_vectors(rows, k + 1), "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TREE_SAMPLE).select("embedding").toArrow()
    points = _unit(_matrix(sample["embedding"]))
    tree = KdTree(points @ projection(points.shape[1]), min(TREE_SAMPLE // 8, math.ceil(n / block_rows)))
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.leaves_of(_unit(x) @ projection(x.shape[1])))], ["vec_id", "embedding", "leaf"])

    index = rows.mapInArrow(placed, "vec_id bigint, embedding array<double>, leaf bigint")
    index = materialize(index, "index")
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    limit = chi_square_quantile(CERTAINTY, PROJECTED)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves of each query: the nearest ones if it has no bound yet, else those that its bound reaches."""
        for batch in batches:
            pick, leaves, bound = [], [], batch.column(2).to_numpy(zero_copy_only=False)
            if batch.num_rows:
                x = _matrix(batch.column(1))
                for i, at in enumerate(_unit(x) @ projection(x.shape[1])):
                    far = shared.value.box_distances(at)
                    first = np.argsort(far, kind="stable")[:FIRST_LEAVES]
                    mine = first if bound[i] < 0 else np.setdiff1d(np.flatnonzero(far <= limit * bound[i] + 1e-9), first)
                    pick += [i] * len(mine)
                    leaves += mine.tolist()
            at = pa.array(pick, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([4.0 if bound[i] < 0 else bound[i] for i in pick], pa.float64()), pa.array(leaves, pa.int64())], ["query_id", "embedding", "bound", "leaf"])

    def ask(asked: DataFrame) -> DataFrame:
        sent = asked.mapInArrow(visits, "query_id bigint, embedding array<double>, bound double, leaf bigint").join(sizes, "leaf")
        many = sent.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
        sent = sent.join(many, "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        data = index.join(sizes, "leaf").join(many, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["leaf", "block", "part"]
        left = data.select("vec_id", "embedding", *keys).groupBy(*keys)
        right = sent.select("query_id", "embedding", "bound", *keys).groupBy(*keys)
        return materialize(left.cogroup(right).applyInArrow(_nearest(k), "query_id bigint, vec_id bigint, score double, verified bigint"), "found")

    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    first = ask(asked.withColumn("bound", F.lit(-1.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query_id", F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("kth"))
    # fewer than k found so far: unit vectors are at most 2 apart, so the bound reaches every leaf that matters
    rest = ask(asked.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", F.lit(float("inf"))).alias("bound")))
    return first.union(rest)
