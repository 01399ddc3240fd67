"""Projection search against brute force."""

import numpy as np
import pandas as pd
from tests.llm import plain

from millrace.llm import neighbours


def compare(spark, vectors, rows, queries, block_rows=neighbours.BLOCK_ROWS):
    asked = vectors.where(vectors.vec_id.isin(queries))
    found: dict = {}
    for r in neighbours.nearest_neighbours(vectors, asked, 5, block_rows).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in queries:
        best, got = plain.nearest(rows, q, 5), sorted(found.get(q, []))
        assert [x[0] for x in got] == list(range(1, len(best) + 1))
        assert all(abs(s - dict(plain.nearest(rows, q, len(rows)))[v]) < 1e-12 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({v for v, _ in best} & {v for _, v, _ in got})
        total += len(best)
    assert set(found) <= set(queries)
    return hits / max(1, total)


def test_recall_over_the_table(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    assert compare(spark, vectors, rows, [i for i in rows if i % 50 == 0], 40) >= 0.9


def test_small_blocks_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 32))
    rows = {i: [float(x) for x in np.float32(centres[i % 6] + 0.4 * rng.standard_normal(32))] for i in range(900)}
    rows |= {i: rows[3] for i in range(1000, 1400)}  # one vector that a third of all rows have
    vectors = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<float>")
    queries = [0, 50, 100, 1000, 1050, 3]
    assert compare(spark, vectors, rows, queries, 64) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = {0: [1.0, 0.0], 1: [0.5, 0.5], 2: [2.0, 0.0], 4: [4.0, 0.0], 50: [0.0, 1.0]}
    bad = [(3, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (150, [0.0, 0.0])]
    vectors = spark.createDataFrame([*good.items(), *good.items(), *bad], "vec_id bigint, embedding array<float>").selectExpr("*", "1 as leaf", "2 as score", "'x' as query_id")
    found = neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100, 150)}
    assert got == {0: [2, 4, 1, 50], 50: [1, 0, 2, 4], 100: [], 150: []}
    assert neighbours.nearest_neighbours(vectors.limit(0), vectors.limit(0), 5).count() == 0


def test_few_candidates_of_clustered_vectors_are_verified(spark):
    """The index prunes: most leaves and rows are never compared, at a recall of 0.9 and more."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((200, 64))
    x = np.float32(centres[rng.integers(0, 200, 20_000)] + 0.5 * rng.standard_normal((20_000, 64)))
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id bigint, embedding array<float>")
    asked = vectors.where("vec_id % 200 = 0")
    found = neighbours._search(neighbours._usable(vectors), neighbours._usable(asked), 5, neighbours.BLOCK_ROWS).toPandas()
    share = found.verified.sum() / (100 * len(x))
    assert share < 0.1
    unit = x / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    scores = unit[::200] @ unit.T
    scores[np.arange(100), np.arange(100) * 200] = -2
    best = np.argsort(-scores, axis=1)[:, :5]
    top = found.sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id").head(5).groupby("query_id").vec_id.agg(set)
    assert np.mean([len(top[q * 200] & set(b)) / 5 for q, b in enumerate(best)]) >= 0.9


def test_one_id_with_two_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [-1.0, 0.1]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    found = neighbours.nearest_neighbours(vectors, vectors.where("vec_id = 0"), 5).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [2, 1]
