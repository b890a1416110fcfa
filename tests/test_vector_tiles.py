"""Top-k in tiles against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlake.operators import vector


def plain(rows, queries, k):
    ids = np.array([i for i, v in rows if v is not None and np.linalg.norm(v) > 0])
    unit = np.array([v / np.linalg.norm(v) for _, v in rows if v is not None and np.linalg.norm(v) > 0])
    out = {}
    for q, v in queries:
        score = np.round(unit @ (v / np.linalg.norm(v)), 9)
        order = np.lexsort((ids, -score))[:k]
        out[q] = list(zip(ids[order].tolist(), score[order].tolist()))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 6).astype(float)) for i in range(900)] + [(1000, None), (1001, np.zeros(6))]
    queries = [(i, rng.integers(-3, 4, 6) + 0.5) for i in range(1300)]
    frame = lambda x, n: spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in x], n)
    return rows, queries, frame(rows, "vec_id long, embedding array<double>"), frame(queries, "query_id long, vector array<double>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def close(got, want):
    """The same scores, and the same ids wherever scores are apart."""
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)
        least = want[q][-1][1]
        assert {i for i, s in got[q] if s > least + 1e-8} == {i for i, s in want[q] if s > least + 1e-8}


def test_more_queries_than_a_block(spark, data):
    rows, queries, vectors, asked = data
    close(found(vector.vector_topk(vectors, asked, 4)), plain(rows, queries, 4))


def test_small_tiles(spark, data):
    rows, queries, vectors, asked = data
    close(found(vector.vector_tiles(vectors, asked.where("query_id < 40"), 3, tile_rows=100, tile_queries=7)), plain(rows, queries[:40], 3))
    many = vector.vector_tiles(vectors.limit(2), asked.where("query_id < 3"), 50, tile_rows=1, tile_queries=2)
    assert many.groupBy("query_id").count().where("count = 2").count() == 3


def test_ties_go_to_the_smaller_id(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [2.0, 0.0]) for q in range(3)], "query_id long, vector array<double>")
    got = found(vector.vector_tiles(vectors, asked, 4, tile_rows=10, tile_queries=2))
    assert all([i for i, _ in r] == [1, 2, 3, 4] for r in got.values())


def test_plan_does_not_grow_with_queries(spark, data):
    _, _, vectors, asked = data
    more = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(F.col("id") + 1.0, *[F.lit(1.0)] * 5).alias("vector"))
    plan = lambda q: re.sub(r"#?\d+L?", "", vector.vector_topk(vectors, q, 4)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plan(more)) < 6_000 and "MapInPandas" not in plan(more)
    assert "Join" not in plan(more)


def test_odd_queries_are_refused(spark, data):
    _, _, vectors, asked = data
    zero = spark.createDataFrame([(-1, [0.0] * 6)], asked.schema)
    short = spark.createDataFrame([(-1, [1.0] * 5)], asked.schema)
    for bad in (zero, short):
        with pytest.raises(Exception, match="length"):
            vector.vector_tiles(vectors, asked.union(bad), 2).collect()


def test_blocks_hold_several_tiles():
    # 64,000 rows in tiles of 2,000 and 500: each row was sent 128 times, each query 32 times.
    across, down = vector._fewer_blocks(128, 32, 500, 2_000, 48)
    assert 48 <= across * down < 128 and across <= 16
    # Blocks stop growing at the default tiles, and a pair of blocks stays for every partition.
    across, down = vector._fewer_blocks(12_800, 3_200, 500, 2_000, 48)
    assert 64e5 / across <= vector.TILE_QUERIES and 64e5 / down <= vector.TILE_ROWS and across + down <= 1_000
    assert vector._fewer_blocks(3, 2, 500, 2_000, 200) == (3, 2) and vector._fewer_blocks(1, 1, 500, 2_000, 1) == (1, 1)


def test_a_block_is_scored_tile_by_tile():
    rng = np.random.default_rng(1)
    ids, rows, asked = rng.permutation(70), rng.integers(-2, 3, (70, 3)) + 0.5, rng.integers(-2, 3, (9, 3)) + 0.5
    whole, tiled = vector._best_of_tile(ids, rows, asked, 4), vector._best_of_block(ids, rows, asked, 4, 20, 2)
    assert all(np.array_equal(a, b) for a, b in zip(whole, tiled))
