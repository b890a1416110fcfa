"""Exact cosine top-k over a vector column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlake.operators.topk import top_n_per_group

# Up to so many queries go to the tasks as they are; more meet the vectors in tiles.
QUERY_BLOCK = 1024
# Rows and queries of a tile, and of a block of smaller tiles at most.
TILE_ROWS = 32_768
TILE_QUERIES = 8_192
# Queries scored at a time, to bound the score matrix of a batch.
SCORE_BLOCK = 256


def _merge(best: tuple, scores: np.ndarray, row_ids: np.ndarray, k: int) -> tuple:
    """Best k (scores, ids) of those so far and a batch, ties to the smaller id."""
    held, held_ids = best
    if len(held) == k:
        # Level scores stay in, since a smaller id may still win.
        level = np.flatnonzero(scores >= held[-1])
        if not len(level):
            return best
        scores, row_ids = scores[level], row_ids[level]
    scores, row_ids = np.concatenate([held, scores]), np.concatenate([held_ids, row_ids])
    first = np.lexsort((row_ids, -scores))[:k]
    return scores[first], row_ids[first]


def _best(vectors: DataFrame, ids: np.ndarray, unit: np.ndarray, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The best k of every task for a block of queries (columns of ``unit``)."""

    def best_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids]
        for batch in batches:
            batch = batch[batch[vector_col].notna()]
            if batch.empty:
                continue
            if {len(v) for v in batch[vector_col]} != {len(unit)}:
                raise ValueError("vectors and queries differ in length")
            rows = np.stack(batch[vector_col].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(rows, axis=1)
            usable = np.isfinite(norms) & (norms > 0)
            rows = rows[usable] / norms[usable, None]
            row_ids = batch[id_col].to_numpy(dtype=np.int64)[usable]
            for start in range(0, len(ids), SCORE_BLOCK):
                block = rows @ unit[:, start:start + SCORE_BLOCK]
                for offset in range(block.shape[1]):
                    q = start + offset
                    best[q] = _merge(best[q], block[:, offset], row_ids, k)
        for query_id, (scores, found) in zip(ids, best):
            yield pd.DataFrame({"query_id": query_id, id_col: found, "score": scores})

    schema = T.StructType([
        T.StructField("query_id", T.LongType()),
        T.StructField(id_col, T.LongType()),
        T.StructField("score", T.DoubleType()),
    ])
    return vectors.select(id_col, vector_col).mapInPandas(best_of_task, schema)


def _directions(vectors: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a direction."""
    there = pc.is_valid(vectors)
    rows, ids = vectors.filter(there).combine_chunks(), ids.filter(there).to_numpy()
    sizes = np.unique(pc.list_value_length(rows).to_numpy(zero_copy_only=False)) if len(rows) else np.zeros(1)
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    values = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), int(sizes[0]))
    norms = np.linalg.norm(values, axis=1)
    usable = np.isfinite(norms) & (norms > 0)
    return ids[usable], values[usable] / norms[usable, None]


def _best_of_tile(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score): the best k rows for each query, ties to the smaller id."""
    found = []
    for low in range(0, len(asked), SCORE_BLOCK):
        scores = rows @ asked[low:low + SCORE_BLOCK].T
        if len(rows) > k:
            least = np.partition(scores, len(rows) - k, axis=0)[len(rows) - k]
            row, query = np.nonzero(scores >= least)
        else:
            row, query = (x.ravel() for x in np.indices(scores.shape))
        score = scores[row, query]
        order = np.lexsort((ids[row], -score, query))
        row, query, score = row[order], query[order], score[order]
        first = np.searchsorted(query, query)  # where each query's rows begin
        kept = np.arange(len(query)) - first < k
        found.append((query[kept] + low, ids[row[kept]], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _best_of_block(
    ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, k: int, tile_rows: int, tile_queries: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best_of_tile`` over the tiles of a block, so that no more than a tile is scored at a time."""
    found = []
    for low in range(0, len(asked), tile_queries):
        tiles = [
            _best_of_tile(ids[at:at + tile_rows], rows[at:at + tile_rows], asked[low:low + tile_queries], k)
            for at in range(0, len(ids), tile_rows)
        ]
        query, id_, score = (np.concatenate(c) for c in zip(*tiles))
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        found.append((query[kept] + low, id_[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _fewer_blocks(across: int, down: int, tile_queries: int, tile_rows: int, pairs: int) -> tuple[int, int]:
    """How many blocks tiles are put into, halved while blocks stay within the default tiles and there are ``pairs`` of them."""
    least = (-(-across * tile_queries // TILE_QUERIES), -(-down * tile_rows // TILE_ROWS))
    while True:
        # The side with more blocks sends the other one more often.
        sides = sorted(((n, i) for i, n in enumerate((across, down)) if -(-n // 2) >= max(1, least[i]) and n > 1), reverse=True)
        for _, i in sides:
            fewer = (-(-across // 2), down) if i == 0 else (across, -(-down // 2))
            if fewer[0] * fewer[1] >= pairs:
                across, down = fewer
                break
        else:
            return across, down


def _tiles(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, tile_rows: int, tile_queries: int
) -> DataFrame:
    """The best k of every group of tiles: blocks of vectors meet blocks of queries through a shuffle.

    A vector is sent once a block of queries and a query once a block of vectors, so blocks hold several tiles, up
    to ``TILE_ROWS`` and ``TILE_QUERIES``, as long as every partition of a shuffle has a pair of blocks. Scores are made tile by
    tile. So neither the driver nor a task holds more than two blocks, and the plan is the same for any number of either.
    """
    across = max(1, -(-queries.count() // tile_queries))
    down = max(1, -(-vectors.count() // tile_rows))
    pairs = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across, down = _fewer_blocks(across, down, tile_queries, tile_rows, pairs)
    block = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("down", block(down, "id", "vector")).withColumn("across", every(across))
    asked = queries.withColumn("across", block(across, "query_id")).withColumn("down", every(down))

    def tile(rows: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids, unit = _directions(asked["vector"], asked["query_id"])
        if len(query_ids) < asked.num_rows:
            raise ValueError("a query vector has length zero")
        ids, directions = _directions(rows["vector"], rows["id"])
        if not len(ids) or not len(query_ids):
            empty = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())]
            return pa.table(empty, names=["query_id", id_col, "score"])
        if directions.shape[1] != unit.shape[1]:
            raise ValueError("vectors and queries differ in length")
        query, found, score = _best_of_block(ids, directions, unit, k, tile_rows, tile_queries)
        return pa.table([query_ids[query], found, score], names=["query_id", id_col, "score"])

    dealt = ["down", "across"]
    return rows.groupBy(*dealt).cogroup(asked.groupBy(*dealt)).applyInArrow(
        tile, f"query_id long, `{id_col}` long, score double"
    )


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For each query (``query_id, vector``) the ``k`` rows of highest cosine similarity.

    Returns ``query_id, rank, <id_col>, score``; ties go to the smaller id. Up to
    ``QUERY_BLOCK`` queries are sent to the tasks, each of which scores its rows
    by matrix products over Arrow batches and gives out its best k a query at its
    end, so what is shuffled depends on tasks and queries, not on rows. More
    queries meet the vectors in shuffled tiles, whatever their number. Rows and
    queries are never paired in the plan. Vectors of length zero or NULL have no
    direction and are not ranked; a query without direction is an error, and so
    are vectors of different lengths.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    block = asked.limit(QUERY_BLOCK + 1).collect()
    if not block:
        raise ValueError("no query vectors")
    if len(block) > QUERY_BLOCK:
        return vector_tiles(vectors, queries, k, id_col, vector_col)
    if any(r["vector"] is None for r in block) or len({len(r["vector"]) for r in block}) != 1:
        raise ValueError("query vectors differ in length")
    matrix = np.array([r["vector"] for r in block], dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1)
    if not np.all(lengths > 0):
        raise ValueError("a query vector has length zero")
    ids = np.array([r["query_id"] for r in block], dtype=np.int64)
    return _ranked(_best(vectors, ids, (matrix / lengths[:, None]).T, k, id_col, vector_col), k, id_col)


def vector_tiles(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile_rows: int = TILE_ROWS,
    tile_queries: int = TILE_QUERIES,
) -> DataFrame:
    """``vector_topk`` for any number of queries, in tiles of ``tile_rows`` vectors and ``tile_queries`` queries."""
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    return _ranked(_tiles(vectors, asked, k, id_col, vector_col, tile_rows, tile_queries), k, id_col)


def _ranked(candidates: DataFrame, k: int, id_col: str) -> DataFrame:
    ranked = top_n_per_group(candidates, ["query_id"], [F.desc("score"), id_col], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), id_col, "score")


def group_centroids(
    vectors: DataFrame, group_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """Mean vector of each group, as queries for ``vector_topk``: ``query_id, vector``.

    All positions of the vectors count; vectors of a group must agree in length.
    """
    places = vectors.filter(F.col(vector_col).isNotNull()).select(
        group_col, F.size(vector_col).alias("_size"), F.posexplode(vector_col).alias("_place", "_value")
    )
    means = places.groupBy(group_col, "_place").agg(
        F.avg(F.col("_value").cast("double")).alias("_mean"),
        F.min("_size").alias("_least"),
        F.max("_size").alias("_most"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_mean"))), lambda p: p["_mean"])
    same = F.min("_least") == F.max("_most")
    refused = F.raise_error("vectors of a group differ in length").cast("array<double>")
    return means.groupBy(F.col(group_col).alias("query_id")).agg(
        F.when(same, ordered).otherwise(refused).alias("vector")
    )
