"""Near-duplicate vectors by PCA-ordered, tiled comparison.

Unit vectors are turned so that their leading dimensions carry most of the product (PCA
of a bounded sample; any rotation keeps all cosines, so the sample only decides the
speed). Cells of the two leading dimensions hold blocks of at most about ``BLOCK`` vectors.
Two blocks meet in one task unless their cells are too far apart for any link. A tile
of two blocks adds up the products of the leading dimensions first; by Cauchy-Schwarz the
rest adds at most the product of the norms of what is left, so a pair stops as soon as
its cosine cannot reach the threshold. Survivors near the threshold are computed again
from the vectors as given, in double precision.

A tile passes on the number of links of each vector and a spanning forest of them, never
the pairs, so a group of near copies costs a row a vector and tile. Vectors with
the same bytes are one from the start. Components come from alternating stars.

Vectors that are null, zero, or hold null or non-finite components, and those with a null
id, link with nothing. Vectors of different lengths do not link. Different vectors
with the same id each get the links of all of them. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlake.llm.components import components
from orderlake.llm.scratch import written

THRESHOLD = 0.95
BLOCK = 4096
SAMPLE = 8192
MAX_STRIPS = 48
ROWS = 512  # of a tile that are compared at a time
DOUBT = 1e-9


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, raw``: ids and the vectors' bytes as 64-bit floats, where the vector can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    raw.append((x + 0.0).tobytes())  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["id", "raw"])

    return vectors.select(F.col(id_column).cast("long"), vector_column).mapInArrow(run, "id long, raw binary")


class Grid:
    """Rotation and cells for vectors of one length, from a sample of them."""

    def __init__(self, sample: np.ndarray, strips: int):
        x = _unit(sample)
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = axes[:, ::-1].copy()
        lead = (x @ self.axes[:, :2]) if x.shape[1] > 1 else np.hstack([x @ self.axes, np.zeros((len(x), 1))])
        self.first = np.quantile(lead[:, 0], np.arange(1, strips) / strips) if strips > 1 else np.zeros(0)
        strip = np.searchsorted(self.first, lead[:, 0])
        self.second = []
        for s in range(strips):
            mine = lead[strip == s, 1]
            full = len(mine) >= strips > 1
            self.second.append(np.quantile(mine, np.arange(1, strips) / strips) if full else np.zeros(0))
        self.strips = strips

    def cells(self, x: np.ndarray) -> np.ndarray:
        lead = x @ self.axes[:, :2]
        strip = np.searchsorted(self.first, lead[:, 0])
        out = strip * self.strips
        for s in np.unique(strip):
            mine = strip == s
            if x.shape[1] > 1:
                out[mine] += np.searchsorted(self.second[s], lead[mine, 1])
        return out

    def near(self, threshold: float) -> dict[int, list[int]]:
        """For each cell, the cells that can hold a link of its vectors (itself included)."""
        edge = lambda cuts, i: (-np.inf if i == 0 else cuts[i - 1], np.inf if i == len(cuts) else cuts[i])
        box = {
            s * self.strips + k: (*edge(self.first, s), *edge(self.second[s], k))
            for s in range(len(self.first) + 1)
            for k in range(len(self.second[s]) + 1)
        }
        ids, b = np.array(list(box)), np.array(list(box.values()))
        reach = 2 - 2 * threshold + 1e-9
        out = {}
        for c, (x0, x1, y0, y1) in box.items():
            gap = lambda lo, hi, a, z: np.maximum(0, np.maximum(lo - z, a - hi))
            d = gap(b[:, 0], b[:, 1], x0, x1) ** 2 + gap(b[:, 2], b[:, 3], y0, y1) ** 2
            out[c] = ids[d <= reach].tolist()
        return out


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of unit vectors whose cosine is at least ``threshold``."""
    ra, rb = a @ axes, b @ axes
    width = a.shape[1]
    cuts = sorted({min(width, k) for k in (max(4, width // 4), max(8, width // 2), width)})
    rest = lambda r, k: np.sqrt(np.maximum(0, (r[:, k:] ** 2).sum(axis=1)))
    found_i, found_j = [], []
    for top in range(0, len(a), ROWS):
        part = ra[top : top + ROWS]
        total = part[:, : cuts[0]] @ rb[:, : cuts[0]].T
        at = cuts[0]
        alive = total + np.outer(rest(part, at), rest(rb, at)) >= threshold - DOUBT
        i, j = np.nonzero(alive)
        for cut in cuts[1:]:
            if not len(i):
                break
            if len(i) * 8 > total.size:  # many pairs: the whole tile by one product
                total += part[:, at:cut] @ rb[:, at:cut].T
                value = total[i, j]
            else:
                value = total[i, j] + np.einsum("ij,ij->i", part[i, at:cut], rb[j, at:cut])
                total[i, j] = value
            at = cut
            keep = value + rest(part, at)[i] * rest(rb, at)[j] >= threshold - DOUBT
            i, j = i[keep], j[keep]
        value = total[i, j]
        doubt = np.flatnonzero(np.abs(value - threshold) <= 2 * DOUBT)
        value[doubt] = np.einsum("ij,ij->i", a[top + i[doubt]], b[j[doubt]])
        keep = value >= threshold
        found_i.append(top + i[keep])
        found_j.append(j[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by the links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while True:
        deeper = label[label]
        if (deeper == label).all():
            return label
        label = deeper


def _compare(own: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """``a, b, links`` of the tiles among different vectors of one length: counts (b null) and forest links."""
    size = own.count()
    strips = int(min(MAX_STRIPS, max(1, np.ceil(np.sqrt(size / block)))))
    # SAMPLE rows at most.
    some = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("raw").collect()
    grid = Grid(np.frombuffer(b"".join(r["raw"] for r in some), np.float64).reshape(-1, width), strips)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, width)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(grid.cells(_unit(raw)), pa.int32())], names=["id", "raw", "copies", "cell"]
                )

    placed = own.select("id", "raw", "copies").mapInArrow(place, "id long, raw binary, copies long, cell int")
    # At most MAX_STRIPS squared rows.
    blocks = {r["cell"]: -(-r["count"] // block) for r in placed.groupBy("cell").count().collect()}
    first, near = {}, {}
    for cell in sorted(blocks):
        first[cell] = sum(blocks[c] for c in first)
    for cell, others in grid.near(threshold).items():
        near[cell] = np.array([first[c] + k for c in others if c in blocks for k in range(blocks[c])], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every tile that a vector's block takes part in."""
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids = batch.column(0).to_numpy()
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cell = batch.column(3).to_pylist()
                mine = np.array([first[c] for c in cell]) + (salt % np.array([blocks[c] for c in cell], np.uint64)).astype(np.int64)
                others = [near[c] for c in cell]
                times = np.array([len(o) for o in others])
                row = np.repeat(np.arange(len(ids)), times)
                other, own_block = np.concatenate(others), np.repeat(mine, times)
                take = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(other, own_block), pa.int64()), pa.array(np.maximum(other, own_block), pa.int64()),
                        pa.array(own_block > other), take.column(0), take.column(1), take.column(2),
                    ],
                    names=["low", "high", "side", "id", "raw", "copies"],
                )

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")]).combine_chunks()
        ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
        x = _unit(np.frombuffer(b"".join(t["raw"].to_pylist()), np.float64).reshape(-1, width))
        side = t["side"].to_numpy(zero_copy_only=False)
        if t["low"][0].as_py() == t["high"][0].as_py():
            i, j = tile_links(x, x, grid.axes, threshold)
            other = i != j
            i, j = i[other], j[other]
            links = np.bincount(i, copies[j], minlength=len(ids))
        else:
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            i, j = tile_links(x[left], x[right], grid.axes, threshold) if len(left) and len(right) else (left[:0], left[:0])
            i, j = left[i], right[j]
            links = np.bincount(i, copies[j], minlength=len(ids)) + np.bincount(j, copies[i], minlength=len(ids))
        root = forest(len(ids), i, j)
        hung = np.flatnonzero(root != np.arange(len(ids)))
        some = np.flatnonzero(links)
        return pa.table({
            "a": np.concatenate([ids[some], ids[hung]]),
            "b": pa.array([None] * len(some) + ids[root[hung]].tolist(), pa.int64()),
            "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(hung), np.int64)]),
        })

    tiles = placed.mapInArrow(deal, "low long, high long, side boolean, id long, raw binary, copies long")
    return tiles.groupBy("low", "high").applyInArrow(compare, "a long, b long, links long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """``<id>, n_links, component_id, kept``: one row a vector."""
    rows = written(usable(vectors, id_column, vector_column), "vectors")
    one = rows.groupBy("raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    one = written(one.withColumn("width", F.octet_length("raw") / 8), "vectors")
    found = None
    # One run for each length; vectors of a table have the same, as a rule.
    for row in one.groupBy("width").count().orderBy("width").collect():
        part = _compare(one.where(F.col("width") == row["width"]), int(row["width"]), threshold, block)
        found = part if found is None else found.unionByName(part)
    everything = vectors.select(F.col(id_column).cast("long").alias("id"))
    if found is None:
        linked = everything.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        found = written(found, "links")
        counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
        roots = components(found.where(F.col("b").isNotNull()).select("a", "b"))
        known = one.select("raw", "id", "copies").join(counts.withColumnRenamed("a", "id"), "id", "left")
        known = known.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
            "raw",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        linking = rows.join(known, "raw").select("id", "n_links", "component_id")
        idle = _unusable(vectors, id_column, vector_column).select(
            "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
        )
        linked = linking.unionByName(idle)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return linked.select(F.col("id").alias(id_column), F.col("n_links").cast("long"), "component_id", kept.alias("kept"))


def _unusable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Ids of the rows that ``usable`` leaves out."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.col(id_column).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.where(~F.coalesce(able, F.lit(False))).select(F.col(id_column).cast("long").alias("id"))
