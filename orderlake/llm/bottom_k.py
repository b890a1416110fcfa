"""Near-duplicates by bottom-k sketches from one hash function.

A document's set holds the hashes of its five-word shingles (A-Z lower-cased); its sketch
the ``SKETCH`` smallest of them. Documents with equal sets are one from here on.

Inverted lists of the retained values generate the pairs. A value that up to ``RARE``
documents retain gives all pairs of its list, a bounded number for each entry. Longer
lists matter only for documents most of whose retained values are in such lists: two
similar documents without a rarer value in common have that property. They meet in
blocks of their lists, together with their sets, where exact bounds against the list's
most central document leave few pairs to count, and only links that join two groups
are passed on, so no list gives out all its pairs.

Pairs from rare values are filtered by the estimate from the union's sketch, with a wide
margin; a join with the full sets counts the exact Jaccard similarity. Components come
from alternating stars.

Null and empty texts and texts without words have an empty set and link with nothing; a
text of fewer than five words has one shingle. Ids are numbers or texts. Rows with the same
id are documents of their own: each belongs to its text's group, whose smallest id it gets.
Other columns are not read; an empty table gives an empty result.

Shingles are hashed with a seed of the run (``arrow_text.Keys``), so which pairs fall short of
the candidates' small remaining chance differs from run to run, and no text can be made to
share shingles it does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlake.llm.arrow_text import Words, flat, keys_of, mix, new_seed, slices
from orderlake.llm.components import components
from orderlake.llm.scratch import written

WORDS = 5
PERCENT = 75
SKETCH = 32
RARE = 8
HOT_KEYS = 8
HOT_SHARE = 0.4
MARGIN = 0.35  # more than four standard deviations of an estimate from SKETCH values
BLOCK = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, size: int = WORDS, seed: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, ascending as signed numbers, and each text's bounds among them."""
    data, at = flat(texts)
    words = Words(_LOWER[data], at)
    keys = keys_of(seed)
    hashes = words.hashes(keys)
    found, start = keys.windows(hashes, words.row, size)
    row = words.row[start]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        short = []
        for r in few:
            x = np.uint64(0)
            for h in hashes[words.first[r] : words.first[r + 1]]:
                x = mix(np.array([x ^ h]))[0]
            short.append(mix(np.array([x ^ np.uint64(words.count[r])]))[0])
        found, row = np.concatenate([found, np.array(short, np.uint64)]), np.concatenate([row, few])
    found = found.view(np.int64)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])])
        found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(at)))


def _list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, pa.int64()))


def _set_hashes(values: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A 128-bit hash of each set, in halves."""
    count = np.diff(at).astype(np.uint64)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values.view(np.uint64) ^ np.uint64(k)))]) for k in (1, 2)]
    a, b = (mix((s[at[1:]] - s[at[:-1]]) + count).view(np.int64) for s in sums)
    return pa.array(a), pa.array(b)


def sketches(docs: DataFrame, size: int, keep: int, seed: bytes) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (a 128-bit hash of the set) and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                values, at = shingle_sets(batch.column(1), size, seed)
                count = np.diff(at)
                taken = np.minimum(count, keep)
                edge = np.concatenate([[0], np.cumsum(taken)])
                which = np.repeat(at[:-1] - edge[:-1], taken) + np.arange(int(edge[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(count), *_set_hashes(values, at), _list_array(values[which], edge)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, sketch array<long>"
    )


def full_sets(docs: DataFrame, size: int, seed: bytes) -> DataFrame:
    """``node, shingles`` (ascending) of the rows of ``node, set_a, set_b, text`` whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                node, wanted_a, wanted_b, text = batch.columns
                values, at = shingle_sets(text, size, seed)
                a, b = _set_hashes(values, at)
                own = pc.and_(pc.equal(a, wanted_a), pc.equal(b, wanted_b))
                made = pa.RecordBatch.from_arrays([node, _list_array(values, at)], names=["node", "shingles"])
                yield made.filter(own)

    return docs.select("node", "set_a", "set_b", "text").mapInArrow(run, "node long, shingles array<long>")


def estimated(a: Column, b: Column, keep: int) -> Column:
    """The share of the union's ``keep`` smallest values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, keep)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _similar(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def block_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of a block's documents, as places; documents of one side are compared elsewhere.

    ``side`` is 0 and 1 for two different blocks of a list, 0 for all in a block with itself.
    What two sets share lies in the pivot's set or in elements that two sets of the block
    hold, and both parts are bounded by the smaller of the two.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, which, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts > 1
    centre = np.bincount(owner, counts[which] * shared[which], minlength=n) / sizes
    pivot = int(np.lexsort((ids, -centre))[0])
    in_pivot = np.zeros(len(counts), bool)
    in_pivot[which[owner == pivot]] = True
    p = np.bincount(owner, in_pivot[which], minlength=n).astype(np.int64)
    q = np.bincount(owner, (shared & ~in_pivot)[which], minlength=n).astype(np.int64)
    group = np.arange(n)
    links = []
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    two = side.any()

    def link(x: int, y: int) -> None:
        links.append((x, y))
        a, b = group[x], group[y]
        group[group == max(a, b)] = min(a, b)

    # The pivot first: most of a family of copies hangs on it.
    for y in np.flatnonzero((100 * p >= percent * (sizes + sizes[pivot] - p)) & (np.arange(n) != pivot)):
        if not two or side[y] != side[pivot]:
            link(pivot, int(y))
    mine = np.zeros(len(counts), bool)
    for x in np.argsort(-p, kind="stable"):
        most = np.minimum(p[x], p) + np.minimum(q[x], q)
        maybe = (100 * most >= percent * (sizes + sizes[x] - most)) & (group != group[x])
        if two:
            maybe &= side != side[x]
        rest = np.flatnonzero(maybe)
        if not len(rest):
            continue
        mine[which[bounds[x] : bounds[x + 1]]] = True
        for y in rest.tolist():
            if group[y] == group[x]:
                continue
            both = int(mine[which[bounds[y] : bounds[y + 1]]].sum())
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                link(int(x), y)
        mine[which[bounds[x] : bounds[x + 1]]] = False
    return links


def _hot_links(hot: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links among sets that share a long list: ``value, node`` with the number ``n`` of its entries."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    # A set of block i goes to the pairs (i, i), (i, j) and (j, i) of its list.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = hot.withColumns({"blocks": blocks, "own": own}).withColumn("other", other)
    placed = placed.select(
        "value", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    rows = placed.join(sets, "node")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        ids = t["node"].to_numpy()
        values = t["shingles"].chunk(0) if t["shingles"].num_chunks else t["shingles"]
        offsets = values.offsets.to_numpy()
        flat_values = values.values.to_numpy()
        found = block_links(ids, [flat_values[a:b] for a, b in zip(offsets, offsets[1:])], t["side"].to_numpy(), percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return rows.groupBy("value", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, sketch: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row a document."""
    seed = new_seed()
    rows = written(sketches(docs, words, sketch, seed), "sketches")
    # One node a set; sets are equal where both halves of their hash are.
    sets = rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch")
    )
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    entries = sets.select("node", F.explode("sketch").alias("value"))
    lengths = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = written(entries.join(lengths, "value"), "entries")

    rare = entries.where(F.col("n") <= RARE).select("value", "node")
    pairs = (
        rare.withColumnRenamed("node", "a")
        .join(rare.withColumnRenamed("node", "b"), "value")
        .where("a < b")
        .select("a", "b")
        .distinct()
    )
    brief = sets.select("node", "n_shingles", "sketch")
    for side in ("a", "b"):
        pairs = pairs.join(
            brief.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")),
            side,
        )
    sizes_fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    enough = estimated(F.col("s_a"), F.col("s_b"), sketch) >= percent / 100 - MARGIN
    pairs = written(pairs.where(sizes_fit).where(enough).select("a", "b", "n_a", "n_b"), "pairs")

    # A document with no more values than the sketch holds shows them all, so its share is exact.
    long = entries.where(F.col("n") > RARE)
    shares = long.groupBy("node").agg(F.count(F.lit(1)).alias("n_long"), F.sort_array(F.collect_list("value")).alias("values"))
    crowded = shares.join(brief, "node").where(F.col("n_long") >= HOT_SHARE * F.size("sketch"))
    hot = crowded.select("node", F.explode(F.slice("values", 1, HOT_KEYS)).alias("value"))
    hot_lengths = hot.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = written(hot.join(hot_lengths, "value"), "hot")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    wanted = sets.select("node", "doc_id", "set_a", "set_b").join(wanted, "node")
    # Texts go through the shuffle at any size, so that what a run moves grows as its input does. Rows with the same id
    # may have different sets; each goes with its own.
    shingles = full_sets(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id"), words, seed)
    shingles = written(shingles.dropDuplicates(["node"]), "shingles")
    for side in ("a", "b"):
        pairs = pairs.join(shingles.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    both = F.size(F.array_intersect("s_a", "s_b"))
    links = pairs.where(_similar(both, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    found = written(components(links.unionByName(_hot_links(hot, shingles, percent, BLOCK))), "components")
    owners = found.join(sets.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    whole = sets.select("set_a", "set_b", "node", "doc_id").join(found, "node", "left").join(owners, "component", "left")
    whole = whole.select("set_a", "set_b", F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.join(whole, ["set_a", "set_b"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents of which no smaller near-duplicate is there; rows with the same id stay together."""
    kept = near_duplicates(docs, **how).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
