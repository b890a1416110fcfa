"""Trie of conversations by their turns: one ROLLUP over positional turn columns for all prefixes.

A turn is known by the SHA-256 of its role and text. A conversation is cut into blocks of
eight turns, one row each, with a column for each position; a further block carries, as its
key, the node its prior block ends in. ``GROUP BY block, key, ROLLUP(t1, ..., t8)`` then has a
group for every prefix of every conversation, and ``grouping_id`` says how long it is. So a
prefix that everyone shares is aggregated in the tasks before anything is shuffled.

The node at the end of a full block is known by the hash of all turns up to there. It is
put together from the hashes of blocks in log2(blocks) steps, each over twice as many.

Sums over subtrees need no walk through the trie: each node belongs to its smallest member,
whose rows carry the sums of what it owns from each position on; a second ROLLUP adds them up
over the members of every prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderlake.llm.numbering import places
from orderlake.llm.scratch import written

WIDTH = 8
_POSITIONS = range(1, WIDTH + 1)
_TURNS = [f"t{i}" for i in _POSITIONS]
_KEYS = ["depth", "node_id"]
#: Ids of one chunk differ in these bits only, so a chunk has 65,536 of them at most.
_CHUNK_BITS = 16

_ROLLUP = f"""
SELECT block, key, {", ".join(_TURNS)}, {WIDTH} - bit_count(grouping_id()) AS level, {{values}}
FROM {{rows}} GROUP BY block, key, ROLLUP({", ".join(_TURNS)})
"""


def turn_id(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, n_turns, turn, chars`` of ``conv_id, turn, role, text``.

    Turns go by number, null first; equal numbers by the hash of the turn. A null role or text is empty; equal rows are
    turns of their own; rows without a conversation are left out; other columns are not used.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("ordinal"),
        turn_id(role, text).alias("turn"),
        F.char_length(text).cast("long").alias("chars"),
    )
    placed = places(written(turns, "trie-turns"), ["conv_id"], ["ordinal", "turn"], "trie-places")
    return placed.select("conv_id", "place", F.col("group_size").alias("n_turns"), "turn", "chars")


def with_shared_heads(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (``conv_id, n_turns``, their turns).

    Conversation c takes its first h turns from conversation ``c - c % family`` (fewer if that has fewer, none if there is
    none) and goes on with its own turns after its first h; h is the CRC-32 of c in decimal, modulo ``heads``.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(heads)
    convs = turns.groupBy("conv_id").agg(F.max("n_turns").alias("own_turns")).withColumns({
        "head": head,
        "first": F.col("conv_id") - F.col("conv_id") % F.lit(family),
    })
    sizes = convs.select(F.col("conv_id").alias("first"), F.col("own_turns").alias("first_turns"))
    taken = F.least("head", F.coalesce("first_turns", F.lit(0)))
    convs = convs.join(sizes, "first", "left").withColumn("taken", taken)
    n_turns = (F.col("taken") + F.greatest(F.col("own_turns") - F.col("head"), F.lit(0))).alias("n_turns")
    shared = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < heads - 1))
    shared = shared.select(F.col("conv_id").alias("first"), "place", "turn", "chars")
    from_first = convs.join(shared, "first").where(F.col("place") < F.col("taken"))
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where(F.col("place") >= F.col("head"))
    own = own.withColumn("place", F.col("place") - F.col("head") + F.col("taken"))
    columns = ["conv_id", "place", "turn", "chars"]
    return convs.select("conv_id", n_turns), from_first.select(columns).unionByName(own.select(columns))


def _block_rows(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a block of a conversation: ``conv_id, n_turns, block, key, t1.., c1..``; a turnless one has an empty block."""
    blocks = turns.groupBy("conv_id", F.expr(f"place div {WIDTH}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "turn", "chars"))).alias("turns")
    )
    rows = convs.join(blocks, "conv_id", "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    at = W.partitionBy("conv_id").orderBy("block")
    full = F.size("turns") == WIDTH
    rows = rows.withColumn("upto", F.when(full, _sha(F.array_join(F.transform("turns.turn", F.hex), ""))))
    for k in range(int((convs.agg(F.max("n_turns")).first()[0] or 0) // WIDTH).bit_length()):
        before = F.lag("upto", 1 << k).over(at)
        rows = rows.withColumn("upto", F.when(before.isNotNull(), _sha(before, F.col("upto"))).otherwise(F.col("upto")))
    turn = lambda i: F.get("turns", F.lit(i - 1))
    return rows.select(
        "conv_id",
        "n_turns",
        "block",
        F.coalesce(F.lag("upto").over(at), F.lit(b"")).alias("key"),
        *(turn(i)["turn"].alias(f"t{i}") for i in range(1, WIDTH)),
        F.col("upto").alias(_TURNS[-1]),
        *(turn(i)["chars"].alias(f"c{i}") for i in _POSITIONS),
    )


def _sha(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(v.cast("binary") for v in values)), 256))


def _node_id(level: Column) -> Column:
    """A node of its block at ``level``: the last column where the block is full, else the key and the turns so far."""
    upto = [F.when(F.lit(i) <= level, F.col(f"t{i}")).otherwise(F.lit(b"")) for i in range(1, WIDTH)]
    inside = F.when(level == 0, F.col("key")).otherwise(_sha(F.col("key"), *upto))
    return F.when(level == WIDTH, F.col(_TURNS[-1])).otherwise(inside)


def _prefixes(rows: DataFrame, values: str) -> DataFrame:
    """Every prefix in ``rows`` once, as ``depth, node_id``, with aggregates; and its parent's id, block and level."""
    groups = rows.sparkSession.sql(_ROLLUP.replace("{values}", values), rows=rows)
    level = F.col("level")
    last = F.element_at(F.array(*_TURNS), F.greatest(level, F.lit(1)))
    root = (level == 0) & (F.col("block") == 0)
    groups = groups.where(root | (level > 0) & last.isNotNull())
    return groups.withColumns({
        "depth": F.col("block") * WIDTH + level,
        "node_id": _node_id(level),
        "parent_id": F.when(level > 0, _node_id(level - 1)),
    })


def _by_level(name: str) -> Column:
    """The value for the position of a prefix's last turn (for the root that of the first)."""
    return F.element_at(F.array(*(f"{name}{i}" for i in _POSITIONS)), F.greatest("level", F.lit(1)))


def _each(function: str, name: str) -> str:
    return ", ".join(f"{function}({name}{i}) AS {name}{i}" for i in _POSITIONS)


def _ends(rows: DataFrame) -> DataFrame:
    """``depth, node_id, ends_sha256``: SHA-256 of the ids of the conversations that end in a node, ascending.

    Ids go in sorted chunks to the task that hashes a node, which holds one chunk at a time.
    """
    last = rows.where(F.col("block") == F.greatest(F.ceil(F.col("n_turns") / WIDTH) - 1, F.lit(0)))
    ended = last.select(
        F.col("n_turns").alias("depth"),
        _node_id(F.col("n_turns") - F.col("block") * WIDTH).alias("node_id"),
        "conv_id",
    )
    chunks = ended.groupBy(*_KEYS, F.shiftright("conv_id", _CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids")
    )
    chunks = chunks.select(*_KEYS, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    chunks = chunks.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "chunk")
    return chunks.select(*_KEYS, "ids").mapInArrow(_hash_ends, "depth long, node_id binary, ends_sha256 string")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, node, digest = ["depth", "node_id", "ends_sha256"], None, None
    kinds = [pa.int64(), pa.binary(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=names
    )
    for batch in batches:
        rows = []
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == node:
                digest.update(b",")
            else:
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield made(rows)
    if node:
        yield made([(*node, digest.hexdigest())])


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs`` (``conv_id, n_turns``) by their ``turns`` (``conv_id, place, turn, chars``).

    Per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes in its subtree), ``saved_tokens`` (over its subtree, code points of each node's turn times members
    but one) and ``ends_sha256`` (of the ids of members that end here, ascending, joined by commas). The root has
    depth 0 and no turn; a conversation without turns is a member of it alone. Ids and places are not null and unique;
    places run from 0 without gaps. No conversation, no node.
    """
    rows = written(_block_rows(convs, turns), "trie-blocks")
    counted = _prefixes(rows, f"count(1) AS n_convs, min(conv_id) AS conv_id, max(n_turns) AS longest, {_each('max', 'c')}")
    nodes = written(
        counted.select(
            *_KEYS, "parent_id", "block", "level", "conv_id", "n_convs", "longest",
            F.when(F.col("level") > 0, _by_level("c")).otherwise(0).alias("chars"),
        ),
        "trie-nodes",
    )

    own = (F.col("n_convs") - 1) * F.col("chars")
    owned = nodes.groupBy("conv_id", "block").agg(
        *(F.sum(F.when(F.col("level") == i, own).otherwise(0)).alias(f"own{i}") for i in _POSITIONS),
        F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"),
    )
    whole = W.partitionBy("conv_id")
    after = whole.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    value = lambda i: F.coalesce(f"own{i}", F.lit(0))
    rows_owning = rows.select("conv_id", "block", "key", *_TURNS).join(owned, ["conv_id", "block"], "left")
    rows_owning = rows_owning.withColumns({
        "later": F.coalesce(F.sum(sum(map(value, _POSITIONS))).over(after), F.lit(0)),
        "leaf": F.coalesce(F.max("leaf").over(whole), F.lit(0)),
        "owns": F.max(F.col("own1").isNotNull()).over(whole),
    }).where("owns")
    rows_owning = rows_owning.withColumns({f"s{i}": F.col("later") + sum(map(value, range(i, WIDTH + 1))) for i in _POSITIONS})
    sums = _prefixes(rows_owning, f"sum(leaf) AS n_leaves, {_each('sum', 's')}")
    sums = sums.select(*_KEYS, "n_leaves", _by_level("s").alias("saved_tokens"))

    children = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_id").alias("node_id"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(sums, _KEYS, "left")
        .join(children, _KEYS, "left")
        .join(_ends(rows), _KEYS, "left")
        .join(parents, ["depth", "parent_id"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
