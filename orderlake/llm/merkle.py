"""Merkle tree over the rows of a dataset, with a proof for every row by pointer jumping.

Rows are leaves. Leaves of one group, in order, meet in runs of ``fanout``; a run's node
is the hash of its members' hashes, and so on until one node, the group's root, remains.
Group roots, in the order of the groups, meet likewise in the root of the dataset.

Each node points at an ancestor, first its parent, and holds the segment of the proof up
to there: per level what stands left and right of it in its run. A join of the nodes
with themselves lets each point at its ancestor's ancestor and puts the segments
together; so the distance doubles, and after log2(height) joins all point at the root.
Leaves stay in their runs meanwhile, with the run's node as the holder of what lies
above, and put their own level before it at the end.

Places of leaves come from a range sort, so a group with most of the rows is still spread.
A null group is a group of its own and comes first; null order values come first; rows
that are equal in order value and hash are leaves of their own, one after the other, which
are alike but for their place. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlake.llm.numbering import places
from orderlake.llm.schema import without
from orderlake.llm.scratch import written

FANOUT = 16
TOP = "top"
ADDED = ("subroot", "root", "steps")
_NODE = ["key", "level", "place"]
_UP = ["up_key", "up_level", "up_place"]


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*values), 256)


def row_hash(*columns: Column) -> Column:
    """The hash of a row: each value as ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, columns))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf's hash and its proof."""
    return F.aggregate(steps, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_text(steps: Column) -> Column:
    """All siblings of a proof put together, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), "")


def _steps(run: Column, at: Column, top: bool) -> Column:
    """What stands beside member ``at`` (from 0) of a run of hashes."""
    return F.struct(
        F.lit(top).alias("top"),
        F.array_join(F.slice(run, F.lit(1), at), "").alias("left"),
        F.element_at(run, at + 1).alias("own"),
        F.array_join(F.slice(run, at + 2, F.size(run)), "").alias("right"),
    )


def _up(width: Column, fanout: int) -> Column:
    return F.ceil(width / fanout).cast("long")


def _climb(nodes: DataFrame, widest: int, fanout: int, top: bool) -> tuple[DataFrame, list[DataFrame], int]:
    """The nodes that remain alone in their tree, pointers from each other node to its parent, and the levels climbed.

    ``nodes``: key, level, place, hash, width (nodes of its tree on its level), and ``from_*``, by which others know it.
    """
    alone, pointers, height = [], [], 0
    while True:
        alone.append(nodes.where(F.col("width") == 1).select(*_NODE, "hash"))
        if widest <= 1:
            break
        members = F.sort_array(F.collect_list(F.struct("place", "hash", "from_key", "from_level", "from_place")))
        runs = (
            nodes.where(F.col("width") > 1)
            .groupBy("key", "level", F.expr(f"place div {fanout}").alias("up"))
            .agg(members.alias("members"), F.max("width").alias("width"))
        )
        runs = written(
            runs.select(
                "key",
                (F.col("level") + 1).alias("level"),
                F.col("up").alias("place"),
                "members",
                digest(F.array_join(F.col("members.hash"), "")).alias("hash"),
                _up(F.col("width"), fanout).alias("width"),
            ),
            "merkle-level",
        )
        spread = runs.select("*", F.posexplode("members").alias("at", "member"))
        pointers.append(
            spread.select(
                *(F.col(f"member.from_{c}").alias(c) for c in _NODE),
                *(F.col(c).alias(u) for c, u in zip(_NODE, _UP)),
                F.array(_steps(F.col("members.hash"), F.col("at"), top)).alias("steps"),
            )
        )
        nodes = runs.select(*_NODE, "hash", "width", *(F.col(c).alias(f"from_{c}") for c in _NODE))
        widest, height = -(-widest // fanout), height + 1
    left = alone[0]
    for more in alone[1:]:
        left = left.unionByName(more)
    return left, pointers, height


def _jump(pointers: DataFrame, root: tuple[str, int, int], height: int, fanout: int) -> DataFrame:
    """All nodes with the whole way to the root, after as many self-joins as ``height`` has binary digits."""
    distance = 1
    at_root = (F.col("up_key") == root[0]) & (F.col("up_level") == root[1]) & (F.col("up_place") == root[2])
    while distance < height:
        # Many nodes share an ancestor that is far up: they are dealt to copies of it.
        salts = fanout if distance > 1 else 1
        far = pointers.where((F.col("key") == TOP) | (F.col("level") >= distance)).select(
            *(F.col(c).alias(f"_{c}") for c in _NODE),
            *(F.col(c).alias(f"_{c}") for c in _UP),
            F.col("steps").alias("_steps"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
        same = F.pmod(F.col("place"), F.lit(salts)) == F.col("_salt")
        for c, u in zip(_NODE, _UP):
            same &= F.col(u) == F.col(f"_{c}")
        further = pointers.where(~at_root).join(far, same)
        further = further.select(*_NODE, *(F.col(f"_{c}").alias(c) for c in _UP), F.concat("steps", "_steps").alias("steps"))
        pointers = written(pointers.where(at_root).unionByName(further), "merkle-pointers")
        distance *= 2
    return pointers


def merkle_proofs(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """Adds ``subroot`` (the root of the leaf's group), ``root`` and ``steps`` (the proof) to every leaf.

    ``leaf`` is the column of leaf hashes. ``steps`` is an array from the leaf up to the root of
    ``struct<top, left, own, right>``: the hashes beside the node put together, its own, and whether the run is one of
    group roots. All columns of ``leaves`` pass through and must be of types that can be sorted; one that has the name of
    an added column gives way to it.
    """
    leaves = without(leaves, ADDED)
    carried = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(leaves.columns)))
    keyed = leaves.select(
        # Null first, then bytewise; no group's key is that of the top tree.
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("key"),
        F.col(order).alias("ordinal"),
        F.col(leaf).alias("hash"),
        carried.alias("carried"),
    )
    placed = places(written(keyed, "merkle-leaves"), ["key"], ["ordinal", "hash"], "merkle-places")
    members = F.sort_array(F.collect_list(F.struct("place", "hash", "carried")))
    bottom = placed.groupBy("key", F.expr(f"place div {fanout}").alias("place")).agg(
        members.alias("members"), F.max("group_size").alias("size")
    )
    lone = F.col("size") == 1
    bottom = written(
        bottom.select(
            "key",
            F.when(lone, 0).otherwise(1).alias("level"),
            "place",
            "members",
            F.when(lone, F.col("members")[0]["hash"]).otherwise(digest(F.array_join(F.col("members.hash"), ""))).alias("hash"),
            _up(F.col("size"), fanout).alias("width"),
        ),
        "merkle-runs",
    )
    empty = F.array().cast("array<struct<top:boolean,left:string,own:string,right:string>>")
    widest = bottom.agg(F.max("width")).first()[0]
    if widest is None:
        nothing = [F.lit(None).cast("string").alias(c) for c in ADDED[:2]]
        return leaves.select("*", *nothing, empty.alias("steps")).where(F.lit(False))
    nodes = bottom.select(*_NODE, "hash", "width", *(F.col(c).alias(f"from_{c}") for c in _NODE))
    subroots, pointers, height = _climb(nodes, widest, fanout, top=False)
    subroots = places(written(subroots.withColumnRenamed("place", "from_place"), "merkle-subroots"), [], ["key"], "merkle-top")
    subroots = subroots.select(
        F.lit(TOP).alias("key"), F.lit(0).alias("level"), "place", "hash", F.col("group_size").alias("width"),
        F.col("key").alias("from_key"), F.col("level").alias("from_level"), "from_place",
    )
    groups = subroots.count()
    _, above, more = _climb(subroots, groups, fanout, top=True)
    # One row: the node that nothing stands above.
    if more:
        last = above[-1].select(*_UP, F.col("steps")[0].alias("step")).first()
        root_key = (last["up_key"], last["up_level"], last["up_place"])
        root = digest(F.lit(last["step"]["left"]), F.lit(last["step"]["own"]), F.lit(last["step"]["right"]))
    else:
        only = subroots.first()
        root_key, root = (only["from_key"], only["from_level"], only["from_place"]), F.lit(only["hash"])
    found = bottom
    if pointers or above:
        whole = [*pointers, *above]
        every = whole[0]
        for part in whole[1:]:
            every = every.unionByName(part)
        ways = _jump(every, root_key, height + more, fanout)
        found = bottom.join(ways.select(*_NODE, "steps"), _NODE, "left")
    else:
        found = bottom.withColumn("steps", empty)
    spread = found.select(
        "level", "members", F.coalesce("steps", empty).alias("above"), F.posexplode("members").alias("at", "member")
    )
    own = F.array(_steps(F.col("members.hash"), F.col("at"), False))
    spread = spread.select(
        "member", F.when(F.col("level") == 0, F.col("above")).otherwise(F.concat(own, "above")).alias("steps")
    )
    at_top = F.filter("steps", lambda step: step["top"])
    return spread.select(
        *(F.col(f"member.carried.c{i}").alias(c) for i, c in enumerate(leaves.columns)),
        F.coalesce(F.get(at_top, F.lit(0))["own"], root).alias("subroot"),
        root.alias("root"),
        "steps",
    )
