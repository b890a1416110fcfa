"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix grows with its weight up to ``max_epochs`` times its size;
what it cannot take is shared out again by weight. Within a source, documents lie on
a tape in the order of a hash of their id, and the mix takes the tape up to the
source's target, a second time where the target is larger than the source. So only the
document at the end is taken in part. Each source has a schedule: its rate at time t
of the training is ``1 + d (1 - 2t)`` times its mean rate. The integral of the schedule
is inverted to give each copy on the tape a position in the training from 0 to 1, and
documents are range-sorted by it.

Sums along a tape are made in two steps, within hash buckets and over the buckets, so
a source with most of the rows is still spread over all tasks. All steps are DataFrame
functions. A null text has size 0; a null source is a source of its own and comes last;
null ids come first on the tape; equal rows are taken one after the other; a column that
has the name of an added one gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderlake.llm.schema import without

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (0.5, 0.0, -0.5)
BUCKET_DIGITS = 3

_OWN = ("_key", "_bucket", "_hash", "_tilt", "_within", "_before", "_start", "_words")
ADDED = ("size", "source_size", "target", "taken", "position")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    tilts: Sequence[float] = TILTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
) -> DataFrame:
    """One row a source: ``_key, source_size, target, _tilt``. One row a source meets in the windows."""
    by_key, by_load = W.orderBy("_key"), W.orderBy("_load", "_key")
    place = (F.row_number().over(by_key) - 1) % F.lit(len(weights))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))
    everything = W.partitionBy()
    sources = (
        sizes.groupBy("_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumns({"_weight": pick(weights), "_tilt": pick(tilts), "_cap": F.col("source_size") * F.lit(max_epochs)})
        .withColumns({
            "_load": F.col("_cap") / F.col("_weight"),
            "_demand": F.sum("source_size").over(everything) * F.lit(share),
            "_all": F.sum("_weight").over(everything),
        })
    )
    before = by_load.rowsBetween(W.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    capped = sources.withColumn(
        "_full",
        (F.col("_demand") - sum_before("_cap")) * F.col("_weight")
        > F.col("_cap") * (F.col("_all") - sum_before("_weight")),
    )
    sum_full = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(F.lit(0.0))).over(everything)
    rest = capped.withColumns({"_rest": F.col("_demand") - sum_full("_cap"), "_open": F.col("_all") - sum_full("_weight")})
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_rest") * F.col("_weight") / F.col("_open"))
    return rest.select("_key", "source_size", target.alias("target"), "_tilt")


def training_position(share: Column, tilt: Column) -> Column:
    """When a source has given ``share`` of its target: t with t + tilt·t·(1-t) = share."""
    root = F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)
    return F.when(tilt == 0, share).otherwise((1 + tilt - root) / (2 * tilt))


def curriculum_plan(docs: DataFrame, **mix) -> DataFrame:
    """Adds ``size, source_size, target, taken`` and ``position`` (of the first copy; null where nothing is taken)."""
    docs = without(docs, [*ADDED, *_OWN])
    digest = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.withColumns({"size": word_count(F.col("text")), "_key": _source_key(F.col("source")), "_hash": digest})
    keyed = keyed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    small = keyed.select("_key", "_bucket", "size")
    buckets = small.groupBy("_key", "_bucket").agg(F.sum("size").alias("size"))
    over = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("size").over(over), F.lit(0)))
    frame = buckets.drop("size").join(source_targets(buckets, **mix), "_key")
    tape = W.partitionBy("_key", "_bucket").orderBy("_hash", "doc_id", "size")
    placed = keyed.withColumn("_within", F.sum("size").over(tape.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(frame, ["_key", "_bucket"]).withColumns({
        "_start": F.col("_before") + F.col("_within"),
        "_words": F.floor(F.col("target") + 0.5),
    })
    first, more = _copy(0), _copy(1)
    middle = F.col("_start") + first / 2.0
    position = F.when(first > 0, training_position(F.try_divide(middle, F.col("_words")), F.col("_tilt")))
    return placed.withColumns({"taken": first + more, "position": position})


def _copy(epoch: int) -> Column:
    """Words taken of a document in one pass over its source's tape."""
    left = F.col("_words") - F.lit(epoch) * F.col("source_size") - F.col("_start")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def plan_columns(docs: DataFrame, **mix) -> DataFrame:
    """The plan range-sorted by the position of the first copy; documents of which nothing is taken come last."""
    plan = curriculum_plan(docs, **mix)
    return plan.orderBy(F.col("position").asc_nulls_last(), "_hash", "doc_id").drop(*_OWN)


def mixed_documents(docs: DataFrame, **mix) -> DataFrame:
    """The mix itself, in training order: the columns of ``docs``, one row a copy.

    A document that the mix takes in part keeps its first words, joined by one space.
    """
    copies = F.array(*(
        F.struct(
            _copy(k).alias("words"),
            training_position(
                F.try_divide(F.lit(k) * F.col("source_size") + F.col("_start") + _copy(k) / 2.0, F.col("_words")),
                F.col("_tilt"),
            ).alias("position"),
        )
        for k in (0, 1)
    ))
    plan = curriculum_plan(docs, **mix)
    rows = plan.withColumn("_copy", F.explode(F.filter(copies, lambda c: c["words"] > 0)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_copy.words").cast("int")), " ")
    whole = F.col("_copy.words") == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(cut)
    out = rows.withColumn("_text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("_text")))
    out = out.withColumn("text", F.col("_text"))
    return out.orderBy(F.col("_copy.position"), F.col("_hash")).select(*without(docs, [*ADDED, *_OWN]).columns)
