"""Places of rows in an order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderlake.llm.scratch import written

_IN_TASK = (1 << 33) - 1


def places(df: DataFrame, by: list[str], order: list[str], purpose: str) -> DataFrame:
    """Adds ``place`` (from 0, within the rows of equal ``by``) and ``group_size``, both long.

    Rows are range-sorted by ``by`` and ``order`` over all tasks, however many rows a group has; a group's rows in one
    partition are a run. Runs are counted, and sums over a group's runs (one a partition at most) give where each
    begins. Nulls come first and are one group. Rows that are equal in ``by`` and ``order`` are spread like others,
    and their places follow the input's order. ``df`` should be a written table: it is read twice, and the places of
    equal rows hold only while it stays the same. The sorted rows are written to the shared folder.
    """
    spread = df.withColumn("_spread", F.monotonically_increasing_id())
    keys = [*by, *order, "_spread"]
    ranged = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_spread")
    rows = written(
        ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(_IN_TASK)}),
        purpose,
    )
    runs = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    over = W.partitionBy(*by)
    before = over.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_run_part"),
        *(F.col(c).alias(f"_run_{c}") for c in by),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(over).alias("group_size"),
    )
    same = F.col("_part") == F.col("_run_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_run_{c}"))
    placed = rows.join(runs, same).withColumn("place", F.col("_at") + F.col("_shift"))
    return placed.select(*df.columns, "place", "group_size")
