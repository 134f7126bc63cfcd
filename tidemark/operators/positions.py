"""Gapless places of rows in a global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

# `monotonically_increasing_id` holds the partition above these bits and the place in it below.
PLACE_BITS = 33


def _ordered(name: str) -> Column:
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_first()


def with_positions(
    df: DataFrame, order: Sequence[str], *, within: Sequence[str] = (), name: str = "position", total: str | None = None
) -> DataFrame:
    """Every row with its place, counted from 0 without gaps, in the order of the columns `order`.

    A column named with a leading "-" descends, nulls last; the others ascend, nulls first. Places
    begin anew in every group of the columns `within`, nulls being a group like any other; `total`
    names a column for the number of rows of the group. Columns of these names are replaced.

    Rows are spread over tasks by ranges of (within, order) and sorted there; only the rows that
    each task holds of each group are counted and added up, one number for a task and group. A group
    or a key that most rows share is spread over many tasks, and rows that are equal in all these
    columns get places of their own, in any order. The sorted rows are written once to the shared
    scratch folder, so that places hold when executors are lost; pass the columns wanted only. An
    empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in (name, total)]
    # The last column breaks ties by the input's order; without it a hot key could not be split.
    ranges = [*map(_ordered, within), *map(_ordered, order), F.col("_tie")]
    tied = df.select(*kept, F.monotonically_increasing_id().alias("_tie"))
    placed = tied.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    rows = stored(placed.select(*kept, F.monotonically_increasing_id().alias("_at")), "positions")

    rows = rows.withColumn("_task", F.shiftright("_at", PLACE_BITS))
    held = rows.groupBy(*within, "_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        *[F.col(c).alias(f"_of_{c}") for c in within],
        F.col("_task").alias("_in"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(group).alias("_total"),
    )
    same = F.col("_task") == F.col("_in")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    more = [F.col("_total").alias(total)] if total else []
    return rows.join(starts, same).select(*kept, (F.col("_at") + F.col("_shift")).alias(name), *more)
