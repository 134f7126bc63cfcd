"""Field-wise last-writer-wins merge of partial updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import ordering


def present(feature: str, keys: str = "feature_keys") -> Column:
    """Whether the update sets `feature`; an explicit null counts as set."""
    return F.array_contains(keys, feature)


def merge_fields(
    updates: DataFrame,
    features: Sequence[str],
    *,
    by: str | Sequence[str] = "entity_id",
    order: Sequence[str] = ("ingest_seq",),
    keys: str = "feature_keys",
    last: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per entity: each feature from the newest update that sets it.

    Features an update leaves out survive from older ones. `order` is arrival order for
    the behaviour of an in-place hash write, or event time first for event-time order.
    `last` names columns taken from the newest update whatever it sets; `extra` adds
    further named aggregates.
    """
    by = [by] if isinstance(by, str) else list(by)
    newest = ordering(order)
    values = [F.max_by(f, F.when(present(f, keys), newest)).alias(f) for f in features]
    seen = [F.max(present(f, keys)).alias(f"_has_{i}") for i, f in enumerate(features)]
    others = [F.max_by(c, newest).alias(c) for c in last]
    merged = updates.groupBy(*by).agg(*values, *seen, *others, *extra)
    named = F.array(*[F.when(F.col(f"_has_{i}"), F.lit(f)) for i, f in enumerate(features)])
    helpers = [f"_has_{i}" for i in range(len(features))]
    return merged.withColumn(keys, F.array_compact(named.cast("array<string>"))).drop(*helpers)


def since_reset(
    writes: DataFrame,
    *,
    by: str = "entity_id",
    order: Sequence[str] = ("seq",),
    written_at: str = "written_at",
    expires_at: str = "expires_at",
    deleted: str = "deleted",
) -> DataFrame:
    """Drop writes that a later expiry or deletion wiped out.

    A write that arrives at or after the expiry set by the write before it starts a new
    row, and so does the write after a deletion. Expects at most one row per entity and
    batch, so that a group is as long as the number of batches not yet compacted.
    """
    by_time = Window.partitionBy(by).orderBy(*order)
    removes = F.coalesce(F.col(deleted), F.lit(False))
    lapsed = F.coalesce(F.col(written_at) >= F.lag(expires_at).over(by_time), F.lit(False))
    after_removal = F.coalesce(F.lag(removes).over(by_time), F.lit(False))
    starts = lapsed | removes | after_removal
    epochs = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = writes.withColumn("_starts", starts.cast("int"))
    numbered = flagged.withColumn("_epoch", F.sum("_starts").over(epochs))
    newest = F.max("_epoch").over(Window.partitionBy(by))
    return (
        numbered.withColumn("_newest", newest)
        .where((F.col("_epoch") == F.col("_newest")) & ~removes)
        .drop("_starts", "_epoch", "_newest")
    )
