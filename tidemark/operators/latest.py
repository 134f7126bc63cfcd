"""Newest whole row per entity."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordering(order: Sequence[str]) -> Column:
    """One comparable column out of several, most significant first."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def latest_per_entity(
    log: DataFrame,
    *,
    by: str | Sequence[str] = "entity_id",
    order: Sequence[str] = ("event_timestamp",),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The row with the largest `order` of each entity.

    Only one row per entity leaves each map task, so an entity that holds most of the log
    costs no more to shuffle than any other.
    """
    by = [by] if isinstance(by, str) else list(by)
    columns = [c for c in (columns or log.columns) if c not in by]
    newest = F.max_by(F.struct(*columns), ordering(order))
    return log.groupBy(*by).agg(newest.alias("_row")).select(*by, "_row.*")


def latest_for_entities(
    log: DataFrame,
    entities: DataFrame,
    *,
    by: str = "entity_id",
    order: Sequence[str] = ("event_timestamp",),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """`latest_per_entity` of the entities listed in another table."""
    wanted = log.join(entities.select(by).distinct(), by, "left_semi")
    return latest_per_entity(wanted, by=by, order=order, columns=columns)


def within(df: DataFrame, ts: str, start: Any = None, end: Any = None) -> DataFrame:
    """Time filter, inclusive at both ends; an end that is None does not filter."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def latest_in_range(
    log: DataFrame,
    *,
    ts: str = "event_timestamp",
    start: Any = None,
    end: Any = None,
    as_of_end: bool = False,
    **kwargs: Any,
) -> DataFrame:
    """Newest row per entity, kept only where it lies in the range.

    An entity whose newest row is later than `end` is left out, not rolled back. With
    `as_of_end` the log is cut at `end` first, which rolls such entities back.
    """
    if as_of_end:
        log = within(log, ts, end=end)
    return within(latest_per_entity(log, **kwargs), ts, start, end)
