"""Counts over the log and the current-value table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import unexpired


def _measures(entity: str, ts: str) -> list[Column]:
    return [
        F.count("*").alias("total_rows"),
        F.count_distinct(entity).alias("unique_entities"),
        F.min(ts).alias("earliest_ts"),
        F.max(ts).alias("latest_ts"),
    ]


def offline_stats(log: DataFrame, *, entity: str = "entity_id", ts: str = "event_timestamp") -> DataFrame:
    """One row of log statistics; an empty log gives zeros and nulls."""
    return log.agg(*_measures(entity, ts))


def offline_stats_by_view(
    log: DataFrame, *, view: str = "feature_view", entity: str = "entity_id", ts: str = "event_timestamp"
) -> DataFrame:
    return log.groupBy(view).agg(*_measures(entity, ts))


def online_count(
    snapshot: DataFrame,
    now: Any,
    *,
    by: Sequence[str] = (),
    approximate: bool = False,
    entity: str = "entity_id",
) -> DataFrame:
    """Entities with an unexpired row, exactly or as a sketch."""
    measure = F.approx_count_distinct(entity) if approximate else F.count("*")
    return unexpired(snapshot, now).groupBy(*by).agg(measure.alias("online_entities"))


def view_stats(offline: DataFrame, online: DataFrame, *, view: str = "feature_view") -> DataFrame:
    """Log statistics with the online count beside them, 0 where nothing is online."""
    return offline.join(online, view, "left").withColumn(
        "online_entities", F.coalesce("online_entities", F.lit(0).cast("long"))
    )
