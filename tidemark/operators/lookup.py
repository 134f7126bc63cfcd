"""Reads of the current-value table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import HIDDEN_PREFIX
from tidemark.session import broadcast_limit, plan_bytes


def choose_features(available: Sequence[str], names: Sequence[str] | None = None) -> list[str]:
    """Visible features by name: none named means all, unknown names are left out."""
    visible = [c for c in available if not c.startswith(HIDDEN_PREFIX)]
    return [c for c in visible if c in names] if names else visible


def unexpired(snapshot: DataFrame, now: Any, expires_at: str = "expires_at") -> DataFrame:
    """Rows whose time to live has not run out at `now`."""
    return snapshot.where(F.col(expires_at) > F.lit(now))


def _requested(ids: DataFrame, snapshot: DataFrame, by: str) -> DataFrame:
    """Snapshot rows that may be asked for.

    A left join cannot broadcast its left side, so a small list of ids would make the whole
    snapshot shuffle; the semi join filters it in place first.
    """
    if plan_bytes(ids) <= broadcast_limit(ids.sparkSession):
        return snapshot.join(ids.select(by).distinct(), by, "left_semi")
    return snapshot


def online_lookup(
    ids: DataFrame,
    snapshot: DataFrame,
    names: Sequence[str] | None = None,
    *,
    by: str = "entity_id",
    features: Sequence[str],
    found: str | None = "found",
) -> DataFrame:
    """Each requested id with its current values; `found` is false where there is none."""
    chosen = choose_features(features, names)
    rows = _requested(ids, snapshot, by).select(by, *chosen, F.lit(True).alias("_found"))
    joined = ids.join(rows, by, "left")
    flag = [F.col("_found").isNotNull().alias(found)] if found else []
    return joined.select(*ids.columns, *chosen, *flag)


def missing_entities(ids: DataFrame, snapshot: DataFrame, *, by: str = "entity_id") -> DataFrame:
    """Requested ids without a current row; repeated requests stay repeated."""
    return ids.join(_requested(ids, snapshot, by).select(by), by, "left_anti")


def delete_entities(snapshot: DataFrame, deletions: DataFrame, *, by: str = "entity_id") -> DataFrame:
    """The snapshot without the listed entities."""
    return snapshot.join(deletions.select(by).distinct(), by, "left_anti")


def wide_listing(
    values: DataFrame, names: Sequence[str], *, by: str, key: str, value: str, order: Sequence[str]
) -> DataFrame:
    """One column per key from key/value rows, newest value each; absent keys are null.

    The keys come from the schema, so the data is not scanned for them.
    """
    newest = F.max_by(value, F.struct(*order))
    return values.groupBy(by).pivot(key, list(names)).agg(newest)


def display_listing(rows: DataFrame, features: Sequence[str], *, by: str = "entity_id") -> DataFrame:
    """Text listing of current values in which absent values are empty."""
    from tidemark.functions.codecs import encode_value

    cells = []
    for name in features:
        text = encode_value(F.col(name), rows.schema[name].dataType)
        cells.append(F.when(F.col(name).isNull(), "").otherwise(text).alias(name))
    return rows.select(by, *cells)
