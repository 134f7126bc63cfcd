"""Small per-row rules: payloads, message keys, times and time to live."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.codecs import encode_value
from tidemark.model import DEFAULT_TTL_SECONDS, FeatureViewSpec


def payload_keys(json_text: Column) -> Column:
    """Names an update sets; null when the text is not a JSON object."""
    return F.json_object_keys(json_text)


def parse_payload(json_text: Column, spec: FeatureViewSpec) -> Column:
    """The payload as the view's typed struct; bytes travel as base64 text."""
    return F.from_json(json_text, spec.struct(), {"mode": "PERMISSIVE"})


def payload_json(spec: FeatureViewSpec, keys: str = "feature_keys") -> Column:
    """The typed features as a JSON object that holds exactly the keys an update set."""
    names = spec.feature_names
    sets = {n: F.array_contains(keys, n) for n in names}
    # A feature that is not set is null here, and null fields are left out.
    values = F.to_json(F.struct(*[F.when(sets[n], F.col(n)).alias(n) for n in names])) if names else F.lit("{}")
    cleared = [F.when(sets[n] & F.col(n).isNull(), F.lit(json.dumps(n) + ":null")) for n in names]
    nulls = F.concat_ws(",", *cleared)
    any_value = F.lit(False)
    for n in names:
        any_value = any_value | (sets[n] & F.col(n).isNotNull())
    comma = F.when(any_value & (nulls != ""), ",").otherwise("")
    return F.concat(F.lit("{"), nulls, comma, F.substr(values, F.lit(2)))


def message_key(view: Column, entity: Column) -> Column:
    return F.concat_ws(":", view, entity)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def ttl_or_default(ttl: Column | int | None, view_ttl: Column | int | None = None) -> Column:
    """First of the two that is set and not 0, else the default."""
    as_column = [t if isinstance(t, Column) else F.lit(t).cast("int") for t in (ttl, view_ttl)]
    return F.coalesce(*[F.nullif(t, F.lit(0)) for t in as_column], F.lit(DEFAULT_TTL_SECONDS))


def expires_at(written_at: Column, ttl: Column) -> Column:
    return written_at + F.make_dt_interval(secs=ttl.cast("decimal(18,6)"))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text with or without offset; text without one is taken as UTC."""
    return F.try_to_timestamp(text)


def as_timestamp(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def stored_text(spec: FeatureViewSpec) -> list[Column]:
    """Every feature in the text form of the hash store."""
    return [encode_value(F.col(f.name), f.dataType).alias(f.name) for f in spec.struct().fields]
