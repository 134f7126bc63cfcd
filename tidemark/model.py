"""Data model: feature dtypes, view specs and the schemas of every table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# The closed set of feature dtypes and their Spark types.
DTYPES: dict[str, T.DataType] = {
    "float64": T.DoubleType(),
    "int64": T.LongType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "list_float64": T.ArrayType(T.DoubleType()),
    "list_int64": T.ArrayType(T.LongType()),
    "bytes": T.BinaryType(),
}

# Compatibility modes and the online TTL used when a view sets none.
MODES = ("BACKWARD", "FORWARD", "FULL", "NONE")
DEFAULT_TTL_SECONDS = 86400

# Features must not begin like this, nor have the name of a column that the tables add to them.
HIDDEN_PREFIX = "__"
TABLE_COLUMNS = frozenset(
    "entity_id event_timestamp event_date created_at batch_seq ingest_seq message_id feature_keys event_ts_ms written_at "
    "expires_at deleted batch bucket seq part n_updates problem payload".split()
)

TAGS = T.MapType(T.StringType(), T.StringType())

# `default` holds JSON text, so that a default of false, 0 or "" stays apart from none.
FEATURE_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("default", T.StringType()),
        T.StructField("tags", TAGS),
    ]
)

SPEC_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("entity_column", T.StringType()),
        T.StructField("timestamp_column", T.StringType()),
        T.StructField("features", T.ArrayType(FEATURE_TYPE)),
        T.StructField("ttl_seconds", T.IntegerType()),
        T.StructField("tags", TAGS),
        T.StructField("description", T.StringType()),
    ]
)

SCHEMA_VERSIONS = T.StructType(
    [
        T.StructField("feature_view", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("spec", SPEC_TYPE),
        T.StructField("compatibility_mode", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# One row per catalog change; the current catalog is a fold over these rows.
VIEW_EVENTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("entity_column", T.StringType()),
        T.StructField("timestamp_column", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("ttl_seconds", T.IntegerType()),
        T.StructField("tags", TAGS),
        T.StructField("description", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("changed_at", T.TimestampType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("feature_view", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("entities_materialized", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)

# Edge form of a feature row: the payload is a JSON object kept as text.
FEATURE_ROWS = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
    ]
)

UPDATE_MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("feature_view", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("producer_id", T.StringType()),
        T.StructField("produced_at", T.TimestampType()),
        T.StructField("logged", T.BooleanType()),
    ]
)

SCHEMA_CHANGE_MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("feature_view", T.StringType()),
        T.StructField("old_version", T.IntegerType()),
        T.StructField("new_version", T.IntegerType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("produced_at", T.TimestampType()),
    ]
)

SPINE = T.StructType(
    [
        T.StructField("spine_id", T.LongType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("label_timestamp", T.TimestampType()),
    ]
)

# Order of arrival of log rows: the number of their batch, then the place in it.
ARRIVAL = ("batch_seq", "ingest_seq")


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    description: str = ""
    default: Any = None
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValueError(f"unknown dtype {self.dtype!r} for feature {self.name!r}")

    def as_row(self) -> tuple:
        default = None if self.default is None else json.dumps(self.default)
        return (self.name, self.dtype, self.description, default, dict(self.tags))


@dataclass(frozen=True)
class FeatureViewSpec:
    name: str
    features: tuple[Feature, ...] | list[Feature]
    entity_column: str = "entity_id"
    timestamp_column: str = "event_timestamp"
    ttl_seconds: int | None = None
    tags: dict[str, str] = field(default_factory=dict)
    description: str = ""

    def __post_init__(self) -> None:
        bad = sorted({f.name for f in self.features if f.name.startswith(HIDDEN_PREFIX) or f.name in TABLE_COLUMNS})
        if bad:
            raise ValueError(f"names that the tables of '{self.name}' use themselves: {', '.join(bad)}")

    @property
    def feature_names(self) -> list[str]:
        return list({f.name: None for f in self.features})

    def struct(self) -> T.StructType:
        """Typed payload; of features declared twice the last one counts."""
        by_name = {f.name: f for f in self.features}
        return T.StructType([T.StructField(n, DTYPES[f.dtype]) for n, f in by_name.items()])

    def log_schema(self) -> T.StructType:
        """Schema of the view's append-only log, without its partition columns."""
        return T.StructType(
            [
                T.StructField("entity_id", T.StringType()),
                T.StructField("event_timestamp", T.TimestampType()),
                T.StructField("created_at", T.TimestampType()),
                T.StructField("batch_seq", T.LongType()),
                T.StructField("ingest_seq", T.LongType()),
                T.StructField("message_id", T.StringType()),
                T.StructField("feature_keys", T.ArrayType(T.StringType())),
                *self.struct().fields,
            ]
        )

    def online_schema(self) -> T.StructType:
        """Schema of the view's current-value table."""
        return T.StructType(
            [
                T.StructField("entity_id", T.StringType()),
                T.StructField("feature_keys", T.ArrayType(T.StringType())),
                T.StructField("event_ts_ms", T.LongType()),
                T.StructField("written_at", T.TimestampType()),
                T.StructField("expires_at", T.TimestampType()),
                T.StructField("deleted", T.BooleanType()),
                *self.struct().fields,
            ]
        )

    def as_row(self) -> tuple:
        return (
            self.name,
            self.entity_column,
            self.timestamp_column,
            [f.as_row() for f in self.features],
            self.ttl_seconds,
            dict(self.tags),
            self.description,
        )

    @classmethod
    def from_row(cls, row: Any) -> FeatureViewSpec:
        """Build a spec from a `SPEC_TYPE` row or the same shape as a plain dict."""
        data = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)
        features = []
        for f in data.pop("features"):
            f = {k: v for k, v in f.items() if v is not None}
            if hasattr(row, "asDict") and "default" in f:
                f["default"] = json.loads(f["default"])
            features.append(Feature(**f))
        data = {k: v for k, v in data.items() if v is not None}
        return cls(features=tuple(features), **data)
