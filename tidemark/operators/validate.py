"""Checks of feature rows against a view's schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import parse_payload, payload_keys
from tidemark.model import FeatureViewSpec


def unknown_features(keys: Column, names: Sequence[str]) -> Column:
    """Names an update sets that the schema does not know."""
    return F.array_except(keys, F.array(*[F.lit(n) for n in names]).cast("array<string>"))


def parse_rows(
    rows: DataFrame, spec: FeatureViewSpec, *, check_types: bool = True, retired: Column | None = None
) -> DataFrame:
    """Rows with JSON payloads as typed columns, `feature_keys` and `problem`.

    `problem` is null for a valid row. Missing features are allowed. A value that does not fit its
    dtype is a problem; without `check_types` it reads as null. `retired` names features that a row
    may still set although the schema has dropped them; they are left out.
    """
    others = [c for c in rows.columns if c != "features"]
    keys = payload_keys(F.col("features"))
    if retired is not None:
        known = F.array(*[F.lit(n) for n in spec.feature_names]).cast("array<string>")
        keys = F.array_except(keys, F.array_except(F.coalesce(retired, F.array().cast("array<string>")), known))
    # Columns of their own, so that the text is parsed once per row rather than once per use.
    parsed = rows.select(
        *others, keys.alias("feature_keys"), parse_payload(F.col("features"), spec).alias("_p"),
        F.from_json("features", "map<string,string>").alias("_raw"),
    )
    unknown = unknown_features(F.col("feature_keys"), spec.feature_names)
    problem = (
        F.when(F.col("entity_id").isNull(), "no entity")
        .when(F.col("feature_keys").isNull(), "payload is not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown features: "), F.array_join(F.array_sort(unknown), ", ")))
    )
    if check_types:
        for name in spec.feature_names:
            misfit = F.col("_p")[name].isNull() & F.col("_raw")[name].isNotNull()
            problem = problem.when(misfit, f"wrong type: {name}")
    typed = [F.col("_p")[n].alias(n) for n in spec.feature_names]
    return parsed.select(*others, "feature_keys", *typed, problem.alias("problem"))
