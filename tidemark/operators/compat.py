"""Compatibility of two versions of a view's schema.

Both specs sit on one row, so the checks are expressions over their feature arrays: no
shuffle, and findings come out in the order of the declared features. The expressions are
written as SQL text, which is shorter here and built in one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the findings is part of the result.
BACKWARD_REMOVED = "BACKWARD: field '%s' removed from new schema but had no default — old data cannot be read."
BACKWARD_REMOVED_DEFAULT = "BACKWARD: field '%s' removed; old data will use default=%s."
BACKWARD_RETYPED = (
    "BACKWARD: field '%s' type changed '%s' → '%s'. Type changes break backward compatibility."
)
FORWARD_ADDED = (
    "FORWARD: new required field '%s' (no default) added to schema — old consumers cannot handle this data."
)
FORWARD_ADDED_DEFAULT = "FORWARD: new optional field '%s' added; old consumers will ignore it."
FORWARD_RETYPED = "FORWARD: field '%s' type changed '%s' → '%s'."
ENTITY_RENAMED = "entity_column renamed '%s' → '%s'. This is never compatible."
TIME_RENAMED = "timestamp_column renamed '%s' → '%s'."

NOTHING = "cast(array() AS array<struct<severity:string,message:string>>)"


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _finding(severity: str, wording: str, *parts: str) -> str:
    message = f"format_string({', '.join([_text(wording), *parts])})"
    return f"named_struct('severity', '{severity}', 'message', {message})"


def python_literal(json_text: str) -> str:
    """SQL for a JSON default as Python would print it."""
    text = f"get(from_json(concat('[', {json_text}, ']'), 'array<string>'), 0)"
    single, double = _text("'"), _text('"')
    return f"""CASE WHEN {json_text} = 'true' THEN 'True'
        WHEN {json_text} = 'false' THEN 'False'
        WHEN NOT startswith({json_text}, {double}) THEN {json_text}
        WHEN contains({text}, {single}) AND NOT contains({text}, {double}) THEN concat({double}, {text}, {double})
        ELSE concat({single}, {text}, {single}) END"""


def features_by_name(features: str) -> str:
    """SQL for features without repeated names: first position, last definition."""
    return f"""transform(array_distinct(transform({features}, f -> f.name)),
        n -> element_at(filter({features}, f -> f.name = n), -1))"""


# Readers on the new schema must understand data of the old one.
BACKWARD_RULE = f"""CASE
    WHEN _new_by_name[f.name] IS NULL AND f.`default` IS NULL THEN {_finding("error", BACKWARD_REMOVED, "f.name")}
    WHEN _new_by_name[f.name] IS NULL
        THEN {_finding("warning", BACKWARD_REMOVED_DEFAULT, "f.name", python_literal("f.`default`"))}
    WHEN _new_by_name[f.name].dtype <> f.dtype
        THEN {_finding("error", BACKWARD_RETYPED, "f.name", "f.dtype", "_new_by_name[f.name].dtype")} END"""

# Readers on the old schema must cope with data of the new one.
FORWARD_RULE = f"""CASE
    WHEN _old_by_name[f.name] IS NULL AND f.`default` IS NULL THEN {_finding("error", FORWARD_ADDED, "f.name")}
    WHEN _old_by_name[f.name] IS NULL THEN {_finding("warning", FORWARD_ADDED_DEFAULT, "f.name")}
    WHEN _old_by_name[f.name].dtype <> f.dtype
        THEN {_finding("error", FORWARD_RETYPED, "f.name", "_old_by_name[f.name].dtype", "f.dtype")} END"""


def _renamed(old: str, new: str, column: str, wording: str) -> str:
    before, after = f"`{old}`.{column}", f"`{new}`.{column}"
    return f"if({before} <> {after}, array({_finding('error', wording, before, after)}), {NOTHING})"


def _prepared(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Add the features of both specs without repeats, as lists and by name.

    As columns of their own they are worked out once per row rather than once per use.
    """
    listed = pairs.withColumns(
        {
            "_before": F.expr(features_by_name(f"`{old}`.features")),
            "_after": F.expr(features_by_name(f"`{new}`.features")),
        }
    )
    return listed.withColumns(
        {
            "_old_by_name": F.expr("map_from_entries(transform(_before, f -> struct(f.name, f)))"),
            "_new_by_name": F.expr("map_from_entries(transform(_after, f -> struct(f.name, f)))"),
        }
    )


def _findings(pairs: DataFrame, old: str, new: str, mode: str) -> DataFrame:
    """Add `_found`: the findings of a pair of specs under its mode, in rule order."""
    found = f"""CASE WHEN `{old}` IS NULL OR `{mode}` = 'NONE' THEN {NOTHING} ELSE concat(
        if(`{mode}` IN ('BACKWARD', 'FULL'),
           filter(transform(_before, f -> {BACKWARD_RULE}), x -> x IS NOT NULL), {NOTHING}),
        if(`{mode}` IN ('FORWARD', 'FULL'),
           filter(transform(_after, f -> {FORWARD_RULE}), x -> x IS NOT NULL), {NOTHING}),
        {_renamed(old, new, "entity_column", ENTITY_RENAMED)},
        {_renamed(old, new, "timestamp_column", TIME_RENAMED)}) END"""
    return _prepared(pairs, old, new).withColumn("_found", F.expr(found))


def _messages(severity: str) -> Column:
    return F.expr(f"transform(filter(_found, x -> x.severity = '{severity}'), x -> x.message)")


def check_compatibility(
    pairs: DataFrame, *, old: str = "old_spec", new: str = "new_spec", mode: str = "mode"
) -> DataFrame:
    """Add `compatible`, `errors` and `warnings`; a null old spec is a first registration."""
    return _findings(pairs, old, new, mode).select(
        *pairs.columns,
        _messages("error").alias("errors"),
        _messages("warning").alias("warnings"),
        F.expr("NOT exists(_found, x -> x.severity = 'error')").alias("compatible"),
    )


def audit(
    pairs: DataFrame, keys: Sequence[str], *, old: str = "old_spec", new: str = "new_spec", mode: str = "mode"
) -> DataFrame:
    """One row per finding, numbered in rule order."""
    # An inner explode would have the optimizer filter on the size of its list, below what makes the
    # list: all findings would be worked out twice for each pair.
    found = _findings(pairs, old, new, mode).select(*keys, F.posexplode_outer("_found").alias("position", "_f"))
    return found.where(F.col("position").isNotNull()).select(
        *keys, "position", F.col("_f.severity").alias("severity"), F.col("_f.message").alias("message")
    )


def spec_diff(pairs: DataFrame, keys: Sequence[str], *, old: str = "old_spec", new: str = "new_spec") -> DataFrame:
    """One row per feature of either spec: added, removed, retyped or same."""
    rows = F.expr(
        """transform(array_union(map_keys(_old_by_name), map_keys(_new_by_name)), n -> named_struct(
            'feature_name', n, 'old_dtype', _old_by_name[n].dtype, 'new_dtype', _new_by_name[n].dtype))"""
    )
    change = (
        F.when(F.col("old_dtype").isNull(), "added")
        .when(F.col("new_dtype").isNull(), "removed")
        .when(F.col("old_dtype") != F.col("new_dtype"), "retyped")
        .otherwise("same")
    )
    # Outer for the same reason as in `audit`; the keys of a map are never null.
    listed = _prepared(pairs, old, new).select(*keys, F.inline_outer(rows)).where(F.col("feature_name").isNotNull())
    return listed.withColumn("change", change)
