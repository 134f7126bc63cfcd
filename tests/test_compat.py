import pytest
from pyspark.sql import types as T

from tidemark.model import SPEC_TYPE, Feature, FeatureViewSpec
from tidemark.operators.compat import audit, check_compatibility, spec_diff

PAIRS = T.StructType(
    [
        T.StructField("case", T.StringType()),
        T.StructField("old_spec", SPEC_TYPE),
        T.StructField("new_spec", SPEC_TYPE),
        T.StructField("mode", T.StringType()),
    ]
)


def spec(*features, entity="entity_id", ts="event_timestamp"):
    parts = []
    for text in features:
        name, dtype, *default = text.split(":")
        parts.append(Feature(name, dtype, default=default[0] if default else None))
    return FeatureViewSpec("v", tuple(parts), entity, ts)


AGE, NAME, CITY = "age:int64", "name:string", "city:string:unknown"
# case: (mode, old, new, compatible, word in an error, word in a warning)
CASES = {
    "backward add optional": ("BACKWARD", spec(AGE, "score:float64"), spec(AGE, "score:float64", CITY), True, "", ""),
    "backward add required": ("BACKWARD", spec(AGE), spec(AGE, NAME), True, "", ""),
    "backward remove required": ("BACKWARD", spec(AGE, NAME), spec(AGE), False, "'name'", ""),
    "backward remove optional": ("BACKWARD", spec(AGE, CITY), spec(AGE), True, "", "'city'"),
    "backward retype": ("BACKWARD", spec(AGE), spec("age:string"), False, "'age'", ""),
    "forward add optional": ("FORWARD", spec(AGE), spec(AGE, CITY), True, "", "'city'"),
    "forward add required": ("FORWARD", spec(AGE), spec(AGE, NAME), False, "'name'", ""),
    "forward remove": ("FORWARD", spec(AGE, NAME), spec(AGE), True, "", ""),
    "full add optional": ("FULL", spec(AGE), spec(AGE, CITY), True, "", "'city'"),
    "full widen": ("FULL", spec(AGE), spec("age:float64"), False, "'age'", ""),
    "none": ("NONE", spec(AGE), spec("score:bool"), True, "", ""),
    "none renames": ("NONE", spec(AGE), spec(AGE, entity="user_id"), True, "", ""),
    "entity renamed": ("BACKWARD", spec(AGE), spec(AGE, entity="user_id"), False, "entity_column", ""),
    "time renamed": ("FORWARD", spec(AGE), spec(AGE, ts="at"), False, "timestamp_column", ""),
}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(name, old.as_row(), new.as_row(), mode) for name, (mode, old, new, *_) in CASES.items()]
    return spark.createDataFrame(rows, PAIRS)


def test_cases(pairs):
    for row in check_compatibility(pairs).collect():
        _, _, _, compatible, error, warning = CASES[row["case"]]
        assert row["compatible"] == compatible, row["case"]
        assert bool(row["errors"]) == (not compatible), row["case"]
        assert all(error in e for e in row["errors"]), row["case"]
        assert bool(row["warnings"]) == bool(warning) and all(warning in w for w in row["warnings"]), row["case"]


def test_full_reports_a_retyped_feature_in_both_directions(pairs):
    found = audit(pairs.where("case = 'full widen'"), ["case"]).orderBy("position").collect()
    assert [r["message"] for r in found] == [
        "BACKWARD: field 'age' type changed 'int64' → 'float64'. Type changes break backward compatibility.",
        "FORWARD: field 'age' type changed 'int64' → 'float64'.",
    ]


def test_falsy_defaults_count_and_repeated_names_take_the_last(spark):
    old = FeatureViewSpec(
        "v",
        (
            Feature("a", "int64"),
            Feature("b", "bool", default=False),
            Feature("c", "string", default=""),
            Feature("d", "string", default="it's"),
            Feature("a", "int64", default=0),
        ),
    )
    row = check_compatibility(spark.createDataFrame([("x", old.as_row(), spec().as_row(), "FULL")], PAIRS)).first()
    assert row["compatible"]
    assert [w.rsplit("=", 1)[1] for w in row["warnings"]] == ["0.", "False.", "''.", '"it\'s".']


def test_first_registration_has_no_findings(spark):
    row = check_compatibility(spark.createDataFrame([("x", None, spec(AGE).as_row(), "FULL")], PAIRS)).first()
    assert row["compatible"] and row["errors"] == [] and row["warnings"] == []


def test_spec_diff(pairs):
    rows = spec_diff(pairs.where("case IN ('backward remove required', 'full widen', 'forward add optional')"), ["case"])
    assert {(r["case"], r["feature_name"], r["change"]) for r in rows.collect()} == {
        ("backward remove required", "age", "same"),
        ("backward remove required", "name", "removed"),
        ("full widen", "age", "retyped"),
        ("forward add optional", "age", "same"),
        ("forward add optional", "city", "added"),
    }


def test_findings_are_worked_out_once_per_pair(pairs):
    """A filter on the size of the list, pushed below it, would hold all the rules again."""
    for df, wording in (
        (audit(pairs, ["case"]), "BACKWARD: field '%s' removed from new schema but had no default"),
        (spec_diff(pairs, ["case"]), "array_union"),
    ):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(wording) == 1
