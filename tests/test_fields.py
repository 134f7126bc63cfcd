import datetime as dt
import json
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.codecs import decode_untyped, decode_value, encode_value, float_text
from tidemark.functions.fields import (
    epoch_ms,
    expires_at,
    message_key,
    parse_payload,
    payload_json,
    payload_keys,
    ttl_or_default,
)
from tidemark.model import DTYPES, Feature, FeatureViewSpec

SPEC = FeatureViewSpec(
    "v",
    (
        Feature("a", "float64"),
        Feature('b"x', "string"),
        Feature("c", "list_int64"),
        Feature("d", "bool"),
        Feature("e", "bytes"),
        Feature("f", "list_float64"),
    ),
)


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_float_text_reads_like_python(spark):
    values = [0.0, -0.0, 0.9, 25.0, 1e7, 12345678.9, 1e15, 1e16, 1e17, 1e-3, 1e-4, 1e-5, 1.5e-4, -2.5e8, 1e22, 1e100]
    values += [123456.789, 3.0e9, -0.00025, math.inf, -math.inf, math.nan]
    got = column(spark, values, "double").select(float_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [repr(v) for v in values]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(), min_size=1, max_size=50))
def test_float_text_keeps_the_value(spark, values):
    got = column(spark, values, "double").select(float_text(F.col("v"))).collect()
    for value, (text,) in zip(values, got):
        assert float(text) == value or (math.isnan(value) and text == "nan")


def test_encode(spark):
    cases = [("bool", [True, False, None], ["True", "False", "None"]), ("int64", [25, -1], ["25", "-1"])]
    cases += [("string", ["x", ""], ["x", ""]), ("list_int64", [[1, 2], []], ["[1, 2]", "[]"])]
    cases += [("list_float64", [[0.5, 1e7, math.nan]], ["[0.5, 10000000.0, NaN]"]), ("bytes", [b"hi"], ["aGk="])]
    for dtype, values, expected in cases:
        kind = DTYPES[dtype]
        got = column(spark, values, kind.simpleString()).select(encode_value(F.col("v"), kind)).collect()
        assert [r[0] for r in got] == expected


def test_decode(spark):
    texts = ["25", " 25 ", "25.7", "1_000", "abc", "", "1e3", "nan", "1.0d", "True", "yes", "0", "[1, 2]", "[x]", None]
    expected = {
        "int64": [25, 25, None, 1000, None, None, None, None, None, None, None, 0, None, None, None],
        "bool": [False] * 9 + [True, True, False, False, False, None],
        "list_int64": [None] * 12 + [[1, 2], None, None],
        "string": texts,
    }
    df = column(spark, texts, "string")
    for dtype, values in expected.items():
        assert [r[0] for r in df.select(decode_value(F.col("v"), dtype)).collect()] == values, dtype
    floats = [r[0] for r in df.select(decode_value(F.col("v"), "float64")).collect()]
    assert floats[:7] == [25.0, 25.0, 25.7, 1000.0, None, None, 1000.0]
    assert math.isnan(floats[7]) and floats[8:] == [None, None, None, 0.0, None, None, None]
    text, numbers = decode_untyped(F.col("v"))
    rows = df.select(text.alias("t"), numbers.alias("n")).collect()
    assert [r["t"] for r in rows] == texts and rows[12]["n"] == [1.0, 2.0] and rows[0]["n"] is None


def test_payload_round_trip(spark):
    payloads = [
        {"a": 1.5, 'b"x': 'q"]}', "c": [1, 2], "d": False, "f": [0.5]},
        {'b"x': None},
        {"a": None, "d": True, "c": None},
        {},
        {"e": "aGk="},
    ]
    df = column(spark, [json.dumps(p) for p in payloads], "string").select(
        payload_keys(F.col("v")).alias("feature_keys"), parse_payload(F.col("v"), SPEC).alias("p")
    )
    back = df.select("feature_keys", "p.*").select(payload_json(SPEC)).collect()
    assert [json.loads(r[0]) for r in back] == payloads


def test_bad_payloads(spark):
    keys = column(spark, ["nope", "[1]", "3", None], "string").select(payload_keys(F.col("v"))).collect()
    assert [r[0] for r in keys] == [None] * 4


def test_small_rules(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 999999)
    row = (
        spark.range(1)
        .select(
            ttl_or_default(None, None).alias("default"),
            ttl_or_default(0, 0).alias("zero"),
            ttl_or_default(None, 7).alias("view"),
            ttl_or_default(5, 7).alias("given"),
            expires_at(F.lit(at), F.lit(90)).alias("expires"),
            epoch_ms(F.lit(at)).alias("ms"),
            message_key(F.lit("v"), F.lit("e:1")).alias("key"),
        )
        .first()
    )
    assert (row["default"], row["zero"], row["view"], row["given"]) == (86400, 86400, 7, 5)
    assert row["expires"] == at + dt.timedelta(seconds=90)
    assert row["ms"] == 1704067200999 and row["key"] == "v:e:1"
