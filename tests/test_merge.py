import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.latest import latest_in_range, latest_per_entity
from tidemark.operators.merge import merge_fields, since_reset

BASE = dt.datetime(2024, 1, 1)
UPDATES = "entity_id string, ingest_seq long, event_timestamp timestamp, feature_keys array<string>, a double, b string"


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def test_fields_survive_and_arrival_or_event_order_decides(spark):
    rows = [
        ("x", 1, at(10), ["a", "b"], 1.0, "one"),
        ("x", 2, at(5), ["a"], 2.0, None),
        ("x", 3, at(20), ["b"], None, None),
        ("y", 4, at(0), ["a"], 7.0, None),
    ]
    updates = spark.createDataFrame(rows, UPDATES)
    by_arrival = {r["entity_id"]: r for r in merge_fields(updates, ["a", "b"]).collect()}
    assert (by_arrival["x"]["a"], by_arrival["x"]["b"]) == (2.0, None)  # an explicit null replaces
    assert by_arrival["x"]["feature_keys"] == ["a", "b"]
    assert by_arrival["y"]["feature_keys"] == ["a"] and by_arrival["y"]["b"] is None
    by_event = merge_fields(updates, ["a", "b"], order=["event_timestamp", "ingest_seq"])
    assert by_event.where("entity_id = 'x'").first()["a"] == 1.0


def test_merge_equals_a_hash_written_in_order(spark):
    rng = random.Random(11)
    rows, store = [], {}
    for seq in range(400):
        entity = f"e{rng.randrange(12)}"
        keys = rng.sample(["a", "b"], rng.randrange(3))
        a, b = rng.choice([None, rng.random()]), rng.choice([None, "s", "t"])
        rows.append((entity, seq, at(rng.randrange(50)), keys, a if "a" in keys else None, b if "b" in keys else None))
        values = {"a": rows[-1][4], "b": rows[-1][5]}
        store.setdefault(entity, {}).update({k: values[k] for k in keys})
    merged = merge_fields(spark.createDataFrame(rows, UPDATES).orderBy(F.rand(1)), ["a", "b"]).collect()
    assert {r["entity_id"]: {k: r[k] for k in r["feature_keys"]} for r in merged} == store


def test_reset_after_expiry_and_deletion(spark):
    schema = "entity_id string, seq long, written_at timestamp, expires_at timestamp, deleted boolean"
    rows = [
        ("kept", 1, at(0), at(10), False),
        ("kept", 2, at(9), at(12), False),
        ("lapsed", 1, at(0), at(10), False),
        ("lapsed", 2, at(10), at(20), False),
        ("shortened", 1, at(0), at(100), False),
        ("shortened", 2, at(1), at(2), False),
        ("shortened", 3, at(50), at(60), False),
        ("gone", 1, at(0), at(10), False),
        ("gone", 2, at(1), None, True),
        ("back", 1, at(0), at(10), False),
        ("back", 2, at(1), None, True),
        ("back", 3, at(2), at(10), False),
    ]
    left = since_reset(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["entity_id"], r["seq"]) for r in left) == [
        ("back", 3),
        ("kept", 1),
        ("kept", 2),
        ("lapsed", 2),
        ("shortened", 3),
    ]


def test_latest_row_and_time_range(spark):
    rows = [("x", at(0), 1), ("x", at(30), 2), ("x", at(30), 3), ("y", at(10), 4)]
    log = spark.createDataFrame(rows, "entity_id string, event_timestamp timestamp, seq long")
    order = ["event_timestamp", "seq"]
    assert {r["entity_id"]: r["seq"] for r in latest_per_entity(log, order=order).collect()} == {"x": 3, "y": 4}
    dropped = latest_in_range(log, order=order, start=at(0), end=at(20)).collect()
    assert {r["entity_id"] for r in dropped} == {"y"}
    rolled_back = latest_in_range(log, order=order, start=at(0), end=at(20), as_of_end=True).collect()
    assert {r["entity_id"]: r["seq"] for r in rolled_back} == {"x": 1, "y": 4}
