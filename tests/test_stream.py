import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureTables, FeatureViewSpec
from tidemark.model import UPDATE_MESSAGE
from tidemark.plans.materialize import newest_rows
from tidemark.session import scratch_path
from tidemark.sources.messages import read_updates
from tidemark.streaming import propagate as propagate_module
from tidemark.streaming.propagate import apply_batch, propagate

T0 = dt.datetime(2024, 1, 1)
SPEC = FeatureViewSpec("clicks", (Feature("n", "int64"), Feature("page", "string")), ttl_seconds=600)


def message(i, entity, features, view="clicks", minutes=0, **extra):
    at = (T0 + dt.timedelta(minutes=minutes)).isoformat() + "Z"
    body = {
        "message_id": f"m{i}",
        "feature_view": view,
        "entity_id": entity,
        "features": features,
        "event_timestamp": at,
        "schema_version": 1,
        "producer_id": "test",
        "produced_at": at,
        **extra,
    }
    return (f"{view}:{entity}", json.dumps(body))


@pytest.fixture
def store(spark):
    made = FeatureTables(spark, scratch_path(spark, "stream"))
    made.register_schema(SPEC, now=T0)
    return made


def feed(spark, path, rows):
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").json(path)


def run(store, source, **options):
    updates = read_updates(store.spark, {"format": "json", "path": source})
    query = propagate(store, updates, f"{store.root}/checkpoint", clock=lambda: T0, **options)
    query.awaitTermination()


def current(store, now=T0):
    rows = store.online("clicks").current(now=now).collect()
    return {r["entity_id"]: (r["n"], r["page"]) for r in rows}


def test_updates_reach_log_and_current_values(spark, store):
    source = scratch_path(spark, "feed")
    feed(
        spark,
        source,
        [
            message(1, "a", {"n": 1, "page": "x"}),
            message(2, "b", {"n": 5}, minutes=3),
            message(3, "a", {"n": 2}, minutes=-9),
            message(4, "a", {"n": 3, "colour": "red"}),
            message(5, "a", {"n": 3}, view="unknown"),
            message(6, "c", {"n": 8}, logged=True),
            ("broken", "{not json"),
            message(7, None, {"n": 8}),
            message(8, "d", {"n": 8}, event_timestamp=None),
        ],
    )
    run(store, source)
    # The late event replaces the newer value: arrival order decides.
    assert current(store) == {"a": (2, "x"), "b": (5, None), "c": (8, None)}
    log = {r["message_id"] for r in store.log.read(SPEC).collect()}
    assert log == {"m1", "m2", "m3"}, "a row that is logged already is not appended again"
    refused = spark.read.parquet(f"{store.root}/quarantine")
    assert sorted((r["problem"], r["message_id"] or "") for r in refused.collect()) == [
        ("no entity", "m7"),
        ("no event time", "m8"),
        ("no such view", ""),
        ("no such view", "m5"),
        ("unknown features: colour", "m4"),
    ]
    feed(spark, source, [message(9, "b", {"page": "y"}, minutes=4)])
    run(store, source)
    assert current(store)["b"] == (5, "y")
    assert store.log.read(SPEC).count() == 4
    # The view's time to live counts from the write.
    assert current(store, T0 + dt.timedelta(seconds=599)) and not current(store, T0 + dt.timedelta(seconds=600))


def batch_of(spark, rows):
    raw = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "ingest_seq long, value string")
    return raw.select("ingest_seq", F.from_json("value", UPDATE_MESSAGE).alias("m")).select("m.*", "ingest_seq")


def test_a_replayed_batch_changes_nothing(spark, store):
    batch = batch_of(spark, [message(1, "a", {"n": 1}), message(2, "a", {"page": "p", "bad": 1})])
    for _ in range(2):
        apply_batch(store, batch, "updates-0", now=T0)
        assert store.log.read(SPEC).count() == 1
        assert current(store) == {"a": (1, None)}
        assert spark.read.parquet(f"{store.root}/quarantine").count() == 1


def test_ttl_choices(spark, store):
    apply_batch(store, batch_of(spark, [message(1, "a", {"n": 1})]), "u-0", now=T0, ttl=None)
    apply_batch(store, batch_of(spark, [message(2, "b", {"n": 1})]), "u-1", now=T0, ttl=5)
    expiry = {r["entity_id"]: r["expires_at"] for r in store.online("clicks").current(now=T0).collect()}
    assert expiry == {"a": T0 + dt.timedelta(days=1), "b": T0 + dt.timedelta(seconds=5)}


def test_repeated_messages_are_dropped_on_request(spark, store):
    source = scratch_path(spark, "feed")
    feed(spark, source, [message(1, "a", {"n": 1}), message(1, "a", {"n": 1}), message(2, "a", {"n": 2})])
    run(store, source, dedupe_within="1 hour")
    assert sorted(r["message_id"] for r in store.log.read(SPEC).collect()) == ["m1", "m2"]


def test_refresh_and_stream_agree_on_full_rows_in_order(spark, store):
    rows = [message(i, f"e{i % 4}", {"n": i, "page": f"p{i}"}, minutes=i) for i in range(20)]
    apply_batch(store, batch_of(spark, rows), "u-0", now=T0)
    newest = newest_rows(store.log.read(SPEC)).collect()
    assert {r["entity_id"]: (r["n"], r["page"]) for r in newest} == current(store)


def test_published_writes_come_back_through_the_stream(spark):
    outbox = scratch_path(spark, "outbox")
    store = FeatureTables(spark, scratch_path(spark, "loop"), updates={"format": "json", "path": outbox})
    store.register_schema(SPEC, now=T0)
    rows = spark.createDataFrame([("a", '{"n": 4}', T0)], "entity_id string, features string, event_timestamp timestamp")
    assert store.write_features("clicks", rows, now=T0) == 1
    run(store, outbox)
    assert current(store) == {"a": (4, None)}
    assert store.log.read(SPEC).count() == 1, "one log row per message"


def test_a_batch_is_checked_once(spark, store, monkeypatch):
    """Log, current values and quarantine all read the checked rows; none of them checks again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(problem):
        seen.add(1)
        return problem

    plain = propagate_module._checked
    count = F.udf(counted, "string")
    monkeypatch.setattr(propagate_module, "_checked", lambda *a: plain(*a).withColumn("problem", count("problem")))
    rows = [(f"m{i}", "clicks", f"u{i % 7}", '{"n": 1}' if i % 5 else '{"x": 1}', T0, T0) for i in range(40)]
    names = "message_id string, feature_view string, entity_id string, features string, event_timestamp timestamp, produced_at timestamp"
    batch = spark.createDataFrame(rows, names).withColumn("logged", F.lit(False))
    apply_batch(store, batch, "b-0", now=T0)
    assert seen.value == 40
    assert store.log.read(SPEC).count() == 32 and len(current(store)) == 7
    assert spark.read.parquet(f"{store.root}/quarantine").count() == 8
