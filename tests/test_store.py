import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureTables, FeatureViewSpec
from tidemark.plans.store import IncompatibleSchema
from tidemark.session import scratch_path
from tidemark.sources import messages

T0 = dt.datetime(2024, 1, 1)
SPEC = FeatureViewSpec(
    "user_stats",
    (
        Feature("score", "float64"),
        Feature("age", "int64", default=18),
        Feature("active", "bool"),
        Feature("recent", "list_int64"),
    ),
    ttl_seconds=3600,
    tags={"team": "growth"},
)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def json_rows(spark, *rows):
    values = [(e, f if isinstance(f, str) else json.dumps(f), t) for e, f, t in rows]
    return spark.createDataFrame(values, "entity_id string, features string, event_timestamp timestamp")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


@pytest.fixture(scope="module")
def store(spark):
    outbox = scratch_path(spark, "outbox")
    made = FeatureTables(
        spark,
        scratch_path(spark, "store"),
        updates={"format": "parquet", "path": f"{outbox}/updates"},
        changes={"format": "parquet", "path": f"{outbox}/changes"},
    )
    made.outbox = outbox
    assert made.register_schema(SPEC, now=T0) == 1
    return made


def test_registering_and_catalog(spark, store):
    wider = FeatureViewSpec(
        "plans", (Feature("a", "int64"), Feature("b", "string", default="x")), entity_column="user_id"
    )
    assert store.register_schema(wider, "FULL", now=T0) == 1
    with pytest.raises(IncompatibleSchema, match=r"refused under BACKWARD: BACKWARD: field 'a' removed"):
        store.register_schema(FeatureViewSpec("plans", (Feature("b", "string"),), entity_column="user_id"))
    newer = FeatureViewSpec("plans", (*wider.features, Feature("c", "bool")), entity_column="user_id")
    # The stored mode is FULL and refuses what the mode of a request may accept.
    assert not store.check_schema(newer)["compatible"]
    assert store.register_schema(newer, "BACKWARD", now=hours(1)) == 2
    assert store.check_schema(FeatureViewSpec("new_view", ()))["mode"] == "NONE"
    assert len(store.check_schema(FeatureViewSpec("new_view", ()))["warnings"]) == 1

    assert store.latest_version_number("plans") == 2
    assert store.latest_version_number("nothing") is None
    assert [(r["version"], r["is_latest"]) for r in store.list_schema_versions("plans").collect()] == [
        (2, True),
        (1, False),
    ]
    assert store.get_schema("plans", 1).count() == 1 and store.get_schema("plans", 7).count() == 0
    assert store.spec("plans") == newer
    listed = {r["name"]: r for r in store.view_listing().collect()}
    assert listed["plans"]["feature_count"] == 3 and listed["plans"]["updated"] == "2024-01-01T01:00:00"

    assert store.deactivate_view("plans", now=hours(2)) and store.deactivate_view("plans", now=hours(3))
    assert not store.deactivate_view("nothing")
    assert not store.view_exists("plans") and store.view_exists("user_stats")
    with pytest.raises(LookupError):
        store.spec("plans")
    assert store.register_schema(newer, "BACKWARD", now=hours(4)) == 3
    assert not store.view_exists("plans"), "registering again does not revive a view"
    changes = [json.loads(r["value"]) for r in spark.read.parquet(f"{store.outbox}/changes").collect()]
    seen = {(c["feature_view"], c["old_version"], c["new_version"], c["change_type"]) for c in changes}
    assert {("plans", None, 1, "create"), ("plans", 1, 2, "update"), ("plans", 2, 3, "update")} <= seen


def test_proposals_must_be_one_per_view(spark, store):
    from tidemark.plans.store import PROPOSALS

    row = (FeatureViewSpec("twice", ()).as_row(), "NONE")
    with pytest.raises(ValueError, match="one schema per view"):
        store.register_schemas(spark.createDataFrame([row, row], PROPOSALS))


def test_write_publish_and_point_in_time(spark, store):
    rows = json_rows(
        spark,
        ("u1", {"score": 0.5, "recent": [1, 2]}, hours(-2)),
        ("u1", {"score": 0.9, "active": True}, hours(-1)),
        ("u2", {"score": 0.8}, hours(-3)),
    )
    assert store.write_features("user_stats", rows, now=T0) == 3
    sent = spark.read.parquet(f"{store.outbox}/updates").collect()
    assert {r["key"] for r in sent} == {"user_stats:u1", "user_stats:u2"}
    bodies = [json.loads(r["value"]) for r in sent]
    assert {"score": 0.9, "active": True} in [b["features"] for b in bodies]
    assert all(b["schema_version"] == 1 and b["logged"] and b["producer_id"] == "api" for b in bodies)
    logged = {r["message_id"] for r in store.log.read(SPEC).collect()}
    assert {b["message_id"] for b in bodies} == logged

    spine = store.spine([("u1", hours(-1.5)), ("u2", hours(-3)), ("u3", hours(0)), ("u1", hours(-1.5))])
    found = store.get_historical_features("user_stats", spine, ordered=True).collect()
    assert [r["features"] and r["features"]["score"] for r in found] == [0.5, 0.8, None, 0.5]
    assert found[0]["features"]["recent"] == [1, 2] and found[0]["feature_timestamp"] == hours(-2)
    named = store.get_historical_features("user_stats", spine, ["score", "nope"], ordered=True).first()
    assert named["features"].asDict() == {"score": 0.5}
    filled = store.get_historical_features("user_stats", spine, fill_defaults=True, ordered=True).collect()
    assert [r["features"] and r["features"]["age"] for r in filled] == [18, 18, None, 18]
    newest = {r["entity_id"]: r["score"] for r in store.latest("user_stats").collect()}
    assert newest == {"u1": 0.9, "u2": 0.8}
    assert [r["score"] for r in store.latest("user_stats", ids(spark, "u1", "u9")).collect()] == [0.9]


def test_bad_rows_refuse_the_request(spark, store):
    before = store.log.read(SPEC).count()
    for bad in ({"score": 1.0, "hat": 2}, "[1]"):
        with pytest.raises(ValueError, match="refused"):
            store.write_features("user_stats", json_rows(spark, ("u1", {"score": 1.0}, T0), ("u2", bad, T0)))
    with pytest.raises(LookupError):
        store.write_features("nothing", json_rows(spark, ("u1", {}, T0)))
    assert store.log.read(SPEC).count() == before


def test_log_replay_range_and_stats(spark, store):
    spec = FeatureViewSpec("replayed", (Feature("v", "float64"),))
    rows = json_rows(spark, ("a", {"v": 1.0}, hours(0)), ("a", {"v": 2.0}, hours(30)), ("b", {"v": 3.0}, None))
    store.register_schema(spec, now=T0)
    empty = store.feature_stats("replayed", now=T0).first()
    assert (empty["total_rows"], empty["unique_entities"], empty["earliest_ts"]) == (0, 0, None)
    for _ in range(2):
        assert store.write_features("replayed", rows, now=hours(1), batch="one") == 3
    stats = store.feature_stats("replayed", now=T0).first()
    assert (stats["total_rows"], stats["unique_entities"], stats["online_entities"]) == (3, 2, 0)
    assert (stats["earliest_ts"], stats["latest_ts"]) == (hours(0), hours(30))
    ranged = store.log.read(spec, start=hours(1), end=hours(30))
    assert sorted(r["v"] for r in ranged.collect()) == [2.0, 3.0]
    # A newer spec reads old files with nulls for what they lack.
    wider = FeatureViewSpec("replayed", (*spec.features, Feature("w", "string")))
    assert {r["w"] for r in store.log.read(wider).collect()} == {None}
    assert store.delete_view_data("replayed") == 3
    assert store.log.read(spec).count() == 0


def online(store, wanted, *, now, view="user_stats", **options):
    found, missing = store.get_online_features(view, ids(store.spark, *wanted), now=now, **options)
    return {r["entity_id"]: r for r in found.collect()}, sorted(r[0] for r in missing.collect())


def test_online_values(spark, store):
    spec = FeatureViewSpec("live", SPEC.features, ttl_seconds=3600)
    store.register_schema(spec, now=T0)
    table = store.online("live")
    schema = "entity_id string, ingest_seq long, event_timestamp timestamp, feature_keys array<string>, score double, age long, active boolean, recent array<long>"

    def write(rows, **options):
        return table.upsert(spark.createDataFrame(rows, schema), **options)

    first = [
        ("a", 1, hours(0), ["score", "age", "active"], 0.9, 25, True, None),
        ("b", 2, hours(0), ["score"], 0.1, None, None, None),
        ("b", 3, hours(1), ["age"], None, 7, None, None),
    ]
    assert write([], now=T0) == 0
    assert write(first, now=T0, batch="first") == 3
    assert write(first, now=T0, batch="first") == 0, "a batch is applied once"
    text, missing = online(store, ["a", "zz", "zz"], now=hours(0.5), view="live", typed=False)
    assert (text["a"]["score"], text["a"]["age"], text["a"]["active"]) == ("0.9", "25", "True")
    assert missing == ["zz", "zz"]
    typed, _ = online(store, ["b"], now=hours(0.5), view="live", names=["age", "score", "nope"])
    assert typed["b"].asDict() == {"entity_id": "b", "score": 0.1, "age": 7}

    # A partial write keeps the other fields and prolongs the whole row.
    assert write([("a", 1, hours(-5), ["score"], 0.2, None, None, None)], now=hours(0.9)) == 1
    for _ in range(2):
        values, missing = online(store, ["a", "b"], now=hours(1.5), view="live")
        assert (values["a"]["score"], values["a"]["age"]) == (0.2, 25) and missing == ["b"]
        stored = table.current(now=hours(1.5)).first()
        assert stored["event_ts_ms"] == int(hours(-5).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        table.compact(now=hours(1.5))

    # After the expiry the old fields do not come back.
    write([("a", 1, hours(5), ["score"], 0.3, None, None, None)], now=hours(5))
    values, _ = online(store, ["a"], now=hours(5), view="live")
    assert (values["a"]["score"], values["a"]["age"]) == (0.3, None)
    assert store.delete_online_features("live", ids(spark, "a"), now=hours(5)) == 1
    assert online(store, ["a"], now=hours(5), view="live") == ({}, ["a"])
    assert write([("a", 1, hours(6), ["age"], None, 1, None, None)], now=hours(5.1), ttl=10) == 1
    values, _ = online(store, ["a"], now=hours(5.1), view="live")
    assert values["a"].asDict() == {"entity_id": "a", "score": None, "age": 1, "active": None, "recent": None}
    assert online(store, ["a"], now=hours(5.1) + dt.timedelta(seconds=10), view="live")[1] == ["a"]


def test_lookup_reads_only_the_buckets_it_needs(spark):
    store = FeatureTables(spark, scratch_path(spark, "buckets"))
    spec = FeatureViewSpec("many", (Feature("v", "int64"),))
    store.register_schema(spec, now=T0)
    table = store.online("many")
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("entity_id"),
        F.col("id").alias("ingest_seq"),
        F.lit(T0).alias("event_timestamp"),
        F.array(F.lit("v")).alias("feature_keys"),
        F.col("id").alias("v"),
    )
    assert table.upsert(rows, now=T0) == 200
    table.compact(now=T0, buckets=16)
    asked = ids(spark, "3", "77", "nobody")
    assert sorted(r["v"] for r in table.current(now=T0, only=asked).collect()) == [3, 77]
    assert table.current(now=T0).count() == 200
    plan = table.current(now=T0, only=asked)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    # A delta on top of a bucketed base.
    table.upsert(rows.where("id = 3").withColumn("v", F.lit(-1).cast("long")), now=T0)
    assert sorted(r["v"] for r in table.current(now=T0, only=asked).collect()) == [-1, 77]
    table.compact(now=T0, buckets=4)
    assert table.current(now=T0).agg(F.sum("v")).first()[0] == sum(range(200)) - 4


def test_materialize_and_runs(spark, store):
    spec = FeatureViewSpec("daily", (Feature("v", "float64"), Feature("w", "string")))
    store.register_schema(spec, now=T0)
    rows = json_rows(
        spark, ("a", {"v": 1.0, "w": "x"}, hours(0)), ("a", {"v": 2.0}, hours(9)), ("b", {"v": 3.0}, hours(1))
    )
    store.write_features("daily", rows, now=hours(9))
    job = store.materialize("daily", end=hours(5), now=hours(10))
    assert (job["status"], job["entities_materialized"]) == ("completed", 1)
    assert online(store, ["a", "b"], now=hours(10), view="daily")[1] == ["a"]
    job = store.materialize("daily", end=hours(5), as_of_end=True, now=hours(11))
    values, _ = online(store, ["a", "b"], now=hours(11), view="daily")
    assert job["entities_materialized"] == 2 and values["a"]["v"] == 1.0
    store.materialize("daily", now=hours(12))
    values, _ = online(store, ["a"], now=hours(12), view="daily")
    assert (values["a"]["v"], values["a"]["w"]) == (2.0, "x"), "the refresh merges into the row"
    with pytest.raises(LookupError):
        store.materialize("nothing", now=hours(13))
    runs = store.runs().collect()
    assert [r["status"] for r in runs] == ["failed", "completed", "completed", "completed"]
    assert "no active view" in runs[0]["error"] and store.runs("daily").count() == 3
    assert store.runs(job_id=job["job_id"]).first()["entities_materialized"] == 2


def test_materialize_all_keeps_going(spark):
    store = FeatureTables(spark, scratch_path(spark, "bulk"))
    for name in ("one", "two"):
        store.register_schema(FeatureViewSpec(name, (Feature("v", "float64"),)), now=T0)
        store.write_features(name, json_rows(spark, ("a", {"v": 1.0}, T0)), now=T0)
    jobs = store.materialize_all(now=T0)
    assert [(j["feature_view"], j["status"], j["entities_materialized"]) for j in jobs] == [
        ("one", "completed", 1),
        ("two", "completed", 1),
    ]


def test_json_files(spark, tmp_path):
    (tmp_path / "rows.json").write_text(
        json.dumps([{"entity_id": "a", "features": {"v": 1.5}, "event_timestamp": "2024-01-01T02:00:00+02:00"}])
    )
    row = messages.read_feature_rows(spark, str(tmp_path / "rows.json")).first()
    assert (row["entity_id"], json.loads(row["features"]), row["event_timestamp"]) == ("a", {"v": 1.5}, T0)
    (tmp_path / "spine.json").write_text(json.dumps([["b", "2024-01-01T00:00:00Z"], ["a", "2024-01-01"]]))
    spine = messages.read_spine(spark, str(tmp_path / "spine.json")).collect()
    assert [tuple(r) for r in spine] == [(0, "b", T0), (1, "a", T0)]
    (tmp_path / "spec.json").write_text(
        json.dumps(
            {
                "name": "v",
                "features": [
                    {"name": "a", "dtype": "int64", "default": 0},
                    {"name": "b", "dtype": "string", "default": "x", "tags": {"k": "v"}},
                    {"name": "c", "dtype": "bool"},
                    {"name": "d", "dtype": "string", "default": None},
                ],
                "ttl_seconds": 5,
            }
        )
    )
    spec = FeatureViewSpec.from_row(messages.read_specs(spark, str(tmp_path / "spec.json")).first()["spec"])
    assert spec.entity_column == "entity_id" and spec.ttl_seconds == 5
    assert [f.default for f in spec.features] == [0, "x", None, None] and spec.features[1].tags == {"k": "v"}


def test_source_columns_come_from_the_spec(spark):
    store = FeatureTables(spark, scratch_path(spark, "mapped"))
    spec = FeatureViewSpec("m", (Feature("v", "float64"),), entity_column="uid", timestamp_column="at")
    store.register_schema(spec, now=T0)
    source = spark.createDataFrame([(7, T0, 1)], "uid long, at timestamp, v int")
    assert store.write_rows("m", store.source_rows("m", source), now=T0) == 1
    row = store.log.read(spec).first()
    assert (row["entity_id"], row["v"], row["feature_keys"]) == ("7", 1.0, ["v"])
