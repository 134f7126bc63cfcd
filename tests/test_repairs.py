"""Cases in which rows were lost or changed without an error."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureTables, FeatureViewSpec
from tidemark.operators.asof import asof_join
from tidemark.operators.registry import catalog
from tidemark.session import scratch_path
from tidemark.sources.messages import KAFKA_CONSUMER, read_feature_rows, read_specs
from tidemark.sources.online_table import OnlineTable
from tidemark.streaming.propagate import apply_batch
from test_asof import LOG, SPINE, at, brute_force

T0 = dt.datetime(2024, 1, 1)
SPEC = FeatureViewSpec("v", (Feature("a", "int64"), Feature("b", "string"), Feature("c", "bool")), ttl_seconds=600)
ROWS = "entity_id string, features string, event_timestamp timestamp"
UPDATES = ROWS + ", message_id string, feature_view string, schema_version int, produced_at timestamp, logged boolean, ingest_seq long"


@pytest.fixture
def store(spark):
    made = FeatureTables(spark, scratch_path(spark, "repairs"))
    made.register_schema(SPEC, "NONE", now=T0)
    return made


def current(table, now=T0):
    return {r["entity_id"]: (r["a"], r["b"], r["c"]) for r in table.current(now=now).collect()}


def test_lines_and_arrays(spark, tmp_path):
    row = lambda i: json.dumps({"entity_id": str(i), "features": {"a": i}, "event_timestamp": "2024-01-01T00:00:00"})
    (tmp_path / "lines.json").write_text("\n".join(map(row, range(5))))
    (tmp_path / "array.json").write_text(" \n[\n" + ",\n".join(map(row, range(5, 9))) + "]")
    (tmp_path / "blank.json").write_text("\n  \n")
    got = read_feature_rows(spark, str(tmp_path))
    assert sorted(r["entity_id"] for r in got.collect()) == [str(i) for i in range(9)]
    assert read_feature_rows(spark, str(tmp_path / "lines.json")).count() == 5


def test_defaults_keep_their_text(spark, tmp_path):
    values = [0.0, [1, 2], 'a"b', "1", True, 12, ""]
    features = [{"name": f"f{i}", "dtype": "string", "default": v} for i, v in enumerate(values)]
    (tmp_path / "spec.json").write_text(json.dumps({"name": "v", "features": features}))
    spec = read_specs(spark, str(tmp_path)).first()["spec"]
    assert [f["default"] for f in spec["features"]] == [json.dumps(v) for v in values]


def test_no_cap_on_a_trigger():
    assert "maxOffsetsPerTrigger" not in KAFKA_CONSUMER


@pytest.mark.parametrize("payload", ['{"a": 25.0}', '{"a": "abc"}', '{"c": 1}', '{"b": "x", "a": true}'])
def test_misfits_are_refused(spark, store, payload):
    rows = spark.createDataFrame([("e", payload, T0), ("f", '{"a": 1}', T0)], ROWS)
    with pytest.raises(ValueError, match="1 rows refused .*wrong type"):
        store.write_features("v", rows, now=T0)
    updates = rows.selectExpr(
        "*", "entity_id AS message_id", "'v' AS feature_view", "1 AS schema_version",
        "event_timestamp AS produced_at", "false AS logged", "1L AS ingest_seq",
    )
    apply_batch(store, updates, "q-0", now=T0)
    assert current(store.online("v")) == {"f": (1, None, None)}
    refused = spark.read.parquet(f"{store.root}/quarantine").collect()
    assert [(r["entity_id"], r["problem"].split(":")[0]) for r in refused] == [("e", "wrong type")]


def test_all_problems_are_counted(spark, store):
    rows = spark.createDataFrame([("e", json.dumps({f"x{i:02}": 1}), T0) for i in range(15)], ROWS)
    with pytest.raises(ValueError, match="15 rows refused .*and 5 more problems"):
        store.write_features("v", rows, now=T0)


def test_absent_columns_are_not_set(spark, store):
    store.write_features("v", spark.createDataFrame([("e", '{"a": 1, "b": "x"}', T0)], ROWS), now=T0)
    later = T0 + dt.timedelta(minutes=1)
    store.write_rows("v", spark.createDataFrame([("e", later, 2)], "entity_id string, event_timestamp timestamp, a long"), now=later)
    keys = [r["feature_keys"] for r in store.log.read(SPEC).orderBy("event_timestamp").collect()]
    assert keys == [["a", "b"], ["a"]]


def test_messages_of_an_older_version(spark, store):
    store.register_schema(FeatureViewSpec("v", (Feature("a", "int64"),)), "NONE", now=T0)
    rows = [
        ("e", '{"a": 1, "b": "x"}', T0, "m1", "v", 1, T0, False, 1),
        ("f", '{"a": 2, "b": "x"}', T0, "m2", "v", 2, T0, False, 2),
        ("g", '{"a": 3, "z": 1}', T0, "m3", "v", 1, T0, False, 3),
    ]
    apply_batch(store, spark.createDataFrame(rows, UPDATES), "q-0", now=T0)
    assert {r["entity_id"]: r["a"] for r in store.online("v").current(now=T0).collect()} == {"e": 1}
    problems = {r["message_id"]: r["problem"] for r in spark.read.parquet(f"{store.root}/quarantine").collect()}
    assert problems == {"m2": "unknown features: b", "m3": "unknown features: z"}


def updates(spark, *rows):
    made = spark.createDataFrame([(e, v, i) for i, (e, v) in enumerate(rows)], "entity_id string, a long, ingest_seq long")
    return made.selectExpr(
        "*", "CAST(NULL AS string) AS b", "CAST(NULL AS boolean) AS c", "array('a') AS feature_keys",
        "timestamp'2024-01-01' AS event_timestamp",
    )


def test_two_writers_at_one_position(spark, monkeypatch):
    table = OnlineTable(spark, scratch_path(spark, "online"), SPEC)
    table.upsert(updates(spark, ("x", 1)), now=T0, batch="first")
    monkeypatch.setattr(table, "_position", lambda batch: (1, False))
    for name, entity in (("one", "y"), ("two", "z")):
        assert table.upsert(updates(spark, (entity, 5), ("x", len(name) + ord(name[0]))), now=T0, batch=name) == 2
    monkeypatch.undo()
    before = current(table)
    assert set(before) == {"x", "y", "z"}
    table.compact(now=T0)
    assert current(table) == before
    # A batch that took its number before the compaction and is listed after it.
    monkeypatch.setattr(table, "_position", lambda batch: (0, False))
    table.upsert(updates(spark, ("late", 9)), now=T0, batch="late")
    monkeypatch.undo()
    assert set(current(table)) == {"x", "y", "z", "late"}
    assert table.upsert(updates(spark, ("late", 7)), now=T0, batch="late") == 0
    table.compact(now=T0)
    assert current(table)["late"] == (9, None, None) and len(table._parts()) == 1


def test_catalog_of_two_versions_at_one_instant(spark):
    columns = "name string, entity_column string, timestamp_column string, schema_version int, ttl_seconds int, tags map<string,string>, description string, is_active boolean, changed_at timestamp"
    rows = [("v", "e", "t", n, None, {}, f"d{n}", True, T0) for n in (1, 2)]
    for order in (rows, rows[::-1]):
        assert catalog(spark.createDataFrame(order, columns).coalesce(1)).first()["schema_version"] == 2


@pytest.mark.parametrize("n, parts", [(40, 3), (41, 2), (60, 3), (130, 5)])
def test_one_entity_just_over_the_limit(spark, n, parts):
    log = [("hot", at(i % 17), i, float(i), "t") for i in range(n)]
    spine = [(i, "hot", at(i * 5)) for i in range(3)] + [(9, "cold", at(3))]
    for limit in (38, 40, 45):
        got = asof_join(
            spark.createDataFrame(spine, SPINE).repartition(2), spark.createDataFrame(log, LOG).repartition(parts),
            ties=["ingest_seq"], features=["score", "tier"], strategy="window", hot_rows=limit,
        )
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(spine, log)


def test_a_short_list_does_not_shuffle_the_log(spark, tmp_path):
    log = spark.range(2000).selectExpr(
        "cast(id % 50 AS string) AS entity_id", "timestamp_seconds(1704067200 + id) AS event_timestamp",
        "id AS ingest_seq", "cast(id AS double) AS score", "'t' AS tier",
    )
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    spine = spark.createDataFrame([(1, "7", at(20)), (2, "8", at(10))], SPINE)
    found = asof_join(spine, log, ties=["ingest_seq"], features=["score", "tier"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "_side" not in plan
    rows = [tuple(r) for r in log.collect()]
    assert {r["spine_id"]: r["score"] for r in found.collect()} == {
        1: max(r[3] for r in rows if r[0] == "7" and r[1] <= at(20)),
        2: max(r[3] for r in rows if r[0] == "8" and r[1] <= at(10)),
    }
    with pytest.raises(ValueError, match="too many"):
        many = spark.range(3000).selectExpr("id AS spine_id", "'7' AS entity_id", "timestamp_seconds(1704067200 + id) AS label_timestamp")
        asof_join(many, log, ties=["ingest_seq"], features=["score"], strategy="marks")


@pytest.mark.parametrize("name", ["__x", "batch", "seq", "deleted", "written_at", "problem", "message_id"])
def test_reserved_names_are_refused(name):
    with pytest.raises(ValueError, match=name):
        FeatureViewSpec("v", (Feature(name, "int64"),))


def test_untyped_lists_are_numbers(spark):
    store = FeatureTables(spark, scratch_path(spark, "lists"))
    store.register_schema(FeatureViewSpec("l", (Feature("xs", "list_int64"), Feature("n", "int64"))), now=T0)
    store.write_features("l", spark.createDataFrame([("e", '{"xs": [1, 2], "n": 3}', T0)], ROWS), now=T0)
    store.materialize("l", now=T0)
    found, _ = store.get_online_features("l", spark.createDataFrame([("e",)], "entity_id string"), now=T0, typed=False)
    assert found.select("xs", "n").first().asDict() == {"xs": [1.0, 2.0], "n": "3"}


def test_current_values_after_a_type_change(spark):
    root = scratch_path(spark, "retyped")
    old = FeatureViewSpec("v", (Feature("a", "int64"), Feature("b", "list_int64")), ttl_seconds=600)
    new = FeatureViewSpec("v", (Feature("a", "string"), Feature("b", "string"), Feature("c", "bool")), ttl_seconds=600)
    rows = spark.createDataFrame([("x", 1, [1, 2], 1)], "entity_id string, a long, b array<long>, ingest_seq long").selectExpr(
        "*", "array('a', 'b') AS feature_keys", "timestamp'2024-01-01' AS event_timestamp"
    )
    OnlineTable(spark, root, old).upsert(rows, now=T0, batch="one")
    table = OnlineTable(spark, root, new)
    assert current(table) == {"x": ("1", "[1,2]", None)}
    later = spark.createDataFrame([("x", "z", 2)], "entity_id string, a string, ingest_seq long").selectExpr(
        "*", "CAST(NULL AS string) AS b", "true AS c", "array('a', 'c') AS feature_keys", "timestamp'2024-01-01' AS event_timestamp"
    )
    table.upsert(later, now=T0, batch="two")
    assert current(table) == {"x": ("z", "[1,2]", True)}
    table.compact(now=T0)
    assert current(table) == {"x": ("z", "[1,2]", True)}
    back = {r["entity_id"]: (r["a"], r["b"]) for r in OnlineTable(spark, root, old).current(now=T0).collect()}
    assert back == {"x": (None, [1, 2])}
