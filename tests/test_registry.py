import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.model import SCHEMA_VERSIONS, VIEW_EVENTS, Feature, FeatureViewSpec
from tidemark.operators import registry
from tidemark.operators.lookup import display_listing, missing_entities, online_lookup
from tidemark.operators.stats import online_count

T0 = dt.datetime(2024, 1, 1)


def test_numbering_within_groups(spark):
    """The busiest group holds most rows, with many of them on one day."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}"
        at = None if rng.random() < 0.05 else T0 + dt.timedelta(hours=rng.choice([1, 1, 2, 30, 700, rng.randrange(900)]))
        rows.append((group, at, i))
    numbered = registry.number_within(
        spark.createDataFrame(rows, "g string, at timestamp, i long"), by=["g"], ts="at", order=["i"]
    )
    expected = {}
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or T0, r[2]))
        expected.update({r[2]: n for n, r in enumerate(ordered, 1)})
    assert {r["i"]: r["version"] for r in numbered.collect()} == expected


def event(name, version, minutes, *, active=True, ttl=None):
    at = T0 + dt.timedelta(minutes=minutes)
    spec = ("entity_id", "event_timestamp", version, ttl, {}, "") if active else (None,) * 6
    return (name, *spec, active, at)


def test_catalog_folds_events(spark):
    events = [
        event("a", 1, 0, ttl=5),
        event("a", 2, 10, ttl=7),
        event("b", 1, 0),
        event("b", None, 5, active=False),
        event("b", 2, 9),
        event("c", 4, 1),
    ]
    views = registry.catalog(spark.createDataFrame(events, VIEW_EVENTS))
    found = {r["name"]: r for r in views.collect()}
    assert (found["a"]["schema_version"], found["a"]["ttl_seconds"], found["a"]["is_active"]) == (2, 7, True)
    assert (found["a"]["created_at"], found["a"]["updated_at"]) == (T0, T0 + dt.timedelta(minutes=10))
    assert not found["b"]["is_active"] and found["b"]["schema_version"] == 2
    spec = FeatureViewSpec("a", (Feature("x", "int64"), Feature("y", "bool"))).as_row()
    versions = spark.createDataFrame(
        [("a", 1, spec, "FULL", T0), ("a", 2, spec, "FULL", T0), ("b", 2, spec, "FULL", T0)], SCHEMA_VERSIONS
    )
    # b is retired, and the version c points to is not registered.
    listed = registry.view_listing(registry.views_with_spec(views, versions)).collect()
    assert [(r["name"], r["schema_version"], r["feature_count"]) for r in listed] == [("a", 2, 2)]
    assert registry.count_views(views).first()["views"] == 2
    rows = spark.createDataFrame([("a",), ("b",), ("zz",)], "feature_view string")
    assert [r[0] for r in registry.only_active(rows, views).collect()] == ["a"]
    assert {(r["feature_view"], r["version"]) for r in registry.with_is_latest(versions).where("is_latest").collect()} == {
        ("a", 2),
        ("b", 2),
    }
    feed = registry.change_feed(versions.where("feature_view = 'a'")).orderBy("new_version").collect()
    assert [tuple(r)[1:] for r in feed] == [(None, 1, "create"), (1, 2, "update")]


def test_newest_versions_are_marked_without_gathering_a_view(spark):
    spec = FeatureViewSpec("a", (Feature("x", "int64"),)).as_row()
    rows = [("hot", v, spec, "FULL", T0) for v in range(1, 200)] + [("b", 3, spec, "FULL", T0), ("b", 3, spec, "FULL", T0)]
    marked = registry.with_is_latest(spark.createDataFrame(rows, SCHEMA_VERSIONS))
    assert "Window" not in marked._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["feature_view"], r["version"]) for r in marked.where("is_latest").collect()]
    assert marked.count() == 201 and sorted(got) == [("b", 3), ("b", 3), ("hot", 199)]


def test_lookup_is_the_same_for_few_and_many_ids(spark):
    values = spark.range(50).select(F.col("id").cast("string").alias("entity_id"), "id", F.lit(None).cast("double").alias("__x"))
    ids = spark.createDataFrame([("1",), ("49",), ("50",), ("1",), ("50",)], "entity_id string")
    results = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("10MB", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            found = online_lookup(ids, values, features=["id", "__x"])
            missing = missing_entities(ids, values)
            results.append((sorted(map(tuple, found.collect()), key=repr), sorted(map(tuple, missing.collect()))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert results[0] == results[1]
    assert results[0][0] == sorted(
        [("1", 1, True), ("1", 1, True), ("49", 49, True), ("50", None, False), ("50", None, False)], key=repr
    )
    assert results[0][1] == [("50",), ("50",)]


def test_listing_and_counts(spark):
    schema = "entity_id string, score double, tags array<bigint>, expires_at timestamp"
    rows = [("a", 0.5, None, T0), ("b", None, [1, 2], T0 + dt.timedelta(hours=1))]
    current = spark.createDataFrame(rows, schema)
    listed = display_listing(current, ["score", "tags"]).orderBy("entity_id").collect()
    assert [tuple(r) for r in listed] == [("a", "0.5", ""), ("b", "", "[1, 2]")]
    assert online_count(current, T0).first()[0] == 1
    assert online_count(current, T0, approximate=True).first()[0] == 1
