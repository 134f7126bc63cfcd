"""The list of a log's parts: replays, numbers, packing, readers that are under way."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureViewSpec
from tidemark.session import scratch_path
from tidemark.sources.commits import FOLD_EVERY, Commits
from tidemark.sources.feature_log import FeatureLog

T0 = dt.datetime(2024, 1, 1)
OLD = FeatureViewSpec("v", (Feature("a", "int64"),))
NEW = FeatureViewSpec("v", (Feature("a", "string"), Feature("b", "float64")))


@pytest.fixture
def log(spark):
    return FeatureLog(spark, scratch_path(spark, "parts"))


def rows(spark, *pairs, minutes=0):
    at = T0 + dt.timedelta(minutes=minutes)
    return spark.createDataFrame([(e, at, a) for e, a in pairs], "entity_id string, event_timestamp timestamp, a long")


def held(df):
    return sorted((r["entity_id"], r["a"]) for r in df.collect())


def test_replay_under_other_types_counts_once(spark, log):
    assert log.append(OLD, rows(spark, ("x", 1), ("y", 2)), now=T0, batch="updates-7") == 2
    assert log.append(OLD, rows(spark, ("z", 3)), now=T0, batch="updates-8") == 1
    assert log.append(NEW, rows(spark, ("x", 10)), now=T0, batch="updates-7") == 1
    assert held(log.read(NEW)) == [("x", "10"), ("z", "3")]
    assert held(log.read(OLD)) == [("x", 10), ("z", 3)]
    assert held(log.read_batch(NEW, "updates-7")) == [("x", "10")]
    assert log.read_batch(NEW, "never").count() == 0


def test_reader_under_way_sees_the_old_rows(spark, log):
    log.append(OLD, rows(spark, ("x", 1)), now=T0, batch="b")
    before = log.read(OLD)
    log.append(OLD, rows(spark, ("x", 2)), now=T0, batch="b")
    assert held(before) == [("x", 1)] and held(log.read(OLD)) == [("x", 2)]
    assert log.vacuum(OLD) == 0
    assert log.vacuum(OLD, older_than_seconds=-60) == 1
    assert held(log.read(OLD)) == [("x", 2)]


def test_writing_that_fails_changes_nothing(spark, log):
    log.append(OLD, rows(spark, ("x", 1)), now=T0, batch="b")
    bad = rows(spark, ("x", 5)).withColumn("a", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception):
        log.append(OLD, bad, now=T0, batch="b")
    assert held(log.read(OLD)) == [("x", 1)]


def test_number_of_a_batch_stays(spark, log):
    for name in ("b-0", "b-1", "b-2", "b-1"):
        log.append(OLD, rows(spark, ("x", int(name[2:]))), now=T0, batch=name)
    order = [r["a"] for r in log.read(OLD).orderBy("batch_seq", "ingest_seq").collect()]
    assert order == [0, 1, 2]


@pytest.mark.parametrize("replayed", [False, True])
def test_packing_keeps_rows_and_replays(spark, log, replayed):
    for i in range(5):
        log.append(OLD if i < 3 else NEW, rows(spark, ("e", i), (f"f{i}", i), minutes=i), now=T0, batch=f"b-{i}")
    before = held(log.read(NEW))
    order = [r["a"] for r in log.read(NEW).where("entity_id = 'e'").orderBy("batch_seq").collect()]
    under_way = log.read(NEW)
    assert log.pack(NEW) == 5 and log.pack(NEW) == 0
    assert held(log.read(NEW)) == before == held(under_way)
    assert [r["a"] for r in log.read(NEW).where("entity_id = 'e'").orderBy("batch_seq").collect()] == order
    assert len(log._commits("v").state()[0]["parts"]) == 1
    if replayed:
        log.append(NEW, rows(spark, ("e", 100)), now=T0, batch="b-2")
        expected = sorted([*(r for r in before if r not in [("e", "2"), ("f2", "2")]), ("e", "100")])
        assert held(log.read(NEW)) == expected
        assert log.pack(NEW) == 2 and held(log.read(NEW)) == expected
        assert held(log.read_batch(NEW, "b-2")) == [("e", "100")]


def test_batch_written_again_while_packing(spark, log, monkeypatch):
    for i in range(3):
        log.append(OLD, rows(spark, (f"e{i}", i)), now=T0, batch=f"b-{i}")
    write = FeatureLog._write

    def slow(self, spec, df):
        part = write(self, spec, df)
        monkeypatch.undo()
        log.append(OLD, rows(spark, ("e1", 50)), now=T0, batch="b-1")
        return part

    monkeypatch.setattr(FeatureLog, "_write", slow)
    log.pack(OLD)
    assert held(log.read(OLD)) == [("e0", 0), ("e1", 50), ("e2", 2)]


def test_packing_leaves_large_parts(spark, log):
    for i in range(4):
        log.append(OLD, rows(spark, (f"e{i}", i)), now=T0)
    size = log._commits("v").state()[0]["parts"][0]["bytes"]
    log.pack(OLD, target_bytes=int(2.5 * size))
    assert len(log._commits("v").state()[0]["parts"]) == 2
    assert log.pack(OLD, target_bytes=size // 2) == 0


def test_changes_since_a_record(spark, log):
    log.append(OLD, rows(spark, ("x", 1)), now=T0, batch="b-0")
    first, mark = log.changes(OLD)
    assert held(first) == [("x", 1)]
    log.append(OLD, rows(spark, ("y", 2)), now=T0, batch="b-1")
    log.pack(OLD)
    second, newer = log.changes(OLD, mark)
    assert held(second) == [("y", 2)] and newer > mark
    assert log.changes(OLD, newer)[0].count() == 0
    log.append(OLD, rows(spark, ("x", 9)), now=T0, batch="b-0")
    assert log.changes(OLD, newer)[0] is None
    _, last = log.changes(OLD)
    assert log.delete(OLD) == 2 and log.read(OLD).count() == 0
    assert log.changes(OLD, last)[0] is None


def test_numbers_are_given_once(spark):
    def apply(state, record):
        state["seen"].append([record["number"], record["who"]])

    path = scratch_path(spark, "commits")
    make = lambda: Commits(spark, path, lambda: {"seen": []}, apply)
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda who: make().add({"who": who}), range(2 * FOLD_EVERY + 10)))
    assert sorted(numbers) == list(range(1, 2 * FOLD_EVERY + 11))
    state, newest = make().state()
    assert newest == 2 * FOLD_EVERY + 10 and state["seen"] == sorted([n, w] for w, n in enumerate(numbers))
