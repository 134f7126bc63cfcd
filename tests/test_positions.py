"""Places in a global order against a sort of all rows in one process."""

import random

import pytest

from tidemark.operators.positions import with_positions

SCHEMA = "grp string, at long, note string, position long"


def _rows(seed: int, n: int):
    rng = random.Random(seed)
    groups = [None, "", "a", "hot", "hot", "hot"]
    return [(rng.choice(groups), rng.choice([None, *range(40)]), rng.choice([None, "x", "y"]), 7) for _ in range(n)]


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_places_within_groups(spark, n):
    rows = _rows(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = with_positions(df, ["at", "note"], within=["grp"], total="of").collect()
    assert len(got) == n
    by_group = {}
    for r in rows:
        by_group.setdefault(r[0], []).append(_key((r[1], r[2])))
    for grp, keys in by_group.items():
        mine = sorted((r for r in got if r["grp"] == grp), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(keys)))
        assert [_key((r["at"], r["note"])) for r in mine] == sorted(keys)
        assert {r["of"] for r in mine} == {len(keys)}


def test_places_descending_over_all_rows(spark):
    rows = _rows(3, 300)
    got = with_positions(spark.createDataFrame(rows, SCHEMA).repartition(4), ["-at"]).collect()
    got.sort(key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(300))
    expected = sorted((r[1] for r in rows), key=lambda v: (v is None, -(v or 0)))
    assert [r["at"] for r in got] == expected


def test_equal_rows_are_spread_over_tasks(spark):
    """One key that all rows share neither meets in one task nor shares a place."""
    df = spark.range(0, 20000, numPartitions=8).selectExpr("'same' as grp", "1 as at")
    placed = with_positions(df, ["at"], within=["grp"])
    assert placed.select("position").distinct().count() == 20000
    ranged = df.selectExpr("*", "monotonically_increasing_id() as _tie").repartitionByRange("grp", "at", "_tie")
    sizes = [r[0] for r in ranged.groupBy("grp", "at", "_tie").count().selectExpr("count").distinct().collect()]
    assert sizes == [1]


def test_places_hold_between_uses(spark):
    df = spark.range(0, 500, numPartitions=6).selectExpr("id", "id % 3 as k")
    placed = with_positions(df, ["k"])
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, placed.collect()))
