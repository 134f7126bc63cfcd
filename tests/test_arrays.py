import json
import random

import pytest

from tidemark.sources.arrays import _pieces, array_elements
from tidemark.sources.messages import read_feature_rows, read_spine

#: What strings may hold that looks like structure.
ODD = ['"', "\\", "]", "[", "}", "{", ",", " ", "\n", "é", "漢", "\\\\", '\\"', "a"]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def odd_text(rng):
    return "".join(rng.choice(ODD) for _ in range(rng.randrange(9)))


def odd_object(rng):
    inner = [odd_text(rng), {odd_text(rng): [[], {}, odd_text(rng)]}, None, rng.randrange(99)]
    return {odd_text(rng) + str(i): rng.choice(inner) for i in range(rng.randrange(4))}


def odd_list(rng):
    return [rng.choice([odd_text(rng), odd_object(rng), [[odd_text(rng)], []]]) for _ in range(rng.randrange(4))]


def elements(spark, path, closer):
    rows = array_elements(spark, str(path), closer).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    return [json.loads(r["element"]) for r in sorted(rows, key=lambda r: r["position"])]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("make", "closer"), [(odd_object, "}"), (odd_list, "]")])
def test_elements_as_parsed_whole(spark, small_blocks, tmp_path, seed, make, closer):
    rng = random.Random(seed)
    array = [make(rng) for _ in range(40)]
    spaced = rng.choice([None, 2])
    (tmp_path / "a.json").write_text(" \n" + json.dumps(array, ensure_ascii=False, indent=spaced) + "\n", "utf-8")
    assert _pieces(spark, str(tmp_path / "a.json"), closer).select("_block").distinct().count() > 10
    assert elements(spark, tmp_path / "a.json", closer) == array


def test_an_element_over_many_blocks(spark, small_blocks, tmp_path):
    array = [{"a": "x" * 500, "b": ["}{" * 90]}, {}, {"c": {"d": [{}] * 60}}]
    (tmp_path / "a.json").write_text(json.dumps(array))
    assert elements(spark, tmp_path / "a.json", "}") == array


@pytest.mark.parametrize("text", ["", " \n", "[]", " [ \n ] "])
@pytest.mark.parametrize("closer", ["]", "}"])
def test_nothing(spark, tmp_path, text, closer):
    (tmp_path / "a.json").write_text(text)
    assert elements(spark, tmp_path / "a.json", closer) == []


def test_a_file_that_breaks_off(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}, {"a": ')
    got = [r["element"] for r in array_elements(spark, str(tmp_path), "}").orderBy("position").collect()]
    assert [json.loads(e) for e in got[:2]] == [{"a": 1}, {"a": 2}] and len(got) <= 3


def test_spines_are_numbered_by_file(spark, small_blocks, tmp_path):
    for name, n in (("a", 30), ("b", 7)):
        pairs = [[f'{name}"]{i}', f"2024-01-01T00:00:{i:02d}"] for i in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps(pairs))
    got = [(r["spine_id"], r["entity_id"], r["label_timestamp"].second) for r in read_spine(spark, str(tmp_path)).collect()]
    assert got == [(i, f'{name}"]{i}', i) for name, n in (("a", 30), ("b", 7)) for i in range(n)]


def test_rows_of_a_stated_kind(spark, small_blocks, tmp_path):
    rows = [
        {"entity_id": str(i), "features": {"v": [1, {"w": "]}"}]}, "event_timestamp": "2024-01-01T00:00:00"}
        for i in range(12)
    ]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    got = [read_feature_rows(spark, str(tmp_path / f"{kind}.json"), kind).collect() for kind in ("array", "lines")]
    for found in got:
        assert {r["entity_id"]: json.loads(r["features"]) for r in found} == {r["entity_id"]: r["features"] for r in rows}
        assert len(found) == 12
    with pytest.raises(ValueError, match="unknown kind"):
        read_feature_rows(spark, str(tmp_path), "table")
