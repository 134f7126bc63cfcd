import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators.asof import asof_join

BASE = dt.datetime(2024, 1, 1)
LOG = "entity_id string, event_timestamp timestamp, ingest_seq long, score double, tier string"
SPINE = "spine_id long, entity_id string, label_timestamp timestamp"


def at(minutes):
    return None if minutes is None else BASE + dt.timedelta(minutes=minutes)


def brute_force(spine, log):
    out = []
    for sid, entity, label in spine:
        seen = [r for r in log if r[0] == entity and None not in (entity, label, r[1]) and r[1] <= label]
        best = max(seen, key=lambda r: (r[1], r[2]), default=None)
        out.append((sid, entity, label, *((best[3], best[4], best[1]) if best else (None, None, None))))
    return sorted(out, key=repr)


def run(spark, spine, log, **kwargs):
    result = asof_join(
        spark.createDataFrame(spine, SPINE),
        spark.createDataFrame(log, LOG),
        ties=["ingest_seq"],
        features=["score", "tier"],
        **kwargs,
    )
    return sorted((tuple(r) for r in result.collect()), key=repr)


VARIANTS = [
    {"strategy": "window"},
    {"strategy": "window", "hot_rows": 3},
    {"strategy": "marks"},
]


@pytest.mark.parametrize("kwargs", VARIANTS)
def test_cases(spark, kwargs):
    log = [
        ("user_1", at(0), 1, 0.5, "free"),
        ("user_1", at(60), 2, 0.9, "paid"),
        ("user_2", at(0), 3, 0.1, None),
        ("user_2", at(60), 4, 0.8, None),
        ("user_3", at(600), 5, 0.7, "x"),
        ("tied", at(5), 6, 1.0, "old"),
        ("tied", at(5), 7, None, "new"),
        (None, at(0), 8, 3.0, "nobody"),
    ]
    spine = [
        (1, "user_1", at(30)),
        (2, "user_2", at(60)),
        (3, "user_3", at(0)),
        (4, "tied", at(5)),
        (5, "tied", at(5)),
        (5, "tied", at(5)),
        (6, None, at(5)),
        (7, "user_1", None),
        (8, "absent", at(5)),
    ]
    got = run(spark, spine, log, **kwargs)
    assert got == brute_force(spine, log)
    by_id = {r[0]: r[3:5] for r in got}
    assert by_id[1] == (0.5, "free")
    assert by_id[2] == (0.8, None)
    assert by_id[3] == (None, None)
    assert by_id[4] == (None, "new")


entities = st.sampled_from(["a", "b", "c", None])
minutes = st.one_of(st.none(), st.integers(0, 12))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    log=st.lists(st.tuples(entities, minutes, st.one_of(st.none(), st.floats(0, 1))), max_size=40),
    spine=st.lists(st.tuples(entities, minutes), min_size=1, max_size=30),
)
def test_random_logs(spark, log, spine):
    log = [(e, at(m), i, s, f"t{i}") for i, (e, m, s) in enumerate(log)]
    spine = [(i, e, at(m)) for i, (e, m) in enumerate(spine)]
    expected = brute_force(spine, log)
    for kwargs in VARIANTS:
        assert run(spark, spine, log, **kwargs) == expected


def test_hot_entity_and_hot_instant(spark):
    """One entity holds most rows, a third of them at a single instant."""
    rng = random.Random(3)
    log, spine = [], []
    for i in range(600):
        entity = "hot" if rng.random() < 0.7 else f"cold{rng.randrange(20)}"
        minute = 500 if rng.random() < 0.33 else rng.randrange(1000)
        log.append((entity, at(minute), i, float(i), f"t{i}"))
    for i in range(600):
        entity = "hot" if rng.random() < 0.7 else f"cold{rng.randrange(20)}"
        minute = 500 if rng.random() < 0.33 else rng.randrange(-50, 1000)
        spine.append((i, entity, at(minute)))
    assert run(spark, spine, log, strategy="window", hot_rows=20) == brute_force(spine, log)


def test_hot_instant_is_salted(spark):
    from tidemark.operators import asof

    log = spark.createDataFrame([("hot", at(i % 50), i, 0.0, "x") for i in range(200)], LOG)
    spine = spark.createDataFrame([(i, "hot", at(25)) for i in range(400)], SPINE)
    keyed = log.selectExpr("entity_id", "event_timestamp as _ts")
    bounds = asof._hot_bounds(spine, keyed, ["entity_id"], "label_timestamp", 20).first()
    assert max(bounds["_slot_salts"]) >= 10
    assert len(bounds["_cuts"]) + 1 == len(bounds["_slot_salts"])
    assert bounds["_cuts"] == sorted(set(bounds["_cuts"]))


def test_order_survives_forced_spill(spark):
    keys = ["spark.shuffle.spill.numElementsForceSpillThreshold", "spark.sql.adaptive.enabled"]
    before = {k: spark.conf.get(k, None) for k in keys[1:]}
    rng = random.Random(5)
    log = [(f"e{rng.randrange(3)}", at(rng.randrange(400)), i, float(i), None) for i in range(3000)]
    spine = [(i, f"e{rng.randrange(4)}", at(rng.randrange(400))) for i in range(500)]
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.windowExec.buffer.spill.threshold", "64")
        spark.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", "16")
        assert run(spark, spine, log, strategy="window") == brute_force(spine, log)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.windowExec.buffer.spill.threshold")
        spark.conf.unset("spark.sql.windowExec.buffer.in.memory.threshold")


def test_nested_and_bounded(spark):
    log = spark.createDataFrame([("a", at(0), 1, 0.5, "x"), ("a", at(90), 2, 0.9, "y")], LOG)
    spine = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(-10))], SPINE)
    rows = asof_join(
        spine, log, ties=["ingest_seq"], features=["score"], nested="features", bound_log=True
    ).orderBy("spine_id")
    assert [r["features"] and r["features"]["score"] for r in rows.collect()] == [0.5, None]


def test_extra_spine_columns_are_kept(spark):
    log = spark.createDataFrame([("a", at(0), 1, 0.5, "x")], LOG)
    spine = spark.createDataFrame(
        [(1, "a", at(10), {"k": "v"}, 3)], SPINE + ", tags map<string,string>, label int"
    )
    row = asof_join(spine, log, ties=["ingest_seq"], strategy="window").first()
    assert row["tags"] == {"k": "v"} and row["label"] == 3 and row["tier"] == "x"
