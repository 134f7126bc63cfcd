import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import raking as K
from tidemark.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, source string, lang string, topic string, weight string"


def docs_of(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join("w" for _ in range(rng.randint(1, 50))) + rng.choice(["", " | x", " ###", " License", " a@b"])
        rows.append((i, text, rng.choice(["s0", "s0", "s0", "s1", None]), rng.choice(["en", "en", "de", "xx"]), "clash", "clash"))
    return rows, spark.createDataFrame(rows, DOCS)


def by_hand(cells, targets, rounds):
    total = sum(cells.values())
    weight = {c: t / total for c, t in cells.items() if t > 0}
    goals = []
    for d, target in enumerate(targets.values()):
        own = {}
        for c, t in cells.items():
            if t > 0:
                own[c[d]] = own.get(c[d], 0) + t / total
        if isinstance(target, dict):
            others = sum(s for v, s in own.items() if v not in target)
            rest = max(0.0, 1 - sum(target.values()))
            want = {v: target.get(v, rest * s / others if v not in target else 0) for v, s in own.items()}
        else:
            want = {v: s**target for v, s in own.items()}
        goals.append({v: w / sum(want.values()) for v, w in want.items()})
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            sums = {}
            for c, w in weight.items():
                sums[c[d]] = sums.get(c[d], 0) + w
            weight = {c: w * goal[c[d]] / sums[c[d]] for c, w in weight.items()}
    return weight, goals


@pytest.mark.parametrize("one_task", [True, False])
def test_weights_are_those_of_proportional_fitting(spark, monkeypatch, one_task):
    if not one_task:
        monkeypatch.setattr(K, "CELLS_AT_ONCE", 0)
    rng = random.Random(2)
    cells = {(a, b, c): rng.randint(0, 500) for a in "pqr" for b in "xy" for c in "mn"}
    cells["p", "x", "m"] = 0
    targets = {"a": {"p": 0.5, "zzz": 0.1}, "b": 0.5, "c": {"m": 0.7, "n": 0.3}}
    df = spark.createDataFrame([(*k, t) for k, t in cells.items()], "a string, b string, c string, tokens long")
    got = K.rake(df, targets, rounds=12).collect()
    expect, _ = by_hand(cells, targets, 12)
    assert {(r["a"], r["b"], r["c"]): r["weight"] for r in got} == pytest.approx(expect, rel=1e-9)
    assert all(r["off"] < 1e-6 for r in got)


def test_unreachable_targets_show(spark):
    df = spark.createDataFrame([("p", "x", 10), ("q", "y", 10)], "a string, b string, tokens long")
    got = K.rake(df, {"a": {"p": 0.9, "q": 0.1}, "b": {"x": 0.5, "y": 0.5}}, rounds=5).collect()
    assert all(r["off"] == pytest.approx(0.4) for r in got)


def test_sample_is_drawn_by_cell_and_id(spark):
    rows, df = docs_of(spark, 800)
    targets = {"source": 0.5, "lang": {"en": 0.5, "de": 0.3}, "topic": 0.9}
    got = K.mix(df, targets, rounds=10).collect()
    topic = lambda t: next((n for m, n in ((" | ", "table"), ("###", "marked"), ("License", "licence"), ("@", "contact")) if m in t), "prose")
    cells = {}
    for _, t, s, lang, *_ in rows:
        key = (s or "none", lang, topic(t))
        cells[key] = cells.get(key, 0) + len(t.split())
    weight, _ = by_hand(cells, targets, 10)
    need = {c: w / (cells[c] / sum(cells.values())) for c, w in weight.items()}
    chance = {c: round(n / max(need.values()), 9) for c, n in need.items()}
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    expect = sorted(i for i, t, s, lang, *_ in rows if draw(i) < chance[s or "none", lang, topic(t)])
    assert sorted(r["doc_id"] for r in got) == expect
    assert all(r["topic"] == r["weight"] == "clash" for r in got)


def test_kept_tokens_have_the_target_shares(spark):
    _, df = docs_of(spark, 6000, seed=5)
    got = K.mix(df, {"lang": {"en": 0.4, "de": 0.4, "xx": 0.2}, "topic": 1.0, "source": 1.0})
    shares = {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.sum("_tokens").alias("n")).collect()}
    total = sum(shares.values())
    assert {k: v / total for k, v in shares.items()} == pytest.approx({"en": 0.4, "de": 0.4, "xx": 0.2}, abs=0.04)


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None, "", ""), (2, "", "s", "en", "", ""), (None, "a b", "s", "en", "", ""), (3, "a " * 100_000, "s", "en", "", ""), (3, "a " * 100_000, "s", "en", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = K.sampled_documents(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "None"]
    assert K.sampled_documents(df.where("false")).count() == 0
    blank = K.sampled_documents(df.where("doc_id < 3")).collect()
    assert sorted(r["doc_id"] for r in blank) == [1, 2] and all(r["n_tokens"] == 0 for r in blank)


def test_languages_without_a_share_keep_their_own(spark):
    rng = random.Random(3)
    langs = [None, "xx", "en", "en", "de", "fr", "es"]
    rows = [(i, "w " * rng.randint(1, 50), rng.choice(["s0", "s1"]), rng.choice(langs), "", "") for i in range(7000)]
    got = K.mix(spark.createDataFrame(rows, DOCS)).collect()
    own, kept = {}, {}
    for _, text, _, lang, *_ in rows:
        own[lang] = own.get(lang, 0) + len(text.split())
    for r in got:
        kept[r["lang"]] = kept.get(r["lang"], 0) + r["_tokens"]
    own, kept = [{k: n / sum(d.values()) for k, n in d.items()} for d in (own, kept)]
    named = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
    left = 1 - own[None] - own["xx"]
    expect = {None: own[None], "xx": own["xx"], **{k: s * left for k, s in named.items()}}
    assert kept == pytest.approx(expect, abs=0.04)


def test_only_languages_without_a_share(spark):
    rows = [(i, "a b c", "s", None if i % 3 else "xx", "", "") for i in range(90)]
    got = K.sampled_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(90)) and all(r["probability"] == 1 for r in got)


def test_values_of_share_0_are_left_out(spark):
    df = spark.createDataFrame([("p", "x", 10), ("q", "y", 10), ("q", "x", 5)], "a string, b string, tokens long")
    got = K.keep_probabilities(K.rake(df, {"a": {"p": 1.0, "q": 0.0}, "b": 1.0}, rounds=5)).collect()
    assert {(r["a"], r["b"]): r["probability"] for r in got} == {("p", "x"): 1, ("q", "y"): 0, ("q", "x"): 0}


def test_twin_in_sql_on_other_languages(spark, tmp_path):
    """The rows of the query and of its SQL on a table with languages that have no named share."""
    rng = random.Random(12)
    langs = ["en"] * 5 + ["de", "fr", "es", "it", None]
    rows = [
        (i, " ".join(["word"] * rng.randint(0, 60)), rng.choice(langs), rng.choice(["a", "b", None]), 0) for i in range(600)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op6_raked_mixture"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got and got == sorted(con.execute(ORACLE["op6_raked_mixture"]).fetchall())
    assert {r[2] for r in got} == {"en", "de", "fr", "es", "it", "none"}


def test_cells_wanted_next_to_nothing_keep_a_chance(spark):
    raked = spark.createDataFrame([("a", 1.0, 1 - 1e-13), ("b", 1e9, 1e-13), ("c", 5.0, 0.0)], "source string, tokens double, weight double")
    got = {r["source"]: r["probability"] for r in K.keep_probabilities(raked).collect()}
    assert got == {"a": 1.0, "b": 2.0**-32, "c": 0.0}
