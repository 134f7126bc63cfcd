import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S

DOCS = "doc_id long, text string, fingerprint string"


def by_hand(text):
    votes = [0] * 64
    for word in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        weight = max(1, min(8, len(word) - 2))
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(64) if votes[b] > 0)


def unsigned(x):
    return x & (1 << 64) - 1


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_fingerprint_is_the_weighted_vote(spark, monkeypatch):
    sample = [*texts(40), None, "", " \n", "A a", "word " * 3000, "\tx\x0by"]
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string")
    expect = {i: by_hand(t) for i, t in enumerate(sample)}
    assert {r["doc_id"]: unsigned(r["fingerprint"]) for r in S.with_fingerprint(df).collect()} == expect
    monkeypatch.setattr(S, "RUN", 7)
    assert {r["doc_id"]: unsigned(r["fingerprint"]) for r in S.with_fingerprint(df).collect()} == expect


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, g, n = by_hand(text), by_hand(edited), by_hand(after)
        like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        near = None
        if key is not None and key % S.QUERY_STEP == 0:
            every = {by_hand(t) for _, t in rows}
            near = sum(0 < bin(f ^ e).count("1") <= S.RADIUS for e in every)
        out.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{g:016x}", like(f, g), like(f, n), near))
    return sorted(out, key=repr)


@pytest.mark.parametrize("step", [1, 1000, 10**15])
def test_documents(spark, step, monkeypatch):
    monkeypatch.setattr(S, "SORTED_AT_ONCE", 10)
    monkeypatch.setattr(S.next_keys, "__defaults__", (10,))
    rows = [(i * step - 7, t) for i, t in enumerate(texts(150, seed=step))]
    # Close to the fingerprint of a query, or equal to it.
    query = 50 * 10**6
    long = " ".join(texts(40, seed=3))
    rows += [(query, long), (query + 1, long + " a"), (query + 2, long + " b c"), (query + 3, long)]
    rows += [(rows[3][0], "twice"), (rows[3][0], "twice"), (None, "no id"), (None, None), (rows[9][0], "")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], DOCS).repartition(4)
    got = S.fingerprint_documents(df).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=repr) == expected(rows)


def test_one_id_that_a_third_of_all_rows_share(spark, monkeypatch):
    """Ranges of many rows are cut into parts, and the order goes on across them."""
    monkeypatch.setattr(S, "PART_ROWS", 7)
    sample = texts(120, seed=11)
    rows = [(i, t) for i, t in enumerate(sample[:60])] + [(200, t) for t in sample[60:95]] + [(None, t) for t in sample[95:]]
    rows += [(200, "same text")] * 9 + [(5000, "last"), (201, "beside")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], DOCS).repartition(4)
    got = S.fingerprint_documents(df).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=repr) == expected(rows)


def test_heavy_words_do_not_overflow(spark):
    sample = ["extraordinary " * 30_000, "extraordinarily uncharacteristic " * 9_000]
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string")
    got = {r["doc_id"]: unsigned(r["fingerprint"]) for r in S.with_fingerprint(df).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(sample)}


def test_one_and_no_document(spark):
    one = spark.createDataFrame([(5, "alone here", "")], DOCS)
    assert [(str(r[0]), *r[1:]) for r in S.fingerprint_documents(one).collect()] == expected([(5, "alone here")])
    assert S.fingerprint_documents(one.where("false")).count() == 0


def test_next_keys(spark):
    rng = random.Random(4)
    keys = sorted({rng.randrange(-(10**6), 10**6) for _ in range(300)} | {rng.randrange(1 << 60) for _ in range(50)})
    for at_once in (3, 1000):
        df = spark.createDataFrame([(k,) for k in keys], "key long")
        got = {r["key"]: r["next_key"] for r in S.next_keys(df, at_once).collect()}
        assert got == dict(zip(keys, [*keys[1:], keys[0]]))


@pytest.mark.parametrize("radius, blocks", [(0, 1), (3, 6), (3, 4), (5, 7)])
def test_all_fingerprints_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(prints)
        for _ in range(rng.randint(0, radius + 2)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    corpus = spark.createDataFrame([(x,) for x in [*signed, *signed[:9], None]], "fingerprint long")
    queries = spark.createDataFrame([(x,) for x in [*signed[::3], None]], "fingerprint long")
    got = [tuple(r) for r in S.within_radius(queries, corpus, radius, blocks).collect()]
    apart = lambda a, b: bin(unsigned(a) ^ unsigned(b)).count("1")
    expect = {(a, b, apart(a, b)) for a in signed[::3] for b in signed if a != b and apart(a, b) <= radius}
    assert sorted(got) == sorted(expect)
    with pytest.raises(ValueError):
        S.within_radius(queries, corpus, 4, 4)


def test_likeness_of_halves(spark):
    a, b = texts(2, seed=8)
    rows = [(0, (a + " ") * 6), (1, (b + " ") * 6)]
    got = S.fingerprint_documents(spark.createDataFrame([(k, t, "") for k, t in rows], DOCS)).orderBy("doc_id").first()
    assert got["near_edited"] > got["near_next"]
    assert S.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("fingerprint") == 0).count() == 0
