import random
import zlib

import pytest

from tidemark.llm import compression
from tidemark.llm.compression import CompressionModel, score_quality, train

DOCS, LABELS = "doc_id long, text string, lang string, score string", "doc_id long, quality int"
WORDS = "the river bank holds water and stones while trees grow along quiet paths near old houses".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        good = i % 3 > 0
        yield i, " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in words), int(good)


def test_held_out_rows_are_told_apart(spark):
    rows = list(texts(400))
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], LABELS)
    got = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    assert len(got) == 400
    for i, _, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = list(texts(200))
    docs = spark.createDataFrame([(i, t, "en", "") for i, t, _ in rows], DOCS)
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a = score_quality(docs, spark.createDataFrame([(i, y) for i, _, y in rows], LABELS))
    b = score_quality(docs, spark.createDataFrame([(i, flip(i, y)) for i, _, y in rows], LABELS))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(a) == key(b)


def test_empty_null_repeated_and_long_texts(spark):
    rows = list(texts(120))
    odd = [(None, None), (500, ""), (501, None), (502, " ".join(WORDS * 20_000)), (503, "a"), (503, "a")]
    docs = spark.createDataFrame([(i, t, None, "") for i, t, _ in rows] + [(i, t, None, "") for i, t in odd], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], LABELS)
    got = score_quality(docs, labels).collect()
    assert len(got) == 126 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[500]["score"] == by_id[501]["score"] and by_id[502]["predicted"] == 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in score_quality(docs, none).collect()] == [0.5]
    assert score_quality(docs.where("false"), none).count() == 0


def test_whole_texts_count():
    model = train([(t, y) for _, t, y in texts(200)])
    good = " ".join(WORDS * 200)
    assert model.score(good) > 0.9 > model.score(good + " " + "X!! " * 20_000)
    assert model.score(None) == model.score("") == model.prior


def test_one_class_only():
    assert train([("a b", 1), ("c d", 1)]) == CompressionModel(b"", b"", (), pytest.approx(0.75))


def test_empty_texts_get_the_share_of_all_labels(spark, monkeypatch):
    monkeypatch.setattr(compression, "PER_CLASS", 10)
    rows = [(i, f"text {i} " * 9, int(i % 5 > 0)) for i in range(200)]
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in rows], (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = score_quality(docs, labels).where("doc_id = 900").first()
    known = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert got["score"] == pytest.approx((sum(known) + 1) / (len(known) + 2)) and got["predicted"] == 1
