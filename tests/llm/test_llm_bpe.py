import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " \n  ▁aetionhsdréßñ\t日\U0001f600x0.9'\"́ﬁㅎ"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def samples():
    rng = random.Random(1)
    yield from ("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(5000))
    yield from (" " * k + w + " " * j for k in range(24) for j in range(12) for w in ("", "a", "the", "\n", "é"))
    yield from ("a" * k for k in range(80))
    yield from ("ab" * k for k in range(40))
    yield "x" * 5000 + " " * 300 + "tail"


def test_encodes_as_the_library(model):
    codec = bpe.codec(MODEL)
    for text in samples():
        assert codec.encode(text) == model.encode(text), repr(text)


def test_decodes_as_the_library(model):
    codec, rng = bpe.codec(MODEL), random.Random(2)
    for _ in range(3000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32_000) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == model.decode(ids), ids


def test_small_memory_gives_the_same(model, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 3)
    codec = bpe.PieceCodec(MODEL)
    for text in list(samples())[:300]:
        assert codec.encode(text) == model.encode(text)


def test_columns(spark, model):
    rows = [(1, "Hello there"), (2, None), (2, ""), (None, "é" * 40_000), (3, "a▁b"), (3, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS n_tokens")
    both = bpe.decode_column(bpe.encode_column(df, MODEL), MODEL).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in both) == sorted(
        (str(k), model.encode(t or ""), model.decode(model.encode(t or ""))) for k, t in rows
    )
    digest = sorted(tuple(map(str, r)) for r in bpe.token_digest(df, MODEL).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = []
    for k, t in rows:
        ids = model.encode(t or "")
        expect.append((str(k), str(len(ids)), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert digest == sorted(expect)
    assert bpe.token_digest(df.where("false"), MODEL).count() == 0
