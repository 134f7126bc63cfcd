import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, predicted string", "doc_id long, toxic int"
WORDS = "river stone water quiet path tree house morning window garden letter bridge cloud winter".split()
INSULTS = ["idiot", "moron", "scum"]


def texts(n, seed=2):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(20, 80))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        yield i, " ".join(words), int(toxic)


def by_hand(s, t):
    total = 0.0
    for a in combinations(range(len(s)), T.ORDER):
        for b in combinations(range(len(t)), T.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += T.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_counts_gapped_subsequences():
    pairs = [("idiot", "idiot"), ("id-iot", "idiot"), ("abcabc", "acb"), ("ab", "abc"), ("ixdxixoxt", "idiot")]
    got = T.subsequence_kernel(T._codes([a for a, _ in pairs], -1), T._codes([b for _, b in pairs], -2))
    assert got == pytest.approx([by_hand(a, b) for a, b in pairs], rel=1e-5)


@pytest.fixture(scope="module")
def machine():
    return T.train([(t, y) for _, t, y in texts(300)])


def test_gapped_and_inserted_letters(machine):
    plain = "the river runs along a quiet path and the garden is green "
    for insult in ("idiot", "i-d-i-o-t", "id.iot", "1d1ot", "i d i o t", "IDIOT!!", "idiiot", "id.i.ot"):
        assert machine.scores([plain + f"you {insult} " * 3])[0] > 0.5, insult
    assert machine.scores([plain, plain * 50]) == pytest.approx([0, 0], abs=0.3)


def test_scores_do_not_depend_on_what_came_before(machine):
    sample = [t for _, t, _ in texts(120, seed=9)]
    together = machine.scores(sample)
    assert T.train([(t, y) for _, t, y in texts(300)]).scores(sample[::-1])[::-1] == pytest.approx(together, abs=1e-6)


def test_memory_is_bounded(machine, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED_WORDS", 50)
    sample = [t + f" extra{i}" for i, t, _ in texts(100, seed=4)]
    assert machine.scores(sample) == pytest.approx(T.train([(t, y) for _, t, y in texts(300)]).scores(sample), abs=1e-6)


def test_held_out_rows(spark):
    rows = list(texts(300))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (901, "", ""), (None, "x " * 200_000, "")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], LABELS)
    got = T.score_toxicity(docs, labels).collect()
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    held = [(by_id[i]["predicted"], y) for i, _, y in rows if by_id[i]["held_out"]]
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert by_id[900]["predicted"] == by_id[901]["predicted"] == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r["predicted"] for r in T.score_toxicity(docs, none).collect()] == [0]
    assert T.score_toxicity(docs.where("false"), none).count() == 0


def test_similar_is_screened_but_not_changed(machine):
    words = sorted({T.letters_of(w) for _, t, _ in texts(50, seed=5) for w in t.split()})
    got = machine.similar(words)
    codes = T._codes(machine.landmarks, -2)
    for i, w in enumerate(words[:40]):
        k = T.subsequence_kernel(np.repeat(T._codes([w], -1), len(codes), axis=0), codes)
        full = (k / np.sqrt(T._self_kernel([w])) / machine._norms) ** T.POWER
        assert np.abs(got[i] - full).max() < 0.05


def test_empty_texts_get_the_share_of_all_labels(spark, monkeypatch):
    # A sample with as many toxic as clean texts, clean copies in it.
    monkeypatch.setattr(T, "PER_CLASS", 20)
    rows = [(i, "the same clean text" if not y else t, y) for i, t, y in texts(400)]
    docs = spark.createDataFrame([(i, t, "") for i, t, _ in rows] + [(900, None, ""), (901, "", "")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, LABELS)
    got = {r["doc_id"]: r for r in T.score_toxicity(docs, labels).where("doc_id >= 900").collect()}
    known = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert got[900]["score"] == got[901]["score"] == pytest.approx(sum(known) / (len(known) + 2))
    assert got[900]["predicted"] == got[901]["predicted"] == 0
