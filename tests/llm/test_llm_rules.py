import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from tidemark.llm import risk_rules as R

DOCS, LABELS = "doc_id long, text string, lang string, n_words string", "doc_id long, quality int"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WORDS = "the river bank holds water and stones while trees grow along quiet paths near old houses".split()


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b", "a a a", "a a a a", "x y z", "\x0b\x0c\r", "é|é\n|\n|\n \n \n"]
    texts += ["".join(rng.choice("ab c\n#&é\t") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += ["so it goes on and on " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in R.text_facts(df).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (0, 1, 5, 40, 700) for k in (0, 1, 3, 30) for p in (0.01, 0.2)]
    for p in (0.01, 0.2):
        rows = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(rows, "k long, n long").withColumn("t", R.binomial_tail(F.col("k"), F.col("n"), p))
        for r in df.collect():
            k, n, q = r["k"], r["n"], Fraction(p)
            exact = 1.0 if k >= n * p else float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
            assert r["t"] == pytest.approx(exact, rel=1e-9)
    far = spark.createDataFrame([(10, 200_000)], "k long, n long").select(R.binomial_tail(F.col("k"), F.col("n"), 0.01)).first()[0]
    assert 0 <= far < 1e-300


def corpus(n):
    rng = random.Random(2)
    for i in range(n):
        good = i % 5 > 0
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "er", "ly"]) for _ in range(rng.randint(60, 120))]
        if not good:
            words = [w + rng.choice(["###", "$$$", "|||"]) for w in words]
        yield i, " ".join(words), "en" if i % 2 else "de", int(good)


def test_cutoffs_catch_the_bad_and_keep_the_good(spark):
    rows = list(corpus(3000))
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, t, lang, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i < 2500], LABELS)
    got = {r["doc_id"]: r for r in R.apply_rules(docs, labels).collect()}
    good = [got[i]["kept"] for i, _, _, y in rows if y and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, _, _, y in rows if not y]
    assert sum(good) >= (1 - R.FALSE_REJECTION) * len(good) and sum(bad) <= 0.05 * len(bad)


def brute_cutoffs(rows, alpha, delta):
    """(stratum, rule) to cutoff by the definition."""
    out = {}
    p = Fraction(alpha / len(R.MEASURES))
    for stratum in {r["stratum"] for r in rows}:
        for rule, cutoffs in R.MEASURES.items():
            mine = [r for r in rows if r["stratum"] == stratum]
            n, best, choice = sum(r["good"] for r in mine), 0, None
            for cutoff in cutoffs:
                k = sum(r["good"] for r in mine if r[rule] > cutoff)
                tail = 1 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                if tail > delta / (len(R.MEASURES) * (len(R.STRATA) + 1)):
                    break
                gain = sum(1 - r["good"] for r in mine if r[rule] > cutoff) - R.GOOD_WEIGHT * k
                if gain > best:
                    best, choice = gain, cutoff
            if choice is not None:
                out[stratum, rule] = choice
    return out


def test_cutoffs_are_those_of_the_definition(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2500):
        good = int(rng.random() < 0.7)
        value = lambda top: top * (rng.random() ** 12 if good else rng.uniform(0.0, 1.3))  # noqa: B023, E731
        rows.append({"stratum": rng.choice(["en", "other"]), "good": good, **{m: value(c[0]) for m, c in R.MEASURES.items()}})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "stratum string, good long, " + ", ".join(f"{m} double" for m in R.MEASURES))
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in R.choose_cutoffs(df, alpha=0.25, delta=0.2).collect()}
    assert got and got == brute_cutoffs(rows, 0.25, 0.2)


def test_few_or_odd_labels_and_rows(spark):
    rows = list(corpus(30)) + [(900, None, None, 0), (901, "", "en", 0), (None, "word " * 60, None, 1), (3, "a " * 70, "en", 1)]
    docs = spark.createDataFrame([(i, t, lang, "") for i, t, lang, _ in rows] * 2, DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(5, None), (6, 7)], LABELS)
    got = R.apply_rules(docs, labels).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert r["kept"] == (not r["base_failed"])
    assert R.apply_rules(docs.where("false"), labels).count() == 0
    assert R.apply_rules(docs, labels.where("false")).where("kept").count() == sum(r["kept"] for r in got)
