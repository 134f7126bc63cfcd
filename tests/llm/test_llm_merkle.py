"""The manifest against one made of lists in one process."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, text]
    texts = [None if v is None else str(v) for v in values]
    return _h("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def _path(levels, at):
    path = []
    for level in levels[:-1]:
        start = at - at % 8
        run = level[start : start + 8]
        path.append(("".join(run[: at - start]), "".join(run[at - start + 1 :])))
        at //= 8
    return path


def _expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {}
    for lang in langs:
        ordered = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        built[lang] = ordered, _levels([_leaf(r) for r in ordered])
    crown = _levels([built[lang][1][-1][0] for lang in langs])
    out = []
    for at_lang, lang in enumerate(langs):
        ordered, levels = built[lang]
        for at, row in enumerate(ordered):
            path = _path(levels, at) + _path(crown, at_lang)
            node = _leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                node = _leaf((row[0], lower, *row[2:]))
            for left, right in path:
                node = _h(left + node + right)
            proof = _h("".join(a + b for a, b in path))
            root = crown[-1][0]
            out.append((row[0], _leaf(row), levels[-1][0], root, proof, node, node == root))
    return out


def _key(row):
    return tuple("" if v is None else str(v) for v in row)


def _held_against(spark, rows):
    docs = spark.createDataFrame([(*r, "more", "x") for r in rows], f"{SCHEMA}, rank string, tree string").repartition(3)
    got = merkle.verified_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(_expected(rows), key=_key)


def _documents(n, langs, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÄÖ", "日本", "", "x" * 300]
    return [
        (i * 7 - 50, rng.choice([None, "", " ".join(rng.choices(words, k=5))]), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, i]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_tree_of_each_shape(spark, n):
    _held_against(spark, _documents(n, ["en"]))


def test_trees_of_several_blocks_and_langs(spark):
    # 1,200 leaves are three blocks; ten languages make a crown of two levels.
    rows = _documents(1200, ["en"]) + [(5000 + i, "Text", f"l{i % 9}", "s", 4) for i in range(20)] + [(9000, "One", None, "s", 3)]
    _held_against(spark, rows)


def test_repeated_rows_and_ids(spark):
    rows = [(3, "Same", "en", "s", 4)] * 30 + [(3, t, "en", "s", 1) for t in "abc"] + [(None, "n", "en", None, None)] * 2
    _held_against(spark, rows)


def test_empty_table(spark):
    assert merkle.verified_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_seen_only_where_letters_change(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(100)]
    got = {r["doc_id"]: r["verified"] for r in merkle.verified_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    hit = {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 0 and i % 2}
    assert {i for i, fine in got.items() if not fine} == hit
