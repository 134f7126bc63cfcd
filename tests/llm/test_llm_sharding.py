import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.sharding import place, rendezvous_shard, shard_documents

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_hand(key, weights):
    def draw(i):
        seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), seed=42)
        bits = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=seed) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weights[i]

    return min((i for i in range(len(weights)) if weights[i] > 0), key=lambda i: (draw(i), i))


def test_shard_is_the_smallest_weighted_draw(spark):
    weights = [1.0, 2.5, 0.0, 4.0]
    keys = [*range(-40, 300), None]
    df = spark.createDataFrame([(k, "") for k in keys], SCHEMA)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", rendezvous_shard(F.col("doc_id"), weights).alias("s")).collect()}
    assert got == {k: by_hand(k, weights) for k in keys}


def test_shares_follow_weights_and_few_keys_move(spark):
    df = spark.range(40_000).select(
        rendezvous_shard(F.col("id"), [1, 1, 2]).alias("a"), rendezvous_shard(F.col("id"), [1, 1, 2, 2]).alias("b")
    )
    rows = df.collect()
    share = Counter(r["a"] for r in rows)
    assert [round(share[i] / 40_000, 1) for i in range(3)] == [0.2, 0.2, 0.5] or abs(share[2] / 40_000 - 0.5) < 0.02
    assert all(r["a"] == r["b"] or r["b"] == 3 for r in rows)
    assert abs(sum(r["b"] == 3 for r in rows) / 40_000 - 1 / 3) < 0.02


def test_documents(spark):
    rows = [(i, "é" * (i % 7)) for i in range(500)] + [(7, "x")] * 300 + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).repartition(4)
    got = rows_of(shard_documents(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows
    )
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_other_columns_stay_and_blocks_split(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.sharding.BLOCK_BITS", 3)
    df = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("slot"), F.lit("v").alias("other"))
    got = rows_of(place(df, "k", [1.0, 3.0]))
    assert set(got[0]) == {"k", "other", "shard", "slot"}
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_no_rows_and_no_weights(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        rendezvous_shard(F.col("x"), [])
    with pytest.raises(ValueError):
        rendezvous_shard(F.col("x"), [1.0, -1.0])
