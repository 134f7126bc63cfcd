"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: Input rows that are numbered together; a block never holds more, whatever the keys are.
BLOCK_BITS = 14


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of every key: the one that wins the weighted draw for this key.

    Shard i draws -ln(u) / w with u uniform from a hash of key and i, and the smallest draw wins,
    so shard i gets the share w / sum(w) of the keys. A draw does not depend on the other shards:
    a new shard takes keys into itself only, and those of a removed one spread over the rest.
    Keys are hashed as text, so their integer width does not matter. Null keys share one shard;
    equal draws go to the lower shard; a shard of weight 0 gets nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")

    def draw(i: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(i)), 11)
        return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))

    draws = [F.struct(draw(i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def place(
    df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None
) -> DataFrame:
    """Every row of `df` with its shard and its slot, a gapless number from 0 within the shard.

    Adds `shard`, `slot` and, given the weights of a larger set, `grown_shard`; columns of these
    names are replaced. Rows are numbered in blocks of the input, so one key that holds most rows
    is no burden, and repeated rows get slots of their own. Pass the columns wanted only: they are
    written once to the shared scratch folder, so that numbers hold when executors are lost.
    """
    rows = df.drop("shard", "slot", "grown_shard").withColumn("shard", rendezvous_shard(F.col(key), weights))
    if grown is not None:
        rows = rows.withColumn("grown_shard", rendezvous_shard(F.col(key), grown))
    rows = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "shards")
    rows = rows.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy("_at")
    numbered = rows.join(starts, ["shard", "_block"]).withColumn(
        "slot", F.col("_start") + F.row_number().over(within) - 1
    )
    return numbered.drop("_at", "_block", "_start")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents in `shards` equal shards by doc_id, with what a loader checks.

    Columns: doc_id, size (UTF-8 bytes plus 1; a null text has 1), text_crc32 (of a null text that
    of the empty one), law, shard, slot, grown_shard (with one more shard). Other columns of `docs`
    are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = place(facts, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
