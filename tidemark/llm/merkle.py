"""Merkle manifest of a dataset, rolled up from the digits of leaf ranks."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.operators.positions import with_positions

#: Children of a node; a rank is read in digits of this base.
FAN_BITS = 3
FAN_OUT = 1 << FAN_BITS
#: Levels rolled up at a time: a block holds FAN_OUT ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 3
BLOCK_BITS = FAN_BITS * BLOCK_LEVELS

NO_PATH = "array<struct<left:string,right:string>>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: dict[str, Column]) -> Column:
    """sha256 of the columns in turn, each as its UTF-8 byte count, ":" and value, or "-" if null."""
    texts = [c.cast("string") for c in columns.values()]
    return _hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def height_of(n: Column) -> Column:
    """Levels above `n` leaves: the least h with FAN_OUT ** h >= n."""
    levels = range((63 + FAN_BITS - 1) // FAN_BITS)
    return sum((F.when(n > F.lit(FAN_OUT**h), 1).otherwise(0) for h in levels), F.lit(0)).cast("int")


def _rolled_up(nodes: DataFrame, done: int) -> DataFrame:
    """Blocks of `nodes`: tree, height, block, hash, and the nested nodes in `inner`.

    Nodes have tree, height, rank, hash and inner, and lie on level `done`. The digits of the rank
    within its block are grouped away from the lowest on; a node keeps its children as an array of
    structs, each with the hashes of its siblings to the left and the right as `step`. Levels above
    the tree's height pass the only child's hash on, with a null step.
    """
    digits = [f"_d{i}" for i in range(BLOCK_LEVELS)]
    rows = nodes.select(
        "tree",
        "height",
        F.shiftright("rank", BLOCK_BITS).alias("block"),
        *[F.shiftright("rank", FAN_BITS * i).bitwiseAND(FAN_OUT - 1).cast("int").alias(d) for i, d in enumerate(digits)],
        "hash",
        "inner",
    )
    # All groupings below have these keys, so this is the only exchange.
    rows = rows.repartition("tree", "block")
    for i, digit in enumerate(digits):
        rest = digits[i + 1 :]
        grouped = rows.groupBy("tree", "height", "block", *rest).agg(
            F.sort_array(F.collect_list(F.struct(digit, "hash", "inner"))).alias("_nodes")
        )
        there = F.col("height") > F.lit(done + i)
        hashes = F.col("_nodes.hash")

        def step(at: Column, hashes: Column = hashes, there: Column = there) -> Column:
            left = F.array_join(F.slice(hashes, 1, at), "")
            right = F.array_join(F.slice(hashes, at + 2, FAN_OUT), "")
            return F.when(there, F.struct(left.alias("left"), right.alias("right")))

        rows = grouped.select(
            "tree",
            "height",
            "block",
            *rest,
            F.when(there, _hash(F.array_join(hashes, ""))).otherwise(hashes[0]).alias("hash"),
            F.transform("_nodes", lambda n, at: F.struct(n["inner"].alias("inner"), step(at).alias("step"))).alias("inner"),
        )
    return rows


def _flat(inner: Column, above: Column, levels: int = BLOCK_LEVELS) -> Column:
    """The nodes at the bottom of a block, each with its steps, from its own up to `above`."""

    def open_up(node: Column) -> Column:
        path = F.concat(F.array(node["step"]), above)
        if levels == 1:
            return F.struct(node["inner"].alias("item"), path.alias("path"))
        return _flat(node["inner"], path, levels - 1)

    opened = F.transform(inner, open_up)
    return opened if levels == 1 else F.flatten(opened)


def _blocks(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Blocks of leaves, blocks of those blocks, and so on until every tree is one block."""
    passes = [saved(_rolled_up(nodes, 0), label)]
    highest = passes[0].agg(F.max("height")).first()[0] or 0
    while BLOCK_LEVELS * len(passes) < highest:
        below = passes[-1].select(
            "tree", "height", F.col("block").alias("rank"), "hash", F.struct(F.col("block").alias("rank")).alias("inner")
        )
        passes.append(saved(_rolled_up(below, BLOCK_LEVELS * len(passes)), label))
    return passes


def _proofs(passes: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """What the leaves of all trees carry, with `tops` (the root, then the tree's top) and `path`.

    `above` has tops and path of every tree's top. A block meets what lies above it in a grouping,
    one row of either kind for a block; nested nodes are then opened and exploded.
    """
    tops = F.array("hash").cast("array<string>")
    top = passes[-1]
    if above is None:
        top = top.withColumn("tops", tops).withColumn("path", F.array().cast(NO_PATH))
    else:
        top = _met(top, above.withColumn("block", F.lit(0).cast("long")))
        top = top.withColumn("tops", F.concat("tops", tops))
    for blocks in [*reversed(passes[:-1]), None]:
        items = top.select("tree", "tops", F.explode(_flat(F.col("inner"), F.col("path"))).alias("_one"))
        opened = items.select("tree", "tops", "_one.item", F.filter("_one.path", lambda s: s.isNotNull()).alias("path"))
        if blocks is not None:
            top = _met(blocks, opened.select("tree", F.col("item.rank").alias("block"), "tops", "path"))
    return opened


def _met(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each block with the tops and path above it: a union grouped by block, two rows to a group."""
    both = blocks.select("tree", "block", "hash", "inner").unionByName(
        above.select("tree", "block", "tops", "path"), allowMissingColumns=True
    )
    carried = [F.first(c, ignorenulls=True).alias(c) for c in ("hash", "inner", "tops", "path")]
    return both.groupBy("tree", "block").agg(*carried)


def manifest(leaves: DataFrame, tree: str, key: str, leaf: str, carried: list[str]) -> DataFrame:
    """A Merkle tree for each value of `tree` over the hashes `leaf`, and one over their tops.

    Leaves ascend by `key`, equal keys by hash, nulls first. Every FAN_OUT consecutive nodes become
    the sha256 of their hashes in hex, the last run of a level however short it is, until one is
    left. The tops, ordered by tree (null first, bytewise), are the leaves of the last tree. Returns
    the columns `carried` and leaf, subroot, root, and path: from the leaf up, the hashes to the left
    and to the right of the node, each side joined.

    Blocks of FAN_OUT ** BLOCK_LEVELS nodes are the largest groups, whatever a tree's share of the
    rows is; a tree of n leaves takes log(n) / log(512) passes, each over 512 times fewer rows. Equal
    rows are leaves of their own. Trees need not be few. An empty table gives no rows.
    """
    rows = leaves.select(F.col(tree).alias("tree"), F.col(key).alias("key"), F.col(leaf).alias("hash"), *carried)
    placed = with_positions(rows, ["key", "hash"], within=["tree"], name="rank", total="_n")
    nodes = placed.select(
        "tree",
        height_of(F.col("_n")).alias("height"),
        "rank",
        "hash",
        F.struct(F.col("hash").alias("leaf"), *carried).alias("inner"),
    )
    passes = _blocks(nodes, "merkle")
    subroots = passes[-1].select(F.lit("").alias("all"), F.col("tree").alias("of"), "hash")
    ordered = with_positions(subroots, ["of"], within=["all"], name="rank", total="_n")
    crowns = ordered.select(
        F.col("all").alias("tree"), height_of(F.col("_n")).alias("height"), "rank", "hash", F.struct("of").alias("inner")
    )
    above = _proofs(_blocks(crowns, "merkle-top"), None)
    found = _proofs(passes, above.select(F.col("item.of").alias("tree"), "tops", "path"))
    return found.select(
        "item.*", F.col("tops")[1].alias("subroot"), F.col("tops")[0].alias("root"), "path"
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: _hash(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """sha256 of the siblings from the leaf up, left to right; of nothing for a leaf that is the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, a tree for each language, and the check of each row's proof against it.

    Rows whose crc32 of the decimal doc_id is divisible by 3 are tampered with before the check:
    A-Z of their texts in lower case. Columns: doc_id, leaf, subroot, root, proof_sha256 (all of the
    untampered table), folded_root (from the tampered leaf and the original siblings) and verified.
    Null values hash as "-", so they differ from empty texts; rows without doc_id come first in
    their tree and are not tampered with. Repeated rows are leaves of their own; of rows that share
    a doc_id the one with the smaller hash comes first. Other columns are not read.
    """
    told = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    hashed = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        leaf_hash(told).alias("_leaf"),
        F.when(hit, leaf_hash({**told, "text": lowered})).alias("_tampered"),
    )
    proven = manifest(hashed, "lang", "doc_id", "_leaf", ["doc_id", "_tampered"])
    again = folded(F.coalesce("_tampered", "leaf"), F.col("path"))
    checked = proven.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root")
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
