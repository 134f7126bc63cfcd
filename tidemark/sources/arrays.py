"""Elements of large JSON arrays, cut out of byte ranges of a file in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import stored

BLOCK = ["_file", "_block"]


def _pieces(spark: SparkSession, paths: str | Sequence[str], closer: str) -> DataFrame:
    """The text between closing brackets, with what each piece does to quotes and to depth.

    A piece starts either outside of a string or in one; `_out` and `_in` are its steps in depth for the
    two cases. No escape is cut, as a backslash before a closing bracket is itself escaped.
    """
    text = spark.read.option("lineSep", closer).text(paths).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("_text"),
    )
    bare = F.regexp_replace("_text", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))

    def step(seen: Column, ends_outside: Column) -> Column:
        shown = F.regexp_replace(seen, r'"[^"]*+"?', "")
        opened = F.length(F.regexp_replace(shown, r"[^\[{]", ""))
        closed = F.length(F.regexp_replace(shown, r"[^\]}]", ""))
        return opened - closed - ends_outside.cast("int")

    return text.select(
        "*",
        quotes.alias("_quotes"),
        step(bare, quotes % 2 == 0).alias("_out"),
        step(F.concat(F.lit('"'), bare), quotes % 2 == 1).alias("_in"),
    )


def _starts(pieces: DataFrame) -> DataFrame:
    """Whether each block starts in a string (`_odd`), and at which depth (`_depth`)."""
    before = Window.partitionBy(*BLOCK).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1
    totals = (
        pieces.select(*BLOCK, "_quotes", "_out", "_in", odd.alias("_odd"))
        .groupBy(*BLOCK)
        .agg(
            F.sum("_quotes").alias("_quotes"),
            F.sum(F.when(F.col("_odd"), F.col("_in")).otherwise(F.col("_out"))).alias("_out"),
            F.sum(F.when(F.col("_odd"), F.col("_out")).otherwise(F.col("_in"))).alias("_in"),
        )
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_odd", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2 == 1)
    steps = F.when(F.col("_odd"), F.col("_in")).otherwise(F.col("_out"))
    return totals.select(*BLOCK, "_odd", F.coalesce(F.sum(steps).over(earlier), F.lit(0)).alias("_depth"))


def array_elements(spark: SparkSession, paths: str | Sequence[str], closer: str) -> DataFrame:
    """The elements of files that each hold one JSON array: file, position (from 0, in each file), element.

    `closer` is the bracket that ends every element: "}" if all are objects, "]" if all are arrays; their
    nesting and what strings hold is free. Files are cut into byte ranges of
    `spark.sql.files.maxPartitionBytes`, each read by a task of its own; an element may span several.
    Where a range starts is found by prefix sums: of quotes, then of depth, which is known for
    either state of quotes, then of ended elements. The first two read the file once, for narrow rows,
    the last reads it again. Only one row for a range is added up over a file, and only one element at
    a time is put together.

    An empty file or array gives no rows. What follows the last whole element is not returned; of a
    file that breaks off in an element, its rest may come as one that does not parse.
    """
    pieces = _pieces(spark, paths, closer)
    starts = stored(_starts(pieces.drop("_text")), "array-starts")
    ordered = Window.partitionBy(*BLOCK).orderBy("_at")
    upto, before = (ordered.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    placed = pieces.join(starts, BLOCK)
    quotes = F.sum("_quotes").over(upto) + F.col("_odd").cast("int")
    placed = placed.select(*BLOCK, "_at", "_text", "_out", "_in", "_quotes", "_depth", quotes.alias("_sum"))
    step = F.when((F.col("_sum") - F.col("_quotes")) % 2 == 1, F.col("_in")).otherwise(F.col("_out"))
    depth = F.sum(step).over(upto) + F.col("_depth")
    placed = placed.select(*BLOCK, "_at", "_text", ((F.col("_sum") % 2 == 0) & (depth == 1)).alias("_ends"))
    number = F.coalesce(F.sum(F.col("_ends").cast("long")).over(before), F.lit(0))
    in_order = F.array_sort(F.collect_list(F.struct("_at", "_text")))
    parts = stored(
        placed.select("*", number.alias("_number"))
        .groupBy(*BLOCK, "_number")
        .agg(
            F.array_join(F.transform(in_order, lambda p: F.concat(p["_text"], F.lit(closer))), "").alias("_text"),
            F.max("_ends").alias("_ends"),
        ),
        "array-parts",
    )
    ended = parts.groupBy(*BLOCK).agg(F.sum(F.col("_ends").cast("long")).alias("_ended"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ended = ended.select(*BLOCK, F.coalesce(F.sum("_ended").over(earlier), F.lit(0)).alias("_before"))
    whole = (
        parts.join(ended, BLOCK)
        .groupBy("_file", (F.col("_before") + F.col("_number")).alias("position"))
        .agg(
            F.array_sort(F.collect_list(F.struct("_block", "_text"))).alias("_parts"), F.max("_ends").alias("_ends")
        )
        .where("_ends")
    )
    text = F.array_join(F.transform("_parts", lambda p: p["_text"]), "")
    opened = F.when(F.col("position") == 0, F.regexp_replace(text, r"^[\s﻿]*\[", "")).otherwise(text)
    return whole.select(
        F.col("_file").alias("file"), "position", F.regexp_replace(opened, r"^[\s,]+", "").alias("element")
    )
