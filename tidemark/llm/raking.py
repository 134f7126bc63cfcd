"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities.

Everything here is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, saved

#: Target marginals by column. Named shares hold for named values; what they leave goes to all other
#: values in proportion to their tokens. Where they leave nothing, other values keep the share of
#: tokens that they have, and named shares hold among the rest. A number tempers the shares: 1 leaves them as they are,
#: and the smaller it is, the more alike they become.
Targets = Mapping[str, Mapping[str, float] | float]

SOURCE_LANGUAGE_TOPIC: Targets = {
    "source": 0.7,
    "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    "topic": 0.95,
}
#: Rounds of raking, and how many are planned at once between two writes of the cells.
ROUNDS = 30
ROUNDS_AT_ONCE = 10
#: Up to this many cells are raked by one task; more are shuffled.
CELLS_AT_ONCE = 20_000
#: Named shares that leave less than this leave nothing.
LEAST_REST = 1e-9
#: Value of a null in a column that is raked.
NONE = "none"


def topic(text: Column) -> Column:
    """The kind of a text by marks it has anywhere; the first that fits."""
    value = F.coalesce(text, F.lit(""))
    marked = F.lit(False)
    for mark in ("###", "***", "$$$", "%%%", "&&&"):
        marked = marked | F.contains(value, F.lit(mark))
    return (
        F.when(F.contains(value, F.lit(" | ")), "table")
        .when(marked, "marked")
        .when(F.contains(value, F.lit("License")), "licence")
        .when(F.contains(value, F.lit("@")), "contact")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """The number of words, 0 for null and blank texts."""
    words = F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def uniform(*keys: Column) -> Column:
    """A number from [0, 1) that depends on the keys alone: 32 bits of their md5."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _over(*columns: str) -> Window:
    return Window.partitionBy(*columns)


def _target(column: str, target: Mapping[str, float] | float, cells: DataFrame) -> DataFrame:
    """`cells` with the share that the value of `column` is to have; shares of present values sum to 1."""
    share, name = F.col("_own"), f"_target_{column}"
    values = cells.groupBy(column).agg(F.sum("tokens").alias("_tokens")).where(F.col("_tokens") > 0)
    total = F.sum("_tokens").over(Window.partitionBy())
    values = values.withColumn("_own", F.col("_tokens") / total)
    if isinstance(target, Mapping):
        named = F.coalesce(*[F.when(F.col(column) == v, F.lit(float(s))) for v, s in sorted(target.items())], F.lit(None))
        rest = 1.0 - sum(target.values())
        others = F.sum(F.when(named.isNull(), share)).over(Window.partitionBy())
        if rest > LEAST_REST:
            wanted = F.coalesce(named, F.lit(rest) * share / others)
        else:
            # Named shares as they are to one another, over the tokens of named values.
            present = F.sum(named).over(Window.partitionBy())
            scaled = F.when(named == 0, 0.0).otherwise(named / present * (1 - F.coalesce(others, F.lit(0.0))))
            wanted = F.coalesce(scaled, share)
    else:
        wanted = F.pow(share, F.lit(float(target)))
    values = values.withColumn("_wanted", wanted)
    # If only values of share 0 are there, they stay as they are.
    sums = F.sum("_wanted").over(Window.partitionBy())
    values = values.withColumn(name, F.when(sums > 0, F.col("_wanted") / sums).otherwise(share))
    return cells.join(values.select(column, name), column)


def rake(cells: DataFrame, targets: Targets, rounds: int = ROUNDS) -> DataFrame:
    """Weights of `cells` (the columns of `targets` and tokens) whose marginals are the targets.

    Iterative proportional fitting: for one column after the other, weights are scaled so that each
    value has its target share. Starting from the tokens, this gives the weights nearest to them.
    Cells without tokens are left out; targets of values that do not occur are shared out. Adds
    `weight` (they sum to 1) and `off`, the largest distance left between a marginal and its target:
    targets that no weights can meet, as when two values only occur together, show there.
    """
    for column, target in targets.items():
        cells = _target(column, target, cells)
    cells = saved(
        cells.where(F.col("tokens") > 0).withColumn(
            "weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
        ),
        "cells",
    )
    one_task = cells.count() <= CELLS_AT_ONCE
    for start in range(0, rounds, ROUNDS_AT_ONCE):
        # One partition needs no exchange for any of the windows.
        cells = cells.coalesce(1) if one_task else cells
        for _ in range(min(ROUNDS_AT_ONCE, rounds - start)):
            for column in targets:
                present = F.sum("weight").over(_over(column))
                # A value that another column has left without weight cannot be scaled.
                scale = F.when(present > 0, F.col(f"_target_{column}") / present).otherwise(0.0)
                cells = cells.withColumn("weight", F.col("weight") * scale)
        cells = saved(cells, "cells")
    cells = cells.coalesce(1) if one_task else cells
    off = [F.abs(F.sum("weight").over(_over(c)) - F.col(f"_target_{c}")) for c in targets]
    cells = cells.withColumns({f"_off{i}": c for i, c in enumerate(off)})
    worst = F.greatest(*[F.max(f"_off{i}").over(Window.partitionBy()) for i in range(len(off))], F.lit(0.0))
    return cells.withColumn("off", worst).drop(
        *[f"_off{i}" for i in range(len(off))], *[f"_target_{c}" for c in targets]
    )


def keep_probabilities(raked: DataFrame) -> DataFrame:
    """`raked` with `probability`, the chance of a document of the cell: its weight over its share of
    the tokens, scaled so that the largest is 1. Expected tokens of what is kept then have exactly
    the raked shares, and no document is wanted twice."""
    everything = Window.partitionBy()
    need = F.col("weight") / (F.col("tokens") / F.sum("tokens").over(everything))
    needed = raked.withColumn("_need", need)
    # Digits beyond these depend on the order of summation. What is wanted at all keeps a chance, the
    # smallest that a draw can tell from none.
    most = F.max("_need").over(everything)
    least = F.when(F.col("_need") > 0, F.lit(1 / (1 << 32))).otherwise(0.0)
    chance = F.when(most > 0, F.greatest(F.round(F.col("_need") / most, 9), least)).otherwise(0.0)
    return needed.withColumn("probability", chance).drop("_need")


def described(docs: DataFrame) -> DataFrame:
    """`docs` with the raked columns and tokens under names of their own, so that none is replaced."""
    return docs.withColumns(
        {
            "_source": F.coalesce(F.col("source"), F.lit(NONE)),
            "_lang": F.coalesce(F.col("lang"), F.lit(NONE)),
            "_topic": topic(F.col("text")),
            "_tokens": tokens(F.col("text")),
        }
    )


def mix(docs: DataFrame, targets: Targets = SOURCE_LANGUAGE_TOPIC, rounds: int = ROUNDS) -> DataFrame:
    """The documents of `docs` that the sample takes, with _source, _lang, _topic, _tokens and
    _probability added.

    Tokens are summed by source, language and topic before they are shuffled, so a source that has
    most rows is no burden. A document is taken if a number drawn from its doc_id is below the
    probability of its cell: the same documents in every run, and equal ids together. Documents
    without a word weigh nothing; their draw is held against the mean probability, 1 if there is
    no other document.
    """
    facts = described(docs)
    cells = facts.groupBy(*[F.col(f"_{c}").alias(c) for c in ("source", "lang", "topic")]).agg(
        F.sum("_tokens").alias("tokens")
    )
    chances = saved(keep_probabilities(rake(cells, targets, rounds)), "chances")
    average = chances.agg((F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens")).alias("p")).first()["p"]
    chances = chances.select(*[F.col(c).alias(f"_{c}") for c in ("source", "lang", "topic")], F.col("probability").alias("_cell"))
    weighed = facts.join(chances, ["_source", "_lang", "_topic"], "left")
    probability = F.when(F.col("_tokens") > 0, F.col("_cell")).otherwise(F.lit(1.0 if average is None else round(average, 9)))
    return weighed.withColumn("_probability", probability).where(uniform(F.col("doc_id")) < F.col("_probability")).drop("_cell")


def sampled_documents(docs: DataFrame) -> DataFrame:
    """The sample: doc_id, source, lang, topic, n_tokens, probability. Nulls of source and lang read none."""
    taken = mix(docs.select("doc_id", "text", "source", "lang"))
    return taken.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"),
    )
