"""Quality rules whose cutoffs are chosen so that few good texts are rejected, with a guarantee.

Everything here is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, saved

#: What a rule looks at: a text is rejected where the measure is over the cutoff. Cutoffs are
#: tried from the mildest on and are fixed before any label is seen.
SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05)
MEASURES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05),
    "capital_share": SHARES,
    "repeat_share": SHARES,
    "dup_line_share": SHARES,
    "chars_per_word": (20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
}
#: Languages with cutoffs of their own; all others form one more stratum.
STRATA = ("en", "de", "fr", "es")
#: A stratum loses at most this share of its good texts, except with probability DELTA over all strata.
FALSE_REJECTION = 0.05
DELTA = 0.05
#: Among valid cutoffs, a good text lost outweighs this many bad ones caught.
GOOD_WEIGHT = 10.0
LEAST_WORDS = 50


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash and sorted, so that equal ones are neighbours.
    """
    windows = F.transform(
        F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("hash"), i.alias("at")
        ),
    )

    def places(ordered: Column) -> Column:
        repeated = F.filter(
            ordered,
            lambda w, i: F.get(ordered, i - 1)["hash"].eqNullSafe(w["hash"])
            | F.get(ordered, i + 1)["hash"].eqNullSafe(w["hash"]),
        )
        return F.array_sort(F.transform(repeated, lambda w: w["at"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    # Arrays around a value bind it once for all elements.
    return F.aggregate(
        F.transform(F.array(F.array_sort(windows)), places)[0],
        start,
        lambda sums, at: F.struct(
            (at + 3).alias("end"), (sums["words"] + F.least(F.lit(3), at + 3 - sums["end"])).alias("words")
        ),
        lambda sums: sums["words"],
    )


def text_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counts that the rules need, over the whole of column `text`.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, all long
    and 0 for null and empty texts; columns of these names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumns(
        {
            "_words": F.filter(F.split(value, f"{SPACE_CLASS}+"), lambda w: w != ""),
            "_lines": F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    without = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    words, lines = F.col("_words"), F.col("_lines")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": without(r"[#*$%&|<>]"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_lines": F.size(lines),
        "n_capitals": without(r"[A-Z]"),
    }
    return split.withColumns({name: c.cast("long") for name, c in counts.items()}).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The measures of MEASURES from the counts of `text_facts`; 0 where there is nothing to divide by."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "chars_per_word": share("word_chars", "n_words"),
    }


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise("other")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The exact probability of at most `k` successes in `n` trials; 1 where k is not below n * p.

    Terms are added up as logarithms, so that a large n does not underflow.
    """
    first = n * F.lit(math.log1p(-p))

    def add(sums: Column, i: Column) -> Column:
        term = sums["term"] + F.ln((n - i + 1) / i) + F.lit(math.log(p / (1 - p)))
        total = F.greatest(sums["total"], term) + F.log1p(F.exp(-F.abs(sums["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: F.exp(s["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def choose_cutoffs(labelled: DataFrame, alpha: float = FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """The cutoff of every rule and stratum: stratum, rule, cutoff and the evidence for it.

    `labelled` has stratum, good (0 or 1) and the columns of MEASURES. For each rule and stratum
    cutoffs are tested from the mildest on; one is valid if so few good texts are over it that, were
    the true share alpha / rules or more, this would have a probability of at most
    delta / (rules * strata). Tests stop at the first failure, so each sequence needs no further
    correction, and the rules of a stratum together reject at most alpha. Among the valid cutoffs
    the one that catches most bad texts for the good ones lost is taken, the mildest among equals;
    a rule that catches nothing, or has too few labels to be sure, gets no row.
    """
    rules = list(MEASURES)
    level = delta / (len(rules) * (len(STRATA) + 1))
    binned = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"),
                # The first step at which the text would be rejected; cutoffs fall from step to step.
                sum((F.col(r) <= c).cast("int") for c in MEASURES[r]).alias("first"),
            )
            for r in rules
        ]
    )
    bins = (
        labelled.select("stratum", "good", F.inline(binned))
        .groupBy("stratum", "rule", "first")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    # A row for every cutoff, also for those that no text comes to lie between.
    cutoffs = F.create_map(*[x for r in rules for x in (F.lit(r), F.array(*map(F.lit, MEASURES[r])))])
    steps = (
        bins.groupBy("stratum", "rule")
        .agg(F.collect_list(F.struct("first", "good", "bad")).alias("bins"))
        .select("stratum", "rule", "bins", F.posexplode(F.element_at(cutoffs, F.col("rule"))).alias("step", "cutoff"))
    )

    def total(name: str, all_bins: bool = False) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(
            "bins",
            zero,
            lambda s, b: s + F.when(F.lit(all_bins) | (b["first"] <= F.col("step")), b[name]).otherwise(zero),
        )

    tested = steps.select(
        "stratum",
        "rule",
        "step",
        "cutoff",
        total("good", True).alias("n_good"),
        total("good").alias("good_lost"),
        total("bad").alias("bad_caught"),
    ).withColumn("p_value", binomial_tail(F.col("good_lost"), F.col("n_good"), alpha / len(rules)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    valid = tested.withColumn("_worst", F.max("p_value").over(so_far)).where(F.col("_worst") <= level)
    gain = F.col("bad_caught") - GOOD_WEIGHT * F.col("good_lost")
    best = Window.partitionBy("stratum", "rule").orderBy(gain.desc(), "step")
    return (
        valid.withColumn("_place", F.row_number().over(best))
        .where((F.col("_place") == 1) & (gain > 0))
        .drop("_place", "_worst", "step")
    )


def rejected_by(facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`facts` with the number of rules that reject each row in `n_rules`, a column of this name replaced.

    There is at most one cutoff for each rule and each of the strata, so the table is small for any
    input and is sent to all tasks.
    """
    wide = cutoffs.groupBy(F.col("stratum").alias("_of")).pivot("rule", list(MEASURES)).agg(F.first("cutoff"))
    joined = facts.drop(*MEASURES).join(
        F.broadcast(wide.select("_of", *[F.col(r).alias(f"_{r}") for r in MEASURES])), F.col("stratum") == F.col("_of"), "left"
    )
    over = sum(F.coalesce((m > F.col(f"_{r}")).cast("int"), F.lit(0)) for r, m in measures().items())
    return joined.withColumn("n_rules", over).drop("_of", *[f"_{r}" for r in MEASURES])


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every document: doc_id, the counts, base_failed, n_rules, kept.

    `kept` is false where the base rules fail or a risk-controlled rule rejects. Cutoffs come from
    all labelled documents that pass the base rules; a stratum without enough labels rejects
    nothing. Labels other than 0 and 1, and null ids, are not used; repeated rows count as often as
    they occur. Texts are read once; the counts are written to the shared scratch folder.
    """
    facts = saved(
        text_facts(docs.select("doc_id", "text", stratum().alias("stratum"))).drop("text"), "facts"
    )
    good = labels.select("doc_id", F.col("quality").cast("long").alias("good")).where(F.col("good").isin(0, 1)).distinct()
    labelled = facts.where(~base_failed()).join(good, "doc_id").select("stratum", "good", *[m.alias(r) for r, m in measures().items()])
    judged = rejected_by(facts, saved(choose_cutoffs(labelled), "cutoffs"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("n_rules") == 0)).alias("kept"),
        "n_rules",
    )
