"""Document fingerprints: SimHash over weighted terms, and searches by permuted block tables.

Everything here is built from DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, saved
from tidemark.operators.positions import with_positions

BITS = 64
#: A term counts as much as it has letters beyond two, within these bounds: short words are in all texts.
LEAST_WEIGHT, MOST_WEIGHT = 1, 8
#: Votes are added up four to a long, 16 bits each, so terms are counted in runs that cannot overflow
#: into the next lane or the sign.
LANES = 4
LANE_BITS = 16
RUN = ((1 << (LANE_BITS - 1)) - 1) // MOST_WEIGHT
#: Multiplying by SPREAD and masking moves bit i of a number below 16 to bit 16 * i.
SPREAD = sum(1 << (i * (LANE_BITS - 1)) for i in range(LANES))
LANE_MASK = sum(1 << (i * LANE_BITS) for i in range(LANES))
#: Neighbouring ids that are sorted together; keys that one task may put in order.
ID_BITS = 6
SORTED_AT_ONCE = 16_384
NO_ID = -(1 << 62)
#: Rows of a range of ids that one task puts in order, and letters that order texts under one id.
PART_ROWS = 4096
PREFIX = 64
#: Documents that are looked up among all others, and how many bits may differ.
QUERY_STEP = 50
RADIUS = 3


def fingerprints(df: DataFrame, keys: list[str], text: str, out: str = "fingerprint") -> DataFrame:
    """`keys` and the 64-bit fingerprint of column `text` as a long in `out`; `keys` tell rows apart.

    Terms are the lower-cased words of the whole text. Null, empty and blank texts have fingerprint
    0; equal texts have equal fingerprints. Every term casts its votes into sums for its run of the
    text, runs are added up bit by bit, and a bit is set where more than half of the weight voted
    for it. Where `df` is dealt out by some of `keys` nothing is shuffled, else a row for each run.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"{SPACE_CLASS}+")
    terms = df.select(*keys, F.posexplode(words).alias("_place", "_word")).select(
        *keys,
        (F.col("_place") / RUN).cast("int").alias("_run"),
        F.xxhash64("_word").alias("_hash"),
        F.when(F.col("_word") == "", 0)
        .otherwise(F.greatest(F.least(F.length("_word") - 2, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)))
        .cast("long")
        .alias("_weight"),
    )

    def packed(k: int) -> Column:
        four = F.shiftrightunsigned("_hash", k * LANES).bitwiseAND(F.lit(15).cast("long"))
        return (four * F.lit(SPREAD)).bitwiseAND(F.lit(LANE_MASK)) * F.col("_weight")

    runs = terms.groupBy(*keys, "_run").agg(
        *[F.sum(packed(k)).alias(f"_v{k}") for k in range(BITS // LANES)], F.sum("_weight").alias("_all")
    )

    def votes(b: int) -> Column:
        lane = F.shiftrightunsigned(f"_v{b // LANES}", b % LANES * LANE_BITS)
        return F.sum(lane.bitwiseAND(F.lit((1 << LANE_BITS) - 1).cast("long")))

    sums = runs.groupBy(*keys).agg(*[votes(b).alias(f"_b{b}") for b in range(BITS)], F.sum("_all").alias("_all"))
    bits = F.lit(0).cast("long")
    for b in range(BITS):
        bit = F.shiftleft(F.lit(1).cast("long"), b)
        bits = bits.bitwiseOR(F.when(F.col(f"_b{b}") * 2 > F.col("_all"), bit).otherwise(0))
    return sums.select(*keys, bits.alias(out))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of column `text` in `out`, replaced if there; it is written once."""
    rows = saved(df.drop(out).withColumn("_row", F.monotonically_increasing_id()), "texts")
    return rows.join(fingerprints(rows, ["_row"], text, out), "_row").drop("_row")


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def shown(fingerprint: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All fingerprints of `corpus` at most `radius` bits from one of `queries`, itself excluded.

    Both have a long column `fingerprint`; the result has fingerprint, near, distance, one row for
    each pair of different fingerprints. Bits are cut into blocks. Two fingerprints that differ in
    at most `radius` bits agree in at least `blocks - radius` blocks, so one table is kept for each
    choice of that many blocks, keyed by their bits, and candidates meet in the first table in
    which they agree: no pair is lost or found twice. Equal fingerprints are one entry, so copies
    cost nothing; null ones are left out.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be smaller than the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]

    def entries(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        rows = F.array(
            *[F.struct(F.lit(t).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)]
        )
        return distinct.select(name, F.inline(rows))

    a, b = entries(queries, "fingerprint"), entries(corpus, "near")
    unlike = F.col("fingerprint").bitwiseXOR(F.col("near"))
    first = F.coalesce(*[F.when(unlike.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    met = (
        (a["table"] == b["table"])
        & (a["key"] == b["key"])
        & (unlike != 0)
        & (F.bit_count(unlike) <= radius)
        & (first == a["table"])
    )
    return a.join(b, met).select("fingerprint", "near", F.bit_count(unlike).alias("distance"))


def next_keys(keys: DataFrame, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """For every value of the distinct long column `key` the next larger one, `next_key`; the
    smallest follows the largest.

    Few keys are sorted by one task. More are cut into ranges of 4096 values, in which tasks sort
    side by side, and what follows a range is found in the same way among the ranges.
    """
    keys = saved(keys.select("key"), "keys")
    if keys.count() <= at_once:
        whole = Window.orderBy("key")
        first = F.min("key").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return keys.select("key", F.coalesce(F.lead("key").over(whole), first).alias("next_key"))
    ranged = keys.select("key", F.shiftright("key", 12).alias("range"))
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"))
    order = next_keys(firsts.select(F.col("range").alias("key")), at_once)
    after = order.join(firsts.withColumnRenamed("range", "next_key"), "next_key").select(
        F.col("key").alias("range"), F.col("first").alias("after")
    )
    inside = F.lead("key").over(Window.partitionBy("range").orderBy("key"))
    return ranged.join(after, "range").select("key", F.coalesce(inside, F.col("after")).alias("next_key"))


def _with_next(rows: DataFrame, order: list[str], value: str, out: str, ranges: DataFrame) -> DataFrame:
    """`rows` with `value` of the next row in `out`: by ranges of ids and their parts, then `order`."""
    window = Window.partitionBy("_range", "_part").orderBy(*order)
    inside = rows.withColumn(out, F.lead(value).over(window)).withColumn(
        "_last", F.lead(F.lit(1)).over(window).isNull()
    )
    key = F.struct(*order, F.col(value).alias("v"))
    firsts = rows.groupBy("_range", "_part").agg(F.min(key)["v"].alias("_after"))
    # After a part comes the next one of its range, after the last the first one of the next range.
    within = firsts.where(F.col("_part") > 0).select(
        F.col("_range").alias("_to"), (F.col("_part") - 1).alias("_to_part"), "_after"
    )
    lasts = rows.groupBy(F.col("_range").alias("key")).agg(F.max("_part").alias("_to_part"))
    begins = firsts.where(F.col("_part") == 0).select(F.col("_range").alias("next_key"), "_after")
    across = ranges.join(lasts, "key").join(begins, "next_key").select(F.col("key").alias("_to"), "_to_part", "_after")
    after = within.unionByName(across)
    met = (F.col("_range") == F.col("_to")) & (F.col("_part") == F.col("_to_part")) & F.col("_last")
    joined = inside.join(after, met, "left")
    return joined.withColumn(out, F.when(F.col("_last"), F.col("_after")).otherwise(F.col(out))).drop(
        "_to", "_to_part", "_after", "_last"
    )


def _parted(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `_part`: ranges that hold many rows, as of one repeated id, are cut into parts of
    PART_ROWS rows in the order of `order`; most ranges are one part."""
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    hot = saved(sizes.where(F.col("_rows") > PART_ROWS).select("_range"), "hot-ranges")
    whole = F.lit(0).cast("long").alias("_part")
    if hot.isEmpty():
        return rows.select("*", whole)
    placed = with_positions(rows.join(hot, "_range", "left_semi"), order, within=["_range"], name="_place")
    parts = placed.select(*rows.columns, F.floor(F.col("_place") / PART_ROWS).alias("_part"))
    return rows.join(hot, "_range", "left_anti").select("*", whole).unionByName(parts)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness.

    The edited text has the first half of a document, and for the rest the first letters of the
    next document. Documents follow one another by doc_id, null ids first; those that share an id by
    the first PREFIX letters of their texts, then by a hash of the text. The first follows the last.
    Null texts count as empty. Texts are shuffled once, by ranges of ids, and only the first text of
    a range once more; a range that holds many rows is cut into parts, so neither a repeated id nor
    missing ids bring many texts together in one task.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal),
    near_edited, near_next, n_near: for documents whose doc_id is divisible by QUERY_STEP the number
    of different fingerprints of all documents within RADIUS bits of theirs, else null.
    """
    by_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), ID_BITS), F.lit(NO_ID)).alias("_range"),
        by_id.alias("_id"),
        F.substring("text", 1, PREFIX).alias("_prefix"),
        F.xxhash64("text").alias("_text_hash"),
    )
    ranges = saved(next_keys(rows.select(F.col("_range").alias("key")).distinct()), "ranges")
    order = ["_id", "_prefix", "_text_hash"]
    parted = _parted(rows, order)
    numbered = parted.withColumn("_at", F.row_number().over(Window.partitionBy("_range", "_part").orderBy(*order)))
    paired = _with_next(numbered, order, "text", "_next", ranges).withColumn(
        "_half", F.floor(F.length("text") / 2).cast("int")
    )
    edited = F.concat(F.expr("substring(text, 1, length(text) - _half)"), F.expr("substring(_next, 1, _half)"))
    told = paired.select(
        "_range",
        "_part",
        "_at",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        edited.alias("_edited"),
    )
    keys = ["_range", "_part", "_at", "doc_id", "n_chars", "edited_sha256", "_which"]
    both = told.withColumn("edited_sha256", F.unhex(F.sha2("_edited", 256))).select(
        *keys[:-1],
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_which"), F.col("text").alias("_text")),
                F.struct(F.lit(1).alias("_which"), F.col("_edited").alias("_text")),
            )
        ),
    )
    prints = fingerprints(both, keys, "_text", "_print")
    made = prints.groupBy(*keys[:-1]).agg(
        *[F.max(F.when(F.col("_which") == n, F.col("_print"))).alias(c) for n, c in enumerate(("_f", "_g"))]
    )
    facts = saved(made.withColumn("edited_sha256", F.lower(F.hex("edited_sha256"))), "fingerprints")
    done = _with_next(facts, ["_at"], "_f", "_n", ranges).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("_f")).alias("fingerprint"),
        shown(F.col("_g")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_g")).alias("near_edited"),
        likeness(F.col("_f"), F.col("_n")).alias("near_next"),
        F.col("_f"),
    )
    # The search: some documents as queries, all fingerprints as the corpus.
    asked = F.coalesce(F.col("doc_id") % QUERY_STEP == 0, F.lit(False))
    corpus = facts.select("doc_id", F.col("_f").alias("fingerprint"))
    pairs = within_radius(corpus.where(asked), corpus, RADIUS)
    counts = pairs.groupBy(F.col("fingerprint").alias("_f")).agg(F.count(F.lit(1)).alias("_near"))
    searched = done.where(asked).join(counts, "_f", "left").withColumn("n_near", F.coalesce("_near", F.lit(0).cast("long")))
    others = done.where(~asked).withColumn("n_near", F.lit(None).cast("long"))
    return searched.drop("_near", "_f").unionByName(others.drop("_f"))
