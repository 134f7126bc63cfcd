"""Personal data: strict patterns, and boosted trees that judge looser candidates by format and context."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BINS, BoostedTrees, bin_bytes, fit_boosted, fit_boosted_table, in_bins
from tidemark.llm.common import give_back, giving_back, in_slices, saved

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")

# The strict patterns. An email is sought around each @, see `_emails`; the others
# are written so that no start is tried twice within a run of digits.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: No candidate of any kind is without one of these.
TRIGGER = re.compile(r"[0-9@(\[{]")
#: Looser candidates: addresses spelt out, and numbers in groups.
SPELT = re.compile(
    r"[\w.%+-]{1,64}\s?(?:[(\[{]\s?at\s?[)\]}]|@)\s?[\w-]{1,64}(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[\w-]{1,64}){1,6}",
    re.IGNORECASE | re.ASCII,
)
NUMBER = re.compile(r"(?<![\w+(])[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,24}(?![0-9])")
PARTED = re.compile(
    r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\.|[(\[{]\s?(?:dot|\.)\s?[)\]}])\s?[0-9]{1,3}){3}(?![\w.]?[0-9])", re.IGNORECASE | re.ASCII
)
DIGITS = re.compile(r"[0-9]+")
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "iban"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "sms"),
}
CONTEXT = 40

#: Extra spans of a kind must be right at this rate on candidates the trees were not trained on.
PRECISION = 0.98
LEAST_CANDIDATES = 50
#: Thresholds are whole numbers of this fraction, and so few that the driver can choose among all.
STEP = 1 / 256
MOST_LOG_ODDS = 64


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each sought from its @: the local part is the run of letters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the strict patterns that pass their checks, by kind and start; ends are exclusive."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    out += [
        ("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))
    ]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(number := _only_digits(m.group())) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Loose spans, some of them proposed as several kinds."""
    out: list[Span] = [("email", m.start(), m.end()) for m in SPELT.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in PARTED.finditer(text)]
    for m in NUMBER.finditer(text):
        n = len(_only_digits(m.group()))
        if 7 <= n <= 15:
            out.append(("phone", m.start(), m.end()))
        if 13 <= n <= 19:
            out.append(("card", m.start(), m.end()))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate, and what stands around it."""
    kind, start, end = span
    inside = text[start:end]
    digits = _only_digits(inside)
    numbers = DIGITS.findall(inside)
    groups = [len(g) for g in numbers]
    before = text[max(0, start - CONTEXT) : start].lower()
    after = text[end : end + 1]
    return [
        *[float(kind == k) for k in KINDS],
        float(end - start),
        float(len(digits)),
        len(digits) / (end - start),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(inside.startswith("+")),
        float("(" in inside),
        float(inside.count("-")),
        float(inside.count(".")),
        float(inside.count(" ")),
        float(luhn(digits)) if digits else -1.0,
        float(len(numbers) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in numbers)),
        float(inside.count("/")),
        float("@" in inside or "at" in inside.lower()),
        float(sum(c.isalpha() for c in inside)),
        float(any(cue in before for cue in CUES[kind])),
        float(before[-1:].isspace() or not before),
        float(after.isspace() or not after),
        float(before[-1:].isalnum()),
        float(after.isalnum()),
    ]


class Standing:
    """Spans to look others up among, in the time of a search; those of a list do not overlap if of one kind."""

    def __init__(self, *lists: Sequence[Span]) -> None:
        self._ends: dict[tuple[int, str], list[int]] = {}
        self._spans: dict[tuple[int, str], list[Span]] = {}
        for k, spans in enumerate(lists):
            for span in sorted(spans, key=lambda s: s[1]):
                self._ends.setdefault((k, span[0]), []).append(span[2])
                self._spans.setdefault((k, span[0]), []).append(span)

    def touching(self, span: Span, kinds: Sequence[str] = KINDS) -> Iterator[Span]:
        """Those of some kinds that share characters with a span."""
        for key, ends in self._ends.items():
            if key[1] in kinds:
                spans, at = self._spans[key], bisect_right(ends, span[1])
                while at < len(spans) and spans[at][1] < span[2]:
                    yield spans[at]
                    at += 1

    def touches(self, span: Span) -> bool:
        return any(True for _ in self.touching(span))

    def matches(self, span: Span) -> bool:
        return _matches(span, list(self.touching(span, (span[0],))))


def _matches(span: Span, base: Sequence[Span]) -> bool:
    """Whether a strict span of the kind covers nearly the same characters."""
    kind, a, b = span
    return any(k == kind and min(b, d) - max(a, c) >= 0.8 * (max(b, d) - min(a, c)) for k, c, d in base)


def _by_fours(card: str, between: str) -> str:
    digits = _only_digits(card)
    return between.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def _worded(address: str, at: str, dot: str) -> str:
    local, _, domain = address.partition("@")
    return f"{local}{at}{domain.replace('.', dot)}"


#: Ways to write a strict span so that the strict patterns do not see it, as many for each kind.
LOOSE = {
    "email": (
        lambda s: _worded(s, " (at) ", " (dot) "),
        lambda s: _worded(s, "[at]", "[dot]"),
        lambda s: _worded(s, " @ ", "."),
    ),
    "ip": (
        lambda s: s.replace(".", " . "),
        lambda s: s.replace(".", "[.]"),
        lambda s: s.replace(".", " (dot) "),
    ),
    "card": (
        lambda s: _by_fours(s, "."),
        lambda s: _by_fours(s, " - "),
        lambda s: _by_fours(s, "/"),
    ),
    "phone": (lambda s: s.lstrip("+"), lambda s: s.lstrip("+").replace("-", "/"), lambda s: "00" + s.lstrip("+")),
}


WAYS = 3


def _spelt_out(text: str, base: Sequence[Span], way: int) -> tuple[str, list[Span]]:
    """The text with its strict spans written loosely in one of the ways, and where they stand then."""
    parts: list[str] = []
    spans: list[Span] = []
    at = length = 0
    for kind, start, end in sorted(base, key=lambda s: s[1:]):
        if start < at:
            continue
        loose = LOOSE[kind][way](text[start:end])
        begin = length + start - at
        spans.append((kind, begin, begin + len(loose)))
        parts += [text[at:start], loose]
        at, length = end, begin + len(loose)
    return "".join([*parts, text[at:]]), spans


@dataclass(frozen=True)
class SpanModel:
    """Trees over candidate features, and for each kind the log odds from which a candidate becomes a span."""

    trees: BoostedTrees
    least: dict[str, float]

    def spans(self, texts: Sequence[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """For each whole text its strict spans, and those with the added ones."""
        out, owner, rows, extra = [], [], [], []
        for text in texts:
            base = base_spans(text) if text and TRIGGER.search(text) else []
            out.append((base, list(base)))
            if not text or not TRIGGER.search(text) or all(x == np.inf for x in self.least.values()):
                continue
            taken = Standing(base)
            for span in candidates(text):
                if self.least[span[0]] < np.inf and not taken.touches(span):
                    owner.append(len(out) - 1)
                    rows.append(features(text, span))
                    extra.append(span)
        if rows:
            margins = self.trees.margin(np.array(rows))
            found = [(o, s, m) for o, s, m in zip(owner, extra, margins.tolist()) if m >= self.least[s[0]]]
            for text, group in groupby(found, key=lambda x: x[0]):
                # Of overlapping candidates the likeliest stays; ties go to the first.
                kept: list[Span] = []
                for _, span, _ in sorted(group, key=lambda x: (-x[2], x[1][1], x[1][0])):
                    if all(span[2] <= k[1] or k[2] <= span[1] for k in kept):
                        kept.append(span)
                out[text][1].extend(kept)
        return [(sorted(a, key=_order), sorted(b, key=_order)) for a, b in out]


def _order(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _steps(margins: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(margins, -MOST_LOG_ODDS, MOST_LOG_ODDS) / STEP).astype(np.int64)


def _least(steps: np.ndarray, n: np.ndarray, right: np.ndarray) -> float:
    """The lowest log odds, at least 0, from which candidates are right at the rate PRECISION.

    Given are different log odds in steps, how many candidates have them and how many of those are right.
    """
    if n.sum() < LEAST_CANDIDATES or not right.any():
        return np.inf
    order = np.argsort(-steps)
    good = np.nonzero(right[order].cumsum() / n[order].cumsum() >= PRECISION)[0]
    return float(max(steps[order][good[-1]] * STEP, 0.0)) if len(good) else np.inf


def examples(text: str) -> Counter[tuple[tuple[float, ...], bool, str | None]]:
    """The candidates of a text, as written and with its strict spans spelt out in all ways, and how often.

    Each has its features, whether it is right, and its kind if the model will be asked about it:
    a candidate is right if a strict span of its kind stands where it does, or one that was spelt
    out; the model is asked about those that no strict span touches.
    """
    found: Counter[tuple[tuple[float, ...], bool, str | None]] = Counter()
    base = base_spans(text)
    loose = [_spelt_out(text, base, way) for way in range(WAYS)] if base else []
    for version, known in [(text, []), *loose]:
        strict = base if version is text else base_spans(version)
        taken, standing = Standing(strict), Standing(strict, known)
        for span in candidates(version):
            found[tuple(features(version, span)), standing.matches(span), None if taken.touches(span) else span[0]] += 1
    return found


def train(texts: Sequence[str]) -> SpanModel:
    """Trees from the examples of different texts in memory; half of the texts, by crc32, find the thresholds.

    For each kind the threshold is found among the candidates that the model will be asked about. A
    kind with fewer than LEAST_CANDIDATES of them, or with no right one, adds nothing to the strict spans.
    """
    folds: tuple[list, list] = ([], [])
    for text in dict.fromkeys(texts):
        folds[crc32(text.encode()) % 2].extend(examples(text).elements())
    y = [right for _, right, _ in folds[0]]
    if not any(y) or all(y) or not folds[1]:
        return _without_model()
    trees = fit_boosted(np.array([x for x, _, _ in folds[0]]), np.array(y, dtype=float))
    least = {}
    for kind in KINDS:
        asked = [(x, right) for x, right, of in folds[1] if of == kind]
        steps, at = np.unique(_steps(trees.margin(np.array([x for x, _ in asked]))), return_inverse=True)
        least[kind] = _least(steps, np.bincount(at), np.bincount(at, [right for _, right in asked]))
    return SpanModel(trees, least)


def _without_model() -> SpanModel:
    return SpanModel(fit_boosted(np.zeros((0, 1)), np.zeros(0)), dict.fromkeys(KINDS, np.inf))


def trained_model(docs: DataFrame) -> SpanModel:
    """The model of `train` from all different whole texts that can hold a candidate.

    Tasks make the examples; equal ones become one row with a count. Cuts are exact quantiles, trees
    grow from sums over all rows, and thresholds from counts over all rows. The driver receives
    those sums only.
    """
    rows = saved(_example_rows(docs), "pii-examples")
    fits = F.col("fold") == 0
    width = len(features("1", ("ip", 0, 1)))
    quantiles = F.array(*[F.lit(q) for q in np.linspace(0, 1, BINS + 1)[1:-1].tolist()])
    # Candidates are short, so that a feature has few different values.
    found = rows.where(fits).agg(*[F.percentile(F.col("x")[k], quantiles, F.col("n")) for k in range(width)]).first()
    if found[0] is None:
        return _without_model()
    cuts = [np.unique(column) for column in found]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            bins = pa.array([row.tobytes() for row in in_bins(x, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([bins, *[batch.column(c) for c in (*EXAMPLE, "n")]], ["bins", *EXAMPLE, "n"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*EXAMPLE, "n"))
    in_cells = rows.mapInArrow(binned, f"bins binary, {kinds}").groupBy("bins", *EXAMPLE).agg(F.sum("n").alias("n"))
    cells = saved(in_cells, "pii-cells")
    trees = fit_boosted_table(cells.where(fits), cuts)
    if not len(trees.leaf):
        return _without_model()
    return SpanModel(trees, _thresholds(cells.where(~fits & F.col("asked").isNotNull()), trees, cuts))


#: What an example has beside its features.
EXAMPLE = ("fold", "right", "asked")


def _example_rows(docs: DataFrame) -> DataFrame:
    """Different examples of all different texts: features x, fold, right, asked and how often, n."""
    texts = docs.where(F.col("text").rlike(TRIGGER.pattern)).select(
        "text", F.md5("text").alias("key"), (F.crc32("text") % 2).cast("int").alias("fold")
    )

    @giving_back
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_slices(batch.column("text")):
                rows = [
                    (x, batch.column("key")[k].as_py(), batch.column("fold")[k].as_py(), right, asked, n)
                    for k, text in enumerate(part, at)
                    for (x, right, asked), n in examples(text).items()
                ]
                at += len(part)
                if rows:
                    columns = list(zip(*rows))
                    types = (pa.list_(pa.float64()), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
                    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(arrays, ["x", "key", *EXAMPLE, "n"])

    found = texts.mapInArrow(made, "x array<double>, key string, fold int, right boolean, asked string, n long")
    # Equal texts have equal examples, which count once.
    once = found.groupBy("key", "x", *EXAMPLE).agg(F.max("n").alias("n"))
    return once.groupBy("x", *EXAMPLE).agg(F.sum("n").alias("n"))


def _thresholds(cells: DataFrame, trees: BoostedTrees, cuts: Sequence[np.ndarray]) -> dict[str, float]:
    """For each kind the threshold from all candidates that the trees were not trained on."""
    # The upper end of a bin stands for its values: no cut lies between them.
    values = [np.concatenate([c, [np.inf]]) for c in cuts]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bin_bytes(batch.column("bins"))
            x = np.stack([v[column] for v, column in zip(values, bins.T)], axis=1)
            steps = pa.array(_steps(trees.margin(x)))
            yield pa.RecordBatch.from_arrays([steps, *[batch.column(c) for c in ("asked", "right", "n")]], ["step", "asked", "right", "n"])

    found = cells.select("bins", "asked", "right", "n").mapInArrow(judged, "step long, asked string, right boolean, n long")
    counts = found.groupBy("asked", "step").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("right").cast("int")).alias("right")
    )
    least = dict.fromkeys(KINDS, np.inf)
    for kind, group in counts.toPandas().groupby("asked"):
        least[kind] = _least(*[group[c].to_numpy() for c in ("step", "n", "right")])
    return least


def find_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Spans of every document: doc_id, counts of strict spans by kind, base_sha256, spans.

    Whole texts are searched; null and empty texts have none. Positions are code points. Only
    doc_id and text are read; repeated rows are all kept.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, spans in model.spans(texts.tolist()):
                kinds = [kind for kind, _, _ in base]
                digest = sha256(listed(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in KINDS], digest, listed(spans)))
            yield pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", search(F.col("text")).alias("_s")).select("doc_id", "_s.*")


def redact(model: SpanModel) -> Column:
    """Column `text` with its spans replaced by their kinds; null stays null."""

    @F.arrow_udf("string")
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], pa.string())]
            for part in in_slices(texts):
                spans = model.spans(part)
                parts.append(pa.array([t if t is None else redacted(t, s) for t, (_, s) in zip(part, spans)], pa.string()))
            yield pa.concat_arrays(parts)
        give_back()

    return replace(F.col("text"))
