"""Quality classifier by compression against dictionaries of good and bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fit_logistic, fold, labelled_sample, logistic, positive_share

LEVEL = 3
DICTIONARY_BYTES = 112 << 10
#: A text is compressed in blocks, so that the dictionary stays in reach throughout a long one.
BLOCK_BYTES = 4 << 10
#: Bounds of the training sample: texts of either class, and characters of a text.
PER_CLASS = 2000
MAX_CHARS = 10_000


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of bad and good text, and the weights that turn sizes into a score."""

    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    prior: float

    def features(self, text: str) -> tuple[float, float]:
        """The normalised difference of the two compressed sizes, and how far the text compresses."""
        bad, good = _compressors(self.bad, self.good)
        data = text.encode("utf-8", "replace")
        with_bad = with_good = 0
        for at in range(0, len(data), BLOCK_BYTES):
            block = data[at : at + BLOCK_BYTES]
            with_bad += len(bad.compress(block))
            with_good += len(good.compress(block))
        if not data:
            return 0.0, 0.0
        return (with_bad - with_good) / (with_bad + with_good), math.log((with_bad + with_good) / 2 / len(data))

    def score(self, text: str | None) -> float:
        if not text or not self.weights:
            return self.prior
        difference, ratio = self.features(text)
        a, b, c = self.weights
        return logistic(a * difference + b * ratio + c)


@lru_cache(maxsize=2)
def _compressors(bad: bytes, good: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(bad), _compressor(good)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False)


def _dictionary(texts: Sequence[str]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    blocks = [data[at : at + 1024] for t in texts for data in [t.encode()] for at in range(0, len(data), 1024)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[-DICTIONARY_BYTES:]


def train(rows: Sequence[tuple[str, int]], prior: float | None = None) -> CompressionModel:
    """Dictionaries from one half of the rows, the calibration from the other.

    A text compresses too well against a dictionary it went into, so halves must not overlap:
    equal texts stay in one half. With a class missing, every score is `prior`,
    by default the share of good rows.
    """
    if prior is None:
        prior = (sum(label for _, label in rows) + 1) / (len(rows) + 2)
    unique = list(dict.fromkeys((text, label) for text, label in rows if text))
    half = {0: 0, 1: 0}
    parts: dict[tuple[int, int], list[str]] = {(label, part): [] for label in (0, 1) for part in (0, 1)}
    for text, label in unique:
        parts[label, half[label] % 2].append(text)
        half[label] += 1
    if not all(parts.values()):
        return CompressionModel(b"", b"", (), prior)
    draft = CompressionModel(_dictionary(parts[0, 0]), _dictionary(parts[1, 0]), (), prior)
    x = np.array([draft.features(t) for label in (0, 1) for t in parts[label, 1]])
    y = np.array([label for label in (0, 1) for _ in parts[label, 1]])
    scale = x.std(axis=0) + 1e-9
    w = fit_logistic((x - x.mean(axis=0)) / scale, y)
    slopes = w[:-1] / scale
    weights = (*map(float, slopes), float(w[-1] - slopes @ x.mean(axis=0)))
    return CompressionModel(draft.bad, draft.good, weights, prior)


def scorer(model: CompressionModel) -> Column:
    """The score of column `text`, computed over the whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(F.col("text"))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """The quality of every document: doc_id, held_out, score (higher: good likelier), predicted.

    Labels are learnt from rows outside the held-out fold only, at most PER_CLASS texts of up to
    MAX_CHARS characters of either class. Null and empty texts get the share of good rows
    among all those labels. Only doc_id and text of `docs` are read; repeated rows are scored alike.
    """
    keep = fold("doc_id", folds) != held_out
    prior = positive_share(labels, "quality", keep, 1)
    model = train(labelled_sample(docs, labels, "quality", keep, PER_CLASS, MAX_CHARS), prior)
    scored = docs.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), scorer(model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
