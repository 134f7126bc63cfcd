"""Hard negatives by a secondary sort of scores under their anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.vectors import by_length, first_by_score, products, slabs, usable, whole

#: Anchors that are held against a batch of rows at a time.
ANCHORS_AT_ONCE = 256
POSITIVE, NEGATIVE = 0, 1
SCORED = "anchor_no long, anchor_id long, score long, kind int, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NAMES = ["anchor_no", "anchor_id", "score", "kind", "vec_id"]


class _Anchors:
    """A slab's anchors of one vector length."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.numbers, self.ids, self.labels, self.vectors = numbers, ids, labels, vectors

    def scored(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Every anchor's number in the slab and its scores with all rows of a batch."""
        for start in range(0, len(self.ids), ANCHORS_AT_ONCE):
            for i, scores in enumerate(products(self.vectors[start : start + ANCHORS_AT_ONCE], vectors)):
                yield start + i, scores


class _Best:
    """The first k rows that a task has seen, for each of several questions."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.kept: dict = {}

    def least(self, question) -> float:
        """Below this score a row is not among the first k."""
        scores, _ = self.kept.get(question, ((), ()))
        return scores[-1] if len(scores) == self.k else -np.inf

    def add(self, question, scores: np.ndarray, ids: np.ndarray) -> None:
        if question in self.kept:
            scores, ids = (np.concatenate(pair) for pair in zip(self.kept[question], (scores, ids)))
        first = first_by_score(scores, ids, self.k)
        self.kept[question] = scores[first], ids[first]


def _anchors(slab: pa.Table, first_no: int) -> dict[int, _Anchors]:
    ids, labels = (np.asarray(slab[c], dtype=np.int64) for c in ("vec_id", "label"))
    numbers = first_no + np.arange(len(slab))
    return {m.shape[1]: _Anchors(numbers[at], ids[at], labels[at], whole(m)) for at, m in by_length(slab["vector"])}


def _pairs(batches: Iterator[pa.RecordBatch], anchors: dict[int, _Anchors]) -> Iterator[tuple]:
    """Anchors of a slab with the ids, labels and scores of a batch's rows."""
    for batch in batches:
        all_ids, all_labels = (np.asarray(batch[c], dtype=np.int64) for c in ("vec_id", "label"))
        for at, vectors in by_length(batch["vector"]):
            own = anchors.get(vectors.shape[1])
            if own:
                ids, labels = all_ids[at], all_labels[at]
                for i, scores in own.scored(whole(vectors)):
                    yield own, i, ids, labels, scores


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=NAMES)


def _positives(rows: DataFrame, slab: pa.Table, first_no: int, k: int) -> DataFrame:
    """The first k other rows of each anchor's label: of each task, then of all."""
    sent = rows.sparkSession.sparkContext.broadcast(slab)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        anchors = _anchors(sent.value, first_no)
        for own, i, ids, labels, scores in _pairs(batches, anchors):
            name = (int(own.numbers[i]), int(own.ids[i]))
            good = np.flatnonzero((labels == own.labels[i]) & (ids != own.ids[i]) & (scores >= best.least(name)))
            if len(good):
                best.add(name, scores[good], ids[good])
        yield _batch([(*name, int(s), POSITIVE, int(v)) for name, kept in best.kept.items() for s, v in zip(*kept)])

    order = Window.partitionBy("anchor_no").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(search, SCORED).withColumn("_rank", F.row_number().over(order))
    return found.where(F.col("_rank") <= k).drop("_rank")


def _negatives(
    rows: DataFrame, slab: pa.Table, first_no: int, positives: pa.Table, k: int, least: int, most: int
) -> DataFrame:
    """Rows of other labels that can be among the first k in the window of one of the positives.

    Each task keeps the first k of its own rows for each window and emits those; the first k of all
    rows are among them.
    """
    windows: dict[int, list[int]] = {}
    for no, score in sorted(set(zip(positives["anchor_no"].to_pylist(), positives["score"].to_pylist())), reverse=True):
        windows.setdefault(no, []).append(score)
    sent = rows.sparkSession.sparkContext.broadcast((slab, windows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, windows = sent.value
        best = _Best(k)
        for own, i, ids, labels, scores in _pairs(batches, _anchors(slab, first_no)):
            tops = windows.get(int(own.numbers[i]), ())
            if not len(tops):
                continue
            # Floors are exact integers, as Python's do not overflow.
            ranges = [(top, -(-least * top // 100), most * top // 100) for top in tops]
            near = (scores >= min(low for _, low, _ in ranges)) & (scores <= max(high for _, _, high in ranges))
            near = np.flatnonzero(near & (labels != own.labels[i]))
            for top, low, high in ranges if len(near) else ():
                question = (int(own.numbers[i]), int(own.ids[i]), top)
                good = near[(scores[near] >= max(low, best.least(question))) & (scores[near] <= high)]
                if len(good):
                    best.add(question, scores[good], ids[good])
        # A row repeats as often as the task has it, but not for every window that it lies in.
        kept: dict[tuple, dict] = {}
        for (no, anchor, _), (scores, found) in best.kept.items():
            counts: dict = {}
            for pair in zip(scores.tolist(), found.tolist()):
                counts[pair] = counts.get(pair, 0) + 1
            ours = kept.setdefault((no, anchor), {})
            for pair, n in counts.items():
                ours[pair] = max(n, ours.get(pair, 0))
        for name, pairs in kept.items():
            yield _batch([(*name, s, NEGATIVE, v) for (s, v), n in pairs.items() for _ in range(n)])

    return rows.mapInArrow(search, SCORED)


def _mined(batches: Iterator[pa.RecordBatch], positives: int, k: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Windows over rows that come sorted by (anchor, descending score, kind, id).

    A positive opens a window, a negative goes to the windows that are open and that it fits; a
    window closes with its last negative or when scores fall below it. All that is held of an
    anchor are its open windows.
    """
    anchor, opened, windows = None, 0, []
    for batch in batches:
        out: list[tuple] = []
        for no, anchor_id, score, kind, vec_id in zip(*(batch[c].to_pylist() for c in NAMES)):
            if no != anchor:
                anchor, opened, windows = no, 0, []
            if kind == POSITIVE:
                if opened < positives:
                    opened += 1
                    windows.append([vec_id, score, 0])
                continue
            windows = [w for w in windows if w[2] < k and 100 * score >= least * w[1]]
            for window in windows:
                if 100 * score <= most * window[1]:
                    window[2] += 1
                    out.append((anchor_id, window[0], window[2], vec_id, window[1], score))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)


def hard_negatives(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    *,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
) -> DataFrame:
    """Rows of other labels that score nearly as high as the positives of an anchor.

    Anchors are rows whose key is divisible by `every`; an anchor's positives are the first
    `positives` other rows of its label. For each, the first `negatives` rows of other labels whose
    score is from `least` to `most` hundredths (100 at most) of the positive's. Scores are inner
    products of floor(256 * x), higher ones come first, ties by smaller key.

    * Rows with a null key, label or vector, or a component that is null or not finite, take no part.
    * Rows of the anchor's own key are no positives; vectors of other lengths are no candidates.
    * Rows that repeat a key count as rows of their own; an anchor that repeats is mined once, and if
      its key has several vectors or labels, once for each.
    * A positive with a score below zero has an empty window. Anchors without positives, and
      positives without negatives, give no rows; so does an empty table. Other columns are not read.

    Scores are packed as (anchor, descending score, kind, key): one shuffle by anchor that sorts
    within its partitions, and an iterator that opens a window at each positive. Before it, each task
    sorts out what cannot be among the first: positives are found first, then each task sends for
    each window as many rows as may be returned, not all pairs. Anchors go to all tasks in slabs of
    bounded size; the table is read twice for each.
    """
    if not 0 <= least <= most <= 100:
        raise ValueError("windows lie between 0 and 100 hundredths")
    present = F.col(key).isNotNull() & F.col(label).isNotNull() & usable(vector)
    part = rows.where(present).select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")
    )
    anchors = part.where(F.col("vec_id") % every == 0).distinct()
    spark = rows.sparkSession
    scored, first_no = spark.createDataFrame([], SCORED), 0
    for slab in slabs(anchors, "vec_id", "vector"):
        own = saved(_positives(part, slab, first_no, positives), "positives")
        # At most `positives` rows for each anchor of the slab.
        found = own.select("anchor_no", "score").toArrow()
        others = _negatives(part, slab, first_no, found, negatives, least, most)
        scored = scored.unionByName(own).unionByName(others)
        first_no += len(slab)
    order = ["anchor_no", F.desc("score"), "kind", "vec_id"]
    packed = scored.repartition("anchor_no").sortWithinPartitions(*order)
    return packed.mapInArrow(lambda batches: _mined(batches, positives, negatives, least, most), MINED)


def mined_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of embeddings; where 7 divides vec_id the label first becomes (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.withColumn("label", moved))
