"""Exact search for the highest inner products, sparing candidates by distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.vectors import by_length, first_by_score, matrix, products, slabs, usable, whole

#: Pivots for vectors of one length.
PIVOTS = 32
#: Rows that pivots are chosen from, and that give a query its first threshold: the first by hash.
SAMPLE = 2000
#: Candidates whose bounds are weighed together, and that are scored at a time.
BLOCK, CHUNK = 2048, 128
#: Queries that are held against a block at a time.
QUERIES_AT_ONCE = 1024
#: Bounds are widened by this share of the squared lengths, far more than doubles round.
SLACK = 1e-9

TABLE = "vec_id long, vector array<double>, distances array<double>, length int, home int, home_distance double"
FOUND = "query_no long, query_id long, vec_id long, score long"


def chosen_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows that lie far from each other: each is the one farthest from those before it."""
    if not len(vectors) or not vectors.shape[1]:
        return vectors[:0]
    nearest = ((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)
    pivots: list[int] = []
    while len(pivots) < n:
        at = int(nearest.argmax())
        if pivots and nearest[at] <= 0:
            break
        nearest_to = ((vectors - vectors[at]) ** 2).sum(axis=1)
        nearest = nearest_to if not pivots else np.minimum(nearest, nearest_to)
        pivots.append(at)
    return vectors[pivots]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.empty((len(vectors), len(pivots)))
    for i, pivot in enumerate(pivots):
        squares[:, i] = ((vectors - pivot) ** 2).sum(axis=1)
    return np.sqrt(squares)


def _sample(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of the first SAMPLE rows by hash, for each length."""
    first = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).select("vec_id", "vector").toArrow()
    ids = np.asarray(first["vec_id"], dtype=np.int64)
    return {m.shape[1]: (ids[at], whole(m)) for at, m in by_length(first["vector"])} if len(ids) else {}


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """All rows with their distances to the pivots of their length, written in the order of the
    nearest pivot and the distance to it, so that rows that stand together are alike.

    Vectors are whole numbers from here on. One row is no key: rows at the same place, also those
    that repeat an id, are dealt out over tasks by their place in the input.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch["vec_id"], dtype=np.int64)
            for at, raw in by_length(batch["vector"]):
                vectors = whole(raw)
                own = pivots.get(vectors.shape[1], vectors[:0])
                far = distances(vectors, own)
                home = far.argmin(axis=1) if len(own) else np.full(len(at), -1)
                near = far.min(axis=1) if len(own) else np.zeros(len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at]),
                        _lists(vectors),
                        _lists(far),
                        pa.array(np.full(len(at), vectors.shape[1], dtype=np.int32)),
                        pa.array(home.astype(np.int32)),
                        pa.array(near),
                    ],
                    names=["vec_id", "vector", "distances", "length", "home", "home_distance"],
                )

    order = ["length", "home", "home_distance", "_tie"]
    table = rows.select("vec_id", "vector").mapInArrow(measured, TABLE)
    placed = table.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(placed.select("vec_id", "vector", "distances"), "pivots")


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1), type=pa.float64()))


def _bounds(square, squares, gaps, slack: float):
    """The highest inner products that vectors of these squared lengths can have at distances of at
    least `gaps`; infinite where doubles overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((square + squares - gaps**2) / 2 + slack + SLACK * square, nan=np.inf, posinf=np.inf)


class _Queries:
    """A slab's queries of one length, with the best that has been found for each so far."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, k: int) -> None:
        self.numbers, self.ids, self.vectors, self.far, self.k = numbers, ids, vectors, far, k
        self.squares = (vectors**2).sum(axis=1)
        # Below this score a candidate is not among the first k, whatever else there is.
        self.floor = np.full(len(ids), -np.inf)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)

    def warm(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take the k-th best among some of the candidates as the floor."""
        for start in range(0, len(self.ids), QUERIES_AT_ONCE):
            part = slice(start, start + QUERIES_AT_ONCE)
            scores = products(self.vectors[part], vectors).astype(np.float64)
            scores[self.ids[part, None] == ids[None, :]] = -np.inf
            if scores.shape[1] >= self.k:
                # The next double below, as a score beyond 53 bits may round up.
                self.floor[part] = np.nextafter(np.partition(scores, -self.k, axis=1)[:, -self.k], -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray) -> None:
        """Hold the queries against a block of candidates.

        The squared distance of two vectors is at least the square of the largest difference of
        their distances to a pivot, which bounds their inner product from above. Blocks are spared
        by the range of their distances, then candidates by their own, in the order of the bounds.
        """
        squares = (vectors**2).sum(axis=1)
        low, high = far.min(axis=0), far.max(axis=0)
        slack = SLACK * (1 + squares.max())
        for start in range(0, len(self.ids), QUERIES_AT_ONCE):
            part = slice(start, start + QUERIES_AT_ONCE)
            own = self.far[part]
            gap = np.maximum(own - high, low - own).max(axis=1, initial=0.0)
            bounds = _bounds(self.squares[part], squares.max(), gap, slack)
            for q in start + np.flatnonzero(bounds >= self.floor[part]):
                self._search(q, ids, vectors, far, squares, slack)

    def _search(
        self, q: int, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, squares: np.ndarray, slack: float
    ) -> None:
        gaps = np.abs(far - self.far[q]).max(axis=1, initial=0.0)
        bounds = _bounds(self.squares[q], squares, gaps, slack)
        order = np.flatnonzero((bounds >= self.floor[q]) & (ids != self.ids[q]))
        order = order[np.argsort(-bounds[order], kind="stable")]
        for start in range(0, len(order), CHUNK):
            chunk = order[start : start + CHUNK]
            if bounds[chunk[0]] < self.floor[q]:
                break
            scores = products(self.vectors[q : q + 1], vectors[chunk])[0]
            good = scores >= self.floor[q]
            if not good.any():
                continue
            scores = np.concatenate([self.scores[q], scores[good]])
            found = np.concatenate([self.found[q], ids[chunk[good]]])
            first = first_by_score(scores, found, self.k)
            self.scores[q], self.found[q] = scores[first], found[first]
            if len(first) == self.k:
                self.floor[q] = max(self.floor[q], np.nextafter(float(scores[first[-1]]), -np.inf))

    def rows(self) -> pa.RecordBatch:
        counts = [len(f) for f in self.found]
        arrays = [np.repeat(self.numbers, counts), np.repeat(self.ids, counts), *map(np.concatenate, (self.found, self.scores))]
        return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()) for a in arrays], names=["query_no", "query_id", "vec_id", "score"])


def _searched(table: DataFrame, slab: pa.Table, first_no: int, sample: dict, k: int) -> DataFrame:
    """The best k of each task for the queries of a slab, which is sent to all tasks."""
    sent = table.sparkSession.sparkContext.broadcast((slab, sample))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, sample = sent.value
        ids, numbers = np.asarray(slab["vec_id"], dtype=np.int64), first_no + np.arange(len(slab))
        far = slab["distances"].combine_chunks()
        queries = {
            v.shape[1]: _Queries(numbers[at], ids[at], v, matrix(far.take(pa.array(at))), k) for at, v in by_length(slab["vector"])
        }
        for length, (known, vectors) in sample.items():
            if length in queries:
                queries[length].warm(known, vectors)
        for batch in batches:
            ids = np.asarray(batch["vec_id"], dtype=np.int64)
            for at, vectors in by_length(batch["vector"]):
                if vectors.shape[1] not in queries:
                    continue
                far = matrix(batch["distances"].take(pa.array(at)))
                for start in range(0, len(at), BLOCK):
                    part = slice(start, start + BLOCK)
                    queries[vectors.shape[1]].meet(ids[at[part]], vectors[part], far[part])
        for own in queries.values():
            yield own.rows()

    return table.mapInArrow(search, FOUND)


def nearest(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", *, every: int = 50, k: int = 5
) -> DataFrame:
    """The k rows with the highest scores for each row whose key is divisible by `every`.

    A score is the inner product of vectors of floor(256 * x), a 64-bit integer (what does not fit
    becomes the nearest that does). Returns query_id, rank from 1, vec_id, score; ties go to the
    smaller key. Exact: pivots only decide what need not be scored.

    * Rows with a null key, a null vector or a component that is null or not finite take no part.
    * A query's candidates are the rows of other keys whose vectors have its length.
    * Rows that repeat a key are candidates of their own; a query that repeats is answered once, and
      if its key has several vectors, once for each.
    * With fewer than k candidates all are returned, with none no row; an empty table gives none.
      Other columns are not read.

    Each task keeps k rows for each query of a slab, of SLAB_BYTES at most; the table is read once for
    each slab. Pivots and first thresholds come from SAMPLE rows.
    """
    part = rows.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")
    )
    sample = _sample(part)
    table = pivot_table(part, {length: chosen_pivots(vectors, PIVOTS) for length, (_, vectors) in sample.items()})
    queries = table.where(F.col("vec_id") % every == 0).distinct()
    found, first_no = table.sparkSession.createDataFrame([], FOUND), 0
    for slab in slabs(queries, "vec_id", "vector"):
        found = found.unionByName(_searched(table, slab, first_no, sample, k))
        first_no += len(slab)
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
