"""Vectors as whole numbers, and queries in bounded slabs: shared by searches over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.positions import with_positions

#: Components become floor(SCALE * x).
SCALE = 256
#: Vectors of queries that are sent to all tasks at a time: at most so many bytes of them.
SLAB_BYTES = 32 << 20
#: Products whose sums stay below this are exact in doubles.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """Whether a vector is not null and has finite components only; an empty vector is usable."""
    infinite = (F.lit(float("inf")), F.lit(float("-inf")))

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | x.cast("double").isin(*infinite)

    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def slabs(queries: DataFrame, key: str, vector: str) -> Iterator[pa.Table]:
    """The rows of `queries`, SLAB_BYTES of vectors at a time, for sending to all tasks.

    Many rows are numbered in the order of `key` first, so that no slab is skipped or taken twice.
    """
    n, longest = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    size = max(1, SLAB_BYTES // (8 * max(1, longest)))
    if n <= size:
        if n:
            yield queries.toArrow()
        return
    placed = with_positions(queries, [key], name="_place")
    for start in range(0, n, size):
        yield placed.where(F.col("_place").between(start, start + size - 1)).drop("_place").toArrow()


def by_length(vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length that occurs: their row numbers and a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths())
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, matrix(vectors if len(rows) == len(vectors) else vectors.take(pa.array(rows)))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    values = np.asarray(lists.flatten(), dtype=np.float64)
    return values.reshape(len(lists), len(values) // max(1, len(lists)))


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of `a` and `b`, whole numbers in doubles, exact as 64-bit integers.

    Where doubles might round, Python's integers are used; what does not fit 64 bits becomes the
    nearest value that does.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    integers = np.vectorize(int, otypes=[object])
    limits = np.iinfo(np.int64)
    return np.clip(integers(a) @ integers(b).T, limits.min, limits.max).astype(np.int64)


def first_by_score(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k highest scores, ties to the smaller id, in that order."""
    return np.lexsort((ids, -scores))[:k]
