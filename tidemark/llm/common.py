"""What the corpus operators share: scratch tables, fixed folds, bounded training samples."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Later uses see the same rows, whatever happens to executors, and only the columns they need.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo the number of folds; null keys are in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_chars: int, key: str = "doc_id"
) -> list[tuple[str, int]]:
    """Up to `per_class` labelled texts of either class, for training on the driver.

    Rows are taken in the order of a hash of their key, so that the sample is the same in every
    run. Labelled rows over `max_chars` characters are not used for training; nothing is cut.
    The driver receives at most 2 * per_class * max_chars characters.
    """
    picked = labels.select(F.col(key), F.col(label).cast("int").alias("_label")).where(
        keep & F.col(key).isNotNull() & F.col("_label").isin(0, 1)
    )
    rows: list[tuple[str, int]] = []
    for value in (0, 1):
        ids = (
            picked.where(F.col("_label") == value)
            .distinct()
            .orderBy(F.xxhash64(F.col(key).cast("string")), key)
            .limit(per_class)
        )
        texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select(key, "text")
        # At most per_class ids are broadcast.
        found = texts.join(F.broadcast(ids), key).orderBy(F.xxhash64(F.col(key).cast("string")), "text").limit(per_class)
        rows += [(r["text"], value) for r in found.select("text").collect()]
    return rows


def positive_share(labels: DataFrame, label: str, keep: Column, more: float, key: str = "doc_id") -> float:
    """The share of label 1 among all different labelled rows, with `more` rows of label 1 among two
    added. Unlike the share in a sample that is bounded by class, it is the same for any size."""
    picked = labels.select(F.col(key), F.col(label).cast("int").alias("_label")).where(
        keep & F.col(key).isNotNull() & F.col("_label").isin(0, 1)
    )
    n, ones = picked.distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    return (ones + more) / (n + 2)


def text_sample(df: DataFrame, column: str, n: int, max_chars: int) -> list[str]:
    """Up to `n` different texts of `column`, for training on the driver.

    They are the first in the order of their hashes, so the sample is the same in every run. The
    hashes are found first; texts of at most n * max_chars characters are sent, from whatever input.
    """
    hashed = df.where(F.length(column) <= max_chars).select(
        F.col(column).alias("text"), F.xxhash64(column).alias("hash")
    )
    last = hashed.select("hash").distinct().orderBy("hash").limit(n).agg(F.max("hash")).first()[0]
    if last is None:
        return []
    chosen = hashed.where(F.col("hash") <= last).groupBy("hash").agg(F.min("text").alias("text"))
    return [r["text"] for r in chosen.orderBy("hash").collect()]


def give_back() -> None:
    """Return memory that is free to the system. Workers live on from stage to stage, and what one
    stage has freed would otherwise stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not the C library that has it.
        pass


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` on a task's batches, after which free memory is returned."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def in_slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of a column, a few rows at a time, so that Python holds few texts at once."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight_0: float = 1.0, ridge: float = 1e-3, steps: int = 50
) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the intercept last.

    Both classes weigh alike in total, class 0 times `weight_0`.
    """
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 * weight_0 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
