"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of an Arrow batch that are worked on together, and the bytes of text after which a
#: slice ends early. Both bound the memory of a Python worker, not the result.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20

#: Pieces in which a group is ranked before the pieces are put in order.
PIECES = 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies; the package that knows it is found by name only."""
    if importlib.util.find_spec("public_tokenizers") is None:
        raise FileNotFoundError(f"no public_tokenizers package: give the path of {name}")
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches, most: int = SLICE_ROWS) -> Iterator:
    """Arrow batches cut into slices of bounded rows and bytes; a longer text stands alone."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rows = min(most, batch.num_rows - start)
            while rows > 1 and batch.slice(start, rows).get_total_buffer_size() > 0 and _bytes(batch, start, rows) > SLICE_BYTES:
                rows //= 2
            yield batch.slice(start, rows)
            start += rows


def _bytes(batch, start: int, rows: int) -> int:
    return batch.slice(start, rows).nbytes


def trim_worker() -> None:
    """Give what a reused worker holds from earlier tasks, and no longer uses, back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # other C libraries than glibc have none
        trim(0)


def trimmed(run):
    """A function of Arrow batches that leaves the worker it ran in as small as it may be.

    Workers are reused by later stages and by other queries: what one task remembered is gone when
    it ends, but without this it stays with the allocators of a worker that may never need it again.
    """

    def whole(batches) -> Iterator:
        trim_worker()
        yield from run(batches)
        trim_worker()

    return whole


def training_row(doc_id: str = "doc_id") -> Column:
    """Whether labels of this document may be learnt from."""
    return (F.crc32(F.col(doc_id).cast("string")) % 5) != 0


def before(counts: DataFrame, by: list[str], piece: str, count: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``count`` over the earlier pieces of the same group."""
    w = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled training documents.

    Documents are chosen by the hash of their id. Rows without a label or an id are left out;
    a document with several labels has the largest. Held-out documents are never among them.
    """
    named = labels.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null")
    chosen = (
        named.where(training_row())
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # At most ``most`` pairs of numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_logistic(x, y, rounds: int = 200, ridge: float = 1e-3):
    """Weights (bias last) of a logistic regression of few columns, by Newton steps."""
    import numpy as np

    x = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    y = np.asarray(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) / len(y) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
