"""Submissions as a stream: every micro-batch extends the leaderboard tables.

Below the path of the tables lie

- changes/<table>/batch=N: what batch N adds, written again if the batch is run again,
- committed/N: an empty file, made when all tables of batch N are written,
- versions/<table>/upto=N: the tables after all batches up to N, and versions/done/N, made when
  they are written. Entries are one row per user there; the other tables hold the rows of the
  batches since the version before.

A version is written every COMPACT batches, from the committed changes. Readers take the last
version that is done and the committed changes behind it: however many batches there were, they
open the files of one version of the entries, one part of the history for COMPACT batches, and
COMPACT batches at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from assentlake.plans.leaderboard import Tables, apply_submissions, newest_entries
from assentlake.session import mark, names_in

PARTS = ("entries", "submissions", "models", "harnesses", "rejected")
#: Batches after which their changes are brought together.
COMPACT = 20


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, folder) if n.isdigit())


def _changes(spark: SparkSession, path: str, part: str, batches: list[int]) -> DataFrame:
    """The rows that these batches added, with their number as ``batch``."""
    folder = f"{path}/changes/{part}"
    return spark.read.option("basePath", folder).parquet(*(f"{folder}/batch={n}" for n in batches))


def _state(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The versions that are done, and the committed batches behind the last of them."""
    versions = _numbers(spark, f"{path}/versions/done")
    last = versions[-1] if versions else -1
    return versions, [n for n in _numbers(spark, f"{path}/committed") if n > last]


def _entries(spark: SparkSession, path: str, versions: list[int], batches: list[int]) -> DataFrame:
    """Of each user the last received entry of the last version and these batches."""
    parts = [_changes(spark, path, "entries", batches)] if batches else []
    if versions:
        parts.append(spark.read.parquet(f"{path}/versions/entries/upto={versions[-1]}").withColumn("batch", F.lit(-1)))
    return newest_entries(reduce(DataFrame.unionByName, parts), "batch")


def compact(spark: SparkSession, path: str) -> None:
    """Bring the committed changes behind the last version together as a new version."""
    versions, batches = _state(spark, path)
    if not batches:
        return
    for part in PARTS:
        rows = (
            _entries(spark, path, versions, batches)
            if part == "entries"
            else _changes(spark, path, part, batches).drop("batch").coalesce(spark.sparkContext.defaultParallelism)
        )
        rows.write.mode("overwrite").parquet(f"{path}/versions/{part}/upto={batches[-1]}")
    mark(spark, f"{path}/versions/done/{batches[-1]}")


def write_batch(raw: DataFrame, batch_id: int, path: str, every: int = COMPACT) -> None:
    """Write one batch below ``path`` and commit it; compact if enough batches came together.

    A batch that is run again after a failure replaces what it wrote before, so nothing is
    counted twice; one that is part of a version already changes nothing.
    """
    spark = raw.sparkSession
    versions, _ = _state(spark, path)
    if versions and batch_id <= versions[-1]:
        return
    tables = apply_submissions(raw, stage=True)
    for part in PARTS:
        getattr(tables, part).write.mode("overwrite").parquet(f"{path}/changes/{part}/batch={batch_id}")
    mark(spark, f"{path}/committed/{batch_id}")
    if len(_state(spark, path)[1]) >= every:
        compact(spark, path)


def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Feed a stream of raw submissions into the tables below ``path``."""
    return (
        stream.writeStream.foreachBatch(lambda raw, batch_id: write_batch(raw, batch_id, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_tables(spark: SparkSession, path: str) -> Tables:
    """The tables after all committed batches; of each user the last received entry."""
    versions, batches = _state(spark, path)

    def history(part: str) -> DataFrame:
        parts = [_changes(spark, path, part, batches).drop("batch")] if batches else []
        if versions:
            parts.append(spark.read.parquet(*(f"{path}/versions/{part}/upto={n}" for n in versions)))
        return reduce(DataFrame.unionByName, parts)

    return Tables(_entries(spark, path, versions, batches), *(history(part) for part in PARTS[1:]))
