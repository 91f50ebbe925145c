"""Session settings the engine relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# JSON log writers repeat keys now and then; the last one counts.
REQUIRED = {
    "spark.sql.variant.allowDuplicateKeys": "true",
}


TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Shuffled bytes for a task. Compressed rows of numbers take some twenty times as much in the
#: sorts and aggregates of one stage, so Spark's default of 64 MB makes tasks of over 1 GB.
TASK_BYTES = "16m"
SPARK_TASK_BYTES = 64 << 20

TASK_COUNT = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Partitions a shuffle starts with, for each one of spark.sql.shuffle.partitions. Adaptive execution
#: brings small ones together up to the size above but splits none, so without more of them a task
#: grows with the input from some GB of shuffled rows on.
FINER = 5


def configure(spark: SparkSession, time_zone: str | None = None) -> SparkSession:
    """Apply the settings results depend on, and a smaller task size where the cluster names none."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    if spark.conf.get(TASK_SIZE) in (f"{SPARK_TASK_BYTES}b", str(SPARK_TASK_BYTES)):
        spark.conf.set(TASK_SIZE, TASK_BYTES)
    if not spark.conf.get(TASK_COUNT, None):
        spark.conf.set(TASK_COUNT, str(FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if time_zone:
        spark.conf.set("spark.sql.session.timeZone", time_zone)
    return spark


def local_session(cores: int | str = "*", app: str = "assentlake") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark, "UTC")


_run_folders: dict[tuple[str, str], str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder where it lies; nothing to do once the session is gone."""
    try:
        hadoop, system = _file_system(spark, path)
        system.delete(hadoop, True)
    except Exception:  # the gateway may have ended before the interpreter
        pass


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store Spark reads; none if there is no such folder."""
    hadoop, system = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(hadoop)) if system.exists(hadoop) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file; one that is there stays."""
    hadoop, system = _file_system(spark, path)
    system.create(hadoop, True).close()


def first_sign(spark: SparkSession, path: str, within: int = 4096) -> str:
    """The first character of a file that is not blank; empty if none stands near its start."""
    hadoop, system = _file_system(spark, path)
    stream = system.open(hadoop)
    try:
        for _ in range(within):
            byte = stream.read()
            if byte < 0:
                return ""
            if byte not in b"\t\n\r ":
                return chr(byte)
        return ""
    finally:
        stream.close()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that every node of the cluster can reach.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is unset, a
    temporary folder takes its place on a local master; on a cluster it would lie on one node
    only, so that is an error. What one application stages lies together and is removed when it
    ends, or before with ``release``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = tempfile.mkdtemp(prefix="assentlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    run = (spark.sparkContext.applicationId, base)
    if run not in _run_folders:
        _run_folders[run] = f"{base.rstrip('/')}/assentlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _run_folders[run])
    return f"{_run_folders[run]}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove everything staged so far; tables that read it can no longer be read."""
    own = [key for key in _run_folders if key[0] == spark.sparkContext.applicationId]
    for key in own:
        _remove(spark, _run_folders.pop(key))


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; with ``by``, in a folder for each value.

    For results that several later steps read: they are computed once, survive the loss of
    executors, and stay columnar, so that each reader loads only the columns it needs.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
