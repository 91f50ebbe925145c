"""Rows of SQLite files. Spark lists and distributes the files; a task opens one at a time."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assentlake.sources.files import Roots, decoded, root_list, selected

# Content up to this size travels through Spark; a larger file is opened where it lies.
INLINE_LIMIT = 256 * 1024 * 1024


BATCH = 10_000


def _rows(connection: sqlite3.Connection, query: str) -> Iterator[list[tuple]]:
    try:
        cursor = connection.execute(query)
        while rows := cursor.fetchmany(BATCH):
            yield rows
    except sqlite3.DatabaseError as error:
        # A file that is no database, or lacks the table, has no rows. Damage is an error.
        if error.sqlite_errorcode == sqlite3.SQLITE_NOTADB or "no such table" in str(error):
            return
        raise
    finally:
        connection.close()


def _text(value) -> str | None:
    """A cell as text: columns are not typed. Binary cells hold no text."""
    return None if value is None or isinstance(value, bytes) else str(value)


def _summed(order: str, data: bytes, sums: tuple[int, int]) -> tuple[int, int]:
    x, y = sums
    for a, b in struct.iter_unpack(order + "II", data):
        x = (x + a + y) & 0xFFFFFFFF
        y = (y + b + x) & 0xFFFFFFFF
    return x, y


def _with_log(image: bytearray, log: bytes) -> bytearray:
    """The image with the committed pages of its write-ahead log, as SQLite recovers them."""
    if len(log) < 32:
        return image
    magic, _, size, _, *salts, first, second = struct.unpack(">8I", log[:32])
    order = {0x377F0682: "<", 0x377F0683: ">"}.get(magic)
    if order is None or (sums := _summed(order, log[:24], (0, 0))) != (first, second):
        return image
    pages: dict[int, int] = {}
    # A frame of an older log, or one that was not written to its end, ends the log.
    for at in range(32, len(log) - size - 23, size + 24):
        number, commit, *rest = struct.unpack(">6I", log[at : at + 24])
        sums = _summed(order, log[at : at + 8], sums)
        sums = _summed(order, log[at + 24 : at + 24 + size], sums)
        if rest != [*salts, *sums]:
            break
        pages[number] = at + 24
        if commit:
            length = commit * size
            image = image[:length].ljust(length, b"\0")
            for page, start in pages.items():
                if page <= commit:
                    image[(page - 1) * size : page * size] = log[start : start + size]
            pages = {}
    return image


def _from_bytes(content: bytes, log: bytes | None, query: str) -> Iterator[list[tuple]]:
    image = _with_log(bytearray(content), log or b"")
    # Bytes 18 and 19 ask for a write-ahead log, which an in-memory image cannot have.
    if image[18:20] == b"\x02\x02":
        image[18:20] = b"\x01\x01"
    if not image:
        return iter(())
    connection = sqlite3.connect(":memory:")
    connection.deserialize(bytes(image))
    return _rows(connection, query)


def _from_path(path: str, query: str, logged: bool) -> Iterator[list[tuple]]:
    scheme, _, name = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{path} is too large to travel and lies in a store that tasks cannot open")
    # An immutable file is read without its log.
    options = "mode=ro" if logged else "mode=ro&immutable=1"
    connection = sqlite3.connect(f"file:{name}?{options}", uri=True)
    return _rows(connection, query)


def read_sqlite(
    spark: SparkSession,
    root: Roots,
    name: str,
    query: str,
    columns: dict[str, str],
    max_depth: int = 5,
) -> DataFrame:
    """Run a read-only query on every file called ``name`` below ``root``.

    Returns file_path and the given columns (name to Spark type), all as the types say. A
    file that is no database or lacks the table gives no rows; a damaged one is an error.
    """
    def found(file: str) -> DataFrame:
        """path, length and content; without content where that is too large to travel."""
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", file)
            .format("binaryFile")
            .load(root_list(root))
            .where(selected(decoded(F.col("path")), root, ["/" + file], max_depth))
        )
        small = files.where(F.col("length") <= INLINE_LIMIT).select("path", "length", "content")
        large = files.where(F.col("length") > INLINE_LIMIT).select(
            "path", "length", F.lit(None).cast("binary").alias("content")
        )
        return small.unionByName(large)

    logs = found(name + "-wal").where("length > 0").select(
        F.expr("left(path, length(path) - 4)").alias("path"), F.col("content").alias("log"), F.lit(True).alias("logged")
    )
    images = found(name).drop("length").join(logs, "path", "left")
    return query_images(images.select("path", "content", "log", F.coalesce("logged", F.lit(False)).alias("logged")), query, columns)


def query_images(images: DataFrame, query: str, columns: dict[str, str]) -> DataFrame:
    """Query database files given as (path, content); without content the path is opened.

    log may hold the write-ahead log of the file; with logged and no log it lies by the path.
    """
    if "logged" not in images.columns:
        images = images.withColumns({"log": F.lit(None).cast("binary"), "logged": F.lit(False)})
    names = list(columns)
    texts = [n for n, t in columns.items() if t == "string"]
    schema = T.StructType.fromDDL(
        "file_path string, " + ", ".join(f"{n} {t}" for n, t in columns.items())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, log, logged in zip(batch["path"], batch["content"], batch["log"], batch["logged"]):
                by_path = content is None or (logged and log is None)
                for rows in _from_path(path, query, logged) if by_path else _from_bytes(content, log, query):
                    out = pd.DataFrame(rows, columns=names, dtype=object)
                    for name in texts:
                        out[name] = [_text(value) for value in out[name]]
                    out.insert(0, "file_path", path)
                    yield out

    rows = images.mapInPandas(run, schema)
    return rows.withColumn("file_path", decoded(F.col("file_path")))
