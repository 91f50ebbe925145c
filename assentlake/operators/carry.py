"""Carry the last seen value forward through the lines of a file.

Changes are few and small, lines are many and hold texts. So the changes are gathered, one row
for each block of a file with its ordered list, and a line finds its value in that list. Lines
are never sorted and meet the lists in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake.functions.arrays import leading
from assentlake.session import staged


def block_changes(lines: DataFrame, update: Column | None = None) -> DataFrame:
    """(file_path, block_start, first_pos, last_pos, changes): one row for each block of a file.

    ``lines`` has file_path, block_start and pos; ``changes`` are the (pos, value) at which
    ``update`` is not NULL, in order. Only these leave the task that read the lines.
    """
    value = F.lit(None).cast("string") if update is None else update
    change = F.when(value.isNotNull(), F.struct(F.col("pos"), value.alias("value")))
    return lines.groupBy("file_path", "block_start").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.sort_array(F.collect_list(change)).alias("changes"),
    )


def timeline(blocks: DataFrame) -> DataFrame:
    """Add ``first_line`` and ``before``: lines of the file, and its last value, before the block.

    Changes to the value that holds already are left out of the lists.
    """
    # The blocks of one file, a row each.
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    real = F.filter(
        "changes", lambda c, i: (i == 0) | ~c["value"].eqNullSafe(F.get(F.col("changes"), i - 1)["value"])
    )
    return blocks.withColumns(
        {
            "first_line": F.coalesce(F.sum(F.col("last_pos") - F.col("first_pos") + 1).over(earlier), F.lit(0)),
            "before": F.last(F.get(F.col("changes"), F.size("changes") - 1)["value"], ignorenulls=True).over(earlier),
        }
    ).withColumn("changes", real)


def value_at(pos: Column, changes: Column) -> Column:
    """The value of the last change at or before ``pos``, by halving the ordered list."""
    before = leading(changes, lambda c: c["pos"] <= pos)
    return F.when(F.size(changes) > 0, F.get(changes, before - 1)["value"])


def carry_forward(records: DataFrame, update: Column, initial: Column, name: str) -> DataFrame:
    """Add ``name``: the latest non-NULL ``update`` at or before each line of its file.

    ``records`` has file_path, block_start and pos, and is read twice. A file of any size is
    spread over as many tasks as it has blocks.
    """
    lists = staged(timeline(block_changes(records, update)), "timeline")
    carried = records.join(lists.select("file_path", "block_start", "changes", "before"), ["file_path", "block_start"])
    return carried.withColumn(
        name, F.coalesce(value_at(F.col("pos"), F.col("changes")), "before", initial)
    ).drop("changes", "before")
