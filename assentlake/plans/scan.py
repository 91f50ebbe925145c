"""Session logs to the common messages table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assentlake.sources.files import Roots, read_docs, read_lines, root_list
from assentlake.sources.lookups import model_lookup
from assentlake.sources.normalize import (
    normalize_claude,
    normalize_cline,
    normalize_codebuddy,
    normalize_codex,
    normalize_cursor,
    normalize_hermes,
    normalize_omp,
    normalize_openclaw_docs,
    normalize_openclaw_lines,
    normalize_opencode,
    normalize_pi,
    normalize_pi_workflow,
)
from assentlake.sources.normalize.databases import (
    CURSOR_QUERY,
    OPENCODE_MESSAGES_QUERY,
    OPENCODE_PARTS_QUERY,
    SESSIONS_QUERY,
    THREADS_QUERY,
)
from assentlake.sources.normalize.shape import MESSAGE_COLUMNS, line_blocks
from assentlake.sources.sqlite import read_sqlite

Loader = Callable[[SparkSession, Roots, Column], DataFrame]
MODEL_ROWS = {"id": "string", "model": "string"}


def _claude(spark: SparkSession, root: Roots, run_ts: Column, exclude: Sequence[str] = ()) -> DataFrame:
    raw = read_lines(spark, root, below=[("transcripts", 2), ("projects", 3)], exclude=exclude)
    return normalize_claude(raw, run_ts, line_blocks(raw))


def _codex(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    threads = model_lookup(read_sqlite(spark, root, "state_5.sqlite", THREADS_QUERY, MODEL_ROWS, 0))
    raw = read_lines(spark, root, below=[("sessions", 6), ("archived_sessions", 6)])
    return normalize_codex(raw, threads, run_ts)


def _omp(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    return normalize_omp(read_lines(spark, root, below=[("agent/sessions", 4)]), run_ts)


def _pi(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    sessions = read_lines(spark, root, below=[("agent/sessions", 4), ("sessions", 4)])
    runs = read_docs(spark, root, below=[("workflows", 5)])
    return normalize_pi(sessions, run_ts).unionByName(normalize_pi_workflow(runs, run_ts))


def _codebuddy(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    models = model_lookup(read_sqlite(spark, root, "workbuddy.db", SESSIONS_QUERY, MODEL_ROWS, 0))
    raw = read_lines(spark, root, max_depth=4, require_any=["/projects/", "/sessions/"])
    return normalize_codebuddy(raw, models, run_ts, line_blocks(raw))


def _cline(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    api = read_docs(spark, root, "/api_conversation_history.json", below=[("tasks", 3)])
    ui = read_docs(spark, root, "/ui_messages.json", below=[("tasks", 3)])
    return normalize_cline(api.unionByName(ui), run_ts)


def _hermes(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    return normalize_hermes(read_docs(spark, root, below=[("sessions", 2)]), run_ts)


def _openclaw(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    raw = read_lines(spark, root, max_depth=4)
    lines = normalize_openclaw_lines(raw, run_ts, line_blocks(raw))
    return lines.unionByName(normalize_openclaw_docs(read_docs(spark, root, max_depth=4), run_ts))


def _cursor(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    columns = {"key": "string", "value": "string"}
    return normalize_cursor(read_sqlite(spark, root, "state.vscdb", CURSOR_QUERY, columns, 3), run_ts)


def _opencode(spark: SparkSession, root: Roots, run_ts: Column) -> DataFrame:
    message_columns = {"id": "string", "session_id": "string", "time_created": "string", "data": "string"}
    part_columns = {"message_id": "string", "data": "string"}
    return normalize_opencode(
        read_sqlite(spark, root, "opencode.db", OPENCODE_MESSAGES_QUERY, message_columns, 0),
        read_sqlite(spark, root, "opencode.db", OPENCODE_PARTS_QUERY, part_columns, 0),
        run_ts,
    )


# The formats a scan knows. A further format is one more function of the same form.
LOADERS: dict[str, Loader] = {
    "claude": _claude,
    "codex": _codex,
    "omp": _omp,
    "pi": _pi,
    "codebuddy": _codebuddy,
    "cline": _cline,
    "openclaw": _openclaw,
    "hermes": _hermes,
    "cursor": _cursor,
    "opencode": _opencode,
}


def union_messages(parts: Iterable[DataFrame]) -> DataFrame:
    """All normalized sources in one relation."""
    return reduce(DataFrame.unionByName, (p.select(*MESSAGE_COLUMNS) for p in parts))


def filter_harness(messages: DataFrame, harnesses: Sequence[str] | None) -> DataFrame:
    """Restrict to some agents. On a union of sources the other branches are pruned."""
    return messages if harnesses is None else messages.where(F.col("harness").isin(*harnesses))


def configured_sources(spark: SparkSession, roots: Mapping[str, Roots]) -> DataFrame:
    """(harness) of the agents whose home folder is there, whether or not it holds a message."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def there(root: str) -> bool:
        path = hadoop(root)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        return found is not None and len(found) > 0

    names = [h for h, wanted in roots.items() if any(there(r) for r in root_list(wanted))]
    return spark.createDataFrame([(h,) for h in names], "harness string")


def load_messages(
    spark: SparkSession,
    roots: Mapping[str, Roots],
    run_ts: Column | None = None,
    harnesses: Sequence[str] | None = None,
    loaders: Mapping[str, Loader] = LOADERS,
) -> DataFrame:
    """Read the logs below ``roots`` (agent id to its home folder) as one messages table.

    An agent may have several home folders, as a list, as a pattern such as /home/*/.claude,
    or both; none may lie inside another. A root that matches nothing is an error.
    ``run_ts`` stands for missing timestamps; give it a fixed value for repeatable results.
    """
    stamp = F.current_timestamp() if run_ts is None else run_ts
    wanted = [h for h in roots if harnesses is None or h in harnesses]
    return union_messages(loaders[h](spark, roots[h], stamp) for h in wanted)

