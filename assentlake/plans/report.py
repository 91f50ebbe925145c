"""The report: every section of a scan, and its sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assentlake import fixed
from assentlake.functions.scores import level_struct
from assentlake.operators import metrics, ranking
from assentlake.operators.detect import with_snippets, with_spans
from assentlake.functions.text import normalize_model
from assentlake.session import staged
from assentlake.sources.lexicon import Matcher


@dataclass
class Report:
    """Sections of a report as DataFrames."""

    totals: DataFrame
    sessions: DataFrame
    models: DataFrame
    top_phrases: DataFrame
    model_harnesses: DataFrame
    harnesses: DataFrame
    daily: DataFrame
    phrases: DataFrame
    quotes: DataFrame
    active: int

    def tables(self) -> dict[str, DataFrame]:
        return {
            "totals": self.totals.crossJoin(F.broadcast(self.sessions)),
            "models": self.models,
            "top_phrases": self.top_phrases,
            "model_harnesses": self.model_harnesses,
            "harnesses": self.harnesses,
            "daily": self.daily,
            "phrases": self.phrases,
            "quotes": self.quotes,
        }


def message_facts(messages: DataFrame, matcher: Matcher) -> DataFrame:
    """What the report needs of each message: its keys and its hits, but not its text."""
    hits = F.transform(
        with_snippets(F.col("t"), F.col("spans")), lambda s: s.dropFields("start", "length")
    )
    return with_spans(messages, matcher).select(
        "harness",
        "session_id",
        "ts",
        "model",
        normalize_model(F.col("model")).alias("norm_model"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_hits"),
        hits.alias("hits"),
    )


def build_report(messages: DataFrame, matcher: Matcher, active: int, stage: bool = True) -> Report:
    """All sections from one pass over the messages.

    The texts are read once. What is left, keys and hits, is staged as a table that the
    sections read; with ``stage=False`` every section reads the messages itself.
    """
    facts = message_facts(messages, matcher)
    if stage:
        facts = staged(facts, "facts")
    hits = (
        facts.where(F.col("n_hits") > 0)
        .select("harness", "session_id", "ts", "model", "norm_model", F.inline_outer("hits"))
    )
    counted = facts.select("harness", "session_id", "ts", "model", "norm_model", "n_hits")
    return Report(
        totals=metrics.totals(counted),
        sessions=metrics.sessions(counted),
        models=metrics.model_counts(counted),
        top_phrases=ranking.top_phrases_per_model(hits),
        model_harnesses=metrics.model_harnesses(counted),
        harnesses=metrics.harness_stats(counted),
        daily=metrics.daily(counted),
        phrases=metrics.phrases(hits),
        quotes=ranking.quotes_round_robin(hits),
        active=active,
    )


#: Sections of the document behind its head, in order, and what encloses the rows of each.
SECTIONS = (
    ("modelRankings", "[]"), ("harnessStats", "{}"), ("dailyTimeline", "[]"), ("phraseCloud", "[]"), ("hallOfShame", "[]"),
)
HEAD = "head"


def report_summary(report: Report, version: str, run_ts: Column) -> DataFrame:
    """The report as parts of one document, in the field names of the report format.

    (section, a, b, c, text): the head, then a row for each model, agent, day, phrase and quote
    as JSON text; within a section the parts are ordered by a, b and c. No list is held in a
    row, so a report may have any number of models or phrases; see write_json.
    """
    level = level_struct(F.col("mdi"))
    nothing = F.lit(0.0)

    def part(rows: DataFrame, section: str, order: list[Column], item: Column, key: Column | None = None) -> DataFrame:
        a, b, c = order
        text = F.to_json(item)
        return rows.select(
            F.lit(section).alias("section"),
            a.cast("double").alias("a"),
            b.cast("double").alias("b"),
            c.cast("string").alias("c"),
            # Agents are an object keyed by id in the report format.
            (text if key is None else F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), text)).alias("text"),
        )

    shanghai = F.convert_timezone(None, F.lit("Asia/Shanghai"), run_ts.cast("timestamp_ntz"))
    head = report.totals.crossJoin(F.broadcast(report.sessions)).select(
        F.lit(version).alias("version"),
        F.unix_millis(run_ts).alias("generatedAt"),
        F.date_format(shanghai, "yyyy/M/d HH:mm:ss").alias("generatedDate"),
        F.col("hits").alias("totalDroolCount"),
        F.col("messages").alias("totalAssistantMessages"),
        F.col("sessions").alias("totalSessionsScanned"),
        F.lit(report.active).alias("activeHarnessCount"),
        F.col("rate").alias("overallDroolRate"),
        F.col("mdi").alias("overallDroolIndex"),
        level.alias("overallDroolLevel"),
    )
    models = report.models.join(report.top_phrases, "model", "left").join(report.model_harnesses, "model", "left")
    parts = [
        part(head, HEAD, [nothing, nothing, F.lit("")], F.struct("*")),
        part(
            models,
            "modelRankings",
            [-F.col("hits"), -F.col("mdi"), F.col("model")],
            F.struct(
                F.col("model"),
                F.col("model").alias("normalizedModel"),
                F.col("hits").alias("droolCount"),
                F.col("messages").alias("totalMessages"),
                F.col("rate").alias("droolRate"),
                F.col("mdi").alias("droolIndex"),
                level.alias("droolLevel"),
                F.coalesce("top", F.array().cast("array<struct<phrase:string,count:bigint>>")).alias("topPhrases"),
                F.col("harnesses"),
            ),
        ),
        part(
            report.harnesses,
            "harnessStats",
            [F.array_position(F.array(*(F.lit(h) for h in fixed.HARNESS_NAMES)), F.col("harness")), nothing, F.col("harness")],
            F.struct(
                F.col("harness"),
                F.col("name"),
                F.col("hits").alias("droolCount"),
                F.col("messages").alias("messageCount"),
                F.col("mdi").alias("droolIndex"),
            ),
            key=F.col("harness"),
        ),
        part(
            report.daily,
            "dailyTimeline",
            [F.unix_date("day"), nothing, F.lit("")],
            F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("hits").alias("count")),
        ),
        part(
            report.phrases,
            "phraseCloud",
            [-F.col("hits"), nothing, F.col("phrase")],
            F.struct(F.col("phrase").alias("text"), F.col("hits").alias("count"), F.col("category")),
        ),
        part(
            report.quotes,
            "hallOfShame",
            [F.col("place"), nothing, F.lit("")],
            F.struct(
                F.col("harness"),
                F.col("session_id").alias("sessionId"),
                F.unix_millis("ts").alias("timestamp"),
                F.col("model"),
                F.col("phrase"),
                F.col("category"),
                F.col("snippet"),
            ),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _document(parts: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The lines of one JSON document, from its parts in order."""
    names = [name for name, _ in SECTIONS]
    at, empty = -1, True

    def opened(until: int) -> Iterator[str]:
        nonlocal at, empty
        while at < until:
            if at >= 0:
                yield SECTIONS[at][1][1]
            at += 1
            if at < len(SECTIONS):
                name, marks = SECTIONS[at]
                yield f',"{name}":{marks[0]}'
                empty = True

    for section, text in parts:
        if section == HEAD:
            yield text[:-1]
            continue
        yield from opened(names.index(section))
        yield text if empty else "," + text
        empty = False
    yield from opened(len(SECTIONS))
    yield "}"


def write_tables(report: Report, path: str, fmt: str = "parquet") -> None:
    """One table per section."""
    for name, table in report.tables().items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def write_json(summary: DataFrame, path: str) -> None:
    """The parts as one JSON document, over several lines of one file.

    The parts are sorted by all tasks; one task writes them as they come and holds none.
    """
    place = F.array_position(F.array(F.lit(HEAD), *(F.lit(name) for name, _ in SECTIONS)), F.col("section"))

    def joined(batches) -> Iterator:
        import pyarrow as pa

        parts = ((s, t) for batch in batches for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for line in _document(parts):
            yield pa.record_batch([pa.array([line])], names=["value"])

    ordered = summary.orderBy(place, "a", "b", "c").select("section", "text").coalesce(1)
    ordered.mapInArrow(joined, "value string").write.mode("overwrite").text(path)
