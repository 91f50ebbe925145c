"""Rollups, ranking and the submission document."""

import json
import random

from pyspark.sql import functions as F

from assentlake.functions import classify_level, normalize_model
from assentlake.operators import metrics, payloads, ranking
from assentlake.plans.report import build_report, report_summary, write_json, write_tables
from assentlake.plans.scan import configured_sources

NAMES = {
    "anthropic/claude-3.5-sonnet": "claude-3-5-sonnet",
    "openai/gpt-4o": "gpt-4o",
    "somebody/gpt-5.6-luna": "gpt-5.6-luna",
    "claude-3-7-sonnet-20250219": "claude-3-7-sonnet",
    "gpt-4o-2024-08-06": "gpt-4o",
    "cline-x:free": "x",
    "m[128k]": "m",
    "": "unknown-model",
}


def test_model_names(spark):
    df = spark.createDataFrame([(k, v) for k, v in NAMES.items()], "raw string, want string")
    for row in df.select("want", normalize_model(F.col("raw")).alias("got")).collect():
        assert row.got == row.want
    extra = spark.createDataFrame([("mine-gpt",)], "raw string")
    assert extra.select(normalize_model(F.col("raw"), ["mine"])).first()[0] == "gpt"


def test_levels(spark):
    cases = {0.0: 0, 2.0: 0, 2.5: 1, 5.0: 1, 20.0: 2, 35.0: 3, 80.0: 4}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "mdi double, want int")
    assert df.where(classify_level(F.col("mdi")) != F.col("want")).count() == 0


def test_counts_per_model(messages, matcher):
    df = messages({}, {"model": "x/claude-opus-5"}, {"text": "好的，开始实现。"}, {"harness": "omp", "session_id": "s2"})
    (row,) = metrics.model_counts(metrics.count_hits(df, matcher)).collect()
    assert (row.model, row.messages, row.hits, row.mdi) == ("claude-opus-5", 4, 3, 750.0)
    assert metrics.sessions(df).first()[0] == 2
    assert metrics.model_harnesses(df).first().harnesses == ["claude", "omp"]


def test_rate_is_per_thousand(messages, matcher):
    df = messages(*({"text": "你说得对" if i < 5 else "好的。"} for i in range(100)))
    row = metrics.totals(metrics.count_hits(df, matcher)).first()
    assert (row.messages, row.hits, row.mdi, row.rate, row.level) == (100, 5, 50.0, 5.0, 3)


def test_ties_are_ordered_by_name(messages, matcher):
    for order in (["aaa", "bbb"], ["bbb", "aaa"]):
        counts = metrics.model_counts(metrics.count_hits(messages(*({"model": m} for m in order)), matcher))
        ranked = ranking.rank_models(counts).orderBy("rank").collect()
        assert [(r.model, r["rank"]) for r in ranked] == [("aaa", 1), ("bbb", 2)]


def test_rank_over_many_ranges(spark):
    rows = spark.range(5000).select(F.expr("cast(id * 7919 % 5000 as int)").alias("x")).repartition(8)
    ranked = ranking.with_rank(rows, F.col("x").desc())
    assert ranked.where(F.col("rank") != 5000 - F.col("x")).count() == 0


def test_bad_timestamps_count_but_have_no_day(messages, matcher):
    counted = metrics.count_hits(messages({"ts": None}, {}), matcher)
    assert metrics.totals(counted).first().hits == 2
    assert [r.hits for r in metrics.daily(counted).collect()] == [1]


def test_partials_merge(messages, matcher, spark):
    """Sums add up; elements that several runs know count once, in sets larger than a row should be."""
    def partial(rows, low, high):
        counts = metrics.model_counts(metrics.count_hits(messages(*rows), matcher)).select("model", "messages", "hits")
        names = spark.range(low, high).select(F.lit("claude-opus-5").alias("model"), F.col("id").cast("string").alias("element"))
        return metrics.Partial(counts, {"names": names})

    merged = metrics.merge_partials([partial([{}, {}], 0, 150_000), partial([{}], 100_000, 200_000), metrics.Partial(partial([{"model": "b"}], 0, 0).counts, {})], ["model"], ["messages", "hits"])
    rows = {r.model: (r.messages, r.hits, r.names) for r in metrics.with_distinct(merged, ["model"], "names").collect()}
    assert rows == {"claude-opus-5": (3, 3, 200_000), "b": (1, 1, 0)}


def test_a_document_of_parts(spark, tmp_path):
    """Any number of rows, sections without rows, and texts that need escapes."""
    from assentlake.plans.report import SECTIONS

    head = [("head", 0.0, 0.0, "", json.dumps({"version": "1"}))]
    many = [("phraseCloud", -float(i), 0.0, f"p{i}", json.dumps({"text": f'"{i}\n\\'})) for i in range(3_000)]
    agents = [("harnessStats", float(i), 0.0, n, json.dumps(n) + ":" + json.dumps({"n": i})) for i, n in enumerate(("b", "a"))]
    for rows in (head, head + agents, many + agents + head):
        random.Random(1).shuffle(rows)
        parts = spark.createDataFrame(rows, "section string, a double, b double, c string, text string").repartition(7)
        write_json(parts, str(tmp_path / "doc"))
        document = json.loads(spark.read.text(str(tmp_path / "doc"), wholetext=True).first()[0])
        assert list(document) == ["version", *(n for n, _ in SECTIONS)]
        assert document["phraseCloud"] == [json.loads(r[4]) for r in sorted((r for r in rows if r[0] == "phraseCloud"), key=lambda r: r[1])]
        assert list(document["harnessStats"]) == (["b", "a"] if len(rows) > 1 else []) and document["hallOfShame"] == []


def test_configured_sources_without_messages(spark, tmp_path):
    for name in ("a", "b/x", "b/y"):
        (tmp_path / name).mkdir(parents=True)
    roots = {"one": str(tmp_path / "a"), "two": [f"{tmp_path}/none", f"{tmp_path}/b/*"], "three": str(tmp_path / "none"), "four": f"{tmp_path}/c*"}
    found = configured_sources(spark, roots)
    assert sorted(r.harness for r in found.collect()) == ["one", "two"]
    assert metrics.active_harnesses(found).first().active == 2


def test_quotes_take_turns(spark):
    """Against the plain loop: phrases in order of frequency, one quote each per round."""
    import random

    rng = random.Random(3)
    rows = []
    for p in range(70):
        for _ in range(rng.choice([1, 2, 5, 300 if p == 0 else 4])):
            rows.append((f"p{p:02d}", "h", f"s{rng.randint(0, 50)}", rng.randint(0, 10**6), "m", f"{rng.random()}"))
    df = spark.createDataFrame(
        rows, "phrase string, harness string, session_id string, ms bigint, model string, snippet string"
    ).withColumn("ts", F.timestamp_millis("ms"))
    queues = {}
    for r in rows:
        queues.setdefault(r[0], []).append(r)
    for q in queues.values():
        q.sort(key=lambda r: (-r[3], r[1], r[2], r[4], r[5]))
    order = sorted(queues, key=lambda p: (-len(queues[p]), p))
    cap, want, turn = min(200, max(60, len(order))), [], 0
    while len(want) < cap and any(turn < len(queues[p]) for p in order):
        want += [queues[p][turn] for p in order if turn < len(queues[p])]
        turn += 1
    got = ranking.quotes_round_robin(df).orderBy("place").collect()
    assert [(r.phrase, r.snippet) for r in got] == [(r[0], r[5]) for r in want[:cap]]


def test_report_and_submission(messages, matcher, spark, tmp_path):
    df = messages(
        {"text": "你说得对，我改。这是很长的对话正文不该外传。"},
        {"session_id": "s2", "text": "好的。", "model": "gpt-6-astra"},
        {"session_id": "s2", "harness": "codex", "text": "按你说的改。", "model": "gpt-6-astra"},
    )
    report = build_report(df, matcher, active=2)
    summary = report_summary(report, "0.1.2", F.lit("2026-01-03").cast("timestamp"))
    write_json(summary, str(tmp_path / "json"))
    document = json.loads(spark.read.text(str(tmp_path / "json"), wholetext=True).first()[0])
    assert document["generatedAt"] == 1767398400000 and document["generatedDate"] == "2026/1/3 08:00:00"
    assert document["totalDroolCount"] == 2 and document["totalAssistantMessages"] == 3
    assert document["totalSessionsScanned"] == 2 and document["activeHarnessCount"] == 2
    assert [m["model"] for m in document["modelRankings"]] == ["claude-opus-5", "gpt-6-astra"]
    assert document["modelRankings"][0]["topPhrases"] == [{"phrase": "你说得对", "count": 1}]
    assert set(document["harnessStats"]) >= {"claude", "codex", "other"}
    assert {q["phrase"] for q in document["hallOfShame"]} == {"你说得对", "按你说的改"}
    write_tables(report, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "phrases")).count() == 2

    payload = payloads.build_payload(
        report.totals, report.models, report.harnesses, report.sessions, "0.1.2", F.lit("2026-01-03").cast("timestamp")
    ).first()[0]
    sent = json.loads(payload)
    assert sent["droolCount"] == 2 and sent["modelCount"] == 2
    assert {h["harness"] for h in sent["harnessEntries"]} == {"Claude Code", "Codex"}
    assert all(h["totalMessages"] > 0 for h in sent["harnessEntries"])
    for private in ("不该外传", "snippet", "session_id", "sessionId"):
        assert private not in payload


def test_agents_outside_the_list_count(spark):
    from assentlake.operators.metrics import harness_stats

    counted = spark.createDataFrame([("newagent", 1), ("newagent", 0), ("pi", 2)], "harness string, n_hits int")
    rows = {r.harness: (r.name, r.messages, r.hits) for r in harness_stats(counted).collect()}
    assert rows["newagent"] == ("newagent", 2, 1) and rows["pi"][1:] == (1, 2) and rows["claude"][1:] == (0, 0)


def test_staged_data_goes_and_a_cluster_needs_a_shared_folder(spark):
    import os
    from types import SimpleNamespace

    import pytest

    from assentlake.session import release, shared_folder, staged

    table = staged(spark.range(3), "kept")
    folder = os.path.dirname(os.path.dirname(table.inputFiles()[0].removeprefix("file:").replace("//", "/")))
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(cluster, "x")
