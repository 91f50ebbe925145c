"""Log folders on disk to messages, for every agent."""

import json
import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assentlake.operators.carry import carry_forward
from assentlake.operators.similarity import sample_messages
from assentlake.operators.payloads import parse_payloads
from assentlake.plans.scan import load_messages
from assentlake.sources import files, pieces
from assentlake.sources.files import discover, parse_lines, read_lines
from assentlake.sources.pieces import array_parts
from verification import QUERIES, logs
from verification.relations import Relations

UUID = "0f0e0d0c-1111-2222-3333-444455556666"

def now():
    return F.lit("2026-01-01").cast("timestamp")



def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records), encoding="utf-8")


def database(path, table, columns, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    db.execute(f"create table if not exists {table} ({columns})")
    db.executemany(f"insert into {table} values ({','.join('?' * len(rows[0]))})", rows)
    db.commit()
    db.close()


def write_logs(root):
    reply = {"type": "assistant", "timestamp": "2026-01-05T10:00:00Z"}
    put(
        root / "claude/projects/a b/c1.jsonl",
        {**reply, "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "one"}, "two"]}},
        {**reply, "message": {"role": "assistant", "model": "<synthetic>", "content": "no"}},
        '{"broken":',
        "",
        '{"type":"assistant","type":"assistant","message":{"role":"assistant","content":"doubled key"}}',
        {"type": "user", "message": {"role": "user", "content": "why"}},
    )
    put(root / "claude/projects/node_modules/c2.jsonl", {**reply, "message": {"role": "assistant", "content": "pruned"}})
    say = {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "hi"}]}}
    put(
        root / f"codex/sessions/2026/rollout-{UUID}.jsonl",
        say,
        {"type": "turn_context", "payload": {"model": "turn-model"}},
        say,
        {"type": "session_meta", "payload": {"id": "other-thread"}},
        say,
    )
    database(root / "codex/state_5.sqlite", "threads", "id text, model text", (UUID, "thread-model"), ("other-thread", "meta-model"), ("x", None))
    for agent, key in (("omp", "model"), ("pi", "modelId")):
        put(
            root / agent / "agent/sessions/p1.jsonl",
            {"type": "message", "message": {"role": "assistant", "timestamp": 1767607200000, "content": "first"}},
            {"type": "model_change", key: "changed"},
            {"type": "message", "message": {"role": "assistant", "content": "second"}},
        )
    put(root / "pi/workflows/w.json", json.dumps({"journal": [{"result": " done "}, {"result": 1}]}))
    put(root / "codebuddy/projects/b1.jsonl", {"role": "assistant", "content": "hello"}, {"role": "assistant", "model": "own", "content": "hello"})
    put(root / "codebuddy/other/b2.jsonl", {"role": "assistant", "content": "wrong folder"})
    database(root / "codebuddy/workbuddy.db", "sessions", "id text, model text", ("b1", "looked-up"))
    put(root / "cline/tasks/t1/api_conversation_history.json", json.dumps([{"role": "assistant", "content": "api"}, {"role": "user", "content": "u"}]))
    put(root / "cline/tasks/t1/ui_messages.json", json.dumps([{"type": "say", "say": "text", "text": " ui "}]))
    put(root / "hermes/sessions/h1.json", json.dumps({"model": "hm", "messages": [{"role": "assistant", "content": "turn"}],
        "response": {"choices": [{"message": {"role": "assistant", "content": ""}}]}}))
    put(root / "hermes/sessions/bad.json", "{")
    put(root / "openclaw/o1.jsonl", {"role": "assistant", "text": "line"})
    put(root / "openclaw/o2.json", json.dumps({"history": [{"type": "assistant", "content": "doc", "timestamp": "nonsense"}]}))
    chat = {"tabs": [{"selectedModel": "cm", "bubbles": [{"type": "ai", "rawText": "answer"}, {"type": "user", "text": "q"}]}]}
    database(root / "cursor/ws1/state.vscdb", "ItemTable", "key text, value text", ("my.chat", json.dumps(chat)), ("theme", json.dumps(chat)), ("composer", "{"))
    put(root / "cursor/ws2/state.vscdb", "this is no database")
    database(root / "opencode/opencode.db", "message", "id text, session_id text, time_created integer, data text", ("m1", "s", 1767607200000, '{"role":"assistant","model":"om"}'), ("m2", "s", 0, '{"role":"user"}'))
    database(root / "opencode/opencode.db", "part", "message_id text, data text", ("m1", '{"type":"text","text":"part"}'), ("m1", '{"type":"tool"}'), ("m2", '{"type":"text","text":"no"}'))


def test_every_agent(spark, tmp_path):
    write_logs(tmp_path)
    agents = ["claude", "codex", "omp", "pi", "codebuddy", "cline", "hermes", "openclaw", "cursor", "opencode"]
    loaded = load_messages(spark, {a: str(tmp_path / a) for a in agents}, now())
    rows = loaded.collect()
    got = sorted((r.harness, r.session_id, r.model, r.text) for r in rows)
    assert got == sorted(
        [
            ("claude", "c1", "m1", "one two"),
            ("claude", "c1", "claude-code", "doubled key"),
            ("codex", UUID, "thread-model", "hi"),
            ("codex", UUID, "turn-model", "hi"),
            ("codex", UUID, "meta-model", "hi"),
            ("omp", "p1", "omp-model", "first"),
            ("omp", "p1", "changed", "second"),
            ("pi", "p1", "pi-model", "first"),
            ("pi", "p1", "changed", "second"),
            ("pi", "w", "pi-workflow-agent", " done "),
            ("codebuddy", "b1", "looked-up", "hello"),
            ("codebuddy", "b1", "own", "hello"),
            ("cline", "t1", "cline-model", "api"),
            ("cline", "t1", "cline-model", " ui "),
            ("hermes", "h1", "hm", "turn"),
            ("hermes", "h1", "hm", ""),
            ("openclaw", "o1", "openclaw-model", "line"),
            ("openclaw", "o2", "openclaw-model", "doc"),
            ("cursor", "ws1", "cm", "answer"),
            ("opencode", "s", "om", "part"),
        ]
    )
    when = {(r.harness, r.text): r.ts for r in rows}
    assert when["claude", "one two"] == datetime(2026, 1, 5, 10)
    assert when["omp", "first"] == datetime(2026, 1, 5, 10)
    assert when["omp", "second"] == datetime(2026, 1, 1)
    assert when["openclaw", "doc"] is None
    assert len({r.msg_id for r in rows}) == len(rows)
    folders = {"omp": str(tmp_path / "omp")}
    assert load_messages(spark, folders, now()).where("model = 'changed'").count() == 1
    only = load_messages(spark, {a: str(tmp_path / a) for a in agents}, now(), harnesses=["omp"])
    assert only.count() == 2


def test_several_roots_and_patterns(spark, tmp_path):
    reply = {"type": "assistant", "message": {"role": "assistant", "model": "m", "content": "yes"}}
    for user in ("ann", "bob", "c+d"):
        put(tmp_path / user / "claude/projects/p/s.jsonl", reply)
        database(tmp_path / user / "codex/state_5.sqlite", "threads", "id text, model text", (user, "m"))
        put(tmp_path / user / f"codex/sessions/{user}.jsonl", {"type": "m", "role": "assistant", "content": "ok"})
    put(tmp_path / "ann/claude/elsewhere/s.jsonl", reply)

    def count(agent, roots):
        return load_messages(spark, {agent: roots}, now()).count()

    assert count("claude", f"{tmp_path}/*/claude") == 3
    assert count("claude", f"{tmp_path}/{{ann,bob}}/claude") == 2
    assert count("claude", f"file:{tmp_path}/[ab]??/claude/") == 2
    assert count("claude", [f"{tmp_path}/ann/claude", f"{tmp_path}/c*/claude", f"{tmp_path}/ann/claude"]) == 2
    found = load_messages(spark, {"codex": f"{tmp_path}/*/codex"}, now())
    assert found.where("model = 'm'").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        count("claude", f"{tmp_path}/nobody*/claude")


def test_depth_and_names(spark, tmp_path):
    for path in ("a.jsonl", "d1/b.jsonl", "d1/d2/c.jsonl", "dist/x.jsonl", "d1/skip-me/y.jsonl", "d1/z.txt"):
        put(tmp_path / path, {"a": 1})
    found = discover(spark, str(tmp_path), ".jsonl", 1, exclude=["skip-me"]).collect()
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in found) == ["a.jsonl", "b.jsonl"]


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    put(tmp_path / "big.jsonl", *({"type": "model_change", "n": i} if i % 700 == 5 else {"n": i, "pad": "x" * (i % 50)} for i in range(6000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_lines(spark, str(tmp_path))
        records = parse_lines(raw).select(
            "file_path", "block_start", "pos",
            F.try_variant_get("v", "$.n", "int").alias("n"),
            F.when(F.try_variant_get("v", "$.type", "string") == "model_change", F.try_variant_get("v", "$.n", "string")).alias("change"),
        ).cache()
        assert records.select("block_start").distinct().count() > 5
        rows = records.orderBy("block_start", "pos").collect()
        assert [r.n for r in rows] == list(range(6000))
        carried = carry_forward(records, F.col("change"), F.lit("start"), "running").collect()
        for r in carried:
            want = "start" if r.n < 5 else str((r.n - 5) // 700 * 700 + 5)
            assert r.running == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_larger_than_a_variant(spark, tmp_path):
    long = "x" * 9_000_000
    turns = [{"role": "assistant", "content": long + str(i)} for i in range(3)]
    put(tmp_path / "hermes/sessions/h.json", json.dumps({"session_id": "S", "model": "hm", "last_updated": 1767607200000, "messages": turns,
        "response": {"model": "rm", "choices": [{"message": {"role": "assistant", "content": "end"}}]}}))
    put(tmp_path / "cline/tasks/t/api_conversation_history.json", json.dumps(turns))
    put(tmp_path / "hermes/sessions/broken.json", json.dumps({"messages": turns})[:-2])
    folders = {a: str(tmp_path / a) for a in ("hermes", "cline")}
    loaded = load_messages(spark, folders, now())
    rows = loaded.select("harness", "session_id", "ts", "model", F.right("text", F.lit(3)).alias("tail"), F.length("text").alias("n")).collect()
    assert sorted((r.harness, r.session_id, r.model, r.tail) for r in rows) == sorted(
        [("hermes", "S", "hm", f"xx{i}") for i in range(3)] + [("hermes", "S", "rm", "end")]
        + [("cline", "t", "cline-model", f"xx{i}") for i in range(3)]
    )
    assert {r.ts for r in rows if r.harness == "hermes" and r.tail != "end"} == {datetime(2026, 1, 5, 10)}


@pytest.mark.parametrize("size", [10, 5_000_000, 70_000_000])
def test_records_of_every_size_are_read_alike(spark, tmp_path, size):
    """The last of repeated keys counts, and nothing vanishes, whatever the size."""
    long = "x" * size
    reply = '"role":"assistant","content":"' + long + '"'
    put(tmp_path / "hermes/sessions/h.json", '{"model":"first","messages":[{' + reply + '}],"model":"last"}')
    put(tmp_path / "claude/projects/p/c.jsonl", '{"type":"assistant","message":{"model":"first",' + reply + ',"model":"last"}}')
    data = '{"type":"tool","text":"' + long + '","type":"text"}'
    database(tmp_path / "opencode/opencode.db", "message", "id text, session_id text, time_created integer, data text", ("m", "s", 1, '{"role":"assistant","model":"last"}'))
    database(tmp_path / "opencode/opencode.db", "part", "message_id text, data text", ("m", data))
    folders = {a: str(tmp_path / a) for a in ("hermes", "claude", "opencode")}
    rows = load_messages(spark, folders, now()).select("harness", "model", F.length("text").alias("n")).collect()
    assert sorted((r.harness, r.model, r.n) for r in rows) == [(a, "last", size) for a in sorted(folders)]
    payload = F.concat(F.lit('{"version":"1","pad":"'), F.repeat(F.lit("x"), F.lit(size)), F.lit('","droolCount":1,"droolCount":2}'))
    got = parse_payloads(spark.range(1).select(payload.alias("payload_json"))).select("accepted", "hits").first()
    assert tuple(got) == (True, 2)


def test_damaged_databases_are_errors(spark, tmp_path):
    database(tmp_path / "cursor/ws/state.vscdb", "ItemTable", "key text, value text", *((f"chat{i}", "x" * 500) for i in range(200)))
    path = tmp_path / "cursor/ws/state.vscdb"
    content = bytearray(path.read_bytes())
    content[4096:] = b"\xff" * (len(content) - 4096)
    path.write_bytes(content)
    with pytest.raises(Exception, match="malformed"):
        load_messages(spark, {"cursor": str(tmp_path / "cursor")}, now()).count()


@pytest.mark.parametrize("file", ["hermes/sessions/h.json", "cline/tasks/t/api_conversation_history.json"])
def test_an_element_too_large_for_a_variant_is_an_error(spark, tmp_path, file):
    turns = [{"role": "assistant", "content": c} for c in ("a", "x" * 140_000_000, "b")]
    put(tmp_path / file, json.dumps({"messages": turns} if "hermes" in file else turns))
    agent = file.split("/")[0]
    with pytest.raises(Exception, match="too large for a VARIANT"):
        load_messages(spark, {agent: str(tmp_path / agent)}, now()).select(F.length("text")).collect()


def test_null_and_odd_fields_of_documents_are_no_error(spark, tmp_path):
    odd = [{"messages": None, "model": None}, {"messages": "[text", "history": {"a": 1}}, {"response": 1}, {"response": {"choices": None}}, {"messages": []}]
    for i, doc in enumerate(odd):
        put(tmp_path / f"hermes/sessions/h{i}.json", json.dumps(doc))
    put(tmp_path / "hermes/sessions/good.json", json.dumps({"model": None, "messages": [None, {"role": "assistant", "content": "ok"}]}))
    rows = load_messages(spark, {"hermes": str(tmp_path / "hermes")}, now()).collect()
    assert [r.text for r in rows] == ["ok"]


@pytest.mark.parametrize("checkpointed", [True, False])
def test_rows_of_a_write_ahead_log_are_read(spark, tmp_path, checkpointed):
    """What is committed only in the log counts; what is not committed does not."""
    path = tmp_path / "opencode/opencode.db"
    path.parent.mkdir(parents=True)
    db = sqlite3.connect(path)
    db.execute("pragma journal_mode=wal")
    db.execute("pragma wal_autocheckpoint=0")
    db.execute("create table message (id text, session_id text, time_created integer, data text)")
    db.execute("create table part (message_id text, data text)")
    for i in range(300):
        db.execute("insert into message values (?, 's', 1, ?)", (f"m{i}", '{"role":"assistant","model":"om"}'))
        db.execute("insert into part values (?, ?)", (f"m{i}", json.dumps({"type": "text", "text": "x" * 50 + str(i)})))
        if i == 100:
            db.commit()
            if checkpointed:
                db.execute("pragma wal_checkpoint(full)")
    db.execute("update part set data = replace(data, 'xx299', 'xx-last')")
    db.commit()
    db.execute("pragma cache_size=1")
    db.executemany("insert into message values (?, 's', 1, '{\"role\":\"assistant\"}')", [(f"open{i}",) for i in range(500)])
    assert (tmp_path / "opencode/opencode.db-wal").stat().st_size > 0
    rows = load_messages(spark, {"opencode": str(tmp_path / "opencode")}, now()).select("text").collect()
    db.rollback()
    db.close()
    assert sorted(r.text for r in rows) == sorted("x" * 50 + (str(i) if i < 299 else "-last") for i in range(300))


def control_and_replies(n):
    """Lines of a session log, with changes of the model at some of them."""
    for i in range(n):
        if i % 90 == 7:
            yield {"type": "model_change", "model": f"m{i // 180}"}
        elif i % 11 == 3:
            yield {"type": "user", "text": "x" * (i % 70)}
        else:
            yield {"type": "message", "message": {"role": "assistant", "content": f"reply {i} model_change"}}


def test_tables_do_not_depend_on_how_files_are_split(spark, tmp_path):
    """Ids, running models and the sample are the same for any size of a split."""
    put(tmp_path / "omp/agent/sessions/long.jsonl", *control_and_replies(3_000))
    put(tmp_path / "omp/agent/sessions/short.jsonl", *control_and_replies(5))
    put(tmp_path / "claude/projects/p/c.jsonl", *({"type": "assistant", "message": {"model": "m", "content": f"reply {i}"}} for i in range(2_000)))
    put(tmp_path / "codex/sessions/s.jsonl", {"type": "session_meta", "payload": {"id": "known"}}, *(
        {"type": "turn_context", "payload": {"model": f"t{i // 50}"}} if i % 50 == 20 else {"type": "r", "role": "assistant", "content": f"c {i}"} for i in range(1_500)))
    database(tmp_path / "codex/state_5.sqlite", "threads", "id text, model text", ("known", "of-thread"))
    folders = {a: str(tmp_path / a) for a in ("omp", "claude", "codex")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in ("128m", "40000", "9001"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            loaded = load_messages(spark, folders, now())
            sample = sample_messages(loaded, ["omp"], 12).select("text").collect()
            seen.append((sorted(map(str, loaded.collect())), [r.text for r in sample]))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == seen[2]
    rows, sample = seen[0]
    assert len(rows) == len(set(rows)) > 5_000
    assert sample == [f"reply {i} model_change" for i in (0, 1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 13)]
    models = {r.text: r.model for r in load_messages(spark, folders, now()).where("harness = 'omp'").collect()}
    assert models["reply 8 model_change"] == "m0" and models["reply 2999 model_change"] == "m16" and models["reply 6 model_change"] in ("omp-model", "m0")
    codex = {r.text: r.model for r in load_messages(spark, folders, now()).where("harness = 'codex'").collect()}
    assert codex["c 0"] == "of-thread" and codex["c 21"] == "t0" and codex["c 1499"] == "t29"


def test_texts_stay_where_they_are_read(spark, tmp_path):
    """The lists of changes are small, so they are broadcast and no exchange holds a text."""
    put(tmp_path / "omp/agent/sessions/a.jsonl", *control_and_replies(100))
    plan = load_messages(spark, {"omp": str(tmp_path / "omp")}, now())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_a_list_of_many_changes(spark):
    rows = [(f"f{i % 3}", i // 3 // 400 * 1000, i, f"v{i // 7}" if i % 5 == 0 else None) for i in range(6_000)]
    records = spark.createDataFrame(rows, "file_path string, block_start long, pos long, change string")
    got = {r.pos: r.model for r in carry_forward(records, F.col("change"), F.lit("none"), "model").collect()}
    last = {}
    for path, _, pos, change in rows:
        last[path] = change or last.get(path, "none")
        assert got[pos] == last[path]


def element(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return "".join(rng.choice('a,"\\[]{}é\n ') for _ in range(rng.randrange(8)))
    if kind < 0.5:
        return rng.choice([None, True, 1.5, -3])
    if kind < 0.75:
        return [element(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f'{i},"\\': element(rng, depth + 1) for i in range(rng.randrange(3))}


def test_parts_of_an_array_are_the_array():
    """For any cuts and damages, against the parser of Python."""
    rng = random.Random(7)
    for round in range(6_000):
        text = bytearray(json.dumps([element(rng) for _ in range(rng.randrange(8))], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode())
        for _ in range(rng.randrange(3) if round % 2 else 0):
            at = rng.randrange(1, len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice([b"", bytes([rng.choice(b'"\\,[]{} a1')])])
        text = rng.choice([b"", b" \n"]) + bytes(text) + rng.choice([b"", b"\n", b" x]"])
        left, chunks = text.split(b","), []
        while left:
            n = rng.randrange(1, 6)
            chunks.append(b",".join(left[:n]) + b",")
            del left[:n]
        try:
            want, _ = json.JSONDecoder().raw_decode(text.decode("utf-8", "replace").lstrip())
        except ValueError:
            want = None
        got = []
        for before, value, sound in array_parts(chunks, rng.choice([1, 10, 50, 10**6])):
            try:
                assert sound and before == len(got)
                got += json.loads(value.decode("utf-8", "replace"))
            except (AssertionError, ValueError):
                got = None
                break
        assert got == want, text


def test_large_arrays_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Ids and messages are the same as those of a single row; a document that is broken anywhere is left out."""
    texts = [f'{i} é, "[{{\\ ' + "word, " * (i % 7) + "}]" for i in range(400)]
    turns = [{"role": "assistant", "content": t} if i % 5 else [None, t] if i % 2 else {"type": "say", "say": "text", "text": t} for i, t in enumerate(texts)]
    plain = json.dumps(turns)
    middle = plain.index('{"role"', len(plain) // 2)
    documents = {
        "plain": plain, "a [1]{x}+%41 b": json.dumps(turns, ensure_ascii=False), "lines": json.dumps(turns, indent=2), "behind": plain + " x],[",
        "object": json.dumps({"messages": turns}), "text": json.dumps(plain), "blank": " \n" * 2_000, "none": "[" + " " * 3_000 + "]",
    }
    broken = {
        "end": plain[:-1], "brace": plain[:-1] + "}", "comma": plain[:-1] + ",]", "blanks": plain[:-1] + "," + " " * 3_000 + "]",
        "double": plain[:middle] + "," + plain[middle:], "word": plain[:middle] + "word " + plain[middle:], "quote": plain[:middle] + '"' + plain[middle:],
    }
    for name, text in {**documents, **broken}.items():
        put(tmp_path / f"tasks/{name}/api_conversation_history.json", text)
        put(tmp_path / f"openclaw/{name}.json", text)
    folders = {"cline": str(tmp_path), "openclaw": str(tmp_path / "openclaw")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for whole in (1 << 30, 2_000):
        monkeypatch.setattr(files, "WHOLE_BYTES", whole)
        monkeypatch.setattr(pieces, "PART_BYTES", 1_000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        try:
            seen.append(sorted(map(str, load_messages(spark, folders, now()).collect())))
            raw = files.read_docs(spark, folders["openclaw"]).select("file_path", F.length("value").alias("n")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and len(seen[0]) == len(set(seen[0])) > 2_000
    assert not any(f"/{name}/" in row or f"/{name}.json" in row for row in seen[1] for name in broken)
    lengths = {name: [r.n for r in raw if r.file_path.endswith(f"/{name}.json")] for name in {**documents, **broken}}
    assert all(len(lengths[n]) > 5 and max(lengths[n]) < 4_000 for n in ("plain", "lines", "behind"))
    assert all(len(lengths[n]) == 1 for n in ("object", "text", "blank")) and not any(lengths[n] for n in broken)


def test_documents_are_written_element_by_element(spark, tmp_path, monkeypatch):
    """src_json_doc: a file for each session, in which no line holds more than one message."""
    monkeypatch.setattr(files, "WHOLE_BYTES", 3_000)
    monkeypatch.setattr(pieces, "PART_BYTES", 1_000)
    written = tmp_path / "documents"
    monkeypatch.setattr(logs, "shared_folder", lambda spark, name: str(written))
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t}") for c in (1, 2, None) for t in (1, 2, 3, 3)]
    docs = [(i % 300, f'{i}, "x" [', "en", (None, "", "src1", "src2")[i % 4], 9) for i in range(600)] + [(900, " ", "en", "src9", 1), (901, None, "en", "src9", 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.session_id: (r["items"], r.chars) for r in QUERIES["src_json_doc"](spark, str(tmp_path)).collect()}
    want = {}
    for row in Relations(spark, str(tmp_path)).messages.where("trim(text) <> ''").select("session_id", "text").collect():
        items, chars = want.get(row.session_id or "__HIVE_DEFAULT_PARTITION__", (0, 0))
        want[row.session_id or "__HIVE_DEFAULT_PARTITION__"] = (items + 1, chars + len(row.text))
    assert got == want and want["__HIVE_DEFAULT_PARTITION__"][0] == 303 and want["src1"][0] == 150
    for name, (items, chars) in want.items():
        (file,) = written.glob(f"session_id={name}/*.txt")
        text = file.read_text(encoding="utf-8")
        assert len(text.splitlines()) == items
        assert sum(len(e["content"]) for e in json.loads(text)) == chars
