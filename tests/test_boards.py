"""Submissions and leaderboards against plain Python."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assentlake import session
from assentlake.operators import boards, payloads
from assentlake.plans.leaderboard import apply_submissions


def report(hits, messages, models=(), **extra):
    return json.dumps({"version": " 1 ", "droolCount": hits, "assistantMessages": messages, "modelEntries": list(models), **extra})


def raw(spark, *rows):
    start = datetime(2026, 1, 1)
    return spark.createDataFrame(
        [(i, u, f"user{u}", start + timedelta(hours=h), p) for i, u, h, p in rows],
        "submission_id bigint, user_id bigint, login string, created_at timestamp, payload_json string",
    )


def asked(spark, **who):
    ((name, value),) = who.items()
    return spark.createDataFrame([(value,)], f"{name} {'string' if name == 'login' else 'long'}")


def test_ranks_from_counts_of_ranges(spark):
    """Many equal scores, ranges of one value, and every user's rank from one table."""
    rng = random.Random(9)
    people = [(u, f"U{u}", rng.choice([0, 0, 0, 1, 5, rng.randint(0, 40)]), rng.choice([10, 100]), datetime(2026, 1, 1 + u % 3)) for u in range(300)]
    entries = spark.createDataFrame(people, "user_id long, login string, hits long, messages long, updated_at timestamp")
    history = spark.createDataFrame([], "submission_id long, user_id long, payload_json string, created_at timestamp")
    table = boards.OrderTable.of(entries)
    assert sum(r.users for r in table.counts.collect()) == 300
    board = {r.user_id: r["rank"] for r in boards.board_people(entries, 300).collect()}
    for user in rng.sample(range(300), 6):
        row = boards.profile(entries, history, asked(spark, user_id=user), table).first()
        assert row["rank"] == board[user] and row.payload_json is None
    nobody = boards.OrderTable.of(entries.limit(0))
    assert boards.profile(entries.limit(0), history, asked(spark, user_id=1), nobody).count() == 0


def test_untidy_payloads(spark):
    cases = [
        (report("12", 100), (12, 100, 120.0)),
        (report(-1, 100.9), (0, 100, 0.0)),
        (report(True, None), (1, 0, 0.0)),
        (report("x", "1e2", mdi=5), (0, 100, 0.0)),
        (report(5, 1000, mdi=5.04), (5, 1000, 5.04)),
        (report(5, 1000, mdi=9), (5, 1000, 5.0)),
        (report(5, 1000, mdi="5.01"), (5, 1000, 5.01)),
        ("[]", None), ("null", None), ("  ", None), ("{", None), ("7", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload_json string")
    parsed = {r.i: r for r in payloads.parse_payloads(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert parsed[i].accepted == (want is not None)
        assert (parsed[i].hits, parsed[i].messages, parsed[i].mdi) == (want or (0, 0, 0.0))
        assert parsed[i].version == ("1" if want else "")


def test_entry_limits(spark):
    models = [{"model": f"m{i}", "droolCount": 1, "totalMessages": 10} for i in range(600)]
    models[3] = {"model": "  "}
    models[4] = 5
    models[5] = {"model": "n" * 300}
    df = spark.createDataFrame([(report(1, 1, models),)], "payload_json string")
    row = payloads.parse_payloads(df).first()
    assert row.model_count == len(row.model_entries) == 498
    assert max(len(e.name) for e in row.model_entries) == 120


def test_the_latest_received_submission_wins(spark):
    first = apply_submissions(raw(spark, (1, 1, 5, report(1, 10)), (2, 2, 1, report(2, 10)), (3, 1, 5, report(3, 10)), (4, 3, 1, "[]")))
    late = apply_submissions(raw(spark, (5, 1, 2, report(9, 10)), (6, 2, 3, report(7, 10))), first)
    assert {r.user_id: r.hits for r in late.entries.collect()} == {1: 3, 2: 7}
    assert late.submissions.count() == 5
    assert first.rejected.count() == 1


def test_a_repeated_name_counts_once(spark):
    models = [{"model": "m", "droolCount": 1, "totalMessages": 10}, {"model": "m", "droolCount": 5, "totalMessages": 10}]
    tables = apply_submissions(raw(spark, (1, 1, 1, report(6, 20, models))))
    assert [(r.model, r.hits) for r in tables.models.collect()] == [("m", 1)]


def test_boards(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        models = [{"model": f"m{m}", "droolCount": rng.randint(0, 20), "totalMessages": rng.randint(1, 9000)} for m in rng.sample(range(5), 3)]
        # One user sends a third of everything.
        user = 0 if i % 3 == 0 else rng.randint(1, 60)
        rows.append((i, user, rng.randint(0, 40), report(sum(m["droolCount"] for m in models), sum(m["totalMessages"] for m in models), models)))
    tables = apply_submissions(raw(spark, *rows))

    latest = {}
    for i, user, hour, text in rows:
        if user not in latest or (hour, i) > latest[user][:2]:
            latest[user] = (hour, i, json.loads(text))
    people = [(u, p["droolCount"], p["assistantMessages"], h) for u, (h, _, p) in latest.items()]
    prior = sum(p[1] for p in people) / sum(p[2] for p in people)

    def score(hits, messages, rate):
        return (hits + 5000 * rate) / (messages + 5000) * 1000

    order = sorted(people, key=lambda p: (-score(p[1], p[2], prior), -p[1], -p[2], p[3], p[0]))
    board = boards.board_people(tables.entries, 10).orderBy("rank").collect()
    assert [r.user_id for r in board] == [p[0] for p in order[:10]]
    for at in (0, 7, len(order) - 1):
        row = boards.profile(tables.entries, tables.submissions, asked(spark, login=f"USER{order[at][0]}")).first()
        assert row["rank"] == at + 1 and row.user_id == order[at][0]
        assert json.loads(row.payload_json)["droolCount"] == order[at][1]
    assert boards.profile(tables.entries, tables.submissions, asked(spark, user_id=order[2][0])).first()["rank"] == 3
    assert boards.profile(tables.entries, tables.submissions, asked(spark, login="nobody")).count() == 0

    children = [(m["model"], u, m["droolCount"], m["totalMessages"]) for u, (_, _, p) in latest.items() for m in p["modelEntries"]]
    rate = sum(c[2] for c in children) / sum(c[3] for c in children)
    ranked = boards.board_models(tables.models, tables.submissions, tables.entries, 4).collect()
    for model in {c[0] for c in children}:
        want = sorted((c for c in children if c[0] == model), key=lambda c: (-score(c[2], c[3], rate), -c[2], -c[3], f"user{c[1]}"))
        got = sorted((r for r in ranked if r.model == model), key=lambda r: r["rank"])
        assert [r.user_id for r in got] == [c[1] for c in want[:4]]
    hot = boards.hottest(tables.models, tables.submissions, tables.models, "model").collect()
    assert {r.model: (r.hits, r.contributors) for r in hot} == {
        m: (sum(c[2] for c in children if c[0] == m), sum(1 for c in children if c[0] == m)) for m in {c[0] for c in children}
    }


def test_empty_tables(spark):
    tables = apply_submissions(raw(spark, (1, 1, 1, "[]")))
    assert boards.board_people(tables.entries).count() == 0
    assert boards.prior(tables.entries).first().rate == 0.0
    assert boards.board_summary(tables.entries).first().average_mdi == 0.0
    assert tables.entries.where(F.col("hits") > 0).count() == 0


def test_listed_rows_of_untidy_documents(spark):
    entry = {"model": " a ", "droolCount": "3", "totalMessages": 10.9, "mdi": "300"}
    lists = [
        [entry, {"model": "a", "droolCount": 9}, {"model": "b", "droolCount": True, "totalMessages": 4}, 5, None, [], {"model": ""}, {"droolCount": 1}],
        {"model": "object"}, "text", None, [], [{"model": "n" * 130}, {"model": "n" * 125}],
        [{"model": f"m{i % 510}", "droolCount": i} for i in range(700)],
    ]
    rows = [(i, i, f"u{i}", datetime(2026, 1, 1), json.dumps({"modelEntries": x})) for i, x in enumerate(lists)] + [(90, 1, "u", None, "[]"), (91, 1, "u", None, None)]
    df = spark.createDataFrame(rows, "submission_id long, user_id long, login string, created_at timestamp, payload_json string")
    docs = payloads.documents(df)
    arrays = payloads.parse_payloads(df).select("submission_id", F.inline("model_entries")).collect()
    got = payloads.entry_rows(docs.select("submission_id", "v"), payloads.MODELS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, arrays)) and len(got) == 3 + 2 + 500
    children = payloads.explode_entries(docs, payloads.MODELS).collect()
    assert sorted((r.model, r.hits, r.messages, r.mdi) for r in children if r.submission_id == 0) == [("a", 3, 10, 300.0), ("b", 1, 4, 250.0)]
    assert sum(r.submission_id == 5 for r in children) == 1 and sum(r.submission_id == 6 for r in children) == 500


def test_tasks_are_small_unless_the_cluster_names_a_size(spark):
    kept = spark.conf.get(session.TASK_SIZE)
    try:
        spark.conf.unset(session.TASK_SIZE)
        session.configure(spark)
        assert spark.conf.get(session.TASK_SIZE) == session.TASK_BYTES
        spark.conf.set(session.TASK_SIZE, "8m")
        session.configure(spark)
        assert spark.conf.get(session.TASK_SIZE) == "8m"
    finally:
        spark.conf.set(session.TASK_SIZE, kept)


def test_shuffles_start_with_finer_parts_unless_the_cluster_names_a_number(spark):
    kept = spark.conf.get(session.TASK_COUNT)
    try:
        spark.conf.unset(session.TASK_COUNT)
        session.configure(spark)
        assert int(spark.conf.get(session.TASK_COUNT)) == session.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(session.TASK_COUNT, "12")
        session.configure(spark)
        assert spark.conf.get(session.TASK_COUNT) == "12"
    finally:
        spark.conf.set(session.TASK_COUNT, kept)
