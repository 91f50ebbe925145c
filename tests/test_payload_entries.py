"""The rows of submitted documents, read together or value by value, once for all tables."""

import json

from test_boards import raw

from assentlake.operators.payloads import HARNESSES, MODELS, documents, explode_entries, listed_entries, parse_payloads
from assentlake.plans.leaderboard import apply_submissions


def row(name, hits, messages, mdi=None, **more):
    return {"model": name, "droolCount": hits, "totalMessages": messages, "mdi": mdi, **more}


LISTS = [
    [row("a", 1, 10, 100.0), row(" b　", 2, 3, 666.6), row("a", 9, 9, 1000.0)],
    [row("a", 1, 2500000, None), row("b", 1, 2500000, 0.0004), {"model": "c", "droolCount": 1, "totalMessages": 2500000}],
    [row("a", 1, 1000, None), row("b", 1, 3, 333.33)],
    [row("a", "1", 10, "100"), row("b", True, 10, 0.1)],
    [row("a", 1.9, 10, 1e30), row("b", -1, 10, 0.1), row("", 1, 10, 0.1), row("c", 1e25, 10, 0.1)],
    [row("a", 1, 10, 100.0, extra=1), row(None, 1, 10, 100.0), row("m" * 300, 1, 10, 100.0)],
    [row("a", 1, 10, 100.0), None, row("b", 1, 10, 100.0)],
    [row(5, 1, 10, 100.0), [1], "x", row("b", [1], 10, 100.0)],
    [row(f"m{i % 400}", i, 1000, 0.5) for i in range(600)],
    {"a": row("a", 1, 10, 100.0)},
    [],
    None,
]


def test_listed_rows_are_the_unfolded_rows(spark):
    for key, listing in (("model", MODELS), ("harness", HARNESSES)):
        text = [json.dumps({listing.key: rows}).replace('"model"', f'"{key}"') for rows in LISTS]
        rows = raw(spark, *((n, n, 1, t) for n, t in enumerate([*text, "[]", "", '{"a":'])))
        want = explode_entries(documents(rows), listing)
        got = listed_entries(parse_payloads(rows), listing)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.dtypes == want.dtypes and want.count() > 60


def test_documents_are_read_once_for_all_tables(spark):
    """What is staged are clean columns; no table reads a document again."""
    tables = apply_submissions(raw(spark, (1, 1, 1, json.dumps({"modelEntries": LISTS[0]})), (2, 1, 1, "[]")), stage=True)
    for part in ("entries", "submissions", "models", "harnesses", "rejected"):
        assert "variant" not in getattr(tables, part)._jdf.queryExecution().toString().lower(), part
    assert [(r.submission_id, r.payload_json) for r in tables.rejected.collect()] == [(2, "[]")]
    assert sorted(r.model for r in tables.models.collect()) == ["a", "b"]
