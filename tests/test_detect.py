"""Detection: examples, and a comparison with a plain loop over random texts."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from assentlake import fixed
from assentlake.operators import similarity
from assentlake.operators.detect import detect, match_candidates, resolve_overlaps
from assentlake.sources.lexicon import Matcher, lexicon_lines, load_lexicon

COMPLIANT = [
    "既然你说不用加，那我就不加了。",
    "你说删哪些我就删。",
    "你说一句 **continue** 我就。",
    "你说一声我就去做。",
    "按你说的改了机制，刷新页面就能看到。",
    "听你的，我这就把所有类型断言全部干掉。",
    "就按你说的办。",
]
VARIATIONS = [
    "你说的对，确实如此",
    "您说得对，我这就去修改",
    "你说得完全正确！",
    "确实是我搞错了，抱歉。",
    "You're right, I missed the semicolon.",
    "Apologies, you are right about the typing.",
]


def test_examples(messages, matcher):
    texts = COMPLIANT + VARIATIONS + ["请提供你希望重构的代码文件路径，我将逐步为你分析其依赖关系。", "", "ok"]
    hits = detect(messages(*({"text": t} for t in texts)), matcher).orderBy("msg_id", "rank").collect()
    by_message = {}
    for h in hits:
        by_message.setdefault(int(h.msg_id), []).append(h)
    for i in range(len(COMPLIANT)):
        assert by_message[i][0].category == "blind_compliance"
    assert all(len(COMPLIANT) + i in by_message for i in range(len(VARIATIONS)))
    assert max(by_message) < len(COMPLIANT) + len(VARIATIONS)


def test_snippet_of_a_single_hit(messages, matcher):
    text = "x" * 100 + "经过重新仔细思考你的指责，\n\n你说得对，这里的锁确实会发生死锁。" + "y" * 100
    (hit,) = detect(messages({"text": text}), matcher).collect()
    assert hit.phrase == "你说得对"
    assert hit.snippet.startswith("...x") and hit.snippet.endswith("y...")
    assert "\n" not in hit.snippet


def test_fences_and_ascii_boundaries(messages, matcher):
    rows = ["```\n你说得对\n``` done", "``` 你说得对", "you're right正如你所说", "you're rightly", "fair```x```point"]
    hits = detect(messages(*({"text": t} for t in rows)), matcher).collect()
    found = sorted((int(h.msg_id), h.phrase) for h in hits)
    assert found == [(1, "你说得对"), (2, "you're right"), (2, "正如你所说"), (4, "fair point")]


def python_model(entries, text):
    """The loop the expressions stand for: longest entry first, left to right, no overlap."""
    if len(text) < 3:
        return []
    t = re.sub(r"```.*?```", " ", text, flags=re.S)
    if len(t.strip()) < 3:
        return []
    taken = []
    for rank, phrase, pattern in entries:
        for m in pattern.finditer(t):
            if not any(max(s, m.start()) < min(e, m.end()) for s, e, _ in taken):
                taken.append((m.start(), m.end(), rank))
    return sorted(taken)


def test_random_texts_against_a_loop(spark, matcher):
    entries = []
    for e in matcher.entries:
        source = e.phrase if e.is_regex else re.escape(e.phrase)
        if not e.is_regex and e.phrase[0].isascii():
            source = rf"(?a:\b){source}(?a:\b)"
        entries.append((e.rank, e.phrase, re.compile(source, re.I)))
    rng = random.Random(7)
    pieces = [e.phrase for e in matcher.entries if not e.is_regex] + [
        "你说", "我就", "既然您说", "，", "。", " ", "```", "\n", "ok", "right", "as you suggested, I'll ",
        "听你的，我", "按你说的办", "a", "YOU'RE RIGHT", "确实",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id int, text string").repartition(8)
    got = {}
    for h in detect(df, matcher).collect():
        got.setdefault(h.msg_id, []).append((h.start, h.start + h.length, h.rank))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == python_model(entries, text), text


def test_gate_never_drops_a_candidate(spark, matcher):
    texts = [e.phrase for e in matcher.entries if not e.is_regex]
    df = spark.createDataFrame([(t.upper(),) for t in texts], "text string")
    assert match_candidates(df, matcher).select("phrase").distinct().count() >= len(texts)


def test_custom_lexicon(spark, messages):
    lines = ["# note", "", "no mark", "all good|praise", "a|b |", "regex:x*|bad", "regex:so be it[,\\s]*ok|yes", "regex:p|q|w"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "line_no int, value string")
    lexicon = load_lexicon(df)
    rows = [(r["rank"], r.phrase, r.category) for r in lexicon.orderBy("rank").collect()]
    assert rows == [(1, "so be it[,\\s]*ok", "yes"), (2, "all good", "praise"), (3, "a|b", "direct_agree"), (4, "p|q", "w")]
    custom = Matcher.of(lexicon)
    assert custom.keywords == ()
    hits = detect(messages({"text": "All Good. So be it,\u3000ok"}, {"text": "zzz"}, {"text": "zpz"}), custom).collect()
    assert sorted((h.msg_id, h.category) for h in hits) == [("0", "praise"), ("0", "yes"), ("2", "w")]


def test_shipped_lexicon(spark):
    lexicon = load_lexicon(lexicon_lines(spark))
    assert lexicon.count() == 126
    assert lexicon.where("is_regex").count() == 15
    assert lexicon.where(F.col("category") == "blind_compliance").count() == 12


@pytest.mark.parametrize("parts", [1, 8])
def test_partitions_do_not_matter(spark, matcher, parts):
    rows = [(i, t) for i, t in enumerate(COMPLIANT + VARIATIONS)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "msg_id int, text string").repartition(parts)
    got = sorted((h.msg_id, h.start, h.phrase) for h in detect(df, matcher).collect())
    again = sorted((h.msg_id, h.start, h.phrase) for h in detect(df.coalesce(1), matcher).collect())
    assert got == again and len(got) >= 13


def test_case_folds_outside_ascii(spark):
    lines = spark.createDataFrame([(1, "Это верно|ack"), (2, "café right|ack")], "line_no bigint, value string")
    patterns = [r.pattern for r in load_lexicon(lines).collect()]
    texts = spark.createDataFrame([("ЭТО ВЕРНО",), ("CAFÉ RIGHT",)], "text string")
    for pattern, n in zip(patterns, (1, 1)):
        assert texts.where(F.col("text").rlike(pattern)).count() == n


def plain_overlaps(spans):
    taken = []
    for s in sorted(spans, key=lambda s: (s[2], s[0])):
        if not any(max(s[0], k[0]) < min(s[0] + s[1], k[0] + k[1]) for k in taken):
            taken.append(s)
    return sorted(taken)


def test_overlaps_of_random_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        spans, size = [], rng.choice([0, 1, 2, 10, 60])
        for rank in rng.sample(range(100), min(size, 12)):
            # the matches of one entry stand one after another
            at = rng.randint(0, 20)
            for _ in range(size // 6 + 1):
                length = rng.randint(1, 6)
                spans.append((at, length, rank))
                at += length + rng.choice([0, 0, 1, 5, 30])
        rng.shuffle(spans)
        rows.append((i, spans))
    df = spark.createDataFrame(rows, "id int, spans array<struct<start:int,length:int,rank:int>>")
    got = {r.id: [tuple(s) for s in r.kept] for r in df.select("id", resolve_overlaps(F.col("spans")).alias("kept")).collect()}
    for i, spans in rows:
        assert got[i] == plain_overlaps(spans)


@pytest.mark.parametrize("piece,per_piece", [("You're right. ", 1), ("确实，你说得对，按你说的", 3), ("you're rightyou're right", 0), ("fair point，确实你说的对", None)])
def test_fifty_thousand_hits_in_one_message(spark, messages, matcher, piece, per_piece):
    few = detect(messages({"text": piece * 50}), matcher).count()
    started = time.monotonic()
    rows = detect(messages({"text": piece * 50_000}), matcher)
    found = rows.agg(F.count("*").alias("n"), F.max(F.length("snippet")).alias("width"), F.max("start").alias("last")).first()
    assert time.monotonic() - started < 30
    assert found.n == few * 1_000 and (found.n == 0 or (found.width < 300 and found.last > len(piece) * 49_000))


def test_snippets_at_the_edges_of_chunks(spark, messages, matcher):
    texts = ["é" * n + " fair point " + "ß\r\n" * m for n in (0, 1, 970, 1000, 1012, 1013, 1023, 1024, 2048) for m in (0, 5, 400)]
    hits = detect(messages(*({"text": t} for t in texts)), matcher).collect()
    assert len(hits) == len(texts)
    for h in hits:
        t = texts[int(h.msg_id)]
        first, last = max(h.start - fixed.SNIPPET_BEFORE, 0), min(h.start + h.length + fixed.SNIPPET_AFTER, len(t))
        body = re.sub(r"\r?\n+", " ", t[first:last]).strip()
        assert h.snippet == ("..." if first else "") + body + ("..." if last < len(t) else "")


def test_grams_of_one_file_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PHRASES_PER_TASK", 10)
    rows = [(i, f"phrase number {i * 7919} of {i % 3} kinds") for i in range(100)] + [(5, "again"), (None, "no number"), (7, None)]
    phrases = spark.createDataFrame(rows, "ref_no int, phrase string").coalesce(1)
    weights = similarity.tfidf_reference(phrases)
    assert weights.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    found = weights.collect()
    sums, df, tfs = {}, {}, {}
    for ref_no, phrase in rows:
        for size in fixed.NGRAM_SIZES:
            for i in range(len(phrase or "") - size + 1):
                key = (ref_no, phrase, phrase[i : i + size])
                tfs[key] = tfs.get(key, 0) + 1
    for *_, gram in tfs:
        df[gram] = df.get(gram, 0) + 1
    assert {(r.ref_no, r.phrase, r.gram): (r.tf, r.df) for r in found} == {k: (n, df[k[2]]) for k, n in tfs.items()}
    for r in found:
        sums[r.ref_no] = sums.get(r.ref_no, 0.0) + r.weight**2
    assert all(abs(r.norm**2 - sums[r.ref_no]) < 1e-6 for r in found)
    assert all(abs(r.idf - (1 + math.log((len(rows) + 1) / (r.df + 1)))) < 1e-9 for r in found)
