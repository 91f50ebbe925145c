"""The training-data operators against brute force, and on rows that nobody would send."""

import collections
import hashlib
import math
import random
import time
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assentlake.llm import byte_bpe, chat, components, licenses, minhash, neighbours, packing, pages, quality, quality_rules, toxicity
from assentlake.llm.common import vocabulary_path
from assentlake.llm.queries import ORACLES, PIECE_PATTERN, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, key int, kept string"


def table(spark, texts, ids=None):
    rows = [(i, t, None, None, None, "s", "i", 1, "k") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, and columns with clashing names."""
    return table(spark, [None, "", " \n\t", "word " * 30_000, "a b c d", "a b c d", "x", "é😀 'tis 12%"], [1, 2, 3, 4, 5, 5, None, 7])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_byte_bpe_equals_the_library(spark, odd, empty):
    import tiktoken

    path = vocabulary_path("byte_bpe_50k.tiktoken")
    tokens, parts = byte_bpe.vocabulary(path)
    own = byte_bpe.Codec(tokens, parts, PIECE_PATTERN)
    other = tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    draw = random.Random(4)
    letters = ["a", "b", "the", "th", "é", "ß", "汉", "😀", " ", "  ", "\n", "1", "22", "!", "'s", "ing", "zz", "\x00"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(2_000)] + ["a" * 20_000, "ab" * 9_000, " " * 3_000]
    for text in texts:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    rows = byte_bpe.round_trip(odd, path, PIECE_PATTERN).collect()
    assert len(rows) == odd.count()
    for row, text in zip(rows, (r.text or "" for r in odd.collect())):
        ids = other.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(odd, path, PIECE_PATTERN)
    assert sorted(bytes(r.bytes) for r in byte_bpe.decode(encoded, path, PIECE_PATTERN).collect()) == sorted((r.text or "").encode() for r in odd.collect())
    assert byte_bpe.round_trip(empty, path, PIECE_PATTERN).count() == 0


def test_tokenized_pieces_equal_the_library(spark, odd):
    import numpy as np
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    draw = random.Random(5)
    letters = ["Ab", "é", "É", "ß", "İ", "Σ", "汉", "😀", " ", "\n", "\x1c", "\x85", " ", "1", "22", "!", "'s", "'", "***", "word", "_", "<|endoftext|>", "é", "ª"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 20))) for _ in range(2_000)]
    own = packing.ChunkTokenizer(open(path, encoding="utf-8").read())
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    pieces = packing.tokenized_pieces(odd, path).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert sum(p.length for p in by_doc[4]) == 30_001 and max(p.length for p in pieces) == 4096
    assert [p.length for p in by_doc[1]] == [1] and by_doc[1][0].ids_crc32 == zlib.crc32((1).to_bytes(4, "little"))


def test_new_words_reach_the_library_in_few_strings(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    own, whole = packing.ChunkTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    sent = []
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda texts, how: sent.extend(texts) or encode(texts, how))
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefgé", k=9)) + draw.choice(["", ".", ",\""]) for _ in range(500)) for _ in range(4)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
    assert len(sent) < 20


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    path = vocabulary_path("word_bpe_49k.json")
    own = packing.ChunkTokenizer(open(path, encoding="utf-8").read())
    first = own.encode(["often seen."])
    for n in range(20):
        assert own.encode(["often seen. " + " ".join(f"w{chr(97 + n)}{chr(97 + k)}" for k in range(10))])[0].startswith(first[0])
        assert "often" in own.chunks.young and len(own.chunks.young) + len(own.chunks.old) <= 60


def test_parts_are_remembered_and_not_their_combinations():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    own, whole = packing.ChunkTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    words, marks = ["one", "Two", "ÉTÉ", "four"], ["", ".", ",", "!?", '"', ")"]
    texts = [" ".join(w + m for w in words for m in marks), None, "", " x\u0301 É\u0301. H\u0331 ", "a\x1cb one."]
    # A slice of a longer array: the offsets do not start at 0.
    for text, ids in zip(texts, own.encode(pa.array(["before", *texts]).slice(1))):
        assert ids == b"".join(i.to_bytes(4, "little") for i in whole.encode(text or "", add_special_tokens=False).ids)
    # Four words, five marks, a letter and what is no plain chunk: not 24 combinations beside them.
    assert len(own.chunks.young) + len(own.chunks.old) <= len(words) + len(marks) + 4


def test_a_worker_is_trimmed_before_and_after_its_rows(monkeypatch):
    from assentlake.llm import common

    seen = []
    monkeypatch.setattr(common, "trim_worker", lambda: seen.append("trim"))
    assert list(common.trimmed(lambda batches: (seen.append(b) or b for b in batches))([1, 2])) == [1, 2]
    assert seen == ["trim", 1, 2, "trim"]


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_gapless_and_tight(spark, seed):
    draw = random.Random(seed)
    kinds = (lambda: draw.randint(1, 64), lambda: int(draw.lognormvariate(3, 1)) % 64 + 1, lambda: draw.choice((7, 33)), lambda: draw.choice((22, 43, 64)))
    sizes = [kinds[seed]() for _ in range((300, 1, 500, 200)[seed])]
    items = spark.createDataFrame([("x", s, "c") for s in sizes], "id string, length int, sequence_id string")
    rows = packing.pack(items, capacity=64).select("length", "sequence_id", "offset").collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    filled = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 64
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= s]
        if fits:
            at = min(fits, key=lambda i: bins[i])
            bins[at] -= s
        else:
            bins.append(64 - s)
    assert len(filled) <= len(bins) * 1.02 + 1


def test_packing_of_nothing(spark):
    items = spark.createDataFrame([], "doc_id long, length long")
    assert packing.pack(items).columns == ["doc_id", "length", "sequence_id", "offset"] and packing.pack(items).count() == 0


def test_chat_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "&lt;s> &amp; <s>", None, "<|turn|>", "a\nb </s>\n", "<", "[INST", "/s>", "", "&#91;"]
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "<s>[INST]"]), draw.choice(nasty)) for c in range(60) for t in range(draw.randint(1, 9))]
    rows += [(900, 1, "user", "same")] * 2 + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    chats = chat.format_chats(turns)
    for r in chats.withColumn("read", chat.read_turns(F.col("formatted"))).collect():
        own = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.read] == [(role, x) for _, role, x in own]
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    for c in range(60):
        learnt = "".join(x or "" for k, _, role, x in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]) if role == "assistant")
        assert back[c].loss_chars == len(learnt) and back[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert back[900].n_turns == 2 and back[None].n_turns == 1
    assert chat.format_chats(turns.limit(0)).count() == 0


def near(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(7)
    texts = []
    for _ in range(25):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(1, 160))]
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 5)):  # chains of copies of copies
            words = [w if draw.random() > 0.03 else "new" for w in words]
            texts.append(" ".join(words).upper() if draw.random() < 0.2 else "  ".join(words))
    texts += [None, "", " \n", "one", "one", "one two", "ONE  two"]
    rows = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts), 3, 85).collect()}
    component, size = near(texts, 3, 85)
    assert [rows[i].component_id for i in range(len(texts))] == component
    assert [rows[i].n_shingles for i in range(len(texts))] == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_sketches_pass_every_link(spark):
    """Pairs at exactly the similarity asked for, whose sketches say far less because of their parts."""
    import numpy as np

    own, draw, rows = minhash.Shingler(3), np.random.default_rng(18), []
    with np.errstate(over="ignore"):
        for common, union, percent, pairs in ((8, 10, 80, 1500), (12, 15, 80, 1500), (60, 75, 80, 500), (12, 14, 85, 500), (120, 150, 80, 500)):
            for _ in range(pairs):
                h = draw.integers(0, 1 << 64, size=union, dtype=np.uint64)
                extra = (union - common) // 2
                sets = [np.sort(np.concatenate((h[:common], h[common:][part]))) for part in (slice(0, extra), slice(extra, None))]
                rows.append((percent, *(v for s in sets for v in (len(s), own.sketch(own.samples(s))))))
    frame = spark.createDataFrame(rows, "percent int, x_n long, x_sketch array<long>, y_n long, y_sketch array<long>")
    for percent in (80, 85):
        # Pairs below the similarity by their sizes alone are no links.
        asked = frame.where((F.col("percent") == percent) & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")))
        assert asked.count() >= 500 and asked.where(~minhash.promising("x", "y", percent)).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 8 and [r.component_id for r in rows if r.doc_id == 5] == [5, 5]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    draw = random.Random(8)
    order = list(range(200))
    draw.shuffle(order)
    edges = list(zip(order, order[1:60])) + [(order[70], x) for x in order[71:100]] + [(5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for group in (order[:60], order[70:100]):
        assert {found.get(x, x) for x in group} == {min(group)}


def test_quality_rules_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for d in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(windows)
        again = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines = [x for x in (d.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(d.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)
        )
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_distances_equal_linear_algebra(spark):
    """The distance of the estimates is that of the covariance they come from."""
    import numpy as np

    draw = np.random.default_rng(9)
    x = draw.normal(size=(400, 5)) @ draw.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    d = [r.d for r in quality_rules._measured(rows, quality_rules._estimate(rows)).collect()]
    share = 400 / (400 + quality_rules.PRIOR_ROWS)
    cov = np.cov(x.T, bias=True) * share + np.diag(np.square(quality_rules.FLOORS))
    z = x - x.mean(0)
    assert np.allclose(sorted(d), sorted(np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))), rtol=1e-6)


def test_outliers_are_rejected_and_ordinary_documents_stay(spark, odd, empty):
    draw = random.Random(10)
    plain = [" ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(draw.randint(60, 300))) for _ in range(120)]
    junk = [" ".join("".join(draw.choices("abcdefghij", k=4)) + "$$$" for _ in range(100)) for _ in range(12)]
    rows = {r.doc_id: r.kept for r in quality_rules.judge(table(spark, plain + junk)).collect()}
    assert sum(rows[i] for i in range(120)) >= 119 and not any(rows[i] for i in range(120, 132))
    assert len(quality_rules.judge(odd).collect()) == 8 and quality_rules.judge(empty).count() == 0


def test_a_tenth_of_symbols_is_an_outlier_where_others_have_none(spark):
    """Symbols of one character in ten, in groups of several sizes whose other texts have none."""
    draw = random.Random(16)

    def text(mark):
        words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(draw.randint(60, 300))]
        return " ".join(w + "|" if mark and i % 10 < 6 else w for i, w in enumerate(words))

    rows = [(1000 * g + i, text(i < n // 12), "x", str(g)) for g, n in enumerate((200, 60, 36)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    marked = [d for d, t, _, _ in rows if "|" in t]
    assert len(marked) == 24 and not any(kept[d] for d in marked)
    assert sum(kept[d] for d, t, _, _ in rows if "|" not in t) >= 0.98 * (len(rows) - len(marked))


def test_outliers_against_a_plain_minimum_covariance_determinant(spark):
    """Verdicts on two groups against many random starts, each run until it no longer changes."""
    import numpy as np

    draw = np.random.default_rng(31)
    groups, variances = {}, dict.fromkeys(quality_rules.VARIANCES, 0.0)
    for name, n in (("a", 600), ("b", 400)):
        mix = draw.normal(size=(5, 5)) * 0.15 + np.eye(5) * 0.3
        x = 6 + draw.normal(size=(n, 5)) @ mix
        x[: n // 6] += draw.choice([2.0, 300.0], size=(n // 6, 1)) * np.array([1.0, 0, 2, 1, 0])  # some of them very far
        groups[name] = x
    rows = [(g, i, *map(float, v), *variances.values()) for g, x in groups.items() for i, v in enumerate(x)]
    columns = ["g string", "i int", *(f"{c} double" for c in (*quality_rules.FEATURES, *variances))]
    frame = spark.createDataFrame(rows, ", ".join(columns))
    estimates = quality_rules.robust_estimates(frame.drop("i"))
    squared = quality_rules._distance() / F.col("scale")
    judged = {(r.g, r.i): r.d for r in frame.join(estimates, "g").select("g", "i", squared.alias("d")).collect()}

    def plain(x, target=None):
        best = None
        for _ in range(40):
            core = x[draw.choice(len(x), 12, replace=False)]
            for _ in range(60):
                centre, spread = core.mean(0), np.cov(core.T, bias=True)
                if target is not None:
                    share = len(core) / (len(core) + quality_rules.PRIOR_ROWS)
                    spread = spread * share + target * (1 - share)
                spread = spread + np.diag(np.square(quality_rules.FLOORS))
                d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread), x - centre)
                core = x[np.argsort(d, kind="stable")[: int(quality_rules.COMPACT * len(x))]]
            if best is None or np.linalg.slogdet(spread)[1] < best[0]:
                best = np.linalg.slogdet(spread)[1], d, np.cov(core.T, bias=True)
        return best[1:]

    cores = [plain(x)[1] for x in groups.values()]
    pooled = sum(c * len(x) for c, x in zip(cores, groups.values())) / sum(map(len, groups.values()))
    for name, x in groups.items():
        d = plain(x, pooled)[0]
        d = d / max(np.median(d) / quality_rules.CHI_MEDIAN, 1.0)
        for i, own in enumerate(d):
            if abs(own / quality_rules.CHI_LIMIT - 1) > 0.2:
                assert (judged[name, i] <= quality_rules.CHI_LIMIT) == (own <= quality_rules.CHI_LIMIT), (name, i)
        assert (d[: len(x) // 6] > quality_rules.CHI_LIMIT).mean() > 0.9


@pytest.mark.parametrize("values", [[0.0, 0.1, 0.1, 31.9, 32.0, 40.0, 1e6, 1e12], [5.0]])
def test_quantiles_of_any_size(spark, values):
    rows = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    shares = {f"q{k}": k / 8 for k in range(1, 9)}
    found = quality_rules._quantiles(rows, ["g"], "x", shares).first()
    for k in range(1, 9):
        exact = sorted(values)[math.ceil(k / 8 * len(values)) - 1]
        assert found[f"q{k}"] == pytest.approx(exact, rel=0.004, abs=0.004)


def test_license_places(spark, odd, empty):
    texts = ["The MIT License. mit-license, MIT LICENSE", "under CC BY 4.0 or Apache  License", "GNU General Public\nLicense", "no licence", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 1, 5, "mit")
    assert rows[1].base_labels == "apache,cc-by" and (rows[1].first_word, rows[1].last_word) == (1, 6)
    assert rows[2].base_labels == "gpl" and rows[3].labels == "" and rows[3].first_word is None
    assert rows[4].base_labels == "" and rows[4].labels == "mit" and rows[4].score == 1.0
    draw = random.Random(11)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "x1"]
    texts = [draw.choice([" ", "-", "."]).join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(300)]
    for r in licenses.scan(table(spark, texts)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id])
        at = [(i, l) for p, l in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({l for _, l in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
    assert licenses.scan(odd).count() == 8 and licenses.scan(empty).count() == 0


@pytest.mark.parametrize("gap", [0, 3, 400])
def test_all_license_texts_in_one_file(spark, gap):
    """Every text that stands there word for word has its label, however many there are."""
    filler = " the of and to in software license public any terms with work " * gap
    draw = random.Random(17)
    orders = [draw.sample(licenses.TEMPLATES, k=len(licenses.TEMPLATES)) for _ in range(4)]
    orders += [draw.sample(licenses.TEMPLATES, k=k) for k in (2, 3, 4, 5, 8) for _ in range(6)]
    texts = [filler.join(f" {text} . " for _, text, _ in order) for order in orders]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, order in enumerate(orders):
        assert {label for label, _, _ in order} <= set(rows[i].labels.split(",")) and rows[i].score == 1.0


def test_license_index_against_comparing_at_every_place():
    """Whatever words are looked up, the same labels and shares as by comparing everywhere."""
    draw = random.Random(23)
    vocabulary = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.encode().split()})
    found = 0
    for turn in range(60):
        index = licenses.Index(licenses.TEMPLATES, {w: draw.randrange(100) for w in vocabulary})
        words = draw.choices(vocabulary, k=draw.randrange(40))
        for _, text, _ in draw.sample(licenses.TEMPLATES, k=3):
            for w in text.encode().split():
                change = draw.random()
                words += [] if change < 0.1 else [b"other"] if change < 0.25 else [b"added", w] if change < 0.28 else [w]
        labels, best = set(), 0.0
        for label, template, keys, _ in index.templates:
            shares = [index.share(words, template, keys, s) for s in range(-len(template), len(words) + 1)]
            if max(shares):
                labels.add(label)
                best = max(best, max(shares))
        assert index.find(words) == (labels, best), turn
        found += len(labels)
    assert found >= 30


def test_changed_and_short_license_texts(spark):
    texts = [
        "Permission is hereby granted, without charge, to any person obtaining a copy of this software and its documentation files",
        "GNU Affero General Public License version 3",
        "Distributed under the Boost Software License, Version 1.0.",
        "We granted any person the rights to merge and to publish a copy of the notice without charge.",
    ]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    assert [rows[i].labels for i in range(4)] == ["mit", "agpl", "boost", ""]
    assert all(not rows[i].base_labels and (0 < rows[i].score <= 1) == (i < 3) for i in range(4))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<div class="cookie-notice"><p>We use cookies</p></div><nav><ul><li><a href="/">Home</a></ul></nav><form>Name <input></form>
<%s><h1>A &amp; B</h1><p>One<br>two <b>three</b> &eacute;<p>Four <a href=x>link</a>.<div class="ad">Buy</div><p>Last</p></%s>
<section id="comments"><article><p>Nice post</p></article></section><aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    own = "A & B\nOne two three é\nFour link.\nLast"
    rows = [(i, f"http://h.example/a/{i}", PAGE % ("article", "article"), "x") for i in range(2)]
    # Without an article element the neighbour tells what is common.
    rows += [(10 + i, f"http://k.example/b/{i}", f"<div>Welcome to K</div><div>Text {i}</div><p>All rights</p>", "x") for i in range(3)]
    rows += [(20, None, "<p>alone", "x"), (21, "http://z/", None, "x"), (22, "http://z/1", "", "x"), (None, "http://q/", "<p>a &lt;b&gt; c", "x"), (20, None, "<p>alone", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = collections.defaultdict(list)
    for r in pages.extract(frame).collect():
        out[r.page_id].append(r.text)
    assert out[0] == out[1] == [own]
    assert [out[10 + i] for i in range(3)] == [["Text 0"], ["Text 1"], ["Text 2"]]
    assert out[20] == ["alone", "alone"] and out[21] == out[22] == [""] and out[None] == ["a <b> c"]
    assert pages.extract(frame.limit(0)).count() == 0


def test_pages_without_shared_lines_stay_where_they_were_read(spark):
    rows = spark.createDataFrame([(i, f"https://h.example/{i}", f"<article><p>Text {i}</p></article>") for i in range(20)], "page_id long, url string, html string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = pages.extract(rows)
        assert "SortMergeJoin" not in texts._jdf.queryExecution().executedPlan().toString()
        assert {r.page_id: r.text for r in texts.collect()} == {i: f"Text {i}" for i in range(20)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_pages_with_shared_lines_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(pages, "SENT_PLACES", most)
    rows = spark.createDataFrame([(i, f"https://h.example/{i}", f"<p>Shared</p><p>Text {i}</p>") for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(rows).collect()} == {i: f"Text {i}" for i in range(6)}


def test_common_subsequence():
    draw = random.Random(12)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(500):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 12))] for _ in range(2))
        found, rest = pages.shared(a, b), iter(b)
        assert len(found) == longest(a, b) and all(any(y == a[i] for y in rest) for i in found)


def test_common_subsequence_in_halves(monkeypatch):
    """Tables that are cut in halves give as long a subsequence as whole ones."""
    draw = random.Random(13)
    cases = [tuple([draw.randint(0, 4) for _ in range(draw.randint(0, 60))] for _ in range(2)) for _ in range(200)]
    whole = [len(pages.shared(a, b)) for a, b in cases]
    monkeypatch.setattr(pages, "TABLE_BITS", 20)
    for (a, b), n in zip(cases, whole):
        found, rest = pages.shared(a, b), iter(b)
        assert found == sorted(set(found)) and len(found) == n and all(any(y == a[i] for y in rest) for i in found)


@pytest.mark.parametrize("html, text", [
    ('<div class="wrap has-sidebar"><article><p>Text one', "Text one"),
    ('<article class="post header-image"><p>Text two</article><div class="sidebar">More', "Text two"),
    ("<form><div class=menu><p>The whole body of the page</div></form>", "The whole body of the page"),
    ('<p><a title="x > y">link</a>', "link"),
    ("<p title=it's>a <b title='>'>b</b>", "a b"),
    ('<script>if (a<b && c="</script><p>after', "after"),
    ("<aside><article>Teaser of another page, much longer than this one</article></aside><article>Own</article>", "Own"),
    ("<main><article>Own<section class=comments><article>A very long comment, longer than all</article></section></article></main>", "Own"),
])
def test_markup_that_misleads(html, text):
    assert "\n".join(t for _, t in pages.own_lines(pages.blocks(html))) == text


@pytest.mark.parametrize("html", ["<svg>", '<p a="', "<div>", "<a b=", "<!--", "<", "</p>", "<p ='"])
def test_long_broken_pages_take_linear_time(html):
    start = time.monotonic()
    pages.blocks(html * 100_000 + "</p>" * 100_000)
    assert time.monotonic() - start < 10


def test_lines_shared_with_the_nearest_page(spark):
    """The whole operator against a plain pairing by path and a plain alignment."""
    draw = random.Random(29)
    rows = []
    for i in range(40):
        host, path = draw.choice(["a", "b", "c"]), "/".join(draw.choice("xyz") for _ in range(3)) + f"/{i}"
        lines = [draw.choice([f"menu {host}", "news", "about", f"own {i}", f"own {i} {draw.random()}"]) for _ in range(6)]
        body = f"<article><p>news<p>text {i}</article>" if i % 3 == 0 else ""
        rows.append((i, f"http://{host}.example/{path}?q=1", "".join(f"<div>{x}</div>" for x in lines) + body, lines, path, host, bool(body)))
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    out = {r.page_id: r.text.split("\n") if r.text else [] for r in pages.extract(frame).collect()}
    for i, _, _, lines, path, host, article in rows:
        order = sorted((r[4], r[0]) for r in rows if r[5] == host)
        at = order.index((path, i))
        near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        agree = [next((k for k, (x, y) in enumerate(zip("/" + path, "/" + p)) if x != y), min(len(path), len(p)) + 1) for p, _ in near]
        inside = ["news", f"text {i}"] if article else []
        results = []
        for k in (k for k in range(len(near)) if agree[k] == max(agree)):
            other = rows[near[k][1]]
            theirs = other[3] + (["news", f"text {other[0]}"] if other[6] else [])
            mine = lines + inside
            gone = set(pages.shared([hash(x) for x in mine], [hash(x) for x in theirs]))
            results.append([x for j, x in enumerate(mine) if j not in gone or j >= len(lines)])
        assert out[i] in results, i


@pytest.mark.parametrize("radius", [0, 7, 15, 16, 37, 55, 127, 128])
def test_buckets_hold_every_code_within_the_radius(radius):
    import numpy as np

    draw = np.random.default_rng(radius)
    codes = draw.integers(0, 256, (400, neighbours.BITS // 8), dtype=np.uint8)
    codes[100:200] = codes[:100] ^ (draw.random((100, codes.shape[1])) < 0.2)  # near ones too
    buckets = neighbours.Buckets(codes)
    for code in codes[::10]:
        found, read = buckets.within(code, radius)
        plain = np.flatnonzero(np.unpackbits(codes ^ code, axis=1).sum(axis=1) <= radius)
        assert found.tolist() == plain.tolist() and len(found) <= read


def test_neighbours(spark):
    import numpy as np

    draw = np.random.default_rng(13)
    x = draw.normal(size=(900, 16)).astype(np.float32)
    x[200:500] = x[0]  # a third of all rows is one vector
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(x)]
    rows += [(2_000, None, ""), (2_050, [0.0] * 16, ""), (2_100, [float("nan")] * 16, ""), (2_150, [1.0, None] * 8, ""), (2_200, [1.0], ""), (None, [1.0] * 16, ""), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    found = collections.defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    assert sorted(found) == list(range(0, 900, 50))
    for q, got in found.items():
        cos = unit @ unit[q]
        cos[q] = -9
        best = np.lexsort((np.arange(900), -np.round(cos, 9)))[:5]
        assert [r for r, _, _ in sorted(got)] == [1, 2, 3, 4, 5] and all(abs(s - cos[v]) < 1e-9 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(best.tolist()))
        if np.array_equal(x[q], x[0]):
            assert [v for _, v, _ in sorted(got)] == best.tolist()
    assert hits >= 0.9 * 5 * len(found)
    few = neighbours.nearest(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_quality_separates_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(held_out(r.doc_id) for r in rows) and len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_pairs_of_the_machine_equal_their_sum():
    import numpy as np

    draw = np.random.default_rng(14)
    n = len(quality.STATISTICS)
    v, w = draw.normal(size=(n + 5, 3)), draw.normal(size=n + 5)
    x = draw.normal(size=n + 5)
    model = (np.zeros(n), np.full(n, 0.5), 0.1, w, v)
    z = x.copy()
    z[:n] = np.clip(x[:n] / 0.5, -4, 4) / 2
    direct = 0.1 + w @ z + sum(v[i] @ v[j] * z[i] * z[j] for i in range(n + 5) for j in range(i))
    assert math.isclose(quality.score_rows(model, [(np.arange(n + 5), x)])[0], 1 / (1 + math.exp(-min(max(direct, -30), 30))), rel_tol=1e-9)


def test_toxicity_of_disguised_words(spark):
    draw = random.Random(15)
    calm = [f"{draw.choice(['calm', 'green', 'table'])}{draw.randint(0, 99)}" for _ in range(300)]
    bad = ["idiot", "moron", "scum"]
    texts, rows = [], []
    for i in range(300):
        words = draw.choices(calm, k=40)
        if i % 3 == 0:
            words[draw.randrange(40)] = draw.choice(bad)
            words[draw.randrange(40)] = draw.choice(bad)
        texts.append(" ".join(words))
        rows.append((i, 1, int(i % 3 == 0)))
    docs = table(spark, texts)
    model = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    asked = table(spark, ["you 1d10t m0r0n", "You ІDІОT, what an Ïdiót", "calm1 green2 table3 " * 10, "", None, "ｍｏｒｏｎ scуm"])
    scores = [r.predicted for r in toxicity.score(asked, model).collect()]
    assert scores[:5] == [1, 1, 0, 0, 0]
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(rows[i].predicted == (i % 3 == 0) for i in range(300)) >= 290
    assert all(r.held_out == held_out(r.doc_id) for r in rows.values())


def test_an_exception_phrase_covers_its_entry():
    matcher = toxicity.Matcher({"cru": 2.0, "hit ": 1.0}, ["hit song"])
    assert matcher.hits("a hit song".split()) == {} and len(matcher.hits("hit him crudely".split())) == 2


def test_hits_against_a_plain_search():
    draw = random.Random(5)
    stems = ["cru", "hit ", "crude ", "so"]
    phrases = ["hit song", "song hit", "crude hit", "hit hit"]
    matcher = toxicity.Matcher({t: 1.0 + i for i, t in enumerate(stems)}, phrases)
    for _ in range(300):
        words = [draw.choice(["hit", "song", "crude", "crudely", "zz", "hits"]) for _ in range(draw.randrange(12))]
        text, starts = " ".join(words) + " ", [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
        gone = {i + d for i in range(len(words) - 1) for d in (0, 1) if " ".join(words[i : i + 2]) in phrases}
        plain = [max((1.0 + k for k, t in enumerate(stems) if text.startswith(t, at)), default=0) for at in starts]
        assert list(matcher.hits(words).values()) == [w for i, w in enumerate(plain) if w and i not in gone], words


def test_hits_of_a_very_long_text_take_linear_time():
    matcher = toxicity.Matcher({"hit ": 1.0}, ["hit song"])
    start = time.monotonic()
    assert len(matcher.hits("hit song zz hit".split() * 50_000)) == 50_000
    assert time.monotonic() - start < 10


def test_classifiers_on_odd_rows(odd, empty, labels):
    for operator in (quality, toxicity):
        learn, score = (operator.train, operator.classify) if operator is quality else (operator.learn, operator.score)
        for docs, n in ((odd, 8), (empty, 0)):
            rows = score(docs, learn(docs, labels)).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        keep = quality.keep_good if operator is quality else toxicity.keep_clean
        assert keep(odd, labels).columns == odd.columns and keep(empty, labels).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, name):
    from verification.compare import connect, difference

    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        after = {r.doc_id for r in rows}
        assert after <= before and len(after) == len(rows), name
        if name == "near duplicates":
            ids = sorted(before)
            texts = {r.doc_id: r.text for r in docs.collect()}
            component, _ = near([texts[i] for i in ids], 5, 80)
            assert after == {ids[i] for i in set(component)}
        docs, before = spark.createDataFrame(rows, docs.schema), after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == before


def test_similar_sets_share_a_rare_shingle(spark):
    """The filter on the rarest shingles against all pairs, at the similarity and just below it."""
    draw = random.Random(31)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        words = list(base[: draw.choice([119, 120])])
        for _ in range(draw.choice([0, 1, 2, 3, 5])):
            words[draw.randrange(len(words))] = f"new{k}-{draw.randint(0, 3)}"
        texts.append(" ".join(words))
    texts = sorted(set(texts)) + [" ".join(f"x{i % 7}{i}" for i in range(n)) for n in (1, 2, 3, 4)]
    docs = table(spark, texts)
    sets = {r.doc_id: set(r.hashes) for r in minhash._sets(docs, docs.select("doc_id").distinct(), 3).collect()}
    for percent in (80, 85):
        similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        alone = docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("component"))
        found = {tuple(r) for r in minhash._across(docs, alone, 3, percent).collect()}
        assert similar <= found and len(similar) > 50 and len(found) < len(sets) * (len(sets) - 1) // 2
        pairs = docs.select(F.col("doc_id").alias("rep"), (F.col("doc_id") % 2).alias("component"))
        assert {p for p in similar if (p[0] - p[1]) % 2} <= {tuple(r) for r in minhash._across(docs, pairs, 3, percent).collect()}
