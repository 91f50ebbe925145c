"""Clustering, secrets and the manifest against brute force, and on rows that nobody would send."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assentlake.llm import centroids, credentials, manifest
from assentlake.llm.queries import ORACLES, QUERIES
from verification.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, leaf string, tree int, spans string, size int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "p", "l", 1, "s", 2) for r in rows], DOCS)


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["op11_centroids", "op13_manifest"])
def test_the_query_equals_its_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


# --- clustering


def plain_clusters(rows, clusters, rounds):
    v = np.array([r[1] for r in rows], object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    c = [list(v[i]) for i in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for x in v]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(c)):
            members = [x for x, k in zip(v, own) if k == j]
            if members:
                c[j] = [sum(column) // len(members) for column in zip(*members)]
    final = assign()
    out = []
    for (i, _), (d, j) in zip(rows, final):
        name = hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
        out.append((i, j, d, sum(e for e, k in final if k == j), sum(e for e, _ in final), name))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,spread,n", [(1, 3.0, 300), (2, 0.02, 200), (3, 900.0, 60), (4, 1.0, 5)])
def test_clusters_equal_plain_rounds(spark, seed, spread, n):
    draw = random.Random(seed)
    vectors = [[float(np.float32(draw.gauss(0, spread))) for _ in range(8)] for _ in range(n)]
    vectors += vectors[: n // 3]  # repeated vectors, and rows below with repeated ids
    rows = list(enumerate(vectors)) + [(0, vectors[0]), (0, vectors[1]), (None, vectors[2])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for clusters in (1, 12):
        got = centroids.cluster(table, clusters=clusters, rounds=3, dimension=8)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(whole, clusters, 3)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0], [1.0, None], [nan, 1.0], [1.0, -inf], [1.0, 2.0, 3.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(bad)]
    schema = "vec_id long, embedding array<double>, cluster string, v int"
    assert centroids.cluster(spark.createDataFrame(rows, schema), dimension=2).count() == 0
    assert centroids.cluster(spark.createDataFrame([], schema), dimension=2).count() == 0
    one = centroids.cluster(spark.createDataFrame([*rows, (9, [0.5, -0.001], "x", 1)], schema), dimension=2).collect()
    assert [tuple(r)[:5] for r in one] == [(9, 0, 0, 0, 0)]
    assert one[0].centroid_sha256 == hashlib.sha256(b"128,-1").hexdigest()
    with pytest.raises(Exception, match="a component beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 1.0], "x", 1)], schema), dimension=2).count()


def test_bounds_hold_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(5)
    for scale in (2, 300, 1 << 26):
        c = rng.integers(-scale, scale, (30, 64))
        c[7] = c[3]
        x = np.concatenate([rng.integers(-scale, scale, (500, 64)), c])
        simplex = centroids.Simplex(c)
        own = simplex.apexes(x)
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        low, high = centroids.bounds(own, simplex.apexes(c))
        assert (low <= exact).all() and (exact <= high).all()
        number, distance, compared = centroids.assign(x, own, c, simplex)
        assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert compared < exact.size
    same = centroids.Simplex(np.full((4, 64), 5))
    assert len(same.pivots) == 1 and centroids.assign(c[:2], same.apexes(c[:2]), np.full((4, 64), 5), same)[0].tolist() == [0, 0]


# --- secrets

WORDS = {"dragon": 9.0, "drag": 10.0, "monkey": 10.0, "key": 7.0, "one": 5.0, "password": 6.0, "changeme": 9.0}


def cheapest(value, per, repeats=True):
    """Every split of a value, by the same prices of spans."""
    prices = {}
    for start, end, bits in credentials.spans(value, WORDS, repeats):
        prices[start, end] = min(bits, prices.get((start, end), math.inf))

    @functools.cache
    def rest(at):
        if at == len(value):
            return 0.0
        options = []
        for end in range(at + 1, len(value) + 1):
            options.append(credentials.CHOICE + per * (end - at) + rest(end))
            if (at, end) in prices:
                options.append(prices[at, end] + rest(end))
        return min(options)

    return rest(0)


def test_the_least_cost_over_all_splits():
    draw = random.Random(6)
    parts = ["dragon", "Monkey", "key", "qwerty", "asdf", "1234", "1999", "2019-04-03", "aaaa", "abab", "x9", "$", "é", "KEY", "fE2"]
    for _ in range(400):
        value = "".join(draw.choices(parts, k=draw.randint(1, 5)))
        per = credentials.alphabet(value)
        assert credentials.guess_bits(value, WORDS) == pytest.approx(cheapest(value, per))


def test_what_is_cheap_and_what_is_not():
    def bits(value):
        return credentials.guess_bits(value, WORDS)

    for weak in ("password", "Dragon12", "qwertyuiop", "12345678", "aaaaaaaaaaaaaaaa", "abcabcabcabc", "2019-04-03", "1987monkey", "changeme", "!@#$%^&*"):
        assert bits(weak) < credentials.ENOUGH, weak
    for strong in ("kX9$vB2!mQ7z", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "q8Zr7LmN2p"):
        assert bits(strong) >= credentials.ENOUGH, strong
    assert bits("DrAgOn") > bits("Dragon") > bits("dragon")
    assert bits("") == 0


def test_spans_of_a_value_grow_with_its_length():
    draw = random.Random(7)
    for text in ("".join(draw.choices("01", k=20_000)), "asdf" * 5_000, "ab" * 10_000, "dragon" * 3_000):
        assert len(list(credentials.spans(text, WORDS))) <= 40 * len(text)


def plain_base(text):
    """The three shapes by their patterns as they are defined."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return [f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def random_texts(n):
    draw = random.Random(8)
    parts = [
        "token", "TOKEN", "Passwd", "secret", "api_key", "apikey", "paſswd", "toKen", "=", ":", " ", "  ", '"', "'", "password=secret: ", "AKIA", "AKIAAKIA",
        "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "kX9vB2mQ7z", "dragon", "é😀", "\n", "is", "bearer ", "://u:", "@h", ".", "short", "xkcdRq88Zp",
    ]
    return ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(n)]


def test_scan_equals_patterns_and_prices(spark):
    texts = [None, "", " \n\t", *random_texts(600), "token = " + "z9" * 40_000 + "Q", "word " * 30_000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(5, texts[5], None, None, None), (None, "secret=abcdefgh", None, None, None)]
    docs = documents(spark, rows)
    found = credentials.scan(docs, WORDS)
    got = sorted(((r.doc_id, r.spans, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in credentials.digests(found).collect()), key=str)
    expected = []
    for i, text, *_ in rows:
        text = text or ""
        base = plain_base(text)
        values = {m.span(1) for p in credentials.CONTEXTS for m in p.finditer(text)}
        spans = [(int(b.split(":")[1]), credentials.KINDS.index(b.split(":")[0]), int(b.split(":")[2])) for b in base]
        for start, end in {(s, s + len(text[s:e].rstrip(".:!?"))) for s, e in values}:
            if end - start >= credentials.SHORTEST and credentials.guess_bits(text[start:end], WORDS) >= credentials.ENOUGH:
                spans.append((start, 3, end))
        listed = ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        counts = [sum(b.startswith(k) for b in base) for k in credentials.KINDS[:3]]
        expected.append((i, listed, *counts, hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert any("guess" in g[1] and "assign" not in g[1] for g in got)
    assert credentials.scan(documents(spark, [])).count() == 0


def test_words_are_counted_outside_of_values(spark):
    docs = documents(spark, [(1, "The dragon, the end. token: dragonfly9 dragon", None, None, None), (2, None, None, None, None), (3, "x1the the_end ab", None, None, None)])
    counted = {r.word: r.n for r in credentials.count_words(docs).collect()}
    assert counted == {"the": 3, "dragon": 2, "end": 2, "token": 1}
    words = credentials.dictionary(docs)
    assert words["the"] == pytest.approx(math.log2(8 / 3)) and set(words) == set(counted)
    assert credentials.dictionary(documents(spark, [])) == {}


def test_the_secret_query_equals_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op12_secrets"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = plain_base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s and not s.startswith("guess")] == base


# --- manifest


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return hexed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def plain_tree(nodes):
    """(root, siblings of each leaf, the same as places to fold)."""
    paths = [[] for _ in nodes]
    groups = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, joined = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            upper.append(hexed(*run))
            joined.append([i for g in groups[at : at + 8] for i in g])
        nodes, groups = upper, joined
    return nodes[0], paths


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault("0" if row[2] is None else "1" + row[2], []).append((row, plain_leaf(row, row[1])))
    names = sorted(trees, key=lambda n: n.encode())
    parts = {}
    for name in names:
        trees[name].sort(key=lambda e: (e[0][0] is not None, e[0][0] or 0, e[1]))
        parts[name] = plain_tree([leaf for _, leaf in trees[name]])
    root, tops = plain_tree([parts[n][0] for n in names])
    out = []
    for name, top in zip(names, tops):
        for (row, leaf), path in zip(trees[name], parts[name][1]):
            path = path + top
            value = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                value = plain_leaf(row, "".join(c.lower() if c.isascii() else c for c in row[1]))
            for before, after in path:
                value = hexed(*before, value, *after)
            proof = hexed(*(s for before, after in path for s in before + after))
            out.append((row[0], leaf, parts[name][0], root, proof, value, value == root))
    return sorted(out, key=str)


def proved(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower, with_witness=True)
    got = rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "witness").collect()
    for r in got:
        # The witness itself leads from the leaf to the root, whatever was found later.
        witness = manifest.unpack(r.witness)
        assert manifest.fold(bytes.fromhex(r.leaf), witness).hex() == r.root
        assert manifest.proof_digest(witness) == r.proof_sha256
    return sorted((tuple(r)[:7] for r in got), key=str)


@pytest.mark.parametrize("sizes", [(1,), (8, 1, 9), (64, 65, 2), (511, 512, 513, 1, 1, 1, 1, 1, 1), (4_097, 1)])
def test_manifest_equals_plain_trees(spark, sizes):
    draw = random.Random(len(sizes))
    rows = []
    for k, size in enumerate(sizes):
        lang = None if k == 1 else ["", "é", "a", "😀", "b", "￮", "ab", "z", "zz"][k]
        for i in range(size):
            text = draw.choice([None, "", "abc", "Mixed É", f"T {i}", "É"])
            rows.append((draw.randint(0, 10**6), text, lang, draw.choice([None, "s"]), draw.choice([None, 3])))
    draw.shuffle(rows)
    assert proved(documents(spark, rows)) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    # repeated rows, null ids, a null for every field, a long text, one id with different texts
    rows = [(1, "A", "x", "s", 1)] * 30 + [(None, None, None, None, None)] * 9 + [(None, "B", "x", None, None), (2, "Word " * 50_000, "x", "s", None)]
    rows += [(3, t, "x", "s", 1) for t in ("A", "a", "", None, "-", "1:A")]
    assert proved(documents(spark, rows)) == plain_manifest(rows)
    assert proved(documents(spark, [])) == []


def test_appender_keeps_whole_and_partial_blocks():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 511, 512):
        values = [hashlib.sha256(bytes([i % 251, n % 251])).digest() for i in range(n)]
        alone = manifest.Appender(full=False)
        witnesses = [alone.append(v) for v in values]
        root, paths = plain_tree([v.hex() for v in values])
        assert alone.root().hex() == root
        assert [[len(o) for _, o in w] for w in witnesses] == [[len(a) + len(b) for a, b in p] for p in paths]
        part = manifest.Appender(full=True)
        witnesses = [part.append(v) for v in values]
        root = part.root()
        assert all(len(w) == manifest.LEVELS and manifest.fold(v, w) == root for v, w in zip(values, witnesses))
    assert manifest.Appender(full=False).root() is None
