"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, rotated so that signs lose least (iterative quantisation,
Gong and Lazebnik, 2011), one bit for each rotated component. A code is split into substrings,
each an index of its own: the codes sorted by that substring, with the place where each value begins.
Codes that differ in at most R = m r + a of their bits differ in at most r bits in one of the first
a + 1 of m substrings, or in at most r - 1 bits in one of the others (Norouzi, Punjani and Fleet,
2014). Looking up the values that near in every index thus finds every code within R; no other
code is read. Those found are compared in full, and what stays is ranked by the original vectors.
R is taken from a bounded sample, such that nearly all true neighbours lie within it; queries
that find too few neighbours are compared with everything.

The queries are dealt against the indexed vectors in blocks of bounded size. Equal vectors are
indexed once, with the few smallest of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake.llm.common import slices
from assentlake.session import staged

BITS, SUBSTRINGS = 128, 16
#: Vectors that the rotation and the radius are learnt from, and those of them used as queries.
SAMPLE, PROBES = 10_000, 400
#: Share of the sample's true neighbours that must lie within the radius.
WITHIN = 0.985
INDEX_BLOCK, QUERY_BLOCK = 32_768, 1_024
PIECES = 32


def _prepared(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id, key (of the vector), raw (its doubles) of the vectors that take part."""

    def run(batches) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for part in slices(batches):
            ids, keys, raws = [], [], []
            for vec_id, vector in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if vec_id is None or not vector or (dimension and len(vector) != dimension) or None in vector:
                    continue
                x = np.array(vector, np.float64) + 0.0  # one zero only
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = x.tobytes()
                ids.append(vec_id), keys.append(hashlib.blake2b(raw, digest_size=16).digest()), raws.append(raw)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "key", "raw"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, key binary, raw binary")


def _unit(x):
    import numpy as np

    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps huge and tiny vectors finite
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(raws, model):
    """Codes, a row of bytes for each vector."""
    import numpy as np

    mean, rotation, _ = model
    x = _unit(np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1))
    return np.packbits((x - mean) @ rotation >= 0, axis=1)


def learn(sample, k: int, seed: int = 11):
    """(mean, rotation, radius) from rows of doubles."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = _unit(sample)
    d = x.shape[1]
    mean = x.mean(axis=0)
    z = x - mean
    parts = []
    while sum(p.shape[1] for p in parts) < BITS:
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(25):
            signs = np.where(z @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(z.T @ signs)
            turn = u @ v
        parts.append(turn)
    rotation = np.concatenate(parts, axis=1)[:, :BITS]
    model = (mean, rotation, BITS)
    codes = encode([row.tobytes() for row in sample], model)
    seen = []
    for i in rng.permutation(len(x))[:PROBES]:
        near = x @ x[i]
        near[i] = -2
        best = np.argsort(-near)[: min(k, len(x) - 1)]
        seen.append(np.bitwise_count(codes[best] ^ codes[i]).sum(axis=1))
    distances = np.concatenate(seen) if seen else np.array([BITS])
    radius = int(np.quantile(distances, WITHIN)) if len(distances) else BITS
    return mean, rotation, radius


class Buckets:
    """An index for each substring of some codes: buckets of the codes that hold a value there."""

    def __init__(self, codes):
        import numpy as np

        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable").astype(np.int32) for s in range(SUBSTRINGS)]
        self.starts = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]
        self.sizes = [np.diff(starts) for starts in self.starts]
        values = np.arange(256, dtype=np.uint8)
        self.apart = np.bitwise_count(values[:, None] ^ values[None, :])

    def within(self, code, radius: int):
        """Places of all codes within the radius, and how many codes the probed buckets hold."""
        import numpy as np

        near, more = divmod(radius, SUBSTRINGS)
        seen = np.zeros(len(self.codes), bool)
        for s, value in enumerate(code):
            reach = near if s <= more else near - 1
            probes = np.flatnonzero(self.apart[value] <= reach) if reach >= 0 else []
            if not len(probes):
                continue
            starts, sizes = self.starts[s][probes], self.sizes[s][probes]
            # The places of all these buckets behind each other.
            shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
            seen[self.order[s][shift + np.arange(len(shift))]] = True
        found = np.flatnonzero(seen)
        distance = np.bitwise_count(self.codes.view(np.uint64)[found] ^ code.view(np.uint64)).sum(axis=1)
        return found[distance <= radius], len(found)


def _search(index, queries, radius: int, k: int):
    """Rows (query key, place in index, score) of the best k of each query within the radius."""
    import numpy as np

    codes, ids, raw = index
    buckets = Buckets(codes)
    norms = np.linalg.norm(raw, axis=1)
    out = []
    for at, (code, q) in enumerate(zip(*queries)):
        mine, _ = buckets.within(code, radius)
        if not len(mine):
            continue
        score = raw[mine] @ q / (norms[mine] * np.linalg.norm(q))
        if len(mine) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            chosen = np.flatnonzero(score >= edge)
        else:
            chosen = np.arange(len(mine))
        order = chosen[np.lexsort((ids[mine[chosen]], -score[chosen]))][:k]
        out.append((at, mine[order], score[order]))
    return out


def _blocks(reps: DataFrame, queries: DataFrame, model, radius: int, k: int, n_index: int, n_queries: int) -> DataFrame:
    """(query, ids, score) of the best of each block for each query, blocks of bounded size."""
    across, down = max(1, -(-n_index // INDEX_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    place = F.xxhash64("key")
    left = reps.select("key", "raw", "ids", F.pmod(place, F.lit(across)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("j"))
    right = queries.select("key", "raw", F.pmod(place, F.lit(down)).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("i"))
    shared = reps.sparkSession.sparkContext.broadcast(model)

    def run(index, wanted):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("query", pa.binary()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not index.num_rows or not wanted.num_rows:
            return schema.empty_table()
        raws, q_raws = index.column("raw").to_pylist(), wanted.column("raw").to_pylist()
        ids, keys = index.column("ids").to_pylist(), wanted.column("key").to_pylist()
        table = [np.frombuffer(b"".join(r), np.float64).reshape(len(r), -1) for r in (raws, q_raws)]
        # Scores do not change with the scale of a vector; this keeps their products finite.
        table = [t / np.abs(t).max(axis=1, keepdims=True) if (np.abs(t).max() > 1e100 or np.abs(t).max(axis=1).min() < 1e-100) else t for t in table]
        found = _search(
            (encode(raws, shared.value), np.array([i[0] for i in ids]), table[0]),
            (encode(q_raws, shared.value), table[1]), radius, k,
        )
        rows = [(keys[q], ids[c], float(s)) for q, cs, ss in found for c, s in zip(cs, ss)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "query binary, ids array<long>, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest by cosine of every vector with ``is_query``.

    Candidates are all rows but the query's own; equal scores go to the smaller vec_id, and
    fewer than k candidates are all returned. Vectors that are null, empty, zero, or hold null
    or non-finite numbers take no part, nor do rows without a vec_id or of another length than
    most of the sample. Rows that repeat a vec_id and vector are one. Further columns are not
    looked at. Without vectors there is no result.
    """
    import numpy as np

    sample = [
        np.frombuffer(r["raw"], np.float64)
        for r in _prepared(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("raw").collect()
    ]
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(s) for s in sample]
    dimension = max(sorted(set(lengths)), key=lengths.count)
    distinct = np.unique(np.array([s for s in sample if len(s) == dimension]), axis=0)
    model = learn(distinct, k)

    rows = staged(_prepared(vectors, dimension).distinct(), "vectors")
    # The smallest ids of equal vectors, first in pieces: a vector may be most of the table.
    piece = F.pmod(F.xxhash64("vec_id"), F.lit(PIECES))
    in_piece = Window.partitionBy("key", "piece").orderBy("vec_id")
    small = rows.withColumn("piece", piece).withColumn("n", F.row_number().over(in_piece)).where(F.col("n") <= k + 1)
    reps = staged(
        small.groupBy("key").agg(F.first("raw").alias("raw"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids")),
        "index",
    )
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query"))
    queries = staged(asked.select("query").distinct().join(reps.select(F.col("key").alias("query"), "raw"), "query").withColumnRenamed("query", "key"), "queries")
    n_index, n_queries = reps.count(), queries.count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = staged(_blocks(reps, queries, model, model[2], k + 1, n_index, n_queries), "found")
    enough = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k)
    short = staged(queries.join(enough.withColumnRenamed("query", "key"), "key", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        whole = _blocks(reps, short, model, BITS, k + 1, n_index, n_short)
        found = found.join(short.select(F.col("key").alias("query")), "query", "left_anti").unionByName(staged(whole, "found"))

    single = found.select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id")]
    best = single.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= k + 1)
    # k + 1 rows of a vector serve all queries that hold it.
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    ranked = asked.join(lists, "query").select(
        "query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "hit")
    )
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
