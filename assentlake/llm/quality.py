"""A factorisation machine that scores documents for quality.

Features are hashed words (their frequencies, scaled to unit length), statistics of the
structure, and the size as the only metadata; label, language, source and id are not among
them. Pairwise interactions have low rank: each feature has a short vector, and half the
difference between the square of the sum and the sum of squares gives all pairs in one pass
over the features of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from assentlake.llm.common import labelled, slices, training_row, trimmed

#: Words are hashed into this many features, after the statistics.
WORDS = 1 << 15
FACTORS = 8
#: The model is fitted on at most so many labelled documents, chosen by the hash of their id.
TRAINING_ROWS = 4_000
EPOCHS = 14
REMEMBERED = 100_000

STATISTICS = (
    "upper", "digit", "symbol", "punctuation", "space", "other", "word_length", "distinct_words",
    "repeated_triples", "repeated_lines", "line_words", "log_words", "log_chars", "long_words",
)


class Features:
    """Statistics and hashed words of a text, as (indices, values)."""

    def __init__(self):
        import numpy as np
        import xxhash

        self.np, self.hash = np, xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}
        kinds = np.full(256, 6, np.uint8)  # bytes of letters outside ASCII
        kinds[:128] = 3
        for kind, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~=+_\\/{}[]")):
            kinds[list(chars)] = kind
        kinds[list(b" \t\n\r\x0b\x0c")] = 4
        kinds[list(b"abcdefghijklmnopqrstuvwxyz")] = 5
        self.kinds = kinds

    def __call__(self, text: str | None):
        np = self.np
        raw = (text or "").encode("utf-8", "surrogatepass")
        kinds = np.bincount(self.kinds[np.frombuffer(raw, np.uint8)], minlength=7)
        words = raw.lower().split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.hash(w) % WORDS
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n, size = max(len(ids), 1), max(len(raw), 1)
        triples = (ids[:-2] * WORDS + ids[1:-1]) * WORDS + ids[2:] if len(ids) > 2 else ids[:0]
        lines = raw.split(b"\n")
        distinct, counts = np.unique(ids, return_counts=True)
        stats = np.array([
            kinds[0] / size, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[6] / size,
            len(raw) / n / 10, len(distinct) / n, 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, np.log1p(len(ids)) / 8,
            np.log1p(len(raw)) / 10, sum(len(w) > 20 for w in words) / n,
        ])
        values = np.sqrt(counts) / np.sqrt(max(counts.sum(), 1))
        return np.concatenate([np.arange(len(stats)), distinct + len(stats)]), np.concatenate([stats, values])


def fit(rows: list[tuple], labels, seed: int = 7):
    """(mean, scale, bias, w, v) of a machine fitted to rows of (indices, values) by Adam."""
    import numpy as np

    rng = np.random.default_rng(seed)
    n_stats, size = len(STATISTICS), len(STATISTICS) + WORDS
    y = np.asarray(labels, np.float32)
    stats = np.array([r[1][:n_stats] for r in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    indices = [np.asarray(r[0], np.int32) for r in rows]
    values = []
    for r in rows:
        x = np.array(r[1], np.float32)
        x[:n_stats] = np.clip((x[:n_stats] - mean) / scale, -4, 4) / 2
        values.append(x)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = np.array([np.log(rate / (1 - rate))])
    params = [bias, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    batch = min(256, max(16, len(rows) // 20))
    for epoch in range(EPOCHS):
        speed = 0.02 * (1 - epoch / EPOCHS) + 0.001
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            idx = np.concatenate([indices[i] for i in own]).astype(np.int64)
            x = np.concatenate([values[i] for i in own]).astype(np.float64)
            lengths = np.array([len(indices[i]) for i in own])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            row = np.repeat(np.arange(len(own)), lengths)
            bias, w, v = params
            vx = v[idx] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            squares = np.add.reduceat((vx * vx).sum(1), starts)
            z = bias[0] + np.add.reduceat(w[idx] * x, starts) + 0.5 * ((total * total).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            e = error[row]
            touched, place = np.unique(idx, return_inverse=True)
            dw = np.bincount(place, e * x) + 1e-6 * w[touched]
            dv = np.stack([np.bincount(place, e * (x * total[row, f] - vx[:, f] * x)) for f in range(FACTORS)], 1) + 1e-5 * v[touched]
            step += 1
            for k, (spot, grad) in enumerate(((slice(None), np.array([error.sum()])), (touched, dw), (touched, dv))):
                first[k][spot] = 0.9 * first[k][spot] + 0.1 * grad
                second[k][spot] = 0.99 * second[k][spot] + 0.01 * grad * grad
                m = first[k][spot] / (1 - 0.9**step)
                s = second[k][spot] / (1 - 0.99**step)
                params[k][spot] -= speed * m / (np.sqrt(s) + 1e-8)
    return mean, scale, float(params[0][0]), params[1], params[2]


def score_rows(model, rows) -> list[float]:
    """Scores between 0 and 1, in time linear in the number of features."""
    import numpy as np

    mean, scale, bias, w, v = model
    out = []
    for idx, x in rows:
        x = np.array(x)
        x[: len(mean)] = np.clip((x[: len(mean)] - mean) / scale, -4, 4) / 2
        vx = v[idx] * x[:, None]
        total = vx.sum(0)
        z = bias + w[idx] @ x + 0.5 * (total @ total - (vx * vx).sum())
        out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return out


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        features = Features()
        for part in slices(batches):
            found = [features(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch(
                [part.column(0), part.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                names=["doc_id", "label", "i", "x"],
            )

    return rows.mapInArrow(trimmed(run), "doc_id long, label int, i array<int>, x array<float>")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS):
    """A model of labels.quality from at most ``most`` training rows; None without both labels.

    Only the features of that bounded sample reach the driver.
    """
    import numpy as np
    import pyarrow as pa

    table = _featured(labelled(docs, labels, "quality", most)).toArrow().sort_by("doc_id")
    y = np.clip(table.column("label").to_numpy(), 0, 1)
    if len(set(y.tolist())) < 2:
        return None
    rows = [(i.values.to_numpy(), x.values.to_numpy()) for i, x in zip(table.column("i"), table.column("x"))]
    model = fit(rows, y)
    del rows, table
    pa.default_memory_pool().release_unused()
    return model


def classify(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text counts as empty.

    Without a model every score is 1, so that nothing is rejected. Repeated rows have equal
    scores; held_out is null for a null doc_id. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        import pyarrow as pa

        features = Features()
        own = shared.value
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            scores = [1.0] * len(texts) if own is None else score_rows(own, map(features, texts))
            yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select(
        "doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns unchanged."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        features = Features()
        own = shared.value
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            scores = [1.0] * len(texts) if own is None else score_rows(own, map(features, texts))
            yield part.filter(pa.array([s >= threshold for s in scores]))

    return docs.mapInArrow(trimmed(run), docs.schema)
