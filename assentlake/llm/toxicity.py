"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguise: case, accents, letters of other scripts that look Latin, and digits or
signs in the place of letters. Letters that one digit may stand for fall together. Entries are
anchored at the start of a word and may be whole words or beginnings of words; their weights
are learnt from labelled documents, as are exception phrases, in which an entry does not count.
The sum of the weights is divided by the length of the text and calibrated to a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.llm.common import fit_logistic, labelled, slices, training_row, trimmed
from assentlake.session import staged

#: Labelled documents to learn from. This alone bounds the lexicon: neither entries nor exception
#: phrases are cut by number.
TRAINING_ROWS = 20_000
#: Lengths of the beginnings of words that may become entries.
STEMS = (3, 4, 5, 6, 7)
#: Training documents that an entry must occur in, and its least log odds.
LEAST_DOCUMENTS, LEAST_WEIGHT = 3, 3.0
#: Hits after which a toxic training document needs no further entries.
EXPLAINED = 2

# Letters and signs that look like a Latin letter. Lower case; i stands for l too.
LOOKALIKES = {
    "а": "a", "α": "a", "@": "a", "4": "a", "ɑ": "a",
    "в": "b", "β": "b", "8": "b", "ь": "b",
    "с": "c", "ϲ": "c",
    "ԁ": "d",
    "е": "e", "є": "e", "ε": "e", "3": "e", "€": "e",
    "ɡ": "g", "9": "g",
    "һ": "h", "н": "h", "η": "n",
    "і": "i", "ι": "i", "ı": "i", "1": "i", "l": "i", "ӏ": "i", "|": "i", "¡": "i",
    "ј": "j",
    "к": "k", "κ": "k",
    "м": "m",
    "п": "n",
    "о": "o", "ο": "o", "σ": "o", "0": "o", "ø": "o",
    "р": "p", "ρ": "p",
    "г": "r",
    "ѕ": "s", "5": "s", "$": "s", "ß": "ss",
    "т": "t", "τ": "t", "7": "t", "+": "t",
    "υ": "u", "μ": "u",
    "ν": "v", "ѵ": "v",
    "ш": "w", "ω": "w", "ԝ": "w",
    "х": "x", "χ": "x",
    "у": "y", "γ": "y",
    "2": "z",
}
SIGNS = "@$|+€¡"


class Folder:
    def __init__(self):
        self.table = {ord(k): v for k, v in LOOKALIKES.items() if k not in SIGNS}
        self.plain = {ord(k): v for k, v in LOOKALIKES.items() if k.isascii() and k not in SIGNS}
        # A sign is a letter only between letters; junk around words is not.
        self.sign = re.compile(f"(?<=[^\\W_])[{re.escape(SIGNS)}](?=[^\\W_])")
        self.word = re.compile(r"[^\W_]+").findall
        self.known: dict[str, str] = {}

    def words(self, text: str | None) -> list[str]:
        """The folded words of a text, in order."""
        text = (text or "").lower()
        if any(s in text for s in SIGNS):
            text = self.sign.sub(lambda m: LOOKALIKES[m[0]], text)
        words = self.word(text)
        if len(self.known) > 400_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.fold(w)
        return list(map(self.known.__getitem__, words))

    def fold(self, word: str) -> str:
        if word.isascii():
            return word.translate(self.plain)
        spread = unicodedata.normalize("NFKD", word)
        return "".join(c for c in spread if not unicodedata.combining(c)).translate(self.table)


def _starts(word: str) -> list[str]:
    """What a word may be found by: itself, with its end, and its beginnings."""
    return [word + " ", *(word[:n] for n in STEMS if len(word) >= n)]


class Matcher:
    """Sums the weights of the entries in a text. ``entries`` map to weights; exception phrases
    are two folded words, and an entry that one of them covers does not count."""

    def __init__(self, entries: dict[str, float], phrases: list[str]):
        import ahocorasick

        self.folder = Folder()
        self.automaton = ahocorasick.Automaton()
        for term, weight in entries.items():
            self.automaton.add_word(" " + term, (len(term), weight))
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, None))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, float]:
        """The weight of the strongest entry at each word start (by place) outside exceptions."""
        best: dict[int, float] = {}
        if not self.filled or not words:
            return best
        covered: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                covered.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if not covered:
            return best
        # Both in order of their starts: an exception that reaches far covers what follows it.
        covered.sort()
        kept, reach, j = {}, -1, 0
        for at in sorted(best):
            while j < len(covered) and covered[j][0] <= at:
                reach = max(reach, covered[j][1])
                j += 1
            if at > reach:
                kept[at] = best[at]
        return kept

    def measures(self, text: str | None) -> tuple[float, float]:
        """Weight by length, and total weight, on logarithmic scales."""
        from math import log1p

        words = self.folder.words(text)
        total = sum(self.hits(words).values())
        return log1p(100 * total / max(len(words), 1)), log1p(total)


def _counted(rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` builds of each labelled text, counted inside a task before they move."""
    def run(batches) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        folder, counts = Folder(), Counter()

        def out():
            keys = list(counts)
            batch = pa.record_batch(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["term", "label", "n"],
            )
            counts.clear()
            return batch

        for part in slices(batches):
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                label = min(max(label, 0), 1)
                counts.update((term, label) for term in make(folder, text, label))
            if len(counts) > 500_000:
                yield out()
        if counts:
            yield out()

    return rows.select("doc_id", "text", "label").mapInArrow(trimmed(run), schema).groupBy("term", "label").agg(F.sum("n").alias("n"))


def _holders(rows: DataFrame, ranked: list[str]):
    """For each entry, by rank, the places of the documents of a bounded sample that hold it.

    Pairs reach the driver as two numbers of four bytes.
    """
    import numpy as np

    rank = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(ranked)})

    def run(batches) -> Iterator:
        import pyarrow as pa

        folder, known = Folder(), rank.value
        for part in slices(batches):
            terms = [sorted({known[t] for w in set(folder.words(text)) for t in _starts(w) if t in known}) for text in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(terms, pa.list_(pa.int32()))], names=["doc_id", "terms"])

    found = rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, terms array<int>").toArrow()
    lists = found.column("terms").combine_chunks()
    docs = np.unique(found.column("doc_id").to_numpy(), return_inverse=True)[1].astype(np.int32)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    terms, docs = lists.flatten().to_numpy(), np.repeat(docs, sizes)
    order = np.lexsort((docs, terms))
    terms, docs = terms[order], docs[order]
    starts = np.searchsorted(terms, np.arange(len(ranked) + 1))
    return [np.unique(docs[lo:hi]) for lo, hi in zip(starts, starts[1:])]


COUNTED = "term string, label int, n long"


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS):
    """(entries, phrases, calibration) from at most ``most`` training rows; None without both labels.

    Terms are counted and weighed where they lie; those that stand out reach the driver, at most
    one for every ``LEAST_DOCUMENTS`` of the words of the sample.
    """
    from math import log

    import numpy as np

    sc = docs.sparkSession.sparkContext
    # Bounded, and read several times: written once.
    rows = staged(labelled(docs, labels, "toxic", most), "toxic")
    sizes = {r["label"]: r["n"] for r in rows.groupBy(F.least(F.greatest("label", F.lit(0)), F.lit(1)).alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    p_all, n_all = sizes[1], sizes[0]

    def weight(p: int, n: int) -> float:
        # The clean side is smoothed by half a document, the toxic side not beyond its count.
        return log(p / (p_all + 1)) - log((n + 0.5) / (n_all + 1))

    def of(label: int) -> Column:
        return F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))

    # Rare terms could be chance: their share must stand out against the share of clean ones.
    found = (
        _counted(rows, lambda folder, text, _: {t for w in set(folder.words(text)) for t in _starts(w)}, COUNTED)
        .groupBy("term")
        .agg(of(1).alias("p"), of(0).alias("n"))
        .where((F.col("p") >= LEAST_DOCUMENTS) & (F.col("p") >= 3 + 3 * F.col("n") * F.lit(p_all / n_all)))
        .where(F.log(F.col("p") / (p_all + 1)) - F.log((F.col("n") + 0.5) / (n_all + 1)) >= LEAST_WEIGHT - 1e-9)
        .collect()
    )
    positive = {r["term"]: r["p"] for r in found}
    entries: dict[str, float] = {}
    # Beginnings first: a longer entry has to say clearly more than the ones it starts with.
    for term, p, n in sorted(found, key=lambda r: (len(r[0]), r[0])):
        own = weight(p, n)
        inside = max((entries.get(term[:n], 0.0) for n in range(min(STEMS), len(term))), default=0.0)
        if own >= LEAST_WEIGHT and own > inside + 0.7:
            entries[term] = own
    ranked = sorted(entries, key=lambda t: (-positive[t] * entries[t], t))
    # Words that merely stand in copies of a toxic text say nothing new: an entry has to occur
    # in documents that stronger entries leave short of two hits.
    hits = np.zeros(p_all, np.int32)
    kept: dict[str, float] = {}
    for term, own in zip(ranked, _holders(rows.where("label >= 1"), ranked)):
        if (hits[own] < EXPLAINED).sum() >= LEAST_DOCUMENTS:
            kept[term] = entries[term]
            hits[own] += 1
    entries = kept

    lexicon = sc.broadcast(entries)

    def phrases_of(folder, text, _):
        words = folder.words(text)
        known = lexicon.value
        hit = [i for i, w in enumerate(words) if any(s in known for s in _starts(w))]
        return {f"{words[i + d]} {words[i + d + 1]}" for i in hit for d in (-1, 0) if 0 <= i + d and i + d + 1 < len(words)}

    around = _counted(rows, phrases_of, COUNTED)
    phrases = [
        r["term"]
        for r in around.groupBy("term")
        .agg(F.sum(F.when(F.col("label") < 1, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") >= 1, F.col("n")).otherwise(0)).alias("toxic"))
        .where((F.col("clean") >= LEAST_DOCUMENTS) & (F.col("toxic") == 0))
        .select("term")
        .orderBy("term")
        .collect()
    ]
    shared = sc.broadcast((entries, phrases))

    def run(batches) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(*shared.value)
        for part in slices(batches):
            a, b = zip(*map(matcher.measures, part.column(1).to_pylist()))
            yield pa.record_batch([part.column(0), pa.array(a), pa.array(b), part.column(2)], names=["doc_id", "a", "b", "label"])

    seen = rows.select("doc_id", "text", "label").mapInArrow(trimmed(run), "doc_id long, a double, b double, label int").orderBy("doc_id").toPandas()
    calibration = fit_logistic(seen[["a", "b"]].to_numpy(), seen.label.clip(0, 1).to_numpy())
    return entries, phrases, [float(c) for c in calibration]


def _scorer(model):
    """A function from texts to scores."""
    import numpy as np

    if model is None:
        return lambda texts: [0.0] * len(texts)
    entries, phrases, (a, b, c) = model
    matcher = Matcher(entries, phrases)

    def scores(texts):
        m = np.array([matcher.measures(t) for t in texts]).reshape(-1, 2)
        return (1 / (1 + np.exp(-np.clip(m[:, 0] * a + m[:, 1] * b + c, -30, 30)))).tolist()

    return scores


def score(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, over its whole text.

    A null or empty text has no hits and the score of a text without any. Without a model all
    scores are 0. held_out is null for a null doc_id; repeated rows have equal scores; other
    columns are not looked at. No row moves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        import pyarrow as pa

        scores = _scorer(shared.value)
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array(scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select(
        "doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        scores = _scorer(shared.value)
        for part in slices(batches):
            yield part.filter(pa.array([s < threshold for s in scores(part.column(at).to_pylist())]))

    return docs.mapInArrow(trimmed(run), docs.schema)
