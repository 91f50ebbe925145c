"""License scan with a positional index of rare template words.

The document frequency of every template word is counted over all documents. Of each template the
rarest words are indexed with their places in it: as many as it takes that a text which covers
enough of the template must hold some of them at their places, whichever words it lacks. The
words of a file are looked up, a posting gives the place where the template would have to start,
and the places on which several different words agree are where a template may lie. There the
whole template is compared, and its mandatory phrases must stand there. The choice of words
thus decides how much is compared and never what is found; no number of licenses in a document,
and no length of it, limits what is looked up. Fixed phrases are counted for themselves.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from assentlake.llm.common import slices

# Phrases that are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages of well-known license texts with the phrases that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("deal in the software",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("governing permissions and limitations",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("agpl", "gnu affero general public license version", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("this list of conditions and the following disclaimer",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: How many different words must agree on a place.
AGREED = 3
#: Share of a template's words that must stand at their places.
LEAST_COVERED = 0.6
#: Words that may be missing or added between agreeing words.
SLACK = 3

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, small letters and anything outside ASCII, after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Places, in words, at which the phrase stands in `` word word ... ``."""
    out, at, seen, words = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


def prefix(words: list[bytes], frequency: dict[bytes, int]) -> tuple[list[bytes], int]:
    """The rarest words of a template to look up, and how many of them must agree on a place.

    A match may lack so many places of the template; the words are enough when even then the
    places left belong to ``AGREED`` different words, or to as many as a short template allows.
    """
    counts = Counter(words)
    least = sum(found / len(words) < LEAST_COVERED for found in range(len(words) + 1))
    lacking = len(words) - least
    agreed, held = 1, []
    for word in sorted(counts, key=lambda w: (frequency.get(w, 0), w)):
        held.append(word)
        left, agreed = sum(counts[w] for w in held) - lacking, 0
        for n in sorted((counts[w] for w in held), reverse=True):
            if left > 0:
                left, agreed = left - n, agreed + 1
        if agreed >= AGREED:
            break
    return held, min(agreed, AGREED)


class Index:
    """Postings of the rarest words of each template."""

    def __init__(self, templates, frequency: dict[bytes, int]):
        self.templates, self.postings = [], defaultdict(list)
        for number, (label, text, keys) in enumerate(templates):
            words = text.encode().split()
            held, agreed = prefix(words, frequency)
            for at, word in enumerate(words):
                if word in held:
                    self.postings[word].append((number, at))
            self.templates.append((label, words, [b" " + k.encode() + b" " for k in keys], agreed))
        self.vocabulary = frozenset(self.postings)

    def find(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels and the best share of a template found."""
        labels, best = set(), 0.0
        present = self.vocabulary.intersection(words)
        held = Counter(number for w in present for number in {n for n, _ in self.postings[w]})
        open_ = {n for n, count in held.items() if count >= self.templates[n][3]}
        if not open_:
            return labels, best
        postings = {w: own for w in present if (own := [p for p in self.postings[w] if p[0] in open_])}
        votes: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        for at, word in enumerate(words):
            for number, inside in postings.get(word, ()):
                votes[number][at - inside].add(word)
        for number, starts in votes.items():
            label, template, keys, agreed = self.templates[number]
            share = 0.0
            for start in sorted({s + d for s in starts for d in range(-SLACK, SLACK + 1)}):
                near = set().union(*(starts.get(start + d, ()) for d in range(-SLACK, SLACK + 1)))
                if len(near) >= agreed:
                    share = max(share, self.share(words, template, keys, start))
                    if share == 1:
                        break
            if share:
                labels.add(label)
                best = max(best, share)
        return labels, best

    @classmethod
    def share(cls, words, template, keys, start: int) -> float:
        """Share of the template that stands at this place, 0 if too little or without its phrases."""
        first = max(start - SLACK, 0)
        part = words[first : max(start + len(template) + SLACK, 0)]
        share = cls._covered(template, start - first, part)
        joined = b" " + b" ".join(part) + b" "
        return share if share >= LEAST_COVERED and all(key in joined for key in keys) else 0.0

    @staticmethod
    def _covered(template, shift: int, part) -> float:
        """Share of the template words that stand in order within the slack of their places."""
        found, last = 0, -1
        for i, word in enumerate(template):
            for at in range(max(last + 1, i + shift - SLACK), min(len(part), i + shift + SLACK + 1)):
                if part[at] == word:
                    found, last = found + 1, at
                    break
        return found / len(template)


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template word stands, counted over all of them.

    A row for each template word at most comes back from every task.
    """
    wanted = frozenset(w for _, text, _ in templates for w in text.encode().split())

    def run(batches) -> Iterator:
        import pyarrow as pa

        counts = Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts.update(wanted.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts the places of the fixed phrases; first_word and last_word are the smallest
    and largest of them, in words from 0, or null. labels adds those of the templates found.
    score is 1 with a fixed phrase, else the best share of a template. A null text counts as
    empty and gives zeros and empty labels; repeated rows stay; other columns are not looked at.
    ``docs`` is read twice, first for the frequencies of the template words.
    """
    table = [(b" " + p.encode() + b" ", label) for p, label in (phrases or PHRASES).items()]
    frequency = frequencies(docs, templates)

    def run(batches) -> Iterator:
        import pyarrow as pa

        index = Index(templates, frequency)
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                at, base = [], set()
                for phrase, label in table:
                    if own := places(joined, phrase):
                        at.extend(own)
                        base.add(label)
                labels, share = index.find(words)
                rows.append((
                    doc, len(words), len(at), min(at, default=None), max(at, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else share,
                ))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
