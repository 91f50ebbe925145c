"""Secrets in texts: known shapes, and values that would be costly to guess.

Three shapes are found by patterns. Beyond them, every value that stands where a credential
would (after a credential word and a separator, after an authorization scheme, in the address
of a login) is priced by the least number of guesses that produce it (after Wheeler's estimator,
2016): a dynamic program splits the value into words, dates, repeats, keyboard walks and
brute-force spans such that the sum of their costs, in bits, is least. Placeholders, words and
`12345678` are cheap; what no one would guess is a secret.

Words and their frequencies come from all texts. The dictionary holds the words that are at
least one in 2 ** RAREST of all, so there are at most 2 ** RAREST of them however large the
corpus is; only that list is sent to the tasks. Values are not counted as words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.llm.common import slices
from assentlake.session import staged

#: Kinds of spans in the order of their listing.
KINDS = ("assign", "access", "hex", "guess")

# The three shapes, and the least characters of what they must hold.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
# A run is matched as a whole, so the least length of these two may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED = 8

# Words before a credential, schemes of authorization, and what separates them.
CREDENTIAL_WORDS = (
    "password", "passwd", "passphrase", "passcode", "passwort", "pwd", "secret", "token", "credential", "credentials",
    "api[_ -]?key", "access[_ -]?key", "private[_ -]?key", "encryption[_ -]?key", "signing[_ -]?key", "auth[_ -]?key",
    "account[_ -]?key", "login[_ -]?key",
)
VALUE = r"""[^\s"'`<>(){}\[\],;|]"""
CONTEXTS = (
    re.compile(rf"""(?ai:(?:{'|'.join(CREDENTIAL_WORDS)})["'`]?[\x20\t]{{0,8}}(?::=|=>|->|==?|:|\bis\b)[\x20\t]{{0,8}}["'`]?)({VALUE}+)"""),
    re.compile(rf"(?ai:\b(?:bearer|basic)[\x20\t]{{1,8}})({VALUE}+)"),
    re.compile(r"""(?ai:\b[a-z][a-z0-9+.-]{1,15}://)[^\s/:@"'<>]{1,64}:([^\s/@"'<>]+)@"""),
)
#: A text without any of these, in lower case, has no such place.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "basic", "://")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Values below these characters, and below these bits, are not taken for secrets.
SHORTEST, ENOUGH = 6, 40.0

#: A word is in the dictionary if it is one in 2 ** RAREST of all; its letters.
RAREST = 18
WORD_MIN, WORD_MAX = 3, 20
WORD = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z]{{{WORD_MIN},{WORD_MAX}}}(?![A-Za-z0-9])")
#: Words a task counts before it sends them on.
COUNTED = 100_000

# Rows of keys, as they lie below each other, and the alphabet.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))

WALK_MIN, WALK_MAX = 3, 24
UNIT_MAX = 12
#: Bits to choose the kind of a span.
CHOICE = 2.0

DATES = (
    # year first, year last, without year, year alone; separators must be the same
    (re.compile(r"(?a:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))"), math.log2(200 * 365)),
    (re.compile(r"(?a:(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:(?:19|20)\d\d))"), math.log2(200 * 365)),
    (re.compile(r"(?a:(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1(?:(?:19|20)\d\d))"), math.log2(200 * 365)),
    (re.compile(r"(?a:(?:19|20)\d\d)"), math.log2(200)),
)


def _steps() -> dict[tuple[str, str], tuple[int, int]]:
    """The direction of a step between neighbouring keys."""
    steps = {}
    for row in KEYBOARD:
        for a, b in zip(row, row[1:]):
            steps.setdefault((a, b), (1, 0))
            steps.setdefault((b, a), (-1, 0))
    rows = KEYBOARD[:4]
    # Each row lies half a key further right: a key touches two keys of the next row. The first
    # row has one more key on its left.
    for upper, (row, below) in enumerate(zip(rows, rows[1:])):
        shift = 1 if upper == 0 else 0
        for i, key in enumerate(below):
            for side in (0, 1):
                at = i + shift + side
                if at < len(row):
                    steps.setdefault((key, row[at]), (side, 1))
                    steps.setdefault((row[at], key), (-side, -1))
    return steps


STEPS = _steps()
KEYS = len({k for k, _ in STEPS})


def alphabet(value: str) -> float:
    """Bits of one character of a value that is guessed character by character."""
    if value and all(c in "0123456789abcdef" for c in value):
        return 4.0 if any(c.isalpha() for c in value) else math.log2(10)
    size = 26 * any("a" <= c <= "z" for c in value)
    size += 26 * any("A" <= c <= "Z" for c in value)
    size += 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value)
    size += 128 * any(not c.isascii() for c in value)
    return math.log2(max(size, 2))


def capital_bits(word: str) -> float:
    """Bits for the capitals of a word: none, the first or all are guessed early."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return 1.0
    return 1.0 + math.log2(math.comb(len(word), min(upper, len(word) - upper)) + 1)


def spans(value: str, words: dict[str, float], repeats: bool = True) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of all words, dates, walks and repeats in a value, by start.

    A repetition is given once, from the place where it begins, in its full length; its unit is
    priced by a split of its own, without repeats. The number of spans grows with the length.
    """
    n = len(value)
    low = "".join(c.lower() if c.isascii() else c for c in value)
    keys = "".join(SHIFTED.get(c, c) for c in low)
    runs = _repeats(value) if repeats else {}
    per = alphabet(value)
    for i in range(n):
        if "a" <= low[i] <= "z":
            for j in range(i + 1, min(n, i + WORD_MAX) + 1):
                if not "a" <= low[j - 1] <= "z":
                    break
                bits = words.get(low[i:j]) if j - i >= WORD_MIN else None
                if bits is not None:
                    yield i, j, CHOICE + bits + capital_bits(value[i:j])
        elif "0" <= value[i] <= "9":
            for pattern, bits in DATES:
                match = pattern.match(value, i)
                if match:
                    separated = bool(match.lastindex and match.group(1))
                    yield i, match.end(), CHOICE + bits + 2.0 * separated
        turns, last = 0, None
        for j in range(i + 2, min(n, i + WALK_MAX) + 1):
            step = STEPS.get((keys[j - 2], keys[j - 1]))
            if step is None:
                break
            turns += step != last
            last = step
            if j - i >= WALK_MIN:
                # The first key, the length, and a direction for each straight part.
                yield i, j, CHOICE + math.log2(KEYS) + math.log2(WALK_MAX) + 3.0 * turns + capital_bits(value[i:j])
        for unit, times in runs.get(i, ()):
            bits = guess_bits(value[i : i + unit], words, per, repeats=False)
            yield i, i + unit * times, CHOICE + bits + math.log2(times)


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """For each start of a repetition: (length of the unit, times), at least three characters."""
    found: dict[int, list[tuple[int, int]]] = {}
    n = len(value)
    for unit in range(1, min(UNIT_MAX, n // 2) + 1):
        i = 0
        while i + unit < n:
            if value[i] != value[i + unit]:
                i += 1
                continue
            start = i
            while i + unit < n and value[i] == value[i + unit]:
                i += 1
            times = (i - start) // unit + 1
            if times >= 2 and times * unit >= 3:
                found.setdefault(start, []).append((unit, times))
    return found


def guess_bits(value: str, words: dict[str, float], per: float | None = None, repeats: bool = True) -> float:
    """The least bits of any split of a value into spans; time grows with its length.

    Brute force costs ``per`` bits a character and one choice for a whole run, so the best split
    that ends inside such a run is kept apart from the others.
    """
    per = alphabet(value) if per is None else per
    n = len(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    run = math.inf
    pending = spans(value, words, repeats)
    item = next(pending, None)
    for i in range(n):
        # Every span that ends here began earlier, so best[i] is final.
        best[i] = min(best[i], run)
        while item is not None and item[0] == i:
            best[item[1]] = min(best[item[1]], best[i] + item[2])
            item = next(pending, None)
        run = min(run, best[i] + CHOICE) + per
    return min(best[n], run)


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three shapes; ``low`` is the text in lower case."""
    out = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    return out


def values(text: str, low: str) -> list[tuple[int, int]]:
    """(start, end) of the values that stand where a credential would, each once."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = {m.span(1) for pattern in CONTEXTS for m in pattern.finditer(text)}
    return sorted({s for s in (_trimmed(text, *f) for f in found) if s[1] - s[0] >= SHORTEST})


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the full stop or the like that ends a sentence."""
    while end > start and text[end - 1] in ".:!?":
        end -= 1
    return start, end


def without(text: str, cut: list[tuple[int, int]]) -> str:
    """The text without the given places."""
    parts, at = [], 0
    for start, end in cut:
        parts.append(text[at : max(at, start)])
        at = max(at, end)
    return "\x00".join([*parts, text[at:]])


def find(text: str, price: Callable[[str], float]) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) of all secrets of a text, by start, then kind."""
    low = text.lower()
    out = [(kind, start, end, None) for start, end, kind in base_spans(text, low)]
    for start, end in values(text, low):
        bits = price(text[start:end])
        if bits >= ENOUGH:
            out.append(("guess", start, end, bits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of letters stands in the texts, outside of values."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        def sent(counts):
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if not text:
                    continue
                cut = values(text, text.lower())
                counts.update(w.lower() for w in WORD.findall(without(text, cut) if cut else text))
                if len(counts) > COUNTED:
                    yield sent(counts)
                    counts.clear()
        yield sent(counts)

    parts = docs.select("text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame) -> dict[str, float]:
    """The bits of every word that is at least one in 2 ** RAREST of all words.

    By this share it has at most 2 ** RAREST entries, whatever the size of the corpus.
    """
    counts = staged(count_words(docs), "words")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    kept = counts.where(F.col("n") * F.lit(1 << RAREST) >= F.lit(total)).toArrow()
    return {w: math.log2(total / n) for w, n in zip(kept.column("word").to_pylist(), kept.column("n").to_pylist())}


def scan(docs: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, bits), of every document.

    Places are code points, the end is exclusive; spans are ordered by start, then kind, and may
    overlap. bits is the guess cost of a `guess`, else null. ``words`` is the dictionary, by
    default that of the texts themselves. A null text is empty; an empty one has no spans.
    Repeated rows each have their own; further columns are not looked at; an empty table has no
    rows. A value of any length is priced as a whole, in time that grows with its length.
    """
    words = dictionary(docs) if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        remembered = lru_cache(1 << 12)(lambda value: guess_bits(value, shared.value))

        def price(value: str) -> float:
            return remembered(value) if len(value) <= 256 else guess_bits(value, shared.value)

        for part in slices(batches):
            found = [find(text or "", price) for text in part.column("text").to_pylist()]
            rows = [[dict(zip(("kind", "start", "end", "bits"), s)) for s in spans] for spans in found]
            yield pa.record_batch([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,bits:double>>")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans (as text)."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scanned.select(
        "doc_id", *(of(k) for k in KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
