"""Byte-level BPE by longest matches and backtracking.

The bytes of a piece of text are read as Latin-1 characters, so that one Aho-Corasick pass
gives the longest vocabulary entry at every byte. Tokens are taken greedily; a token is
accepted only if BPE itself could leave it next to the token before. That test undoes the
merges of the two tokens towards their border and is remembered for each pair. Where no token
fits, the last one is given up for its next shorter prefix, and the byte where nothing fitted
is not tried again: every byte is left at most once for each entry that starts there, so the
work is linear in the length of the piece, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, functions as F

from assentlake.llm.common import slices

#: Distinct pieces whose tokens one task remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: A piece longer than this is encoded anew each time it occurs.
LONG_PIECE = 64


def parse_ranks(content: bytes) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 token and rank."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge_table(tokens: list[bytes]) -> list[tuple[int, int]]:
    """For each token the two tokens that its last merge joins.

    A single byte stands for itself twice; (-1, -1) marks a token that merges never reach.
    """
    rank = {token: i for i, token in enumerate(tokens)}
    parts: list[tuple[int, int]] = []
    for own, token in enumerate(tokens):
        if len(token) == 1:
            parts.append((own, own))
            continue
        row = [rank[token[i : i + 1]] for i in range(len(token))]
        while len(row) > 2:
            joined = [rank.get(tokens[a] + tokens[b], own) for a, b in zip(row, row[1:])]
            best = min(joined)
            if best >= own:
                break
            at = joined.index(best)
            row[at : at + 2] = [best]
        parts.append((row[0], row[1]) if len(row) == 2 else (-1, -1))
    return parts


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes], parts: list[tuple[int, int]], pattern: str):
        import ahocorasick
        import regex

        self.tokens, self.parts = tokens, parts
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        reachable = [i for i, (left, _) in enumerate(self.parts) if left >= 0]
        self.joins = {p: i for i in reachable if len(self.tokens[i]) > 1 for p in (self.parts[i],)}
        self.length = [len(t) for t in self.tokens]
        self.shorter = [-1] * len(self.tokens)
        words = {self.tokens[i]: i for i in reachable}
        for i in reachable:
            token = self.tokens[i]
            self.shorter[i] = next((words[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in words), -1)
        self.automaton = ahocorasick.Automaton()
        for token, i in words.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.names = [str(i) for i in range(len(self.tokens))]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens; remembered."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        fit = self.fits[left << 32 | right] = self._stay_apart(left, right)
        return fit

    def _stay_apart(self, left: int, right: int) -> bool:
        # Merges are undone from the last one backwards. ``done`` is the rank of the merge just
        # undone: a merge across the border of a lower rank would have come before it. Of two
        # equal ranks the left one comes first, hence the half.
        done = float("inf")
        while True:
            across = self.joins.get((left, right))
            if across is not None and across < done:
                return False
            one_left, one_right = self.length[left] == 1, self.length[right] == 1
            if one_left and one_right:
                return True
            if not one_left and (one_right or left > right):
                done, left = left, self.parts[left][1]
            else:
                done, right = right + 0.5, self.parts[right][0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        n, length, shorter = len(piece), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            # Ends come in rising order, so the longest token of a start is written last.
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token, last, known = 0, longest[0], -1, self.fits.get
        while at < n:
            end = at + length[token]
            if not closed[end]:
                fit = True if last < 0 else known(last << 32 | token)
                if fit is None:
                    fit = self.adjacent(last, token)
                if fit:
                    out.append(token)
                    last, at = token, end
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                closed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        pieces = self.split(text or "")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(pieces).difference(known)
        large: dict[str, tuple[int, ...]] = {}
        for piece in new:
            (known if len(piece) <= LONG_PIECE else large)[piece] = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if large:
            return list(chain.from_iterable(known.get(p) or large[p] for p in pieces))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Tokens and merges of a rank file that the driver can read; tasks get them by broadcast."""
    with open(path, "rb") as file:
        tokens = parse_ranks(file.read())
    return tokens, merge_table(tokens)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids: the tokens of each whole text; a null text counts as empty.

    One row per row of ``docs``, repeated ids included; other columns are not looked at. The
    vocabulary (about one megabyte) is the only thing sent to the tasks, and no row moves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches) -> Iterator:
        import pyarrow as pa

        own = Codec(*shared.value, pattern)
        for part in slices(batches):
            ids = [own.encode(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes of each row's ids; null ids give no bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches) -> Iterator:
        import pyarrow as pa

        own = Codec(*shared.value, pattern)
        for part in slices(batches):
            raw = [own.decode(i or ()) for i in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, in one pass.

    Encodes, then decodes what was encoded, and keeps the digests of both; a null text counts
    as empty, and repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches) -> Iterator:
        import pyarrow as pa

        own, sha = Codec(*shared.value, pattern), hashlib.sha256
        for part in slices(batches):
            counts, encoded, decoded = [], [], []
            for text in part.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                encoded.append(sha(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(own.decode(ids)).hexdigest())
            yield pa.record_batch(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
