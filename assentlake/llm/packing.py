"""Best-fit packing of tokenised documents in bulk rounds.

Documents and the gaps of the sequences are sorted together by ranges, largest first. One sweep
over that order gives every document the smallest gap that is left for it: gaps are put on a
stack and documents take from it. The sweep is distributed. The height of the stack at each
size follows from the numbers of gaps and documents of each size (no more of them than a
sequence has tokens, so the driver does this part); a rank inside the size turns it into the level at which a row puts or takes; and
the rows of one level alternate, so that a window over a level finds the gap of each document.
Documents of equal size that want the same gaps are told apart by their ranks alone. Then the
gaps are updated and the next round starts, until every document has a place.

A gap that can hold several of the largest documents left offers as many slots. Documents are
served by size classes, the large ones first, so that small ones are left for the gaps; new
sequences are opened for what no gap can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake.llm.common import slices, trimmed
from assentlake.session import shared_folder, staged

CAPACITY = 4096
END_OF_TEXT = 1
#: Lower ends of the size classes, as divisors of the capacity. Larger documents than half a
#: sequence stand alone in a new one.
CLASSES = (2, 4, 8, 32)
REMEMBERED = 150_000
#: Texts that are tokenised together, if their bytes allow it: the more, the fewer distinct chunks.
TEXTS = 1024
#: Parts of chunks that are encoded as the lines of one string.
LINES = 256

# Letters that NFC and lower-casing map one to one, then ASCII punctuation without apostrophe:
# such a chunk splits into exactly these two parts.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
# Python takes these for white space, the tokenizer may not.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85"


class Remembered:
    """Bytes by key in two generations: what is met again in time moves to the younger one, the
    rest goes with the older one. Together they hold about REMEMBERED keys."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lacking(self, keys: set[str]) -> list[str]:
        """Of ``keys`` those that are not known; all others are in ``young`` from now on."""
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        old = self.old
        new = keys.difference(self.young)
        self.young.update((k, old[k]) for k in new if k in old)
        return [k for k in new if k not in old]


class ChunkTokenizer:
    """Tokens of whole texts, with the tokens of parts of chunks between white space remembered.

    The vocabulary drops white space and never joins across it, so a text has the tokens of its
    chunks. A chunk of letters and punctuation is brought to normal form here and skips the
    general normaliser and splitter, which cost more than the merges. New parts of chunks go to
    the library as lines, many in one string: a call and its result cost as much as the merges.
    Texts are split and put together as Arrow arrays, so Python meets each part of a slice once.
    """

    def __init__(self, content: str):
        import os

        # A task has one core; threads of the library would wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(content)
        self.general = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_only = (None, as_bytes)
        self.by_line = (None, pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), as_bytes]))
        # No part holds a line break, so its token stands between parts and nowhere else.
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.bytes_only
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.chunks = Remembered()

    def _encode(self, texts: list[str], how) -> list[bytes]:
        from array import array
        from sys import byteorder

        if not texts:
            return []
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = how
        ids = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if byteorder == "big":
            for i in ids:
                i.byteswap()
        return [i.tobytes() for i in ids]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, which is not empty and holds no line break."""
        import numpy as np

        if len(self.line_end) != 1:
            return self._encode(parts, self.bytes_only)
        out: list[bytes] = []
        lines = ["\n".join(parts[at : at + LINES]) for at in range(0, len(parts), LINES)]
        for ids in self._encode(lines, self.by_line):
            ends = np.flatnonzero(np.frombuffer(ids, "<u4") == self.line_end[0]) * 4
            starts = [0, *(ends + 4).tolist()]
            out.extend(ids[a:b] for a, b in zip(starts, [*ends.tolist(), len(ids)]))
        return out

    def _known(self, parts: list[str], other: set[str]) -> list[bytes]:
        """The ids of each part, once they are all remembered; ``other`` take the general way."""
        wanted = self.chunks.lacking({p for p in parts if p})
        plain, general = [p for p in wanted if p not in other], [p for p in wanted if p in other]
        known = self.chunks.young
        known.update(zip(plain, self._encode_parts(plain)))
        known.update(zip(general, self._encode(general, self.general)))
        return [known[p] if p else b"" for p in parts]

    def _chunks(self, chunks):
        """The ids of each chunk, which holds no white space; Arrow arrays both."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.extract_regex(chunks, PLAIN)
        # A chunk that is not plain is never equal to a part of a plain one: one memory serves both.
        other = set(chunks.filter(split.is_null()).to_pylist())
        letters = pc.coalesce(pc.utf8_lower(pc.struct_field(split, "letters")), chunks)
        marks = pc.fill_null(pc.struct_field(split, "marks"), "")
        parts = pa.concat_arrays([letters, marks]).dictionary_encode()
        ids = pa.array(self._known(parts.dictionary.to_pylist(), other), pa.large_binary()).take(parts.indices)
        empty = pa.scalar(b"", pa.large_binary())
        return pc.binary_join_element_wise(ids[: len(chunks)], ids[len(chunks) :], empty)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text, null or not, as little-endian 32-bit numbers."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, f"[{ODD_SPACES}]")
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        found = words.flatten().dictionary_encode()
        laid = self._chunks(found.dictionary).take(found.indices)
        _, ends, ids = laid.buffers()
        ends = np.frombuffer(ends, np.int64)[laid.offset : laid.offset + len(laid) + 1]
        offsets = words.offsets.to_numpy()
        bounds, ids = ends[offsets - offsets[0]].tolist(), memoryview(ids or b"")
        out = [bytes(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode([texts[i].as_py()], self.general)[0]
        return out


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (4 bytes each) of each text's tokens and a
    final end mark. Who needs no ids leaves them in the task that makes them.

    A null text counts as empty and has the end mark alone. Only a document longer than
    ``capacity`` is cut. Other columns are not looked at; repeated rows stay. No row moves.
    """
    import pyarrow as pa

    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    end = END_OF_TEXT.to_bytes(4, "little")

    def run(batches) -> Iterator:
        from zlib import crc32

        tokenizer = ChunkTokenizer(shared.value)
        for part in slices(batches, TEXTS):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, k * capacity, len(own) // 4, crc32(own), own))
            columns = list(zip(*rows))[: len(types)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        types, schema = {**types, "ids": pa.binary()}, schema + ", ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)


def _levels(runs: list, docs: dict[int, int], slots: dict[int, int]) -> tuple[list[tuple], dict[int, int]]:
    """Where the rows of each run stand on the stack, and how many documents of a size get no slot.

    ``runs`` are the rows (length, kind, range, n, first) of the sorted events, ``docs`` and
    ``slots`` their numbers by size. Of a run: (length, kind, range, first, base); its i-th slot
    stands at level base + i, its i-th document takes from level base - i.
    """
    heights, left = {}, {}
    height = 0
    for size in sorted(docs.keys() | slots.keys(), reverse=True):
        heights[size] = height
        offered, wanted = height + slots.get(size, 0), docs.get(size, 0)
        height = max(0, offered - wanted)
        if wanted > offered:
            left[size] = wanted - offered
    out, before = [], {}
    for length, kind, part, n, first in sorted(runs):
        rank = before.get((length, kind), 0)
        before[length, kind] = rank + n
        base = heights[length] + (slots.get(length, 0) - rank if kind else rank + 1)
        out.append((length, kind, part, first, base))
    return out, left


def _sweep(docs: DataFrame, slots: DataFrame, by_size: tuple[dict[int, int], dict[int, int]]) -> tuple[DataFrame, dict[int, int]]:
    """(id, length, sequence_id) of every document, the sequence null where no slot is left, and
    the number of such documents by size.

    ``docs`` has id and length, ``slots`` has sequence_id, slot and length; ``by_size`` are
    their numbers. Every document gets the smallest slot that larger ones have left, each slot
    at most one document.
    """
    events = docs.select("id", F.lit(0).alias("slot"), "length", F.lit(1).alias("kind")).unionByName(
        slots.select(F.col("sequence_id").alias("id"), "slot", "length", F.lit(0).alias("kind"))
    )
    order = [F.col("length").desc(), F.col("kind"), F.col("id"), F.col("slot")]
    placed = staged(
        events.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*",
            F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ),
        "sweep",
    )
    # Sizes and ranges are both sorted, so there is a row for each size and kind, and one more
    # for each range at most, whatever the number of documents.
    runs = placed.groupBy("length", "kind", "range").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    bases, left = _levels([tuple(r) for r in runs], *by_size)
    table = docs.sparkSession.createDataFrame(bases, "length long, kind int, range int, first long, base long")
    step = F.col("place") - F.col("first")
    leveled = placed.join(F.broadcast(table), ["length", "kind", "range"]).withColumn(
        "level", F.col("base") + F.when(F.col("kind") == 0, step).otherwise(-step)
    )
    turn = Window.partitionBy("level").orderBy(F.col("length").desc(), "kind")
    taken = F.lag(F.when(F.col("kind") == 0, F.col("id"))).over(turn)
    # Below the first level the stack is empty; these rows need no window of their own.
    waiting = leveled.where((F.col("level") < 1) & (F.col("kind") == 1)).select("id", "length", F.lit(None).cast("long").alias("sequence_id"))
    served = leveled.where(F.col("level") >= 1).withColumn("sequence_id", taken).where(F.col("kind") == 1)
    return served.select("id", "length", "sequence_id").unionByName(waiting), left


def _offers(rooms: dict[int, int], largest: int, smallest: int, most: int) -> dict[int, int]:
    """How many slots a gap of each size offers: several, if the largest document fits often."""
    return {free: min(most, max(1, free // largest)) for free in rooms if free >= smallest}


def _slots(gaps: DataFrame, offers: dict[int, int]) -> DataFrame:
    """(sequence_id, slot, length) of all slots of the gaps."""
    # A row for each size of a gap. As a table and not as constants, so that every round has
    # the same generated code, and the driver does not compile it anew.
    each = gaps.sparkSession.createDataFrame(sorted(offers.items()), "free long, n int")
    return (
        gaps.join(F.broadcast(each), "free")
        .withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("sequence_id", "slot", F.floor(F.col("free") / F.col("n")).alias("length"))
    )


def _slot_sizes(rooms: dict[int, int], offers: dict[int, int]) -> dict[int, int]:
    """The number of slots by size, from the number of gaps by size."""
    sizes: dict[int, int] = {}
    for free, n in offers.items():
        sizes[free // n] = sizes.get(free // n, 0) + rooms[free] * n
    return sizes


def _by_size(rows: DataFrame, column: str) -> dict[int, int]:
    """How many rows there are of each size: at most as many sizes as a sequence has tokens."""
    return {r[0]: r[1] for r in rows.groupBy(column).count().collect()}


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, sequence_id, offset) for every item of (id, length); ids must differ.

    Lengths lie between 1 and ``capacity``. Sequences are gapless from 0; their numbers mean
    nothing. The same items give the same number of sequences. Every round is written to the
    shared folder and only its rows are read later, so a lost executor costs no earlier round
    and plans do not grow. The driver holds numbers by size, no documents.
    """
    spark = items.sparkSession
    placed = "id long, length long, sequence_id long"
    large = F.col("length") > capacity // 2
    folders = [shared_folder(spark, "packed")]
    items.where(large).select("id", "length", F.col("id").alias("sequence_id")).write.parquet(folders[0])
    alone = spark.read.schema(placed).parquet(folders[0])
    gaps = alone.where(F.col("length") < capacity).select("sequence_id", (capacity - F.col("length")).alias("free"))
    rooms, sizes = _by_size(gaps, "free"), _by_size(items, "length")
    opened = 0
    for low, high in zip(CLASSES[1:] + (capacity,), CLASSES):
        lo, hi = (capacity // low if low < capacity else 0), capacity // high
        docs = items.where((F.col("length") > lo) & (F.col("length") <= hi)).select("id", "length")
        left = {size: n for size, n in sizes.items() if lo < size <= hi}
        matched = 0
        while left:
            n, top, least = sum(left.values()), max(left), min(left)
            room = sum(g for free, g in rooms.items() if free >= least)
            if room * 100 < n or 0 < matched * 100 < n:
                # For what few gaps do not hold: as many sequences as equal lengths would fill.
                new = max(1, math.ceil(sum(k / (capacity // size) for size, k in left.items()) * 0.98))
                ids = spark.range(new).select((-F.col("id") - 1 - opened).alias("sequence_id"))
                gaps = gaps.unionByName(ids.withColumn("free", F.lit(capacity).cast("long")))
                rooms[capacity] = rooms.get(capacity, 0) + new
                opened, room = opened + new, room + new
            most = max(2, 2 * math.ceil(n / room), capacity // top if room < n else 1)
            offers = _offers(rooms, top, least, most)
            swept, after = _sweep(docs, _slots(gaps, offers), (left, _slot_sizes(rooms, offers)))
            folders.append(shared_folder(spark, "packed"))
            swept.write.parquet(folders[-1])
            swept = spark.read.schema(placed).parquet(folders[-1])
            docs = swept.where("sequence_id is null").select("id", "length")
            used = swept.where("sequence_id is not null").select("sequence_id", (-F.col("length")).alias("free"))
            gaps = staged(gaps.unionByName(used).groupBy("sequence_id").agg(F.sum("free").alias("free")).where("free > 0"), "gaps")
            rooms = _by_size(gaps, "free")
            matched, left = n - sum(after.values()), after
    out = spark.read.schema(placed).parquet(*folders).where("sequence_id is not null")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "id")
    return out.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select("id", "sequence_id", "offset")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length) and where each lies: sequence_id and offset.

    Any columns may come along, also ones named like the working columns; none is read but
    length. No rows give no rows.
    """
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(pieces.columns)]
    at = pieces.columns.index("length")
    kept = staged(pieces.select(*names, F.monotonically_increasing_id().alias("id")), "pieces")
    places = best_fit(kept.select("id", F.col(f"c{at}").cast("long").alias("length")), capacity)
    back: list[Column] = [F.col(f"c{i}").alias(c) for i, c in enumerate(pieces.columns) if c not in ("sequence_id", "offset")]
    return kept.join(places, "id").select(*back, "sequence_id", "offset")
