"""Near-duplicate documents by banded MinHash, odd sketches and a check on the full sets.

Documents with the same set of shingles form a class and are handled once. Classes that agree
in a band of MinHash samples are candidates. All samples of a class are also folded into a
bitmap of parities; the number of ones in the XOR of two bitmaps estimates how many samples
differ, most precisely where the sets are nearly equal, and sends only promising candidates to
the comparison of the whole sets.

A bucket of a band is not expanded into all pairs. Each class is first compared with the
hub of its bucket; only where a bucket still holds several components after that are pairs
across components looked for, by an exact filter on their rarest shingles, so that no link that
joins components is missed and texts that share common passages alone do not meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.llm.common import slices, trimmed
from assentlake.llm.components import components
from assentlake.session import staged

#: Two sets with the similarity below agree in no band with a probability under one in a million:
#: (1 - 0.85 ** 6) ** 32.
BANDS, ROWS = 32, 6
FUNCTIONS = BANDS * ROWS
#: Every function gives a sample in each part of the hash range; together they fill a sketch.
PARTS = 4
SAMPLES = FUNCTIONS * PARTS
SKETCH_BITS = 2048
#: How far the estimate of a sketch may fall below the similarity asked for, in standard deviations
#: of samples, parts and parities together; sets smaller than SMALL go to the exact check directly,
#: since the sizes of their parts differ too much for an estimate.
DEVIATIONS, SMALL = 7.0, 128
#: Ids up to this number are sent to every task instead of moving the texts (16 bytes each).
SENT_IDS = 500_000
REMEMBERED = 100_000
#: Counters by which shingles are ordered by rarity.
SLOTS = 1 << 18


class Shingler:
    """The set of word shingles of a text, as sorted 64-bit hashes."""

    def __init__(self, size: int):
        import numpy as np
        import xxhash

        self.np, self.hash, self.size = np, xxhash.xxh3_64_intdigest, size
        self.known: dict[bytes, int] = {}
        draw = np.random.default_rng(20_260_101)
        self.mixers = draw.integers(1, 1 << 63, size=size + 1, dtype=np.uint64) | np.uint64(1)
        self.multipliers = draw.integers(1, 1 << 32, size=(FUNCTIONS, 1), dtype=np.uint32) | np.uint32(1)
        self.masks = draw.integers(0, 1 << 32, size=(FUNCTIONS, 1), dtype=np.uint32)
        self.salts = draw.integers(1, 1 << 63, size=SAMPLES, dtype=np.uint64) | np.uint64(1)

    def _mixed(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def hashes(self, text: str | None):
        np, known = self.np, self.known
        # bytes: only A-Z are lower-cased, and only ASCII white space splits.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = self.size
        if len(own) < n:
            if not len(own):
                return own
            # Shorter than a shingle: the whole sequence, marked with its length.
            total = np.uint64(len(own)) * self.mixers[n]
            for i in range(len(own)):
                total = total + own[i : i + 1] * self.mixers[i]
            return self._mixed(total)
        total = own[: len(own) - n + 1] * self.mixers[0]
        for i in range(1, n):
            total = total + own[i : len(own) - n + 1 + i] * self.mixers[i]
        return np.unique(self._mixed(total))

    def samples(self, hashes):
        """The MinHash samples: for each part of the sorted hashes and each function the smallest value."""
        np = self.np
        short = hashes.astype(np.uint32)
        ends = np.searchsorted(hashes, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(62))
        out = np.full((PARTS, FUNCTIONS), 0xFFFFFFFF, np.uint32)
        for part, own in enumerate(np.split(short, ends)):
            for at in range(0, len(own), 2048):
                low = ((own[at : at + 2048] ^ self.masks) * self.multipliers).min(axis=1)
                out[part] = np.minimum(out[part], low)
        return out

    def bands(self, samples) -> list[int]:
        np = self.np
        rows = samples.min(axis=0).reshape(BANDS, ROWS).astype(np.uint64)
        total = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            total = self._mixed(total * self.salts[i] + rows[:, i])
        return total.view(np.int64).tolist()

    def sketch(self, samples) -> list[int]:
        """Parities of the samples, each counted in the bit that it hashes to."""
        np = self.np
        at = self._mixed(samples.reshape(-1).astype(np.uint64) * self.salts + self.salts) % np.uint64(SKETCH_BITS)
        odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), bands and sketch of each whole text."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = Shingler(size)
        with np.errstate(over="ignore"):
            for part in slices(batches):
                counts, keys, bands, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    hashes = own.hashes(text)
                    counts.append(len(hashes))
                    if not len(hashes):
                        keys.append(None), bands.append([]), sketches.append([])
                        continue
                    samples = own.samples(hashes)
                    keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    bands.append(own.bands(samples))
                    sketches.append(own.sketch(samples))
                longs = pa.list_(pa.int64())
                yield pa.record_batch(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)],
                    names=["doc_id", "n_shingles", "key", "bands", "sketch"],
                )

    schema = "doc_id long, n_shingles long, key binary, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with these distinct ids."""
    few = ids.count() <= SENT_IDS
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, hashes) of the documents with these distinct ids."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = Shingler(size)
        with np.errstate(over="ignore"):
            for part in slices(batches):
                sets = [own.hashes(t).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    return _wanted(docs, ids).mapInArrow(trimmed(run), "doc_id long, hashes array<long>")


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of the rarest of n shingles must be looked up, as the larger and the smaller set.

    Two similar sets share one among the first of the larger and the second of the smaller, in
    any one order of all shingles (Chaudhuri et al., 2006; Xiao et al., 2008).
    """
    return n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


def _rarest(docs: DataFrame, ids: DataFrame, size: int, percent: int) -> DataFrame:
    """(rep, n, pos, token, leads): the rarest shingles of the documents with these ids, in order.

    ``leads`` marks those that also count for the smaller of two sets. The order is by the
    number of shingles in SLOTS slots of the hash, then by the hash; any order gives the same
    pairs. A shingle alone in its slot is in no other set and is left out.
    """
    wanted = staged(_wanted(docs, ids), "texts")

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, counts = Shingler(size), np.zeros(SLOTS, np.int64)
        with np.errstate(over="ignore"):
            for part in slices(batches):
                for text in part.column(1).to_pylist():
                    counts += np.bincount((own.hashes(text) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    import numpy as np

    # At most SLOTS numbers.
    counted = wanted.mapInArrow(trimmed(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SLOTS, np.int64)
    frequency[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches) -> Iterator:
        import pyarrow as pa

        own, frequency = Shingler(size), shared.value
        schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("token", pa.int64()), ("leads", pa.bool_())])
        with np.errstate(over="ignore"):
            for part in slices(batches):
                columns = [[], [], [], [], []]
                for rep, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    hashes = own.hashes(text)
                    often = frequency[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
                    longer, shorter = prefix_lengths(len(hashes), percent)
                    order = np.lexsort((hashes, often))[:longer]
                    pos = np.flatnonzero(often[order] > 1)
                    for column, values in zip(columns, (np.full(len(pos), rep), np.full(len(pos), len(hashes)), pos, hashes[order][pos].view(np.int64), pos < shorter)):
                        column.append(values)
                yield pa.record_batch([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, schema.types)], schema=schema)

    return wanted.withColumnRenamed("doc_id", "rep").mapInArrow(trimmed(run), "rep long, n long, pos long, token long, leads boolean")


def _across(docs: DataFrame, mixed: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``mixed`` (rep, component) in different components that may be similar.

    An exact filter: similar sets share one of their rarest shingles, and what stands behind
    the first shared one in both is enough. Texts that share common passages alone do not meet.
    Of each shingle, those in its largest component are compared with the others only.
    """
    tokens = _rarest(docs, mixed.select(F.col("rep").alias("doc_id")), size, percent).join(mixed, "rep")
    tokens = staged(tokens, "tokens")
    groups = tokens.groupBy("token", "component").agg(F.count("*").alias("k"), F.max("leads").alias("leads"))
    largest = groups.groupBy("token").agg(
        F.max(F.struct("k", "component")).getField("component").alias("main"), F.count("*").alias("parts"), F.max("leads").alias("led")
    )
    shared = staged(
        tokens.join(largest.where("parts > 1 and led").select("token", "main"), "token")
        .withColumn("other", F.col("component") != F.col("main"))
        .drop("main"),
        "shared",
    )

    def side(prefix: str) -> DataFrame:
        return shared.select(*(F.col(c).alias(f"{prefix}_{c}") for c in shared.columns))

    # x is the smaller set; sets of equal size are ordered by their ids.
    x, y = side("x").where("x_leads"), side("y")
    smaller = F.struct("x_n", "x_rep") < F.struct("y_n", "y_rep")
    needed = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent) - 1e-9)
    enough = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= needed
    match = (F.col("x_token") == F.col("y_token")) & (F.col("x_component") != F.col("y_component")) & smaller & enough
    found = (
        x.where("x_other").join(y, match).select("x_rep", "y_rep")
        .unionByName(x.where("not x_other").join(y.where("y_other"), match).select("x_rep", "y_rep"))
    )
    return found.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def margin(n: Column, percent: int) -> Column:
    """How far the estimate for two sets, the smaller one of n shingles, may fall short.

    The variance of the samples; that of parts of unequal size, in which the same share of
    samples stands for different numbers of shingles; and that of the parities of the sketch.
    """
    p = percent / 100
    toggled = 2 * SAMPLES * (1 - p)
    q = math.exp(-2 * toggled / SKETCH_BITS)
    parity = (SKETCH_BITS / 4 * (1 - q * q) - toggled * q * q) / q / (2 * SAMPLES) ** 2
    size = n.cast("double")
    return DEVIATIONS * F.sqrt(p * (1 - p) * (1 / SAMPLES + (PARTS - 1) / (size * size)) + parity)


def promising(x: str, y: str, percent: int) -> Column:
    """Whether two sketched sets can be similar enough, by their sizes and the XOR of the sketches.

    ``x`` and ``y`` are prefixes of the columns n and sketch.
    """
    a, b, n, m = (F.col(f"{p}_{c}") for c in ("sketch", "n") for p in (x, y))
    # Written out, so that it stays in generated code: it runs for every candidate.
    ones = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))
    inner = F.greatest(1 - 2 * ones / F.lit(float(SKETCH_BITS)), F.lit(1e-9))
    similar = 1 + F.log(inner) * (SKETCH_BITS / (4.0 * SAMPLES))
    least = F.least(n, m)
    return (100 * least >= percent * F.greatest(n, m)) & ((least < SMALL) | (similar >= percent / 100 - margin(least, percent)))


def _sketched(classes: DataFrame, name: str, prefix: str) -> DataFrame:
    return classes.select(F.col("rep").alias(name), F.col("n").alias(f"{prefix}_n"), F.col("sketch").alias(f"{prefix}_sketch"))


def _links(docs: DataFrame, near: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    # Each column is made distinct where it lies, before anything moves.
    ids = staged(near.select(F.col("a").alias("doc_id")).distinct().unionByName(near.select(F.col("b").alias("doc_id")).distinct()).distinct(), "compared")
    sets = _sets(docs, ids, size)
    both = near.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    rows = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sum"))
    return staged(rows.where(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Words are split at ASCII white space after A-Z are lower-cased; a set holds the distinct
    shingles of ``size`` words, or the whole sequence of fewer words. Documents whose sets
    have 100 * intersection >= percent * union are linked. A null, empty or blank text has an
    empty set and is linked with nothing. component_id is the smallest doc_id reachable, and
    the row with that id is kept. Rows that share a doc_id are one document. A null doc_id is
    linked with nothing: its component is null and it is kept. Other columns are not looked at.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    signed = staged(signatures(docs, size), "signatures")
    full = signed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets have equal bands and sketches; copies are merged before anything moves.
    classes = staged(
        full.groupBy("key").agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    rows = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(rows.join(shared, "bucket"), "buckets")
    # The member that meets most others is the hub of a bucket: mostly the text that its
    # variants were made from, and so the same one in most buckets of a group.
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("hub"))
    pairs = (
        members.join(hubs, "bucket")
        .select(F.col("rep").alias("b"), F.col("hub").alias("a"))
        .where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    near = (
        pairs.join(_sketched(classes, "a", "x"), "a")
        .join(_sketched(classes, "b", "y"), "b")
        .where(promising("x", "y", percent))
        .select("a", "b")
    )
    links = _links(known, staged(near, "candidates"), size, percent)
    labels = components(links)

    # Buckets that still hold several components: the pairs across them.
    placed = members.select("bucket", "rep").join(labels.toDF("rep", "component"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    several = placed.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d")
    mixed = staged(placed.join(several.select("bucket"), "bucket").select("rep", "component").distinct(), "mixed")
    across = staged(_across(known, mixed, size, percent), "across")
    across = (
        across.join(_sketched(classes, "a", "x"), "a")
        .join(_sketched(classes, "b", "y"), "b")
        .where(promising("x", "y", percent))
        .select("a", "b")
    )
    more = _links(known, staged(across, "candidates"), size, percent)
    labels = components(links.unionByName(more))

    of_class = classes.select("key", "rep").join(labels.toDF("rep", "component"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component")
    )
    return (
        signed.select("doc_id", "n_shingles", "key")
        .join(of_class, "key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
