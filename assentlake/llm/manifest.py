"""A Merkle manifest of a dataset, with a witness for every row.

Every group of rows (here: a language) is a tree whose nodes have up to eight children; the
roots of the groups are the leaves of one more such tree. A witness holds, level by level, the
siblings a leaf needs to fold up to the root.

Leaves are appended in order. The appender (``Appender``) keeps one open run per level. What is
appended opens a partial witness; when a run is complete, or the stream ends, the siblings of
each member are attached to the partial witnesses below that member, and the digest of the run
is appended one level higher. No more than the open runs and the witnesses of one block are
held.

A tree of any size is cut into aligned blocks of 8 ** LEVELS leaves, each appended by one task
group. The roots of blocks are appended in the same way, as leaves of a smaller tree, until one
root is left; the witness of a block's root then extends the witnesses of its leaves. No task
sees more than a block, whatever the size of a group of rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.operators.ranking import with_rank
from assentlake.session import staged

#: Children of a node, and levels of a tree that one task group builds.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS

#: What stands for a null field.
NOTHING = "-"


def field(value: Column) -> Column:
    """A field of a leaf: its length in UTF-8 bytes and its text, so that fields cannot merge."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NOTHING))


def leaf(*fields: Column) -> Column:
    """The digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)).cast("binary"), 256))


def digest(children) -> bytes:
    """The digest of a run: its members' digests as hex text, concatenated."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


class Appender:
    """Appends digests to one block and keeps the witnesses of all its leaves.

    A witness is a list of (place in the run, siblings), from the leaves up. ``full`` says that
    the block is part of a larger tree: it then always has LEVELS levels. Otherwise it ends
    where one node is left.
    """

    def __init__(self, full: bool):
        self.full = full
        self.open: list[list[tuple[bytes, list]]] = [[]]  # per level: (digest, witnesses below)
        self.closed = [0]  # runs completed on each level

    def append(self, value: bytes) -> list:
        witness: list = []
        self._add(0, value, [witness])
        return witness

    def _add(self, level: int, value: bytes, below: list) -> None:
        if level == len(self.open):
            self.open.append([])
            self.closed.append(0)
        self.open[level].append((value, below))
        if len(self.open[level]) == FAN and level < LEVELS:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.open[level]
        self.open[level] = []
        self.closed[level] += 1
        members = [value for value, _ in run]
        for place, (_, below) in enumerate(run):
            step = (place, members[:place] + members[place + 1 :])
            for witness in below:
                witness.append(step)
        self._add(level + 1, digest(members), [w for _, below in run for w in below])

    def root(self) -> bytes | None:
        """Close the open runs from the leaves up; the digest that is left."""
        level = 0
        while level < len(self.open):
            run = self.open[level]
            alone = not self.closed[level] and len(run) == 1
            if level == LEVELS or (alone and not self.full):
                return run[0][0] if run else None
            if run:
                self._complete(level)
            level += 1
        return None


def pack(witness: list) -> bytes:
    """A witness as bytes: per level the place, the number of siblings, and their digests."""
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in witness)


def unpack(data: bytes) -> list:
    witness, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        at += 2
        witness.append((place, [data[at + 32 * i : at + 32 * (i + 1)] for i in range(n)]))
        at += 32 * n
    return witness


def fold(value: bytes, witness: list) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, others in witness:
        value = digest([*others[:place], value, *others[place:]])
    return value


def proof_digest(witness: list) -> str:
    """The digest of all siblings of a witness, in order."""
    return hashlib.sha256(b"".join(o.hex().encode() for _, others in witness for o in others)).hexdigest()


def _appended(table):
    """The witnesses (in order of place) and the root of the block that ``table`` holds."""
    table = table.sort_by("pos")
    block = Appender(full=table.column("size")[0].as_py() > BLOCK)
    witnesses = [block.append(v) for v in table.column("digest").to_pylist()]
    return table, witnesses, block.root()


def _roots(items: DataFrame) -> DataFrame:
    """(tree, pos, size, digest) of the roots of all blocks: the leaves of the next round."""

    def run(table):
        import pyarrow as pa

        table, _, root = _appended(table)
        size = table.column("size")[0].as_py()
        return pa.table(
            {
                "tree": table.column("tree").slice(0, 1),
                "pos": pa.array([table.column("pos")[0].as_py() // BLOCK], pa.int64()),
                "size": pa.array([-(-size // BLOCK)], pa.int64()),
                "digest": pa.array([root], pa.binary()),
            }
        )

    return (
        items.select("tree", "pos", "size", "digest", _block().alias("block"))
        .groupBy("tree", "block")
        .applyInArrow(run, "tree string, pos long, size long, digest binary")
    )


def _block() -> Column:
    return F.floor(F.col("pos") / F.lit(BLOCK)).cast("long")


def _extended(items: DataFrame, above: DataFrame, each, columns: list[str], schema: str) -> DataFrame:
    """``each(row, witness, whole witness)`` of all items, with the witness of their block's root.

    ``above`` has (tree, pos, witness) of the roots of blocks, pos being the block.
    """
    left = items.select("tree", "pos", "size", "digest", *columns, _block().alias("block"))
    right = above.select("tree", F.col("pos").alias("block"), "witness")

    def run(table, upper):
        import pyarrow as pa

        names = [part.split()[0] for part in schema.split(", ")]
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        table, witnesses, _ = _appended(table)
        shared = unpack(upper.column("witness")[0].as_py())
        rows = [each(row, own + shared) for row, own in zip(table.to_pylist(), witnesses)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), types)})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(run, schema)


def _forest(items: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The roots of all trees, and the staged items of every round, leaves first."""
    rounds = []
    while True:
        rounds.append(items)
        roots = staged(_roots(items), "roots")
        if not roots.where("size > 1").limit(1).count():
            return roots, rounds
        items = roots


def _descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Witnesses (tree, pos, witness) of the block roots of the leaves.

    ``top`` has the witnesses of the roots of the trees. From the last round down, each block
    root's witness extends those of the block's members.
    """
    above = top
    for items in reversed(rounds[1:]):
        above = staged(
            _extended(items, above, lambda row, w: (row["tree"], row["pos"], pack(w)), [], "tree string, pos long, witness binary"),
            "witnesses",
        )
    return above


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add pos (from 0, inside the tree) and size (of the tree): by ranges, not one task a tree."""
    ranked = with_rank(rows, F.col("tree"), *(F.col(c).asc_nulls_first() for c in order))
    trees = ranked.groupBy("tree").agg(F.min("rank").alias("_first"), F.count("*").alias("size"))
    return ranked.join(trees, "tree").withColumn("pos", F.col("rank") - F.col("_first")).drop("rank", "_first")


def manifest(docs: DataFrame, tampered: Column, changed_text: Column, with_witness: bool = False) -> DataFrame:
    """One row per document: its digests, the roots, and what its witness proves.

    Columns: doc_id, lang, pos (its place in the language), leaf, subroot (of its language),
    root, proof_sha256 (digest of all siblings), folded_root (root that the witness leads to
    from the row as it is found later) and verified (whether that is the root). ``tampered``
    marks the rows that are found changed, with ``changed_text`` for their text. With
    ``with_witness`` also the witness itself as bytes (see ``unpack``).

    A leaf is made of doc_id, source, lang, n_chars and text; null fields are `-`, so null and
    empty texts differ. Leaves of a language ascend by doc_id (null first), then by digest;
    rows that are equal in all five are leaves of their own with equal digests. A null language
    is a tree of its own, before all others. A tree of one leaf has that leaf as root. An empty
    table has no rows. Further columns are not looked at.
    """
    own = ["doc_id", "source", "lang", "n_chars"]
    leaves = staged(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("lang").cast("string").alias("lang"),
            F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"),
            leaf(*(F.col(c) for c in own), F.col("text")).alias("digest"),
            F.when(F.coalesce(tampered, F.lit(False)), leaf(*(F.col(c) for c in own), changed_text)).alias("found"),
            # Equal rows get an order that the staged table keeps.
            F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    items = staged(numbered(leaves, "doc_id", "digest", "tie").drop("tie"), "items")
    subroots, rounds = _forest(items)

    # The roots of the trees, in the order of their names, are the leaves of the last tree.
    last = staged(
        numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"), "subroots"
    )
    whole, upper = _forest(last)
    nothing = whole.select("tree", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("witness"))
    root = whole.select(F.col("digest").alias("root"))
    tops = _extended(last, _descend(upper, nothing), lambda row, w: (row["name"], 0, row["digest"], pack(w)), ["name"], "tree string, pos long, subroot binary, witness binary")
    tops = staged(tops, "tops")
    above = _descend(rounds, tops.select("tree", "pos", "witness"))

    def proved(row, witness):
        found = row["digest"] if row["found"] is None else row["found"]
        out = (row["doc_id"], row["lang"], row["tree"], row["pos"], row["digest"].hex(), proof_digest(witness), fold(found, witness).hex())
        return (*out, pack(witness)) if with_witness else out

    schema = "doc_id long, lang string, tree string, pos long, leaf string, proof_sha256 string, folded_root string"
    rows = _extended(items, above, proved, ["doc_id", "lang", "found"], schema + (", witness binary" if with_witness else ""))
    names = tops.select("tree", F.lower(F.hex("subroot")).alias("subroot"))
    return (
        rows.join(names, "tree")
        # The root is a single row.
        .crossJoin(F.broadcast(root.select(F.lower(F.hex("root")).alias("root"))))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("tree")
    )
