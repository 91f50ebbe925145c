"""Centroid clustering with N-simplex projection, on integers.

Vectors become integers, and every step that decides (distances, ties, sums, means) is exact.
So that few exact distances are needed, each vector's distances to a few fixed pivots are
computed once and cached as the coordinates of an apex over the simplex of the pivots (Connor,
Vadicamo and Rabitti, 2017). The distance of two apexes is a lower bound of the distance of
their vectors; mirrored at the base of the simplex it is an upper bound. A centroid whose lower
bound lies above the least upper bound cannot be the nearest. What is left is compared exactly.
The bounds are floats; they are widened by far more than rounding can amount to.

Vectors never move after they were staged: each round is one pass over them with a few
centroids, and only sums for each cluster are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from assentlake.session import staged

DIMENSION, CLUSTERS, ROUNDS = 64, 40, 5
SCALE = 256
#: Pivots of the simplex, taken from the first centroids.
PIVOTS = 16
#: Integers up to this size keep squared distances within a long, and their halves in a float.
LARGEST = 1 << 27
#: Relative widening of squared bounds.
SLACK = 1e-6

INTEGERS = "vec_id long, v array<int>"


def integer_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the integer vectors of the rows that take part.

    Vectors that are null, of another length, or hold null or non-finite components take no
    part. A component beyond LARGEST would not fit the distances; it stops the job.
    """
    wide = F.col("embedding").cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size("embedding") == dimension) & ~bad)
    number = lambda x: F.floor(x * float(scale))
    safe = F.transform(
        wide,
        lambda x: F.when(F.abs(x * float(scale)) < float(LARGEST), number(x).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("int")
        ),
    )
    return kept.select(F.col("vec_id").cast("long"), safe.alias("v"))


class Simplex:
    """Apex coordinates from distances to pivots, for vectors of integers."""

    def __init__(self, candidates):
        import numpy as np

        points = np.asarray(candidates, np.float64)
        chosen, widest = [0], 0.0
        # Pivots far from the span of those before, so that the simplex does not degenerate.
        while len(chosen) < PIVOTS:
            base = (points[chosen[1:]] - points[chosen[0]]).T if len(chosen) > 1 else np.zeros((points.shape[1], 0))
            q = np.linalg.qr(base)[0]
            rest = points - points[chosen[0]]
            rest = rest - (rest @ q) @ q.T
            height = (rest * rest).sum(axis=1)
            best = int(height.argmax())
            widest = widest or height[best]
            if height[best] <= 1e-3 * widest:
                break
            chosen.append(best)
        self.pivots = np.asarray(candidates, np.int64)[chosen]
        edges = points[chosen[1:]] - points[chosen[0]]
        # The base of the simplex in coordinates of its own, as a lower triangle.
        self.base = np.linalg.qr(edges.T)[1].T if len(chosen) > 1 else np.zeros((0, 0))
        self.lengths = (edges * edges).sum(axis=1)
        self.inverse = np.linalg.inv(self.base) if len(chosen) > 1 else self.base

    def apexes(self, rows):
        """A row of coordinates for each vector; the last is the height over the base."""
        import numpy as np

        squares = np.stack([squared(rows, p) for p in self.pivots], axis=1).astype(np.float64)
        flat = (squares[:, :1] - squares[:, 1:] + self.lengths) / 2 @ self.inverse.T
        height = np.sqrt(np.maximum(squares[:, 0] - (flat * flat).sum(axis=1), 0))
        return np.concatenate([flat, height[:, None]], axis=1)


def squared(rows, point):
    """Exact squared distances of rows to a point, as 64-bit integers."""
    import numpy as np

    gap = rows.astype(np.int64) - point
    return np.einsum("ij,ij->i", gap, gap)


def bounds(own, others):
    """Squared lower and upper bounds of the distances of two sets of apexes."""
    import numpy as np

    flat_own, flat_others = own[:, :-1], others[:, :-1]
    flat = (flat_own**2).sum(1)[:, None] + (flat_others**2).sum(1)[None, :] - 2 * flat_own @ flat_others.T
    near = (own[:, -1:] - others[:, -1][None, :]) ** 2
    far = (own[:, -1:] + others[:, -1][None, :]) ** 2
    # Rounding grows with the coordinates, not with their difference.
    slack = SLACK * ((own**2).sum(1)[:, None] + (others**2).sum(1)[None, :] + 1)
    flat = np.maximum(flat, 0)
    return flat + near - slack, flat + far + slack


def assign(rows, apexes, centroids, simplex: Simplex):
    """(number, squared distance) of the nearest centroid of each row, and distances computed.

    Ties go to the smaller number.
    """
    import numpy as np

    low, high = bounds(apexes, simplex.apexes(centroids))
    possible = low <= high.min(axis=1, keepdims=True)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    number = np.zeros(len(rows), np.int32)
    for c in range(len(centroids)):
        # A lower bound above what was found already rules a centroid out as well.
        at = np.flatnonzero(possible[:, c] & (low[:, c] <= best))
        if not len(at):
            continue
        distance = squared(rows[at], centroids[c])
        closer = distance < best[at]
        best[at[closer]] = distance[closer]
        number[at[closer]] = c
    return number, best, int(possible.sum())


def _matrix(column, width: int, kind):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def _cached(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """The vectors with their apexes."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            rows = _matrix(v, len(v[0]), np.int64)
            flat = simplex.apexes(rows)
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))
            yield pa.record_batch([batch.column("vec_id"), v, lists], names=["vec_id", "v", "apex"])

    return vectors.mapInArrow(run, INTEGERS + ", apex array<double>")


def _pass(cached: DataFrame, centroids, simplex: Simplex, sums: bool) -> DataFrame:
    """One pass: for every vector its cluster and distance, or with ``sums`` those per task."""
    schema = "cluster int, n long, total array<long>" if sums else "vec_id long, cluster int, distance long"

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        count = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("v"), centroids.shape[1], np.int64)
            apexes = _matrix(batch.column("apex"), len(simplex.pivots), np.float64)
            number, distance, _ = assign(rows, apexes, centroids, simplex)
            if sums:
                count += np.bincount(number, minlength=len(centroids))
                order = np.argsort(number, kind="stable")
                present, starts = np.unique(number[order], return_index=True)
                total[present] += np.add.reduceat(rows[order], starts, axis=0)
            else:
                yield pa.record_batch([batch.column("vec_id"), pa.array(number), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        if sums:
            used = np.flatnonzero(count)
            yield pa.record_batch(
                [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                names=["cluster", "n", "total"],
            )

    columns = ["v", "apex"] if sums else ["vec_id", "v", "apex"]
    return cached.select(*columns).mapInArrow(run, schema)


def _moved(cached: DataFrame, centroids, simplex: Simplex):
    """The centroids after one round: exact floors of the means; empty clusters stay."""
    parts = _pass(cached, centroids, simplex, sums=True)
    totals = (
        parts.select("cluster", "n", F.posexplode("total").alias("axis", "x"))
        .groupBy("cluster", "axis")
        # Sums over all tasks may exceed a long.
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    )
    moved = centroids.copy()
    # One number for each component of each centroid.
    for row in totals.collect():
        moved[row["cluster"], row["axis"]] = int(row["x"]) // row["n"]
    return moved


def first_centroids(vectors: DataFrame, clusters: int, salt: str) -> DataFrame:
    """The vectors with the smallest hashes of their ids, ascending; equal ids by components."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    return vectors.orderBy(hashed.asc_nulls_last(), F.col("v")).limit(clusters)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    Centroids start as vectors chosen by the hash of their ids and move ``rounds`` times to the
    floors of their clusters' means; then vectors are assigned once more. Ties of distance go to
    the smaller number. With fewer vectors than ``clusters`` there are as many centroids as
    vectors. Repeated rows count as often as they stand there, and equal first centroids leave
    the later ones empty. A null vec_id is a vector like others, but a first centroid only if
    ids do not suffice. Further columns are not looked at; without vectors there are no rows.
    """
    import numpy as np

    integers = staged(integer_vectors(vectors, dimension), "integers")
    first = [r["v"] for r in first_centroids(integers, clusters, salt).collect()]  # ``clusters`` rows
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    centroids = np.array(first, np.int64)
    simplex = Simplex(centroids)
    cached = staged(_cached(integers, simplex), "apexes")
    for _ in range(rounds):
        centroids = _moved(cached, centroids, simplex)
    assigned = staged(_pass(cached, centroids, simplex, sums=False), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    whole = sums.agg(F.sum("part").cast("long").alias("inertia"))
    names = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)],
        "cluster int, centroid_sha256 string",
    )
    # A row for each centroid, and a single row.
    about = sums.select("cluster", F.col("part").cast("long").alias("cluster_inertia")).join(names, "cluster").crossJoin(whole)
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
