"""Centroid clustering of integer vectors with an n-simplex filter (operator 12).

Vectors of exactly ``SIZE`` components, none null or not finite, become
integers ``floor(1024 * x)``. Each round gives every vector its nearest
centroid and replaces each centroid by its vectors' exact rounded-down mean.

The filter: distances to a few pivots, computed once and stored with each
vector, are turned into the coordinates of an apex above the simplex that the
pivots span. For two apexes, the Euclidean distance of their coordinates is a
lower bound of the true distance, and the same with the sign of one last
coordinate turned an upper bound. A centroid whose lower bound is beyond the
least upper bound can't be nearest; all others are compared by exact integer
distances. ``SLACK`` covers rounding, so the filter never changes a result.

The nearer the centroids are to the flat that the pivots span, the tighter the
bounds. So the pivots are the centroids of an early round: of the start, and
again of the rounds in ``RENEWED``, when centroids have settled; vectors keep
their distances to these until then.

How it scales: vectors and their apexes are stored once; a round reads them,
works on Arrow batches in numpy and hands on one row a batch and cluster
(sums and counts), added up by Spark. To the driver go centroids and pivots
only: ``k`` times ``SIZE`` numbers. No vector is shuffled.

Cases: vectors of another size, or with null or non-finite components, and null
vectors are left out; repeated vec_ids are vectors of their own, and equal
hashes start in order of their components; fewer than ``k`` vectors give fewer
centroids; an empty table gives an empty result. Components beyond ``EXACT``
(floats over 131,072) are compared without the filter by numbers of any size,
those beyond 64 bits as the largest ones of 64 bits; distances and sums of them
beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import staged

#: Components of a vector, clusters, rounds, the seed of the first centroids, the scale of components.
SIZE, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Rounds before which the pivots are renewed; the least height of a pivot above the others, as a share of the longest edge.
RENEWED, HEIGHT = (1, 4), 0.1
#: Share of the largest bound that rounding can make of a bound, with room to spare.
SLACK = 1e-6
#: Components below this can't bring a squared distance over 64 bits.
EXACT = 1 << 27


def integer_vectors(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v): the kept vectors as integers."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col("vec_id").alias("vec_id"), e.cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & good)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * float(SCALE))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """The ``k`` vectors of the smallest digests of ``seed:vec_id``, in order of the digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [np.array(r.v, np.int64) for r in vectors.select(digest.alias("d"), "v").orderBy("d", "v").limit(k).collect()]  # k rows


class Simplex:
    """Pivots, and the coordinates of apexes above them."""

    def __init__(self, points: np.ndarray):
        """Takes each point in turn that stands high enough above the simplex so far."""
        self.pivots: list[np.ndarray] = []
        self.rows = np.zeros((0, 0))
        points = points[np.abs(points).max(1) < EXACT]
        reach = max((float(np.sqrt(_squares(points, p).max())) for p in points), default=0.0)
        for p in points:
            at = self.apexes(self.distances(p[None, :]))[0]
            if not self.pivots or at[-1] > HEIGHT * reach:
                n = len(self.pivots)
                rows = np.zeros((n + 1, n))
                rows[:n, : max(n - 1, 0)] = self.rows
                if n:
                    rows[n] = at
                self.rows = rows
                self.pivots.append(p)

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([_squares(v, p) for p in self.pivots], 1).astype(float)) if self.pivots else np.zeros((len(v), 0))

    def apexes(self, d: np.ndarray) -> np.ndarray:
        """Coordinates of apexes by their distances to the pivots: as many as pivots, the last one the height."""
        n = d.shape[1]
        out = np.zeros((len(d), n))
        if not n:
            return out
        # The first pivot is the origin; that the others are at the known distances gives a triangular system.
        square = d * d
        for i in range(1, n):
            row = self.rows[i]
            out[:, i - 1] = (square[:, 0] - square[:, i] + row @ row - 2 * out[:, : i - 1] @ row[: i - 1]) / (2 * row[i - 1])
        out[:, n - 1] = np.sqrt(np.maximum(0, square[:, 0] - (out[:, : n - 1] ** 2).sum(1)))
        return out


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def nearest(v: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact comparisons) of vectors; of equal distances the smaller number wins."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) >= EXACT:
        far = np.stack([((v.astype(object) - c.astype(object)) ** 2).sum(1) for c in centroids], 1)
        best = np.array([min(range(len(r)), key=lambda j, r=r: (r[j], j)) for r in far], np.int64)
        return best, far[np.arange(len(v)), best], far.size
    own = simplex.apexes(simplex.distances(centroids))
    flat = ((apexes[:, None, :-1] - own[None, :, :-1]) ** 2).sum(2)
    low = np.sqrt(flat + (apexes[:, None, -1] - own[None, :, -1]) ** 2)
    high = np.sqrt(flat + (apexes[:, None, -1] + own[None, :, -1]) ** 2)
    may = low <= high.min(1, keepdims=True) + SLACK * high.max(initial=1.0)
    best = np.zeros(len(v), np.int64)
    least = np.full(len(v), np.iinfo(np.int64).max)
    for j, c in enumerate(centroids):
        at = np.flatnonzero(may[:, j])
        d = _squares(v[at], c)
        closer = d < least[at]
        best[at[closer]], least[at[closer]] = j, d[closer]
    return best, least, int(may.sum())


def _array(column: pa.ChunkedArray | pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), width)


def _with_apexes(simplex: Simplex):
    def put(batches):
        for b in batches:
            v = _array(b.column("v"), SIZE, np.int64)
            apexes = simplex.apexes(simplex.distances(v)) if np.abs(v).max(initial=0) < EXACT else np.zeros((len(v), len(simplex.pivots)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(list(apexes), pa.list_(pa.float64()))], ["vec_id", "v", "apex"])

    return put


def _sums(centroids: np.ndarray, simplex: Simplex):
    """(cluster, n, compared, high, low) of each batch: sums of the high and the low halves of components, so that adding them is exact."""

    def add(batches):
        for b in batches:
            v = _array(b.column("v"), SIZE, np.int64)
            best, _, compared = nearest(v, _array(b.column("apex"), len(simplex.pivots), float), centroids, simplex)
            met = np.unique(best)
            halves = [[half[best == j].sum(0).tolist() for j in met] for half in (v >> 32, v & 0xFFFFFFFF)]
            n = [int((best == j).sum()) for j in met]
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n, pa.int64()), pa.array([compared if i == 0 else 0 for i in range(len(met))], pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in halves]], ["cluster", "n", "compared", "high", "low"])

    return add


def _assigned(centroids: np.ndarray, simplex: Simplex):
    def put(batches):
        for b in batches:
            best, d, _ = nearest(_array(b.column("v"), SIZE, np.int64), _array(b.column("apex"), len(simplex.pivots), float), centroids, simplex)
            d = pa.array([int(x) if int(x) < 1 << 63 else None for x in d], pa.int64()) if d.dtype == object else pa.array(d)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), d], ["vec_id", "cluster", "distance"])

    return put


def _moved(points: DataFrame, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, int, int]:
    """The means of the clusters around ``centroids``, how many distances were compared exactly, and how many vectors there are."""
    parts = points.mapInArrow(_sums(centroids, simplex), "cluster long, n long, compared long, high array<long>, low array<long>")
    each = parts.select("cluster", "n", "compared", F.posexplode(F.arrays_zip("high", "low")).alias("i", "x"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), whole("x.high").alias("high"), whole("x.low").alias("low")).collect()  # a row a centroid and component
    moved = centroids.copy()
    for r in sums:
        moved[r.cluster, r.i] = ((int(r.high) << 32) + int(r.low)) // r.n
    return moved, sum(r.compared for r in sums if r.i == 0), sum(r.n for r in sums if r.i == 0)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, told: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    ``told`` gets for each round how many distances were compared exactly, and how many vectors there are.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    kept = staged(integer_vectors(vectors), "vectors")
    first = first_centroids(kept, k, seed)
    if not first:
        return kept.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array(first)
    for i in range(rounds):
        if i == 0 or i in RENEWED:
            simplex = Simplex(now)
            points = staged(kept.mapInArrow(_with_apexes(simplex), f"vec_id {kind}, v array<long>, apex array<double>"), "apexes")
        now, compared, n = _moved(points, now, simplex)
        if told is not None:
            told.append((compared, n))
    found = staged(points.mapInArrow(_assigned(now, simplex), f"vec_id {kind}, cluster int, distance long"), "clusters")
    sums = {r.cluster: r.own for r in found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("own")).collect()}  # a row a cluster
    short = lambda x: int(x) if x is not None and x < 1 << 63 else None
    inertia = short(sum(sums.values())) if None not in sums.values() else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    of = lambda values, kind: reduce(lambda a, j: a.when(F.col("cluster") == j, F.lit(values.get(j)).cast(kind)), sorted(sums), F.when(F.lit(False), F.lit(None).cast(kind)))
    return found.select("vec_id", "cluster", "distance", of({j: short(x) for j, x in sums.items()}, "long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), of(dict(enumerate(digests)), "string").alias("centroid_sha256"))
