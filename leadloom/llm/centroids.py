"""Exact centroid clustering with Shallot search, in rounds over a written table.

Every vector keeps its nearest centroid, its second-nearest and bounds of the
distances to both: an upper one to the nearest, a lower one to all others.
After the centroids move, bounds move with them.  A vector whose upper bound
stays below its lower bound, or below half of the way from its centroid to the
next one, needs no search.  The others measure both remembered centroids, take
the closer one as the start, and go through the start's neighbours by rising
distance.  A neighbour further from the start than the sum of the distances to
the start and to the second best so far can be neither of the two, nor can those
after it; the ball shrinks with every better second.  Distances that decide are
whole numbers; bounds are doubles widened by more than their rounding, so that
no tie is decided by a bound.

One round is one pass over the written table: assign, write, and add up the
components per centroid on the map side.  To the driver come k sums of vectors a
round and no rows.  A lost executor repeats its own tasks of the round, as the
table of the round before lies in the shared folder.

Defined cases: a vector is kept if it has exactly `dims` components, none null,
non-finite, or 2^27 and more in size once scaled (sums of squares then stay
within 64 bits); the others give no row.  Equal hashes of repeated ids start in
the order of their components; a null id is hashed as the seed and a colon alone
and starts last.  Fewer kept vectors than centroids give that many centroids;
equal centroids lose to the smallest number; an empty centroid stays where it
is; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import read
from leadloom.session import settle

CENTROIDS = 16
DIMS = 64
SCALE = 64
ROUNDS = 3
SEED = 1
_LIMIT = 1 << 27
#: Relative width that rounding in sums and roots of doubles stays far below.
_SLACK = 1e-9
_SLICE = 4096


def scaled(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and whole components of the vectors that are kept."""
    x = F.col("embedding")
    fit = F.coalesce(
        (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) * scale < _LIMIT - 1, F.lit(False))), F.lit(False))
    return rows.where(fit).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("vector"))


def starts(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hashes, in their order; a top-k that each task prunes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select("vector", F.col("vec_id").isNull().alias("__none"), digest.alias("__digest")).orderBy("__none", "__digest", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _squares(vectors: np.ndarray, centroids: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Squared distances, in whole numbers, of rows to one centroid each."""
    apart = vectors - centroids[picked]
    return np.einsum("ij,ij->i", apart, apart)


class Search:
    """The centroids of a round, the ways between them, and how far each came since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        apart = centroids[:, None, :] - centroids[None, :, :]
        ways = np.sqrt(np.einsum("abi,abi->ab", apart, apart).astype(np.float64))
        np.fill_diagonal(ways, -1.0)
        self.order = np.argsort(ways, axis=1, kind="stable")
        self.sorted_ways = np.take_along_axis(ways, self.order, axis=1)
        np.fill_diagonal(ways, np.inf)
        self.half_way = ways.min(axis=1) / 2 if len(centroids) > 1 else np.full(len(centroids), np.inf)
        moved = np.zeros_like(centroids) if before is None else centroids - before
        self.moves = np.sqrt(np.einsum("ij,ij->i", moved, moved).astype(np.float64)) * (1 + _SLACK)
        #: The longest move of all centroids but one.
        top = np.argsort(-self.moves, kind="stable")
        self.other_moves = np.full(len(centroids), self.moves[top[0]] if len(top) else 0.0)
        if len(top):
            self.other_moves[top[0]] = self.moves[top[1]] if len(top) > 1 else 0.0

    def assign(self, vectors: np.ndarray, best: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring the four arrays up to date in place; returns how many vectors were searched."""
        upper += self.moves[best]
        lower -= self.other_moves[best]
        bound = np.maximum(lower * (1 - _SLACK), self.half_way[best] * (1 - _SLACK))
        open_ = np.flatnonzero(upper * (1 + _SLACK) >= bound)
        if len(open_):
            self._search(vectors, open_, best, second, upper, lower)
        return len(open_)

    def _search(self, vectors, open_, best, second, upper, lower) -> None:
        rows, k = vectors[open_], len(self.centroids)
        one, two = best[open_], second[open_]
        d_one, d_two = _squares(rows, self.centroids, one), _squares(rows, self.centroids, two)
        swap = (d_two < d_one) | ((d_two == d_one) & (two < one))
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        d_one, d_two = np.where(swap, d_two, d_one), np.where(swap, d_one, d_two)
        start, reach = one.copy(), np.sqrt(d_one.astype(np.float64))
        alone = one == two
        d_two[alone] = np.iinfo(np.int64).max
        live = np.arange(len(open_))
        for step in range(1, k):
            near, way = self.order[start[live], step], self.sorted_ways[start[live], step]
            inside = way * (1 - _SLACK) <= (reach[live] + np.sqrt(d_two[live].astype(np.float64))) * (1 + _SLACK)
            live, near = live[inside], near[inside]
            if not len(live):
                break
            # The two remembered centroids are measured already.
            new = (near != one[live]) & (near != two[live])
            at, c = live[new], near[new]
            d = _squares(rows[at], self.centroids, c)
            first = (d < d_one[at]) | ((d == d_one[at]) & (c < one[at]))
            later = ~first & ((d < d_two[at]) | ((d == d_two[at]) & (c < two[at])))
            lead, then = at[first], at[later]
            two[lead], d_two[lead] = one[lead], d_one[lead]
            one[lead], d_one[lead] = c[first], d[first]
            two[then], d_two[then] = c[later], d[later]
        best[open_], second[open_] = one, two
        upper[open_] = np.sqrt(d_one.astype(np.float64)) * (1 + _SLACK)
        lower[open_] = np.where(one == two, np.inf, np.sqrt(d_two.astype(np.float64)) * (1 - _SLACK))


def _assigned(table: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """The table of the next round, or the distances if it is the last."""
    dims = centroids.shape[1]
    kind = table.schema["vec_id"].dataType.simpleString()

    def run(batches):
        search = Search(centroids, before)
        for whole in batches:
            for at in range(0, len(whole), _SLICE):
                batch = whole.slice(at, _SLICE)
                vectors = _matrix(batch["vector"], dims)
                if before is None:
                    best, second = np.zeros(len(batch), np.int32), np.full(len(batch), min(1, len(centroids) - 1), np.int32)
                    upper, lower = np.full(len(batch), np.inf), np.full(len(batch), -np.inf)
                else:
                    best, second, upper, lower = (batch[c].to_numpy(zero_copy_only=False).copy() for c in ("best", "second", "upper", "lower"))
                search.assign(vectors, best, second, upper, lower)
                if last:
                    arrays = [batch["vec_id"], pa.array(best, pa.int32()), pa.array(_squares(vectors, centroids, best), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])
                else:
                    arrays = [batch["vec_id"], batch["vector"], pa.array(best, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vector", "best", "second", "upper", "lower"])

    if last:
        return table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    columns = table.select("vec_id", "vector") if before is None else table
    return columns.mapInArrow(run, f"vec_id {kind}, vector array<int>, best int, second int, upper double, lower double")


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means per centroid, added up per task before the shuffle."""
    k, dims = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            best = batch["best"].to_numpy(zero_copy_only=False)
            vectors = _matrix(batch["vector"], dims)
            for c in np.unique(best):
                chosen = vectors[best == c]
                sums[c] += chosen.sum(axis=0)
                counts[c] += len(chosen)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(used)), pa.int32()),
             pa.array(sums[used].ravel(), pa.int64()), pa.array(np.repeat(counts[used], dims), pa.int64())], names=["best", "place", "total", "n"])

    rows = table.select("best", "vector").mapInArrow(run, "best int, place int, total long, n long").groupBy("best", "place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.copy()
    for r in rows:
        moved[r["best"], r["place"]] = r["total"] // r["n"]
    return moved


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of whole-number vectors of one length, and the last centroids."""
    table = settle(vectors.select("vec_id", "vector"), "centroid-vectors")
    centroids, before = starts(table, k, seed), None
    if not len(centroids):
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for turn in range(rounds):
        table = settle(_assigned(table, centroids, before, False), f"centroid-round-{turn}")
        before, centroids = centroids, _moved(table, centroids)
    return _assigned(table, centroids, before, True), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with the sums of distances of their cluster and of all, and the digest of their centroid.

    The joined side has one row per centroid.
    """
    assigned = settle(assigned, "centroid-clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = assigned.sparkSession.createDataFrame(digests, "__c int, centroid_sha256 string")
    sums = assigned.groupBy(F.col("cluster").alias("__cluster")).agg(F.sum("distance").alias("cluster_inertia"))
    total = F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia")
    sums = sums.join(named, F.col("__cluster") == F.col("__c")).select("__cluster", "cluster_inertia", total, "centroid_sha256")
    return assigned.join(F.broadcast(sums), F.col("cluster") == F.col("__cluster")).drop("__cluster")


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return with_inertia(*cluster(scaled(read(spark, folder, "embeddings"))))


_ASSIGN = """
a{n} AS MATERIALIZED (
  SELECT id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT k.id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{n} m
  ) GROUP BY id, v
)"""
_MOVE = """
c{after} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(moved.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY place) AS v FROM (
      SELECT cluster, place, ((total - (total % n + n) % n) // n)::BIGINT AS mean FROM (
        SELECT cluster, place, sum(x) AS total, count(*) AS n FROM (
          SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{n}
        ) GROUP BY cluster, place
      )
    ) GROUP BY cluster
  ) moved ON moved.cluster = c{n}.c
)"""
OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS})
), {",".join(_ASSIGN.format(n=n) + ("," + _MOVE.format(n=n, after=n + 1) if n < ROUNDS else "") for n in range(ROUNDS + 1))}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (id) JOIN c{ROUNDS} ON c{ROUNDS}.c = cluster
"""
