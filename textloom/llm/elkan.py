"""Centroid clustering of integer vectors: Lloyd's rounds with Elkan's bounds, exact in every decision."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, in_arrow
from textloom.session import Workspace

#: Squared distances of integers below DOUBLE are exact as doubles, those below MOST as longs, at 64 components.
DOUBLE, MOST = 1 << 22, 1 << 27
#: Vectors that are handled at once.
ROWS = 8192

_STATE = "id bigint, v array<int>, cluster int, upper float, lower array<float>, calculations int"
_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, calculations int"


def _up(x: np.ndarray) -> np.ndarray:
    """Floats that aren't less than x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """Floats that aren't more than x, 0 at least: no distance is less."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and y."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _kind(*arrays: np.ndarray):
    """The type in which squared distances are exact and fastest."""
    return np.float64 if all(not x.size or np.abs(x).max() < DOUBLE for x in arrays) else np.int64


class Bounds:
    """One pass over vectors: each gets its nearest centroid (ties: the smaller number), by as few distances as bounds allow.

    ``upper`` is no less than a vector's distance to its centroid and ``lower`` no more than those to all centroids; both
    are kept as floats rounded outwards. A centroid is passed over only where a bound is strictly on the safe side, so
    that a tie is always calculated, in integers.
    """

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None):
        self.centroids, self.k = centroids, len(centroids)
        gaps = np.sqrt(np.array([_squared(centroids, c[None, :]) for c in centroids]).astype(np.float64))
        #: Half of what is between two centroids, rounded down; a vector nearer than that to one is not nearer to the other.
        self.half = np.maximum(gaps / 2 * (1 - 1e-12), 0)
        other = self.half + np.where(np.eye(self.k, dtype=bool), np.inf, 0)
        self.nearest = other.min(axis=1)
        #: How far each centroid moved in the last round, rounded up; None: nothing was assigned yet.
        self.moved = moved

    def begin(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """All vectors with centroid 0."""
        d = np.sqrt(_squared(x, self.centroids[:1]).astype(np.float64))
        lower = np.zeros((len(x), self.k), dtype=np.float32)
        lower[:, 0] = _down(d)
        return np.zeros(len(x), dtype=np.int32), _up(d), lower, np.ones(len(x), dtype=np.int32)

    def run(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, ...]:
        """The new cluster, bounds and number of distances calculated so far of each vector."""
        if self.moved is not None:
            upper, lower = _up(upper + self.moved[cluster]), _down(lower - self.moved[None, :])
        cluster, upper, lower, done = cluster.copy(), upper.astype(np.float32), lower.astype(np.float32), done.copy()
        best = np.zeros(len(x), dtype=np.int64)
        known = np.zeros(len(x), dtype=bool)
        active = np.flatnonzero(~(upper < self.nearest[cluster]))

        def needs(rows: np.ndarray, j: int) -> np.ndarray:
            own = cluster[rows]
            return rows[(own != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < self.half[own, j])]

        for j in range(self.k):
            rows = needs(active, j)
            loose = rows[~known[rows]]
            if len(loose):  # the distance to the own centroid first: the tight bound may do
                own = cluster[loose]
                best[loose] = _squared(x[loose], self.centroids[own])
                d = np.sqrt(best[loose].astype(np.float64))
                upper[loose], lower[loose, own], known[loose] = _up(d), _down(d), True
                done[loose] += 1
                rows = needs(rows, j)
            if not len(rows):
                continue
            found = _squared(x[rows], self.centroids[j : j + 1]).astype(np.int64)
            d = np.sqrt(found.astype(np.float64))
            lower[rows, j] = _down(d)
            done[rows] += 1
            better = (found < best[rows]) | ((found == best[rows]) & (j < cluster[rows]))
            won = rows[better]
            cluster[won], best[won], upper[won] = j, found[better], _up(d[better])
        return cluster, upper, lower, done


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _assigned(centroids: np.ndarray, moved: np.ndarray | None, last: bool):
    """The pass over a table's state; ``last``: exact distances instead of bounds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            x = _matrix(batch.column("v"))
            kind = _kind(x, centroids)
            x, pass_ = x.astype(kind), Bounds(centroids.astype(kind), moved)
            if moved is None:
                state = pass_.begin(x)
            else:
                state = np.asarray(batch.column("cluster")), np.asarray(batch.column("upper")), _matrix(batch.column("lower")), np.asarray(batch.column("calculations"))
            cluster, upper, lower, done = pass_.run(x, *state)
            if last:
                distance = _squared(x, pass_.centroids[cluster]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(done, pa.int32())], names=["id", "cluster", "distance", "calculations"])
            else:
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, pass_.k, dtype=np.int32)), pa.array(lower.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), bounds, pa.array(done, pa.int32())], names=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _moved_to(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without a vector stay. A row a centroid comes to the driver."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("v")[i].cast("bigint")) for i in range(centroids.shape[1]))).alias("s"))
    out = centroids.copy()
    for x in sums.collect():
        out[x.cluster] = [s // x.n for s in x.s]
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, length: int = 64, seed: int = 1) -> DataFrame:
    """Clusters of the integer vectors floor(``scale`` * component): one row a vector that takes part.

    Columns: vec_id, cluster (from 0), distance (squared, to the own final centroid), cluster_inertia and inertia (its
    sum over the cluster and over all), centroid_sha256 (of the centroid's components, joined by commas), and
    calculations: how many distances were calculated for this vector, of (rounds + 1) * k without bounds, the last exact
    one left out.

    The first centroids are the ``k`` vectors (all, if there are fewer) with the smallest sha256 of ``seed:vec_id``. Each of
    ``rounds`` assigns every vector to its nearest centroid (ties: the smaller number) and puts every centroid with
    vectors at the floor of their mean; then all are assigned once more. Vectors that are null, of another length than ``length`` or hold a
    null or non-finite component take no part. A row with a null id does (it becomes a first centroid only after all
    others); repeated rows count each time, and where ids are repeated with other vectors, smaller components come first.
    An empty table gives no row; other columns are ignored. Integers of 2**27 or more are an error, as squared distances
    could exceed a long.

    Bounds and clusters stand in a table of the shared folder, written by each round and deleted after the next. A round
    reads it once to assign and once to add up; nothing is shuffled but a row a centroid and task, so neither large
    clusters nor equal vectors weigh on a task.
    """
    spark = vectors.sparkSession
    usable = F.col("e").isNotNull() & (F.size("e") == length) & F.expr("NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where(usable)
    scaled = rows.select("id", F.transform("e", lambda x: F.floor(F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST))) * scale).cast("bigint")).alias("v"))
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    first = scaled.orderBy(*order).limit(k).collect()
    if not first:
        return spark.createDataFrame([], _RESULT)
    if scaled.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] >= MOST:
        raise ValueError(f"components times {scale} have to be less than {MOST}")
    centroids, moved = np.array([x.v for x in first], dtype=np.int64), None
    with Workspace(spark) as tables:
        state = scaled.select("id", F.col("v").cast("array<int>").alias("v"))
        for i in range(rounds):
            kept, before = tables.keep(state.transform(in_arrow, _assigned(centroids, moved, False), _STATE)), state
            if i:
                tables.drop(before)
            state, old = kept, centroids
            centroids = _moved_to(state, old)
            moved = np.sqrt(_squared(old, centroids).astype(np.float64)) * (1 + 1e-12)
        final = cut(state.transform(in_arrow, _assigned(centroids, moved, True), "id bigint, cluster int, distance bigint, calculations int"))
    found = {x.cluster: x.s for x in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    each = F.array(*(F.lit(found.get(j, 0)).cast("bigint") for j in range(len(centroids))))
    digests = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids))
    return final.select(
        F.col("id").alias("vec_id"), "cluster", "distance", each[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(found.values())).cast("bigint").alias("inertia"), digests[F.col("cluster")].alias("centroid_sha256"), "calculations"
    )


def oracle(k: int = 16, rounds: int = 3, scale: int = 64, length: int = 64, seed: int = 1) -> str:
    """The same in SQL, by all distances, over ``embeddings`` with float components."""
    inner = "CAST(list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)".format(n=length)
    assign = "a{i} AS (SELECT r, vec_id, v, arg_min(n, (d, n)) AS n, min(d) AS d FROM (SELECT r, vec_id, v, n, " + inner + " AS d FROM kept, c{i}) GROUP BY ALL)"
    move = """c{j} AS (SELECT n, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT n, list(floor_ ORDER BY pos) AS m FROM (SELECT n, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_
FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY n, pos) GROUP BY n) USING (n))"""
    steps = [assign.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, j=i + 1), assign.format(i=i + 1)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
SELECT vec_id, CAST(a{rounds}.n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (n)"""


ORACLE = oracle()
