"""Nearest neighbours by a hash-prefix forest: long hash strings in sorted arrays, one array a tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm.common import cut, in_arrow

#: Trees; half-axes of a first symbol come from at most AXES projections; further symbols, of two bits each.
TREES, AXES, TAIL = 160, 128, 24
#: A query is compared with about WIDE * n ** -FALL of n vectors: nearest neighbours of a larger table are nearer, so that
#: recall holds with a falling share (measured from 2,000 to 1,000,000 isotropic vectors).
WIDE, FALL = 1.1, 0.17
#: Vectors of which the centre is taken; vectors of a part with trees of its own, while there are few parts and at most;
#: parts from which on they grow; queries of one set.
SAMPLE, PART_ROWS, PART_MOST, FEW, SET_ROWS = 5_000, 2_000, 32_768, 32, 65_536


class Forest:
    """Hash strings of vectors: a first symbol that cuts finely, then symbols that each cut what is left by four.

    Vectors are centred and scaled to length 1 first. The first symbol is the nearest of the half-axes after a random
    rotation, each further one the nearest of four in a random plane. All bits stand together in a number, the first
    symbol's highest, so that equal prefixes are ranges of a sorted array.
    """

    def __init__(self, centre: np.ndarray, seed: int = 7, trees: int = TREES):
        self.centre, self.trees, self.dim = centre, trees, len(centre)
        self.axes = min(self.dim, AXES)
        self.head = max(1, int(np.ceil(np.log2(2 * self.axes))))
        self.bits = self.head + 2 * TAIL
        rng = np.random.default_rng(seed)
        self.turns = []
        for _ in range(trees):
            turn = rng.normal(size=(self.dim, self.axes))
            turn = np.linalg.qr(turn)[0]
            self.turns.append(np.concatenate((turn, rng.normal(size=(self.dim, 2 * TAIL))), axis=1).astype(np.float32))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Trees x vectors."""
        x = vectors - self.centre
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)
        out, row = np.empty((self.trees, len(x)), dtype=np.int64), np.arange(len(x))
        weight = np.int64(1) << np.arange(2 * (TAIL - 1), -1, -2, dtype=np.int64)
        for tree, turn in enumerate(self.turns):
            y = x @ turn
            axis = np.abs(y[:, : self.axes]).argmax(axis=1)
            plane = y[:, self.axes :].reshape(len(x), TAIL, 2)
            second = np.abs(plane[:, :, 1]) > np.abs(plane[:, :, 0])
            symbols = 2 * second + (np.where(second, plane[:, :, 1], plane[:, :, 0]) > 0)
            out[tree] = ((2 * axis + (y[row, axis] > 0)) << (2 * TAIL)) + symbols @ weight
        return out


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), dim)


def part_of(node: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a node is searched."""
    h = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _asked(parts: int, sets: int):
    """Each query once for every part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(part_of(np.asarray(batch.column("node")) ^ 0x5BD1E995, sets))
            for part in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, dtype=np.int32)), own, batch.column("node"), batch.column("vector")], names=["part", "set", "query", "vector"])

    return run


def _dealt(parts: int, sets: int):
    """Each vector in its part, once for every set of queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(part_of(np.asarray(batch.column("node")), parts))
            for own in range(sets):
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(batch.num_rows, own, dtype=np.int32)), batch.column("node"), batch.column("vector")], names=["part", "set", "node", "vector"])

    return run


class Trees:
    """The keys of some vectors (trees x vectors) in sorted arrays, one a tree."""

    def __init__(self, keys: np.ndarray, head: int):
        self.head, self.n = head, keys.shape[1]
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(keys, self.order, axis=1)

    def ranges(self, asked: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each tree holds the first ``length`` (1 at least, by query) symbols of ``asked`` (trees x queries)."""
        rest = 2 * (TAIL + 1 - length)
        prefix = asked >> rest
        return tuple(np.stack([np.searchsorted(key, p, side="left") for key, p in zip(self.sorted, (prefix + k) << rest, strict=True)]) for k in (0, 1))

    def candidates(self, asked: np.ndarray, target: float, least: int = 1) -> Iterator[tuple[int, np.ndarray | None]]:
        """For each query (a column of ``asked``) the prefix length at which its ascent ended, and the distinct vectors found.

        All trees descend to their longest match and are ascended in step, symbol by symbol, tree after tree in a fixed
        order, until ``target`` distinct vectors are found. The ascent ends at one symbol, or, where those prefixes hold
        fewer than ``least`` vectors or all are asked for, at the root: length 0 and None stand for all vectors.
        """
        if target >= self.n:
            yield from [(0, None)] * asked.shape[1]
            return
        queries = asked.shape[1]
        # The longest length at which all trees together hold the target (copies counted): no shorter one is passed by.
        low, high = np.ones(queries, dtype=np.int64), np.full(queries, TAIL + 1, dtype=np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            a, b = self.ranges(asked, mid)
            enough = (b - a).sum(axis=0) >= target
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        deeper = self.ranges(asked, np.minimum(low + 1, TAIL + 1))
        now = self.ranges(asked, low)
        for q in range(queries):
            named, found, length = np.zeros(self.n, dtype=bool), 0, int(low[q])
            if length <= TAIL:
                for order, a, b in zip(self.order, deeper[0][:, q], deeper[1][:, q], strict=True):
                    named[order[a:b]] = True
                found = int(named.sum())
            begins, ends = now[0][:, q], now[1][:, q]
            while True:
                for order, a, b in zip(self.order, begins, ends, strict=True):
                    if found >= target:
                        break
                    some = order[a:b]
                    some = some[~named[some]]
                    named[some] = True
                    found += len(some)
                if found >= target or length == 1:
                    break
                length -= 1
                begins, ends = (x[:, 0] for x in self.ranges(asked[:, q : q + 1], np.array([length])))
            yield (length, np.flatnonzero(named)) if found >= min(least, self.n) else (0, None)


def _nearest(x: np.ndarray, squares: np.ndarray, y: np.ndarray, at: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``at`` of x (None: all) the k nearest to y and all that tie with the last one, with their distances."""
    some, square = (x, squares) if at is None else (x[at], squares[at])
    if not len(some):
        return np.empty(0, np.int64), np.empty(0)
    rough = square - 2 * (some @ y)
    k = min(k, len(rough))
    # Rounding errors are far smaller than this; what may be among the k nearest is measured exactly.
    close = np.flatnonzero(~(rough > np.partition(rough, k - 1)[k - 1] + 1e-9 * (square.max() + y @ y)))
    score = np.sqrt(((some[close] - y) ** 2).sum(axis=1))
    best = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    return (close if at is None else at[close])[best], score[best]


def _checked(centre: np.ndarray, seed: int, trees: int, k: int, share: float):
    """The k nearest of a part's vectors, of those its trees name, for each query; ties with the last one stay."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and asked.num_rows:
            forest = Forest(centre, seed, trees)
            node = np.asarray(vectors.column("node").combine_chunks())
            x = _matrix(vectors.column("vector").combine_chunks(), forest.dim)
            squares = (x * x).sum(axis=1)
            own = Trees(np.concatenate([forest.keys(x[a : a + 4096]) for a in range(0, len(x), 4096)], axis=1), forest.head)
            for start in range(0, asked.num_rows, 1024):
                some = asked.slice(start, 1024)
                query, ys = np.asarray(some.column("query").combine_chunks()), _matrix(some.column("vector").combine_chunks(), forest.dim)
                for i, (_, at) in enumerate(own.candidates(forest.keys(ys), max(share * len(x), 3 * k), k)):
                    best, score = _nearest(x, squares, ys[i], at, k)
                    out[0].append(np.full(len(best), query[i]))
                    out[1].append(node[best])
                    out[2].append(score)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return pa.table({"query": pa.array(join(out[0], np.int64), pa.int64()), "node": pa.array(join(out[1], np.int64), pa.int64()), "score": pa.array(join(out[2], np.float64), pa.float64())})

    return run


def due_share(n: int, wide: float = WIDE, fall: float = FALL) -> float:
    """The share of ``n`` vectors that a query is compared with."""
    return min(1.0, wide * max(1, n) ** -fall)


def search(
    vectors: DataFrame, asked: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, trees: int = TREES, seed: int = 7, wide: float = WIDE, fall: float = FALL
) -> DataFrame:
    """The ``k`` nearest rows (Euclidean) to each row of ``vectors`` for which ``asked`` holds: query_id, rank, vec_id, score.

    Rows with a null id and vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
    do vectors of another length than the commonest (the longest of those, in a tie). A query is never its own result,
    also where its row is repeated: rows alike in id and vector count once. Ties go to the smaller id. Other columns
    are ignored.

    Equal vectors are one node, of which the k + 1 smallest ids are kept: no more can be in a result. Nodes are dealt
    out by chance to parts, and each part has trees of its own, so that no prefix, however common, gathers in one task.
    A part's trees are ascended in step until they hold the due share of its nodes (``due_share`` of all of them),
    three times ``k`` at least, counted as distinct nodes, or down to one symbol; every node found is compared exactly. An empty table, and one
    without a query, gives no row.
    """
    valid = F.col("asked").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & F.expr("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(valid)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], result)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("v") == dim)
    # Equal vectors hash alike; the vector itself is compared too. -0.0 counts as 0.0.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v"))
    first = W.partitionBy("h", "v").orderBy("id")
    kept = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    groups = kept.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    nodes = cut(groups.select(F.col("ids")[0].alias("node"), "ids", "h", F.col("v").alias("vector")))
    # An id may stand with several vectors; then nodes are told apart by the hash instead.
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():
        nodes = cut(nodes.withColumn("node", F.col("h")))
    queries = cut(rows.where("asked").select("id", "h", "v").distinct().join(nodes.select("h", F.col("vector").alias("v"), "node"), ["h", "v"]).select("id", "node"))
    n = nodes.count()

    sample = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(SAMPLE).select("vector").toPandas()["vector"]
    centre = np.stack(sample.to_list()).mean(axis=0) if n > 1 else np.zeros(dim)
    wanted = queries.select("node").distinct().join(nodes.select("node", "vector"), "node")
    parts = max(1, -(-n // PART_MOST), min(FEW, -(-n // PART_ROWS)))
    sets = max(1, -(-wanted.count() // SET_ROWS))
    requests = wanted.transform(in_arrow, _asked(parts, sets), "part int, set int, query bigint, vector array<double>")
    dealt = nodes.select("node", "vector").transform(in_arrow, _dealt(parts, sets), "part int, set int, node bigint, vector array<double>")
    checked = dealt.groupBy("part", "set").cogroup(requests.groupBy("part", "set")).applyInArrow(_checked(centre, seed, trees, k + 1, due_share(n, wide, fall)), "query bigint, node bigint, score double")

    near = checked.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("id"))
    top = near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "id"))).where(F.col("r") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))
    answered = queries.join(lists, queries["node"] == lists["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return answered.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
