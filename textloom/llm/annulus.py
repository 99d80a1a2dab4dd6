"""Hard negatives by vantage-point trees over norm-augmented vectors: score windows are annuli round an anchor."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import cut, in_arrow
from textloom.session import Workspace

#: Vectors of a part's tree, about: PART_ROWS while there are FEW parts at most, then more, up to PART_MOST.
PART_ROWS, FEW, PART_MOST = 8_192, 32, 131_072
#: Vectors of a leaf; anchors that are answered at once; anchors of one set, which one task holds.
LEAF, ASKED, SET_ROWS = 256, 512, 262_144
#: The upper tree, which deals vectors out to cells, is made from at most SAMPLE vectors and has at most CELLS leaves.
SAMPLE, CELLS = 20_000, 4_096
#: Inner products of integers below DOUBLE are exact as doubles, those below MOST as longs, up to WIDE components.
DOUBLE, MOST, WIDE = 1 << 21, 1 << 26, 1 << 10

#: An anchor with its windows, each of which has a number, a lowest and a highest score.
_REQUEST = "part int, batch int, anchor bigint, y array<int>, label bigint, own bigint, window array<bigint>, low array<bigint>, high array<bigint>"
_TREE = "part int, ids binary, labels binary, vectors binary, size int, vantage binary, path binary, near binary, far binary"


def _space(y: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, by which all have the length sqrt(``most``): inner products become distances."""
    y = y.astype(np.float64)
    return np.concatenate((y, np.sqrt(np.maximum(most - (y * y).sum(axis=1, keepdims=True), 0))), axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x and y."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0))


class VantageTree:
    """A binary tree of vantage points whose leaves are stretches of the rows, in their new order.

    Each level halves every node by the distance to one of its rows: those inside the median ball, and those outside. So
    a node is a range of places, ``path`` names the vantage points above a leaf, and ``near`` and ``far`` hold the least
    and largest distance that the leaf's rows have to each of them.
    """

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 5):
        n, rng = len(x), np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        self.order, ends = np.arange(n), [0, n]
        self.vantage = np.empty(0, dtype=np.int64)  # rows of x, by node, level after level
        for _ in range(self.depth):
            middle, points = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                rows = self.order[a:b]
                point = int(rows[rng.integers(len(rows))]) if b > a else 0
                points.append(point)
                self.order[a:b] = rows[np.argsort(_apart(x[rows], x[point : point + 1])[:, 0], kind="stable")] if b > a else rows
                middle.append((a + b) // 2)
            self.vantage = np.concatenate((self.vantage, points)).astype(np.int64)
            ends = sorted([*ends, *middle])
        self.ends = np.array(ends)
        leaves = len(ends) - 1
        # Node i of level d is 2**d - 1 + i; a leaf's ancestor there is its own number without the last digits.
        self.path = np.array([[2**d - 1 + (i >> (self.depth - d)) for d in range(self.depth)] for i in range(leaves)], dtype=np.int64).reshape(leaves, self.depth)
        self.near, self.far = np.zeros((leaves, self.depth)), np.zeros((leaves, self.depth))
        for i in range(leaves):
            rows = self.order[self.ends[i] : self.ends[i + 1]]
            if len(rows) and self.depth:
                away = _apart(x[rows], x[self.vantage[self.path[i]]])
                self.near[i], self.far[i] = away.min(axis=0), away.max(axis=0)


def reach(away: np.ndarray, path: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance that rows of each leaf can have to each point; ``away``: points x vantage points."""
    least, most = np.zeros((len(away), len(path))), np.full((len(away), len(path)), np.inf)
    for d in range(path.shape[1]):
        to = away[:, path[:, d]]
        np.maximum(least, np.maximum(to - far[:, d], near[:, d] - to), out=least)
        np.minimum(most, to + far[:, d], out=most)
    return least, most


def scores_of(least: np.ndarray, most: np.ndarray, norms: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest and least inner product that those distances allow, both with room for rounding."""
    whole = (norms + length)[:, None]
    room = 1e-6 * (whole + 1)
    return (whole - least**2) / 2 + room, np.where(np.isinf(most), -np.inf, (whole - np.where(np.isinf(most), 0, most) ** 2) / 2 - room)


class Best:
    """For each request the ``k`` best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, low: np.ndarray):
        self.k, self.low = k, low.astype(np.int64)
        self.request, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.bar = self.low.copy()  # lower scores can't come in any more; equal ones can, by their id

    def take(self, request: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.request, self.score, self.id = (np.concatenate(x) for x in ((self.request, request), (self.score, score), (self.id, ids)))
        order = np.lexsort((self.id, -self.score, self.request))
        request = self.request[order]
        rank = np.arange(len(order)) - np.searchsorted(request, request, side="left")
        order = order[rank < self.k]
        self.request, self.score, self.id = self.request[order], self.score[order], self.id[order]
        last = rank[rank < self.k] == self.k - 1
        self.bar[self.request[last]] = np.maximum(self.low[self.request[last]], self.score[last])


def _numbers(data, kind) -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def _searched(k: int, same: bool, length: float) -> Callable:
    """The best rows of one part for each request that was sent there."""
    kind = {"window": pa.int64(), "score": pa.int64(), "id": pa.int64()}

    def answered(tree: dict, asked: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ids, labels, path = _numbers(tree["ids"], np.int64), _numbers(tree["labels"], np.int64), _numbers(tree["path"], np.int64)
        leaves = tree["size"]
        path, near, far = (x.reshape(leaves, -1) for x in (path, _numbers(tree["near"], np.float64), _numbers(tree["far"], np.float64)))
        ends = np.concatenate(([0], np.cumsum(_numbers(tree["vantage"], np.int64)[:leaves])))
        vantage = _numbers(tree["vantage"], np.int64)[leaves:]
        each = np.diff(np.asarray(asked.column("window").offsets))
        spread = lambda values: np.repeat(values, each, axis=0)
        y = spread(_matrix(asked, "y"))
        x = _numbers(tree["vectors"], np.int32).reshape(len(ids), -1)
        exact = np.float64 if max(np.abs(x).max(), np.abs(y).max()) < DOUBLE else np.int64
        x, y = x.astype(exact), y.astype(exact)
        label, own = (spread(np.asarray(asked.column(c))) for c in ("label", "own"))
        window, low, high = (np.asarray(asked.column(c).flatten()) for c in ("window", "low", "high"))
        points = np.concatenate((y.astype(np.float64), np.zeros((len(y), 1))), axis=1)
        norms = (points * points).sum(axis=1)
        least, most = reach(_apart(points, _space(x[vantage], length)), path, near, far) if len(vantage) else (np.zeros((len(y), leaves)), np.full((len(y), leaves), np.inf))
        above, below = scores_of(least, most, norms, length)
        # Nearest first, but nothing within the annulus' inner sphere: leaves that reach into it are alike.
        best, turns = Best(len(y), k, low), np.argsort(-np.minimum(above, high[:, None]), axis=1, kind="stable")
        open_ = np.arange(len(y))
        for step in range(leaves):
            leaf = turns[open_, step]
            wanted = above[open_, leaf] >= best.bar[open_]
            # Later leaves are no nearer; a request is through once the next one is too far.
            open_, leaf = open_[wanted], leaf[wanted]
            if not len(open_):
                break
            use = below[open_, leaf] <= high[open_]
            some, leaf = open_[use], leaf[use]
            order = np.argsort(leaf, kind="stable")
            groups = np.flatnonzero(np.diff(leaf[order], prepend=-1))
            hits: tuple[list, list, list] = ([], [], [])
            for rows in np.split(order, groups[1:]) if len(order) else []:
                at, q = slice(ends[leaf[rows[0]]], ends[leaf[rows[0]] + 1]), some[rows]
                score = y[q] @ x[at].T
                right = (labels[at][None, :] == label[q][:, None]) == same
                good = right & (score >= best.bar[q][:, None]) & (score <= high[q][:, None]) & (ids[at][None, :] != own[q][:, None])
                r, c = np.nonzero(good)
                for out, found in zip(hits, (q[r], score[r, c].astype(np.int64), ids[at][c]), strict=True):
                    out.append(found)
            if hits[0]:
                best.take(*(np.concatenate(h) for h in hits))
        return window[best.request], best.score, best.id

    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for tree in trees.to_pylist() if asked.num_rows else []:
            for batch in asked.to_batches(max_chunksize=ASKED):
                out.append(answered(tree, batch))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({name: pa.array(x, t) for (name, t), x in zip(kind.items(), columns, strict=True)})

    return run


def _built(length: float) -> Callable:
    """A part's rows as one row with their tree."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        # By id, whatever order they come in, so that a task that is run again builds the same tree.
        ids, labels = (np.asarray(rows.column(c).combine_chunks()) for c in ("id", "label"))
        x = np.asarray(rows.column("y").combine_chunks().flatten()).reshape(n, -1)
        order = np.lexsort((*x.T, labels, ids))
        ids, labels, x = ids[order], labels[order], x[order]
        tree = VantageTree(_space(x, length), LEAF)
        place = np.empty(n, dtype=np.int64)
        place[tree.order] = np.arange(n)
        row = {
            "part": rows.column("part")[0].as_py(), "ids": ids[tree.order].tobytes(), "labels": labels[tree.order].tobytes(), "vectors": x[tree.order].astype(np.int32).tobytes(), "size": len(tree.ends) - 1,
            "vantage": np.concatenate((np.diff(tree.ends), place[tree.vantage])).astype(np.int64).tobytes(), "path": tree.path.tobytes(), "near": tree.near.tobytes(), "far": tree.far.tobytes(),
        }
        kinds = {"int": pa.int32(), "binary": pa.binary()}
        return pa.table({name: pa.array([row[name]], kinds[t]) for name, t in (c.split() for c in _TREE.split(", "))})

    return run


class Cells:
    """The upper tree: cells of space, between spheres round vantage points of the sample, whatever rows fall in."""

    def __init__(self, sample: np.ndarray, cells: int, length: float):
        self.length = length
        x = _space(sample, length)
        tree = VantageTree(x, max(1, -(-len(x) // max(1, cells))))
        self.points, self.path, self.depth = x[tree.vantage], tree.path, tree.depth
        self.radius = np.zeros(len(tree.vantage))
        leaves = len(tree.ends) - 1
        for node in range(len(tree.vantage)):
            level = int(np.log2(node + 1))
            a, b = ((node - 2**level + 1 + k) << (self.depth - level) for k in (0, 1))
            inside = tree.order[tree.ends[a] : tree.ends[(a + b) // 2]]
            self.radius[node] = _apart(x[inside], self.points[node : node + 1]).max() if len(inside) else 0.0
        right = np.array([[(i >> (self.depth - d - 1)) & 1 for d in range(self.depth)] for i in range(leaves)], dtype=bool).reshape(leaves, self.depth)
        room = 1e-9 * (np.sqrt(length) + 1)
        self.near, self.far = np.where(right, self.radius[self.path] - room, 0.0), np.where(right, np.inf, self.radius[self.path] + room)

    def of(self, y: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node, x = np.zeros(len(y), dtype=np.int64), _space(y, self.length)
        for _ in range(self.depth):
            away = np.sqrt(((x - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (away > self.radius[node])
        return node - (2**self.depth - 1)

    def reached(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and least score that each cell (column) can hold for each anchor."""
        points = np.concatenate((y.astype(np.float64), np.zeros((len(y), 1))), axis=1)
        least, most = reach(_apart(points, self.points), self.path, self.near, self.far) if self.depth else (np.zeros((len(y), 1)), np.full((len(y), 1), np.inf))
        return scores_of(least, most, (points * points).sum(axis=1), self.length)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, -1)


def _in_cells(cells: Cells) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(_matrix(batch, "y")), pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _sent(cells: Cells, first: np.ndarray, sets: int, home: bool) -> Callable:
    """Each anchor for each part that it has to see: ``home``, a part of the anchor's own cell; else all others that may hold a result."""
    names = [x.split()[0] for x in _REQUEST.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            y = _matrix(batch, "y")
            cell, own = cells.of(y), np.asarray(batch.column("anchor"))
            mine = first[cell] + own % np.maximum(first[cell + 1] - first[cell], 1)
            if home:
                row, part = np.arange(len(y)), mine
            else:
                above, below = cells.reached(y)
                begins = np.asarray(batch.column("window").offsets)[:-1] - batch.column("window").offsets[0].as_py()
                least, most = np.minimum.reduceat(np.asarray(batch.column("low").flatten()), begins), np.maximum.reduceat(np.asarray(batch.column("high").flatten()), begins)
                row, to = np.nonzero((above >= least[:, None]) & (below <= most[:, None]))
                size = (first[1:] - first[:-1])[to]
                row, part = np.repeat(row, size), np.repeat(first[to] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row, part = row[part != mine[row]], part[part != mine[row]]
            for a in range(0, len(row), 4096):
                some = batch.take(pa.array(row[a : a + 4096]))
                batch_of = pa.array(np.asarray(some.column("anchor")) % sets, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 4096], pa.int32()), batch_of, *(some.column(x) for x in names[2:])], names=names)

    return run


class Index:
    """Vectors in parts, each with its tree, in a table of the workspace."""

    def __init__(self, tables: Workspace, rows: DataFrame, n: int, length: float, part_rows: int = PART_ROWS):
        self.length = length
        part_rows = max(part_rows, min(PART_MOST, -(-n // FEW)))
        cells = min(CELLS, max(1, -(-n // part_rows)))
        sample = rows.orderBy(F.xxhash64("id", "label"), "id", "label", "y").limit(SAMPLE).select("y").toPandas()["y"]
        self.cells = Cells(np.stack(sample.to_list()).astype(np.int64), cells, self.length)
        placed = tables.keep(rows.transform(in_arrow, _in_cells(self.cells), "id bigint, label bigint, y array<int>, cell int"))
        counts = np.zeros(len(self.cells.near), dtype=np.int64)
        for x in placed.groupBy("cell").count().collect():
            counts[x["cell"]] = x["count"]
        #: Parts of cell c are first[c] to first[c + 1] - 1; a cell of many vectors has many, dealt out by a hash.
        self.first = np.concatenate(([0], np.cumsum(-(-counts // part_rows)))).astype(np.int64)
        begins, parts = (F.array(*(F.lit(int(v)) for v in a)) for a in (self.first[:-1], np.maximum(np.diff(self.first), 1)))
        part = (begins[F.col("cell")] + F.pmod(F.xxhash64("id", "label", "y"), parts[F.col("cell")])).cast("int")
        schema = placed.withColumn("part", part).select("part", "id", "label", "y")
        self.trees = tables.keep(schema.groupBy("part").applyInArrow(_built(self.length), _TREE))
        tables.drop(placed)

    def search(self, tables: Workspace, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(window, rank, id, score): the ``k`` best rows of each window, of the anchor's label or of others.

        First a part of the anchor's own cell is searched. What is found there raises the windows' lower ends, so that only
        the parts are asked that can hold a better row.
        """
        sets = max(1, -(-asked.count() // SET_ROWS))
        trees = self.trees.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).groupBy("part", "batch")

        def ask(rows: DataFrame, home: bool) -> DataFrame:
            sent = rows.transform(in_arrow, _sent(self.cells, self.first, sets, home), _REQUEST).groupBy("part", "batch")
            return trees.cogroup(sent).applyInArrow(_searched(k, same, self.length), "window bigint, score bigint, id bigint")

        begun = tables.keep(ask(asked, True))
        bar = begun.groupBy("window").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") == k)
        raised = asked.select("anchor", F.inline(F.arrays_zip("window", "low", "high"))).join(bar, "window", "left").withColumn("low", F.greatest("low", "bar"))
        raised = raised.groupBy("anchor").agg(F.collect_list(F.struct("window", "low", "high")).alias("w")).select("anchor", *(F.col(f"w.{x}").alias(x) for x in ("window", "low", "high")))
        every = begun.unionAll(ask(asked.drop("window", "low", "high").join(raised, "anchor"), False))
        ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("window").orderBy(F.desc("score"), "id")))
        return tables.keep(ranked.where(F.col("rank") <= k))


def mine(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3,
    low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), part_rows: int = PART_ROWS,
) -> DataFrame:
    """Hard negatives for each anchor (rows of ``vectors`` for which ``anchors`` holds) and each of its positives.

    Components become floor(``scale`` * component); a row's score is its integer inner product with the anchor. An
    anchor's positives are its ``positives`` best other rows of the same label; a positive's negatives the ``negatives`` best rows of other labels
    whose score is between ``low`` and ``high`` (fractions) of the positive's; a positive below 0 has none. Higher scores come first, ties by smaller id; all, where
    there are fewer. Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id or label, a null or empty vector or any null or non-finite component take no part, nor do vectors
    of another length than the commonest (the longest of those, in a tie). Rows alike in id, label and vector count
    once. Rows that share an id are rows and anchors of their own, but never each other's positives or negatives. An empty table,
    and one without anchors, gives no row; other columns are ignored. Integers of 2**26 or more, and more than 1,024 components, are an error: scores could exceed a long.

    With one more component that brings all vectors to one length, a score is a distance from the anchor, and a window
    of scores an annulus. An upper tree of vantage points over a bounded sample deals all vectors to cells; those with
    too many are divided by a hash, so equal vectors fill no task. Each part has a tree of its own, built once, whose
    leaves are searched nearest first within the annulus until none that is left can hold a better row or an equal one
    with a smaller id. All of it is exact: bounds only leave out what can't be among the results.
    """
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.expr("NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(embedding).cast("array<double>").alias("e"), F.coalesce(anchors, F.lit(False)).alias("asked")).where(usable)
    spark, result = vectors.sparkSession, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    sizes = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    dim = sizes[0]["d"]
    scaled = F.transform("e", lambda x: F.floor(F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST))) * scale).cast("bigint"))
    whole = rows.where(F.size("e") == dim).select("id", "label", scaled.alias("y"), "asked")
    square = F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, largest, length = whole.agg(F.count("*"), F.max(F.array_max(F.transform("y", F.abs))), F.max(square)).first()
    if largest >= MOST or dim > WIDE:
        raise ValueError(f"components times {scale} have to be less than {MOST}, and vectors no longer than {WIDE}")
    y = F.col("y").cast("array<int>").alias("y")
    with Workspace(spark) as tables:
        distinct = tables.keep(whole.select("id", "label", y, "asked").groupBy("id", "label", "y").agg(F.max("asked").alias("asked")))
        # Requests are numbered by a hash of the whole row.
        chosen = tables.keep(distinct.where("asked").select(F.xxhash64("id", "label", "y").alias("anchor"), "id", "label", "y"))
        if chosen.isEmpty():
            return spark.createDataFrame([], result)
        index = Index(tables, distinct.select("id", "label", "y"), n, length, part_rows)
        rows = chosen.select("anchor", "y", "label", F.col("id").alias("own"))
        all_ = {"window": F.array("anchor"), "low": F.array(F.lit(-(2**62))), "high": F.array(F.lit(2**62))}
        near = index.search(tables, rows.withColumns(all_), positives, True).withColumnRenamed("window", "anchor")
        # Positives of one score share a window; there is none below 0, where its ends would cross.
        exact = F.col("score").cast("decimal(38,0)")
        ends = {"low": F.ceil(exact * low[0] / low[1]), "high": F.floor(exact * high[0] / high[1])}
        windows = near.where("score >= 0").select("anchor", "score").distinct().withColumn("window", F.xxhash64("anchor", "score"))
        windows = tables.keep(windows.withColumns({x: c.cast("bigint") for x, c in ends.items()}).where("low <= high"))
        lists = windows.groupBy("anchor").agg(F.collect_list(F.struct("window", "low", "high")).alias("w")).select("anchor", *(F.col(f"w.{x}").alias(x) for x in ("window", "low", "high")))
        hard = index.search(tables, rows.join(lists, "anchor"), negatives, False)
        pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(windows.select("anchor", F.col("score").alias("positive_score"), "window"), ["anchor", "positive_score"])
        out = pairs.join(hard.select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "window").join(chosen.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        return cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: The same in SQL, by all inner products, over ``embeddings`` with the labels of the query.
ORACLE = """WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.l = b.l AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 3"""
