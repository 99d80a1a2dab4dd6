import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import prefix_forest, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and usable(v)]
    out = {}
    for q, x in rows:
        if q % 10 == 0:
            near = sorted({(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q})[:k]
            out[q] = [(i, r + 1, s) for r, (s, i) in enumerate(near)]
    return out


def found(df):
    out = {}
    for x in df.collect():
        out.setdefault(x.query_id, []).append((x.vec_id, x["rank"], x.score))
    return {q: sorted(v, key=lambda y: y[1]) for q, v in out.items()}


def random_rows(n, copies):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return rows + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(copies)]


def test_exact_where_all_are_candidates(spark):
    odd = [(2000, None), (2010, []), (2020, [0.0] * 4), (2030, [1.0, None, 0.0, 0.0]), (2040, [float("nan"), 1.0, 0.0, 0.0]), (2050, [float("inf"), 1.0, 0.0, 0.0]), (2060, [1.0, 2.0]), (None, [1.0] * 4)]
    rows = random_rows(60, 40) + odd
    got = found(prefix_forest.search(frame(spark, rows), F.col("vec_id") % 10 == 0, wide=1e9))
    assert got == brute(rows, 10)


def test_repeated_rows_count_once(spark):
    rows = random_rows(12, 0)
    assert found(prefix_forest.search(frame(spark, rows * 3), F.col("vec_id") % 10 == 0)) == brute(rows, 10)


def test_few_and_none(spark):
    for rows in ([], [(10, [1.0, 0.0, 0.0, 0.0])], [(10, [1.0, 0.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0])], [(10, None)]):
        assert found(prefix_forest.search(frame(spark, rows), F.col("vec_id") % 10 == 0)) == {q: v for q, v in brute(rows, 10).items() if v}


def test_recall_by_prefixes(spark):
    """With few candidates asked for, most queries stop at a prefix; those that are found have exact distances."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    vectors = np.concatenate([c + rng.normal(size=(50, 16)) for c in centres]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = found(prefix_forest.search(df, F.col("vec_id") % 10 == 0, trees=24))
    hits = 0
    for q, near in got.items():
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & {i for i, _, _ in near})
        assert all(abs(d[i] - s) < 1e-12 for i, _, s in near) and len(near) == 10
    assert len(got) == 200 and hits / 2000 >= 0.9


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = found(queries.op4_prefix_forest(spark, folder))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & {i for i, _, _ in got[q]})
    assert hits >= 0.9 * 10 * len(got)


def built(x):
    forest = prefix_forest.Forest(np.zeros(x.shape[1]))
    return forest, prefix_forest.Trees(np.concatenate([forest.keys(x[a : a + 4096]) for a in range(0, len(x), 4096)], axis=1), forest.head)


def test_candidates_are_distinct_and_recall_holds():
    """At each size queries stop at a prefix that holds its due of distinct vectors; the root is reached by none."""
    rng = np.random.default_rng(5)
    for n, depth in ((1_000, 1), (12_000, 2), (48_000, 2)):
        x = rng.normal(size=(n, 64))
        forest, trees = built(x)
        due, hits, lengths = prefix_forest.due_share(n) * n, 0, []
        for y, (length, at) in zip(x[:50], trees.candidates(forest.keys(x[:50]), due), strict=True):
            lengths.append(length)
            assert len(set(at.tolist())) == len(at) and due <= len(at) < 1.1 * due + 20
            d = ((x - y) ** 2).sum(axis=1)
            hits += len(set(np.argsort(d)[1:11]) & set(at.tolist()))
        assert min(lengths) >= 1 and max(lengths) >= depth and hits >= 0.9 * 500, (n, hits, lengths)


def test_ranges_are_prefixes():
    """The ranges of each length are those of a plain comparison of symbols, and the ascent's result is their union."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(300, 8)), 1 + 0.05 * rng.normal(size=(300, 8))))
    forest, trees = built(x)
    keys = forest.keys(x)
    for length in (1, 2, 5, prefix_forest.TAIL + 1):
        rest = 2 * (prefix_forest.TAIL + 1 - length)
        begins, ends = trees.ranges(keys[:, :7], np.full(7, length))
        for tree in range(0, forest.trees, 40):
            for q in range(7):
                assert set(trees.order[tree][begins[tree, q] : ends[tree, q]].tolist()) == set(np.flatnonzero(keys[tree] >> rest == keys[tree, q] >> rest).tolist())
    for q, (length, at) in enumerate(trees.candidates(keys[:, 290:310], 60)):
        under = lambda n, q=q: set(np.flatnonzero((keys >> 2 * (prefix_forest.TAIL + 1 - n) == (keys[:, 290 + q] >> 2 * (prefix_forest.TAIL + 1 - n))[:, None]).any(axis=0)).tolist())
        below, through = under(length + 1) if length <= prefix_forest.TAIL else set(), under(length)
        assert below <= set(at.tolist()) <= through and len(below) < 60 <= len(at)


def test_longer_prefixes_name_their_share():
    """Vectors in few narrow clusters: longer prefixes hold the due, and the nearest are found there."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 64))
    x = np.concatenate([c + 0.02 * rng.normal(size=(1000, 64)) for c in centres])
    forest, trees = built(x)
    due = prefix_forest.due_share(len(x)) * len(x)
    got = list(trees.candidates(forest.keys(x[::100]), due))
    assert min(length for length, _ in got) > 2
    hits = 0
    for y, (_, at) in zip(x[::100], got, strict=True):
        assert len(at) >= due
        hits += len(set(np.argsort(((x - y) ** 2).sum(axis=1))[:10]) & set(at.tolist()))
    assert hits >= 0.9 * 10 * len(got)
