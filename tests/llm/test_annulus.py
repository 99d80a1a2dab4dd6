import math
import random

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from textloom.llm import annulus, queries
from textloom.session import Workspace

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor int, y string, score double, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "x", 0.5, "z") for i, v, c in rows], SCHEMA)


def brute(rows, dim=4, every=10):
    """All inner products, in Python's integers."""
    kept = {(i, c, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, c in rows if i is not None and c is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in kept if b[0] != a[0])
        for p, i, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [(n, j) for n, j, c in scored if c != a[1] and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a[0], i, r + 1, j, -p, -n) for r, (n, j) in enumerate(fits)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def random_rows(n, grid, seed=0, centres=1):
    """On a grid many scores tie."""
    rng = random.Random(seed)
    at = [[rng.gauss(0, 3 * (centres > 1)) for _ in range(4)] for _ in range(centres)]
    draw = lambda i, j: at[i % centres][j] + rng.gauss(0, 1)
    return [(i, [round(draw(i, j) * grid) / grid if grid else draw(i, j) for j in range(4)], rng.randrange(4)) for i in range(n)]


ODD = [(2000, None, 1), (2010, [], 1), (2020, [0.0] * 4, 1), (2030, [1.0, None, 0.0, 0.0], 1), (2040, [float("nan"), 1.0, 0.0, 0.0], 1), (2050, [float("inf"), 1.0, 0.0, 0.0], 1), (2060, [1.0, 2.0], 1), (None, [1.0] * 4, 1), (2070, [1.0] * 4, None), (2080, [0.0] * 4, 2)]


@pytest.mark.parametrize(("grid", "leaf", "part_rows", "cells"), [(0, 256, 8192, 4096), (2, 8, 40, 4), (1, 3, 16, 64), (0, 5, 1000, 1)])
def test_same_as_all_products(spark, monkeypatch, grid, leaf, part_rows, cells):
    """Small leaves, parts and cells; a third of the rows are one vector, and rows and ids are repeated."""
    for name, value in (("LEAF", leaf), ("CELLS", cells), ("FEW", 100), ("SET_ROWS", 9), ("ASKED", 7)):
        monkeypatch.setattr(annulus, name, value)
    rows = random_rows(240, grid) + [(1000 + i, [0.5, 1.0, 0.0, -0.5], i % 3) for i in range(120)]
    rows += rows[:30] + [(i, v[::-1], (c + 1) % 4) for i, v, c in rows[:30]] + ODD
    assert found(annulus.mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, part_rows=part_rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(10, [1.0, 0.0, 0.0, 0.0], 1)], [(10, [1.0] * 4, 1), (20, [1.0] * 4, 1), (30, [0.9] * 4, 2)], [(11, [1.0] * 4, 1)], [(i, [0.0] * 4, i % 2) for i in range(30)], [(i, [-1.0, 0.0, 0.0, float(i % 3)], i % 2) for i in range(40)], ODD])
def test_few_and_none(spark, rows):
    got = annulus.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and found(got) == brute(rows)


def test_large_numbers(spark):
    rows = [(i, [v * 30_000 for v in x], c) for i, x, c in random_rows(60, 0, 3)]
    assert found(annulus.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows)
    with pytest.raises(ValueError, match="less than"):
        annulus.mine(frame(spark, [(10, [1e9] * 4, 1)]), F.col("vec_id") % 10 == 0)


def test_bounds_hold():
    """No row is nearer or farther than its leaf's bounds say, also where all vectors are equal."""
    rng = np.random.default_rng(2)
    for x in (rng.integers(-300, 300, size=(700, 5)), np.full((100, 5), 7), np.zeros((10, 5), dtype=np.int64)):
        length = float((x * x).sum(axis=1).max())
        tree = annulus.VantageTree(annulus._space(x, length), 16)
        asked = rng.integers(-400, 400, size=(50, 5))
        points = np.concatenate((asked, np.zeros((50, 1))), axis=1)
        away = annulus._apart(points, annulus._space(x[tree.vantage], length))
        above, below = annulus.scores_of(*annulus.reach(away, tree.path, tree.near, tree.far), (asked * asked).sum(axis=1).astype(float), length)
        score, leaf = asked @ x[tree.order].T, np.repeat(np.arange(len(tree.ends) - 1), np.diff(tree.ends))
        assert (score <= above[:, leaf]).all() and (score >= below[:, leaf]).all() and sorted(tree.order) == list(range(len(x)))
        cells = annulus.Cells(x, 8, length)
        above, below = cells.reached(asked)
        of = cells.of(x)
        assert (asked @ x.T <= above[:, of]).all() and (asked @ x.T >= below[:, of]).all()


def test_far_parts_are_not_asked(spark, monkeypatch):
    """Of vectors of one length in groups, an anchor that looks for near ones sees few parts."""
    monkeypatch.setattr(annulus, "FEW", 1000)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(60, 8)), 50, axis=0) + 0.1 * rng.normal(size=(3_000, 8))
    y = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    length = float((y * y).sum(axis=1).max())
    df = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(y.tolist())], "id bigint, label bigint, y array<int>")
    with Workspace(spark) as tables:
        index = annulus.Index(tables, df, len(y), length, 50)
        parts = index.trees.count()
        asked = df.where("id % 50 = 0").select(F.col("id").alias("anchor"), "y", "label", F.col("id").alias("own"), F.array("id").alias("window"), F.array(F.lit(int(0.95 * length)).cast("bigint")).alias("low"), F.array(F.lit(2**62)).alias("high"))
        sent = asked.transform(annulus.in_arrow, annulus._sent(index.cells, index.first, 1, False), annulus._REQUEST).count()
    assert parts > 60 and sent < 0.3 * parts * 60


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_same_as_sql(spark, size):
    folder = f"/root/testdata/{size}"
    same(queries.op11_hard_negatives(spark, folder), queries.ORACLES["op11_hard_negatives"], folder)
