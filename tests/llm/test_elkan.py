import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from oracle import same

from textloom.llm import elkan, queries

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, id int, v string, `upper` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 1, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k, rounds, length=4, scale=64):
    """Every distance of every round, in Python's integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = defaultdict(int)
    for _, j, d in found:
        sums[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], sum(sums.values()), digest[j]) for i, j, d in found), key=str)


def found(df):
    return sorted((tuple(x)[:6] for x in df.collect()), key=str)


ODD = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 1.0, 0.0, 0.0]), (904, [float("-inf"), 1.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [0.0] * 5), (907, [0.0] * 4), (None, [0.5] * 4), (None, [-0.5] * 4)]


@pytest.mark.parametrize("grid", [0, 4])
def test_same_as_all_distances(spark, grid):
    """On a coarse grid most distances tie; half of the rows are one vector, and rows and ids are repeated."""
    rng = random.Random(grid)
    rows = [(i, [round(rng.gauss(0, 1) * grid) / grid if grid else rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.25, 0.5, -0.25, 0.0]) for i in range(300)] + rows[:40] + [(i, v[::-1]) for i, v in rows[:40]] + ODD
    got = elkan.cluster(frame(spark, rows).repartition(5), k=9, length=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "calculations"]
    assert found(got) == brute(rows, 9, 3)


def test_bounds_save_distances_and_lose_nothing(spark):
    rng = random.Random(1)
    rows = [(i, [10 * (i % 5) + rng.random(), 7 * (i % 3) + rng.random(), 0.0, 0.0]) for i in range(400)]
    got = elkan.cluster(frame(spark, rows), k=8, length=4, rounds=5)
    assert found(got) == brute(rows, 8, 5) and got.agg({"calculations": "sum"}).first()[0] < 0.5 * 400 * 8 * 6


def test_bounds_hold_in_every_round():
    rng = np.random.default_rng(3)
    x, centroids = rng.integers(-60, 60, size=(500, 6)).astype(np.int64), rng.integers(-60, 60, size=(7, 6)).astype(np.int64)
    state, moved = elkan.Bounds(centroids, None).begin(x), None
    for _ in range(5):
        state = elkan.Bounds(centroids, moved).run(x, *state)
        true = np.sqrt(((x[:, None] - centroids[None]) ** 2).sum(axis=2))
        assert (state[0] == true.argmin(axis=1)).all() and (state[1] >= true.min(axis=1)).all() and (state[2] <= true).all()
        old, centroids = centroids, np.array([x[state[0] == j].sum(axis=0) // (state[0] == j).sum() if (state[0] == j).any() else c for j, c in enumerate(centroids)])
        moved = np.sqrt(((old - centroids) ** 2).sum(axis=1)) * (1 + 1e-12)


@pytest.mark.parametrize("rows", [[], [(5, [0.1, 0.2, 0.3, 0.4])], [(5, None)], [(5, [0.5] * 4)] * 6, [(i, [100_000.0 + i, 0.0, -90_000.0, 1.0]) for i in range(20)]])
def test_few_equal_and_large(spark, rows):
    assert found(elkan.cluster(frame(spark, rows), k=3, length=4)) == brute(rows, 3, 3)


def test_too_large(spark):
    with pytest.raises(ValueError, match="less than"):
        elkan.cluster(frame(spark, [(1, [1e30, 0.0, 0.0, 0.0])]), length=4)


def test_nothing_is_left(spark, tmp_path):
    """Only the result's own table stays in the shared folder."""
    import os

    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = {x for x in os.listdir(folder) if x.startswith("work-")}
    elkan.cluster(frame(spark, [(i, [float(i), 0.0, 0.0, 1.0]) for i in range(50)]), k=3, length=4)
    assert {x for x in os.listdir(folder) if x.startswith("work-")} <= before


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, size):
    folder = f"/root/testdata/{size}"
    same(queries.op13_elkan(spark, folder), queries.ORACLES["op13_elkan"], folder)
