"""Vector operators on small input, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import vectors


def test_cross_entropy_is_stable_and_masked(spark):
    rows = spark.createDataFrame([([1000.0, 999.0], 0), ([-1000.0, -1000.0], 1), ([0.0, 1.0], -100), ([0.0, 1.0], None), (None, 1)], "l array<double>, t int")
    got = [x[0] for x in rows.select(vectors.cross_entropy(F.col("l"), F.col("t"))).collect()]
    assert got[0] == pytest.approx(math.log(1 + math.exp(-1))) and got[1] == pytest.approx(math.log(2)) and got[2:] == [None, None, None]
    with pytest.raises(Exception, match="no such class"):
        spark.createDataFrame([([1.0], 3)], "l array<double>, t int").select(vectors.cross_entropy(F.col("l"), F.col("t"))).collect()


def test_sequence_loss_counts_what_is_shown(spark):
    rng = random.Random(1)
    rows = [(i, [[rng.gauss(0, 3) for _ in range(5)] for _ in range(i)], [rng.choice([-100, 0, 4]) for _ in range(i)], [rng.randrange(2) for _ in range(i)]) for i in range(6)]
    loss = lambda z, t: math.log(sum(math.exp(x) for x in z)) - z[t]
    df = spark.createDataFrame(rows, "i int, l array<array<double>>, t array<int>, m array<int>")
    for masked in (True, False):
        got = df.select("i", vectors.sequence_loss(F.col("l"), F.col("t"), F.col("m") if masked else None).alias("x")).select("i", "x.*").orderBy("i").collect()
        for (_, z, t, m), x in zip(rows, got, strict=True):
            each = [loss(a, b) for a, b, c in zip(z, t, m, strict=True) if b >= 0 and (c or not masked)]
            assert x.tokens == len(each) and x.total == pytest.approx(sum(each))
    assert df.where("i = 0").select(vectors.mean_loss(F.lit(0.0), F.lit(0))).first()[0] is None


def test_lookup_keeps_order_and_splits_hot_ids(spark):
    ids = {0: [7] * 3_000, 1: [], 2: [1, 99, 7, 2], 3: None, 4: [None, 2]}
    table = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(20)], "id int, vector array<double>")
    rows = spark.createDataFrame(list(ids.items()), "k int, ids array<int>")
    got = {x.k: x.vectors for x in vectors.lookup(rows, table, "k").collect()}
    assert got == {k: [[float(i), -float(i)] if i is not None and i < 20 else None for i in v or []] for k, v in ids.items()}


def test_no_task_gathers_a_hot_id(spark):
    """One repeated token: rows of the join's tasks by the salt that the places have."""
    rows = spark.createDataFrame([(k, [7] * 500) for k in range(40)], "k int, ids array<int>")
    table = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id int, vector array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = vectors.lookup(rows, table, "k", salts=512)
        joined = plan._jdf.queryExecution().toString()
        assert "SortMergeJoin" in joined or "ShuffledHashJoin" in joined
        places = rows.select("k", F.posexplode("ids").alias("p", "i")).withColumn("s", F.pmod(F.xxhash64("k", "p"), F.lit(512)).cast("int"))
        sizes = sorted(x["count"] for x in places.repartition(4, "i", "s").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pool_weighs_and_leaves_out(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 3), ("a", None, 1), ("a", [1.0], 1), (None, [5.0, 5.0], 2)], "k string, v array<float>, w int")
    assert {x.k: (x.n, x.pooled) for x in vectors.mean_pool(rows, ["k"], "v", 2).collect()} == {"a": (2, [2.0, 4.0]), None: (1, [5.0, 5.0])}
    assert {x.k: (x.n, x.pooled) for x in vectors.mean_pool(rows, ["k"], "v", 2, F.col("w")).collect()} == {"a": (4, [2.5, 5.0]), None: (2, [5.0, 5.0])}


@pytest.mark.parametrize(("width", "block", "group", "out"), [(7, 3, 2, 5), (4, 4, 8, 3), (5, 1, 1, 3), (6, 100, 100, 9)])
def test_product_by_blocks(spark, width, block, group, out):
    rng = random.Random(width)
    x = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    w = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(out)]
    rows = spark.createDataFrame(list(enumerate(x)), "k int, v array<double>")
    weights = spark.createDataFrame(list(enumerate(w)), "row int, values array<double>")
    want = [[sum(a * b for a, b in zip(r, c, strict=True)) for c in w] for r in x]
    got = {y.k: y.out for y in vectors.product(rows, weights, "k", "v", "out", width=width, block=block, group=group).collect()}
    assert all(got[i] == pytest.approx(y) for i, y in enumerate(want)) and len(got) == 9
    missing = vectors.product(rows, weights.where("row <> 1"), "k", "v", "out", width=width, block=block, group=group).where("k = 0").first().out
    assert missing == pytest.approx([0.0 if i == 1 else y for i, y in enumerate(want[0])])
    assert vectors.product(rows, weights.where("false"), "k", "v", "out", width=width).first().out == []


def test_low_rank_with_bias(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "k int, v array<double>")
    down = spark.createDataFrame([(0, [1.0, 0.0, 1.0]), (1, [0.0, 1.0, 0.0])], "row int, values array<double>")
    up = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 2.0]), (2, [1.0, 0.0])], "row int, values array<double>")
    got = vectors.low_rank(rows, down, up, "k", "v", "out", [2.0, 0.5], 3, [0.0, 10.0, 0.5], block=2, group=2).first().out
    assert got == pytest.approx([9.0, 12.0, 8.5])


def test_mixture(spark):
    rows = spark.createDataFrame([([2.0, 0.0],), ([1.0, 1.0],)], "v array<double>")
    made = vectors.mixture(F.col("v"), [[1.0, 0.0], [0.0, 1.0]], [[10.0], [20.0]], ["a", "b"])
    x, y = rows.select(*(c.alias(n) for n, c in made.items())).collect()
    p = math.exp(2) / (math.exp(2) + 1)
    assert (x.task, x.share, x.mixed[0]) == ("a", pytest.approx(p), pytest.approx(20 - 10 * p)) and (y.task, y.mixed[0]) == ("a", pytest.approx(15.0))
    with pytest.raises(ValueError, match="each task"):
        vectors.mixture(F.col("v"), [[1.0]], [], [])


def test_mixture_computes_each_part_once(spark):
    """As many exponentials stand in the plan whatever the width: one for the softmax and one for its scale, a column."""
    unit = lambda i, n: [float(i == j) for j in range(n)]
    for width in (2, 64):
        rows = spark.createDataFrame([(unit(0, width),)], "v array<double>")
        made = vectors.mixture(F.col("v"), [unit(0, width), unit(1, width)], [unit(0, width), unit(1, width)], ["a", "b"])
        for name, column in made.items():
            assert rows.select(column.alias(name))._jdf.queryExecution().analyzed().toString().count("EXP(") == 2
        plan = rows.select(F.inline(F.array(vectors.mixed(F.col("v"), [unit(0, width)], [unit(1, width)], ["a"]))))
        assert plan._jdf.queryExecution().analyzed().toString().count("EXP(") == 2 and plan.first().mixed == unit(1, width)
