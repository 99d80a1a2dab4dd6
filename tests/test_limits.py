"""Limits that stop early, logs that only append, metrics of running jobs, rules in plans, exact formats."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text
from textloom.operators import curate, runs
from textloom.sources import files, jsonl, runstore


def bytes_read(spark, action):
    """What tasks read for an action, by Spark's own count."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalInputBytes()

    before = total()
    action()
    return total() - before


def test_a_head_reads_the_first_blocks_only(spark, tmp_path):
    """With eight times the rows (in files sorted by id) the first ones cost about as much."""
    read = {}
    for n in (40_000, 320_000):
        path = f"{tmp_path}/{n}"
        rows = spark.range(0, n, 1, n // 10_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("m"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        rows.write.option("parquet.block.size", 1 << 18).parquet(path)
        table = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(path)  # what other threads read isn't counted
        for name, rule, raw in (("loaded", None, False), ("accepted", F.col("m") == 1, False), ("raw", F.col("m") == 1, True)):
            got = []
            read[n, name] = bytes_read(spark, lambda rule=rule, raw=raw, got=got, table=table: got.extend(curate.head(table, 50, "k", rule, raw).collect()))
            want = [k for k in range(n) if rule is None or k % 3 == 1][:50] if not raw else [k for k in range(50) if k % 3 == 1]
            assert sorted(x.k for x in got) == want
        whole = bytes_read(spark, lambda table=table: table.write.format("noop").mode("overwrite").save())
        read[n, "column"] = bytes_read(spark, lambda table=table: table.agg(F.min("k")).collect())
    # What is read besides that column are the first blocks, and for each try the ends of all files.
    more = {x: (read[320_000, x] - read[320_000, "column"]) - (read[40_000, x] - read[40_000, "column"]) for x in ("loaded", "accepted", "raw")}
    assert max(more.values()) < 28 * 16_384 * 4 and read[320_000, "accepted"] - read[320_000, "column"] < 0.15 * whole, (read, whole)


def test_heads_of_odd_tables(spark):
    rows = spark.createDataFrame([(5, "a"), (None, "n"), (10**12, "z"), (-7, "b")], "k bigint, v string")
    assert [x.v for x in curate.head(rows, 2, "k").collect()] == ["n", "b"]
    assert sorted(x.v for x in curate.head(rows, 4, "k").collect()) == ["a", "b", "n", "z"] and curate.head(rows, 9, "k").count() == 4
    assert curate.head(rows.where("false"), 3, "k").count() == 0 and [x.v for x in curate.head(rows, 1, "k", F.col("v") > "n").collect()] == ["z"]


def test_scans_stop_with_the_file_that_has_enough(spark, tmp_path):
    schema, rng = "query_code string, query_dataclass_code string", random.Random(1)
    line = lambda f, i: "{bad" if i % 5 == 0 else json.dumps({"query_code": f"def f{f}_{i}(): return {i}", "query_dataclass_code": "x" * rng.randrange(9)})
    for f in range(30):
        (tmp_path / f"p{f:02}.jsonl").write_text("".join(line(f, i) + "\n" for i in range(200)))
    path, read = str(tmp_path), {}
    size = sum(x.stat().st_size for x in tmp_path.iterdir())
    read["skipping"] = bytes_read(spark, lambda: jsonl.read_skipping(spark, path, schema, 20)[0].collect())
    read["accepted"] = bytes_read(spark, lambda: jsonl.read_accepted(spark, path, schema, 20))
    read["raw"] = bytes_read(spark, lambda: jsonl.head_raw(spark, path, 20).collect())
    assert all(0 < x < 0.5 * size for x in read.values())
    assert [x.line for x in jsonl.read_skipping(spark, path, schema, 250)[0].orderBy("line").collect()] == [i for i in range(600) if i % 5][:250]
    taken, skipped = jsonl.read_accepted(spark, path, schema, 170)
    assert taken.count() == 170 and skipped == 43 and jsonl.head_raw(spark, path, 450).count() == 450 and jsonl.head_raw(spark, path, 10**6).count() == 6_000


def test_a_log_appends(spark, tmp_path, monkeypatch):
    """Each metric's file is opened once, and a log that goes on keeps what an earlier one wrote."""
    opened = []
    plain = files.Appended
    monkeypatch.setattr(files, "Appended", lambda *a: opened.append(a[1]) or plain(*a))
    for k in range(2):
        log = runstore.RunLog(spark, str(tmp_path), "1", "r", "n", clock=lambda: 5)
        for step in range(100):
            log.metrics(1000 * k + step, loss=float(step), rate=0.5)
        log.end()
    assert len(opened) == 4
    got = runstore.read_metrics(spark, str(tmp_path))
    assert got.count() == 400 and got.where("key = 'loss'").agg(F.max("step"), F.sum("value")).first()[:] == (1099, 9900.0)


def test_metrics_of_a_job(spark):
    rows, metrics = runs.observed(spark.range(100).withColumn("x", F.col("id") * 2), n=F.count("*"), total=F.sum("x"), most=F.max("id"))
    rows.write.format("noop").mode("overwrite").save()
    assert metrics() == {"n": 100, "total": 9900, "most": 99}


def test_each_step_calls_back_in_order(spark, tmp_path):
    """Four micro-batches: what the callback is told, and when."""
    import os

    for k in range(4):
        path = tmp_path / f"in{k}.json"
        path.write_text("".join(json.dumps({"loss": float(k), "n": i}) + "\n" for i in range(k + 1)))
        os.utime(path, (1_000 + k, 1_000 + k))
    told = []
    stream = spark.readStream.schema("loss double, n int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    with runs.each_step(stream, lambda step, metrics: told.append((step, metrics)), loss=F.avg("loss"), rows=F.count("*")) as watched:
        query = watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if len(told) == 4:
                break
            import time

            time.sleep(0.1)
    assert told == [(k, {"loss": float(k), "rows": k + 1}) for k in range(4)]


def test_broken_configurations_fail_the_job(spark):
    rows = spark.createDataFrame([("good", 128, 4, None), ("odd", 130, 4, None), ("both", 130, 4, 2.0), ("none", None, None, None)], "name string, width int, heads int, dropout double")
    found = {x["name"]: x.broken for x in config.judged(rows).collect()}
    assert found["good"] == [] == found["none"] and len(found["odd"]) == 1 and len(found["both"]) == 2
    assert config.validated(rows.where("name in ('good', 'none')"), "name").count() == 2
    assert config.validated(rows.where("name in ('good', 'none')"), "name").columns == rows.columns
    with pytest.raises(Exception, match="configuration both: width has to be a multiple of heads; dropout has to be from 0 to 1"):
        config.validated(rows.where("name <> 'odd'"), "name").collect()
    # The same verdicts as those of configurations made one by one.
    rng = random.Random(4)
    many = [(i, rng.choice([64, 65, 128]), rng.choice([0, 1, 4]), rng.choice([-1.0, 0.0, 0.5, 1.5]), rng.choice([0.0, 0.5, 1.0]), rng.choice([0, 3, 9]), rng.choice([3, 9, 500]), rng.choice([["q"], ["q", "z"], []])) for i in range(60)]
    table = spark.createDataFrame(many, "i int, width int, heads int, dropout double, share double, span_low int, span_high int, targets array<string>")
    for x in config.judged(table).collect():
        try:
            config.TrainingConfig(width=x.width, heads=x.heads, dropout=x.dropout, share=x.share, span=(x.span_low, x.span_high), targets=tuple(x.targets))
            said = ""
        except ValueError as error:
            said = str(error)
        assert "; ".join(x.broken) == said


def test_runs_of_other_steps_align(spark):
    rows = spark.createDataFrame([("a", 0, 5.0), ("a", 7, 3.0), ("a", 12, 2.0), ("b", 3, 4.0), ("b", 10, 1.0), ("b", 30, 0.5), ("b", None, 9.0), ("b", 31, None)], "r string, s bigint, v double")
    assert sorted(tuple(x) for x in runs.held(rows, "r", "s", "v", 5).collect()) == [("a", 0, 5.0), ("a", 5, 5.0), ("a", 10, 3.0), *[("b", s, v) for s, v in ((5, 4.0), (10, 1.0), (15, 1.0), (20, 1.0), (25, 1.0), (30, 0.5))]]
    assert [tuple(x) for x in runs.compare(rows, "r", "s", "v", 5).orderBy("rank").collect()] == [("b", 10, 1.0, 1.0, 2, 1, 0.0), ("a", 10, 3.0, 3.0, 3, 2, 2.0)]
    apart = rows.where("r = 'a'").unionAll(spark.createDataFrame([("c", 90, 1.0)], rows.schema))
    assert runs.compare(apart, "r", "s", "v", 5).count() == 0


def test_exact_formats(spark):
    """As Python writes them: ties, neighbours of ties, carries, signs, and sizes from 1e-9 to 1e19."""
    rng = random.Random(2)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, 0.125, 2.675, 1.005, 0.045, 3085.0, 6.25, 9.995, 99.5, 999.5, 0.9999999, 5e-324, 1e-9, -0.004, 123456789.125, 2.0**53, 2.0**62 + 2**20, 1e19, 1e22, 1e23, 4503599627370497.5, 1e-7]
    for _ in range(1_500):
        v = rng.choice([rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 17), round(rng.uniform(0, 2000)) / 8, (2 * rng.randrange(10**6) + 1) / 2 / 10 ** rng.randrange(5), rng.randrange(10**7) * 5.0])
        values += [v, math.nextafter(v, math.inf), math.nextafter(v, -math.inf)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", *(text.fixed(F.col("v"), p).alias(f"f{p}") for p in (0, 1, 2, 4, 8)), text.fixed(F.col("v"), 2, grouped=True).alias("g"), text.power(F.col("v")).alias("e")).collect()
    for x in got:
        v = values[x.i]
        assert [x.f0, x.f1, x.f2, x.f4, x.f8, x.g] == [f"{v:.0f}", f"{v:.1f}", f"{v:.2f}", f"{v:.4f}", f"{v:.8f}", f"{v:,.2f}"], v
        if v == 0 or 1e-8 <= abs(v) < 1e17:
            assert x.e == f"{v:.2e}", v
    odd = [x[0] for x in spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(text.fixed(F.col("v"), 2)).collect()]
    assert odd == ["NaN", "Infinity", None]
