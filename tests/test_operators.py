"""Rules that are easily got wrong: gaps of ladders, limits, fallbacks, exact splits, label sets."""

import itertools

import pytest
from pyspark.sql import functions as F

from textloom.functions import ladders, schedule, text
from textloom.operators import curate, evaluate, runs, sequences, stats
from textloom.sources import jsonl, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("rules", "cases"), [
    (ladders.CYCLOMATIC, "0 exponential 1 constant 4 constant 5 exponential 6 linear 9 linear 10 exponential 11 quadratic 19 quadratic 20 exponential 21 cubic 49 cubic 50 exponential 51 exponential"),
    (ladders.COGNITIVE, "0 constant 4 constant 5 exponential 6 linear 14 linear 15 exponential 16 quadratic 30 exponential 31 cubic 60 exponential 61 exponential"),
])
def test_ladder_gaps(spark, rules, cases):
    words = cases.split()
    got = one(spark, *(ladders.ladder(F.lit(int(v)), rules).alias(f"c{i}") for i, v in enumerate(words[::2])))
    assert list(got) == words[1::2]


def test_other_ladders(spark):
    values = (4.99, 5, 10, 20, 40)
    assert one(spark, *(ladders.halstead_class(F.lit(v)) for v in values)) == ("constant", "linear", "quadratic", "cubic", "exponential")
    values = (80, 79.9, 60, 40, 20, 19.9)
    assert one(spark, *(ladders.maintainability_class(F.lit(v)) for v in values)) == ("constant", "linear", "linear", "quadratic", "cubic", "exponential")
    assert one(spark, *(ladders.maintainability_rank(F.lit(v)) for v in (80, 60, 40, 20, 19.9))) == tuple("ABCDF")


def tree(depth, loops, rec, base):
    if rec:
        return "exponential" if depth >= 1 or base > 5 else "nlogn"
    if depth >= 2:
        return {2: "quadratic", 3: "cubic"}.get(depth, "exponential")
    if depth == 1:
        return "nlogn" if (loops > 2 and base > 8) or (loops == 1 and base > 10) else "linear"
    return ("logn" if base > 10 else "constant") if loops == 0 else "linear"


def test_structural_tree(spark):
    grid = [x for x in itertools.product(range(6), range(5), (False, True), (0.0, 5.0, 5.1, 8.0, 8.1, 10.0, 10.1, 99.0))]
    df = spark.createDataFrame(grid, "d int, l int, r boolean, b double")
    got = df.select("*", ladders.structural_class(*map(F.col, "dlrb")).alias("c")).collect()
    assert all(x.c == tree(x.d, x.l, x.r, x.b) for x in got)


def test_evaluation(spark):
    pairs = [("linear", "linear"), ("linear", "cubic"), ("cubic", "cubic"), ("np", "cubic"), ("np", "linear"), ("logn", "logn"), ("logn", None)]
    counts = evaluate.pair_counts(spark.createDataFrame(pairs, "true_complexity string, predicted_complexity string"))
    assert evaluate.accuracy(counts).first()["accuracy"] == 0.5
    means = evaluate.averages(counts).first()
    assert means["recall_weighted"] == pytest.approx(0.5) and means["precision_weighted"] == pytest.approx(0.388889, abs=1e-6) and means["f1_macro"] == pytest.approx(0.5)
    assert {x["error"]: x["n"] for x in evaluate.errors(counts).collect()} == {"linear_as_cubic": 1, "np_as_cubic": 1, "np_as_linear": 1}
    assert sum(sum(v for v in x.asDict().values() if isinstance(v, int)) for x in evaluate.confusion(counts).collect()) == 4
    assert evaluate.distances(counts).first()["pairs"] == 4
    labels = {x["label"] for x in evaluate.report(counts).collect()}
    assert "micro avg" in labels and "accuracy" not in labels


def test_evaluation_of_nothing(spark):
    counts = evaluate.pair_counts(spark.createDataFrame([], "true_complexity string, predicted_complexity string"))
    assert evaluate.accuracy(counts).first()["accuracy"] == 0
    assert evaluate.per_class(counts).agg(F.sum("support")).first()[0] == 0
    assert evaluate.distances(counts).first()["max_distance"] == 0


def test_code_fallback_and_length(spark):
    rows = [(0, None, "alternative"), (1, "", "alternative"), (2, "   ", "alternative"), (3, "123456789", "x"), (4, "1234567890", "x"), (5, "\t 12345678901\u00a0", "x")]
    df = spark.createDataFrame(rows, "i int, query_code string, query_dataclass_code string")
    assert [x.i for x in curate.curate(df).orderBy("i").collect()] == [0, 1, 4, 5]
    strict = df.where(text.long_enough(text.code_of(F.col("query_code"), F.col("query_dataclass_code")), strict=True))
    assert [x.i for x in strict.orderBy("i").collect()] == [0, 1, 5]


def test_complexity_labels(spark):
    cases = [(None, None), ("", "Unknown"), ("UNKNOWN", None), ("unknown", None), ("O(n)", "Unknown"), (None, "O(1)")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [x[0] for x in df.select(text.has_complexity(F.col("a"), F.col("b"))).collect()] == [False, False, False, True, True, True]


def test_exact_split(spark):
    for n, share in ((100, 0.29), (7, 0.5), (1, 0.9), (0, 0.9), (1000, 0.9)):
        got = curate.exact_split(spark.range(n).toDF("id"), share, 3, "id").where("train").count()
        assert got == int(n * share)


def test_limits(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "i int, k int")
    ids = lambda x: [r.i for r in x.orderBy("i").collect()]
    assert ids(curate.head(df, 3, "i", F.col("k") == 1)) == [1, 3, 5] and ids(curate.head(df, 3, "i", F.col("k") == 1, raw=True)) == [1]
    assert len(ids(curate.head(df, -1, "i"))) == len(ids(curate.head(df, None, "i"))) == 10


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = jsonl.read_skipping(spark, str(path), "a int")
    assert sorted(x.a for x in good.collect()) == [1, 2] and [x.value for x in bad.collect()] == ["not json"]
    assert jsonl.head_raw(spark, str(path), 3).count() == 3
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        jsonl.read_strict(spark, str(path), "a int").collect()
    assert jsonl.read_whole(spark, str(tmp_path / "none.txt")).first()[0] == jsonl.FALLBACK
    with pytest.raises(ValueError, match="unknown language"):
        jsonl.default_path(spark, "cobol", str(tmp_path))


def test_early_stopping(spark):
    df = spark.createDataFrame(list(enumerate((5.0, 4.0, 4.5, 3.0, 3.0, 3.2, 2.0), 1)), "epoch int, loss double")
    got = runs.early_stopping(df, "loss", "epoch", 2).orderBy("epoch").collect()
    assert [x.epoch for x in got if x.stopped] == [6] and len(got) == 6


def test_sequences(spark):
    df = spark.createDataFrame([(0, "ab😀b"), (1, ""), (2, None), (3, "b")], "i int, text string")
    vocabulary = sequences.char_vocabulary(df)
    assert [tuple(x) for x in vocabulary.orderBy("id").collect()] == [("a", 0), ("b", 1), ("😀", 2)]
    coded = sequences.encode(df, vocabulary)
    assert {x.i: x.ids for x in coded.collect()} == {0: [0, 1, 2, 1], 1: [], 2: [], 3: [1]}
    assert {x.i: x.decoded for x in sequences.decode(coded, vocabulary).collect()} == {0: "ab😀b", 1: "", 2: "", 3: "b"}
    x, y = sequences.shift(F.col("ids"))
    assert {r.i: (r.x, r.y) for r in coded.select("i", x.alias("x"), y.alias("y")).collect()}[0] == ([0, 1, 2], [1, 2, 1])
    ids, mask = sequences.pad(F.col("ids"), 3)
    assert {r.i: (r.a, r.m) for r in coded.select("i", ids.alias("a"), mask.alias("m")).collect()} == {0: ([0, 1, 2], [1, 1, 1]), 1: ([0, 0, 0], [0, 0, 0]), 2: ([0, 0, 0], [0, 0, 0]), 3: ([1, 0, 0], [1, 0, 0])}
    assert {r.i: r.c for r in coded.select("i", sequences.crop(F.col("ids"), 2).alias("c")).collect()} == {0: [2, 1], 1: [], 2: [], 3: [1]}
    assert [tuple(r) for r in sequences.windows(coded, "ids", 2).select("start", "x", "y").orderBy("start").collect()] == [(0, [0, 1], [1, 2]), (1, [1, 2], [2, 1])]
    assert [tuple(r) for r in sequences.window_ends(coded, "ids", 2).select("i", "start", "x_first", "x_last", "y_last").orderBy("start").collect()] == [(0, 0, 0, 1, 2), (0, 1, 1, 2, 1)]


def test_bpe_is_lossy(spark):
    tokenizer = sequences.train_bpe(["def f(x):\n", "def g(x):\n"] * 5, 60)
    df = sequences.bpe_encode(spark.createDataFrame([("def f(x): zz\n",), (None,)], "text string"), tokenizer)
    got = [x.decoded for x in sequences.bpe_decode(df, tokenizer).collect()]
    assert "z" not in got[0] and got[1] == ""


def test_timing(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 2.0, 3.0, 4.0)] + [("b", 0.0)], "tool string, execution_time double")
    got = {x.tool: x for x in stats.timing(df, ["tool"]).collect()}
    assert got["a"].mean_time == 2.5 and got["a"].p95_time == pytest.approx(3.85) and got["a"].samples_per_second == 0.5
    assert got["b"].mean_time == 0 and got["b"].p95_time is None


def test_schedules(spark):
    rate = lambda k, s: one(spark, schedule.learning_rate(k, F.lit(s), 100, 1e-3))[0]
    assert rate("cosine", 0) == pytest.approx(1e-3) and rate("cosine", 100) == pytest.approx(1e-6)
    assert rate("linear", 100) == pytest.approx(1e-4) and rate("constant", 50) == 1e-3


def test_text_functions(spark):
    assert one(spark, text.preview(F.lit("x" * 201)))[0] == "x" * 200 + "..." and one(spark, text.preview(F.lit("x" * 200)))[0] == "x" * 200
    assert one(spark, text.pad_right(F.lit("abcdef"), 3), text.pad_right(F.lit("a"), 3)) == ("abcdef", "a  ")
    assert one(spark, text.ratio(F.lit(1), F.lit(0)))[0] == 0
    for source in ("a\r\nb\rc\n\nd", "", "\n", "a\u2028b", "x\x0by"):
        assert one(spark, text.lines(F.lit(source)))[0] == source.splitlines(keepends=True)


def test_configs_and_summary(spark, tmp_path):
    import dataclasses

    @dataclasses.dataclass
    class Config:
        block: int = 128
        rate: float = 1e-3

    sinks.save_config(spark, Config(64), str(tmp_path / "c.json"))
    assert sinks.load_config(spark, Config, str(tmp_path / "c.json")) == Config(64)
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(ValueError, match="unknown"):
        sinks.load_config(spark, Config, str(tmp_path / "d.json"))
    sinks.write_summary(spark.createDataFrame([("a", 1.0)], "tool string, accuracy double"), str(tmp_path / "s.json"))
    assert '"accuracy": 1.0' in (tmp_path / "s.json").read_text()


def test_programs(spark):
    from textloom.plans import programs

    samples = spark.createDataFrame([(0, "for x in a:\n    pass\n", "linear", None), (1, "x = 1\n", "constant", "p"), (2, "def f(:", "np", "p")], "ord int, src string, complexity string, problem string")
    got = programs.analyse(samples)
    summary = {x.tool: x for x in got["summary"].collect()}
    assert len(summary) == 7 and summary["nbd"].total_samples == 3 and summary["nbd"].accuracy == pytest.approx(2 / 3)
    code = spark.createDataFrame([(i, f"value_{i:03d} = {i}", None, "O(1)", None) for i in range(20)], "line int, query_code string, query_dataclass_code string, time_complexity_inferred string, space_complexity_inferred string")
    vocabulary = sequences.char_vocabulary(code, "query_code")
    train, held = programs.batches(code, vocabulary, 8, 4)
    assert train.count() == 4 and all(len(x.input_ids) == 4 for x in train.collect())
    assert sum(len(x.input_ids) for x in held.collect()) == 2


def test_run_store(spark, sf_dir):
    from textloom.plans.training import QUERIES

    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect()
    names = sorted({x.event_type for x in events})
    got = {(x.run_id, x.key): x for x in QUERIES["run_params_pivot"](spark, sf_dir).collect()}
    assert {x for x, _ in got} == {x for k, x in enumerate(names) if k % 5 < 3}  # the failed and the deleted run are left out
    for (name, key), x in got.items():
        own = [e for e in events if e.event_type == name]
        read = [e for e in own if key == "loss" or e.event_id % 100 == 0]
        assert (x.points, x.last_value, x.vocab_size, x.n_layer) == (len(read), read[-1].value, str(len(own)), str(len(name)))
    assert {key for _, key in got} == {"loss", "final"}


def test_metric_append(spark, tmp_path):
    from textloom.sources.runstore import append_metrics

    rows = spark.createDataFrame([("a", "loss", 1, 0, 2.5)], "run_id string, key string, ts long, step long, value double")
    for _ in range(2):
        append_metrics(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_sessions_and_tables(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b" * 300), (1, 1, "user", "a"), (2, 1, "user", "c")], "conv_id int, turn int, role string, text string")
    got = {x.conv_id: x for x in runs.sessions(turns).collect()}
    assert (got[1].steps, got[1].prompt_length, got[1].generated_length, got[1].per_second) == (2, 1, 300, 300.0) and got[2].generated_length == 0
    assert [s.token_text[0] for s in runs.session_records(turns).where("conv_id = 1").first().steps] == ["a", "b"]
    assert runs.metric_table(spark.createDataFrame([("loss", 1234.5)], "k string, v double"), "k", "v", 6).first()[0] == "loss   | 1,234.5000"


def test_logging(tmp_path):
    import logging

    from textloom.session import log_to

    before = logging.getLogger().handlers[:], logging.getLogger().level
    log_to("info", str(tmp_path / "l")).info("hello")
    logging.getLogger().handlers[:], _ = before[0], logging.getLogger().setLevel(before[1])
    assert "hello" in (tmp_path / "l").read_text()


@pytest.mark.parametrize("accuracy", [4, 50, 10_000])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    import numpy as np

    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    groups = {"a": rng.normal(size=900), "b": rng.integers(0, 4, 700).astype(float), None: rng.exponential(size=33), "d": np.array([7.0]), "e": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("f", None)], "k string, v double")
    shares = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x.k: x for x in stats.percentiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert [got[k][n] for n in shares] == pytest.approx([np.percentile(x, 100 * p) for p in shares.values()], abs=1e-12)
    assert stats.percentiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(np.concatenate(list(groups.values()))))
