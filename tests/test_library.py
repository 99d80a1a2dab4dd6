"""Configurations, tokenizers, run logs, scans with limits, registries and reports."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import ladders
from textloom.functions.codemetrics import measure, token_metrics
from textloom.operators import code, curate, evaluate, runs, sequences, tokenizers
from textloom.sources import files, jsonl, runstore, sinks


def lines_file(tmp_path):
    rows = ["", "{bad", *(json.dumps({"query_code": f"def f{i}(): return {i}" if i % 3 else "short", "query_dataclass_code": "x"}) for i in range(30)), "  "]
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path), rows


SCHEMA = "query_code string, query_dataclass_code string"


def test_scan_limits_count_what_they_say(spark, tmp_path):
    path, rows = lines_file(tmp_path)
    good, bad = jsonl.read_skipping(spark, path, SCHEMA, 5)
    assert [x.line for x in good.orderBy("line").collect()] == [2, 3, 4, 5, 6] and [x.value for x in bad.collect()] == ["{bad"]
    assert jsonl.read_skipping(spark, path, SCHEMA, 0)[0].count() == 0 and jsonl.read_skipping(spark, path, SCHEMA)[0].count() == 30
    taken, skipped = jsonl.read_accepted(spark, path, SCHEMA, 4)
    assert [x.line for x in taken.orderBy("line").collect()] == [3, 4, 6, 7] and skipped == 3  # one malformed line, two short codes
    assert jsonl.read_accepted(spark, path, SCHEMA)[1] == 11
    with pytest.raises(ValueError, match="no row"):
        jsonl.read_accepted(spark, path, SCHEMA, keep=F.lit(False))
    # Physical lines: two that aren't samples and one that is too short are among the first five.
    assert jsonl.tokenizer_texts(spark, path, 5) == ["def f1(): return 1", "def f2(): return 2"]
    assert [x.value for x in jsonl.numbered_lines(spark, path).orderBy("line").collect()] == rows


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4000), ("c", 2)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [x.value for x in jsonl.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == [f"{name}{i}" for name, n in (("a", 3), ("b", 4000), ("c", 2)) for i in range(n)]


def test_configurations():
    made = config.preset("code_analysis", "small", batch=4, accumulate=8)
    assert (made.width, made.effective_batch, made.complexity_head) == (128, 32, True)
    assert made.merged(rate=1e-3).rate == 1e-3
    for broken, said in (({"width": 130}, "multiple"), ({"share": 1.0}, "share"), ({"rate": 0}, "rate"), ({"batch": 0}, "above 0"), ({"dropout": 2}, "dropout"), ({"rank_ratio": 0}, "rank_ratio"), ({"span": (9, 3)}, "span"), ({"targets": ("z",)}, "targets")):
        with pytest.raises(ValueError, match=said):
            config.preset(size="small", **broken)
    with pytest.raises(ValueError, match="unknown preset"):
        config.preset("poetry")
    with pytest.raises(TypeError):
        made.merged(colour=1)


@pytest.mark.parametrize("kind", ["char", "bpe"])
def test_tokenizers_share_an_interface(spark, tmp_path, kind):
    texts = ["abc abd", "abc\nabd é", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = tokenizers.CharTokenizer.fit(docs) if kind == "char" else tokenizers.PairTokenizer.fit([x for x in texts if x], 40)
    made.save(spark, str(tmp_path / "t.json"))
    again = tokenizers.load(spark, str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text(encoding="utf-8"))["type"] == kind
    coded = made.cached(docs)
    try:
        assert again.size() == made.size() > 4 and again.encode(docs).collect() == coded.collect()
        if kind == "char":
            assert [x.decoded for x in again.decode(coded).orderBy("id").collect()] == [x or "" for x in texts]
    finally:
        coded.unpersist()
    files.write_text(spark, str(tmp_path / "u.json"), '{"type": "other"}')
    with pytest.raises(ValueError, match="no such tokenizer"):
        tokenizers.load(spark, str(tmp_path / "u.json"))


def test_a_run_is_logged_and_read_back(spark, tmp_path):
    times = iter(range(100, 200))
    log = runstore.RunLog(spark, str(tmp_path), "1", "r", "first", clock=lambda: next(times))
    log.params(layers=6, name="x")
    log.tags(owner="me")
    for step, loss in enumerate((3.0, 2.5)):
        log.metrics(step, loss=loss)
    log.end()
    got = runstore.read_metrics(spark, str(tmp_path)).orderBy("step").collect()
    assert [(x.run_id, x.key, x.value, x.step) for x in got] == [("r", "loss", 3.0, 0), ("r", "loss", 2.5, 1)]
    assert {(x.key, x.value) for x in runstore.read_params(spark, str(tmp_path)).collect()} == {("layers", "6"), ("name", "x")}
    assert [(x.key, x.value) for x in runstore.read_params(spark, str(tmp_path), "tags").collect()] == [("owner", "me")]
    run = runstore.read_runs(spark, str(tmp_path)).first()
    assert (run.run_name, run.status, run.start_time, run.lifecycle_stage) == ("first", 3, 100, "active") and run.end_time > 100
    told = []
    broken = runstore.RunLog(spark, "nosuchscheme://x", "1", "r", "n", report=told.append)
    broken.params(a=1)
    assert len(told) == 2


def test_one_document_a_tool(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "tool string, accuracy double")
    errors = spark.createDataFrame([("a", "x_as_y", 2), ("a", "y_as_é", 1), ("b", "x_as_y", 3)], "tool string, error string, n int")
    paths = sinks.write_documents(str(tmp_path), scores=scores, errors=errors)
    found = json.loads(files.read_text(spark, paths[0]))
    assert found == {"scores": {"accuracy": 0.5}, "errors": [{"error": "x_as_y", "n": 2}, {"error": "y_as_é", "n": 1}]} and len(paths) == 2


def test_other_tools_and_mappers(spark):
    measured = code.code_metrics(spark.createDataFrame([("for x in y:\n    pass\n", "keep", 7)], "src string, label string, error int"))
    assert measured.columns[:2] == ["src", "label"] and measured.columns.count("error") == 1
    ladders.register("by_lines", lambda: F.lit("cubic"))
    try:
        got = {x.tool: x.predicted_complexity for x in code.predictions(measured, tools=["by_lines", "nbd"], mappers={"nbd": lambda: F.lit("logn")}).collect()}
        assert got == {"by_lines": "cubic", "nbd": "logn"}
        with pytest.raises(ValueError, match="known"):
            ladders.register("radon", lambda: F.lit("x"))
    finally:
        for table in (ladders.BASELINE, ladders.ENHANCED, ladders.TOOLS):
            del table["by_lines"]


def test_confusion_has_every_class(spark):
    rows = spark.createDataFrame([("t", "linear", "cubic"), (None, "linear", "linear"), ("t", "other", "linear")], "tool string, true_complexity string, predicted_complexity string")
    assert evaluate.confusion(evaluate.pair_counts(rows)).count() == 7
    each = evaluate.confusion(evaluate.pair_counts(rows, ["tool"]), ["tool"]).collect()
    assert len(each) == 14 and {(x.tool, x.t, x["linear"], x["cubic"]) for x in each if x["linear"] or x["cubic"]} == {("t", "linear", 0, 1), (None, "linear", 1, 0)}


def test_callbacks_come_in_order(spark):
    seen = []
    rows = spark.createDataFrame([(3, 0.1), (1, 0.3), (2, 0.2)], "step int, loss double")
    assert runs.call_back(rows, lambda step, metrics: seen.append((step, metrics["loss"]))) == 3 and seen == [(1, 0.3), (2, 0.2), (3, 0.1)]


def test_ordinals_over_ranges_of_ranges(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 900, 17, 3, 64, 2_000_000, 65, 1_000)], "k bigint")
    got = [(x.k, x.ordinal) for x in curate.ordinals(rows, "k", 8).collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(x.k for x in rows.collect()))]


def test_many_functions_take_little_time():
    import ast
    import time

    source = "".join(f"def f{i}(a, b):\n    if a and b:\n        return {i}\n" for i in range(3_000))
    began = time.perf_counter()
    assert token_metrics(ast.parse(source), source)["token_cyclomatic"] == 3 and time.perf_counter() - began < 5
    nested = measure("def f(a):\n    if a:\n        def g(b):\n            for x in b:\n                if x or b:\n                    pass\n        return g\n    return 1\n")
    assert nested["token_cyclomatic"] == 4 and nested["function_names"] == ["f", "g"]


def test_byte_pair_ids_by_portions(spark, monkeypatch):
    """The library gets a bounded stretch of texts at once, whatever the batch holds, and the ids are those of all at once."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["ab" * k + " c\n" for k in range(60)] + [None, ""]
    told = sequences.train_bpe([x for x in texts if x], 20)
    monkeypatch.setattr(sequences, "PORTION", 200)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    portions = list(sequences._portions([batch], 0))
    assert len(portions) > 10 and sum(x.num_rows for x in portions) == len(texts) and all(x.num_rows == 1 or x.nbytes < 1000 for x in portions)
    monkeypatch.undo()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = sequences.bpe_decode(sequences.bpe_encode(rows, told), told).orderBy("i").collect()
    whole = Tokenizer.from_str(told)
    assert [x.ids for x in got] == [whole.encode(x or "").ids for x in texts] and [x.decoded for x in got] == [whole.decode(x.ids) for x in got]
