"""Queries of classification and evaluation, over ``documents`` and ``events``.

Stand-ins: a document's length and number of lines are the metrics, one gives the true class and the other the
prediction; its language is the tool, and ``doc_id % 101`` its time in milliseconds. Every ninth true label is outside
the classes and every seventeenth prediction is missing, as both occur in real results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ladders
from textloom.operators import code, evaluate, stats
from textloom.schema import CLASSES


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def _lines():
    return F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = F.when(F.col("doc_id") % 9 == 0, "other").otherwise(ladders.ladder(F.floor(F.col("n_chars") / 150), ladders.CYCLOMATIC))
    guess = F.when(F.col("doc_id") % 17 != 0, ladders.ladder(_lines(), ladders.COGNITIVE))
    return _docs(spark, sf_dir, "doc_id", "text", "lang", "n_chars").select(
        "doc_id", F.col("lang").alias("tool"), true.alias("true_complexity"), guess.alias("predicted_complexity"), ((F.col("doc_id") % 101).cast("double") / F.lit(1000.0)).alias("execution_time")
    )


def _counts(spark, sf_dir, keys=()):
    return evaluate.pair_counts(predictions(spark, sf_dir), list(keys))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers as bigint, so that engines agree in the last bit."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns))


def class_ladder(spark, sf_dir):
    """Half-open ladders, gaps included."""
    value = F.floor(F.col("n_chars") / 150)
    return _docs(spark, sf_dir, "doc_id", "text", "n_chars").select("doc_id", ladders.ladder(value, ladders.CYCLOMATIC).alias("cyclomatic_class"), ladders.ladder(_lines(), ladders.COGNITIVE).alias("cognitive_class"))


def halstead_mi_nbd_ladders(spark, sf_dir):
    """The ladders without gaps, and the rank."""
    v = F.col("n_chars") / F.lit(100.0)
    return _docs(spark, sf_dir, "doc_id", "text", "n_chars").select(
        "doc_id", ladders.halstead_class(v).alias("halstead_class"), ladders.maintainability_class(v).alias("mi_class"), ladders.maintainability_rank(v).alias("mi_rank"), ladders.nesting_class(_lines()).alias("nbd_class")
    )


def structural_tree(spark, sf_dir):
    """The structural tree over remainders of the id and the length."""
    depth, base = F.col("doc_id") % 6, F.col("n_chars") % 13
    loops = F.when(depth == 0, 0).otherwise(depth + F.col("doc_id") % 4)
    mi = ladders.maintainability_base(F.col("n_chars") % 101)
    return _docs(spark, sf_dir, "doc_id", "n_chars").select("doc_id", ladders.structural_class(depth, loops, F.col("doc_id") % 7 == 0, base).alias("class"), ladders.structural_class(depth, loops, F.col("doc_id") % 7 == 0, mi).alias("mi_class"))


def accuracy(spark, sf_dir):
    return _rounded(evaluate.accuracy(_counts(spark, sf_dir)))


def per_class_prf(spark, sf_dir):
    return _rounded(evaluate.per_class(_counts(spark, sf_dir)).select("label", "precision", "recall", "f1", "support"))


def weighted_macro_prf(spark, sf_dir):
    return _rounded(evaluate.averages(_counts(spark, sf_dir)))


def confusion_matrix(spark, sf_dir):
    return _rounded(evaluate.confusion(_counts(spark, sf_dir)))


def classification_report(spark, sf_dir):
    return _rounded(evaluate.report(_counts(spark, sf_dir)))


def class_distribution(spark, sf_dir):
    return _rounded(evaluate.distribution(_counts(spark, sf_dir)))


def error_distribution(spark, sf_dir):
    return _rounded(evaluate.errors(_counts(spark, sf_dir)))


def ordinal_distance(spark, sf_dir):
    return _rounded(evaluate.distances(_counts(spark, sf_dir)))


def tool_summary(spark, sf_dir):
    return _rounded(stats.tool_summary(predictions(spark, sf_dir)))


def tool_report(spark, sf_dir):
    """Rank and text of the report's lines."""
    return _rounded(stats.report_lines(stats.tool_summary(predictions(spark, sf_dir)).where("tool IS NOT NULL")))


def console_report(spark, sf_dir):
    """Lines of the report's blocks, by tool and place."""
    return _rounded(stats.report_blocks(predictions(spark, sf_dir).where("tool IS NOT NULL"), places=6))


def speed_report(spark, sf_dir):
    """The table of tools by speed."""
    return _rounded(stats.speed_lines(tool_summary(spark, sf_dir).where("tool IS NOT NULL")))


def custom_mapper(spark, sf_dir):
    """Classes of one tool by a caller's function from the metrics, of another by the registry."""
    measured = code.code_metrics(programs(spark, sf_dir))
    mine = {"mccabe": lambda: F.when(F.col("total_loops") > 1, "quadratic").otherwise("constant")}
    return code.predictions(measured, "baseline", ["radon", "mccabe"], mine).select("doc_id", "tool", "predicted_complexity")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("tool"), F.col("value").alias("execution_time"))


def timing_stats(spark, sf_dir):
    return _rounded(stats.timing(_events(spark, sf_dir), ["tool"]))


def tool_speed_rank(spark, sf_dir):
    return _rounded(evaluate.rank_by_time(stats.timing(_events(spark, sf_dir), ["tool"])).select("tool", "mean_time", "rank"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs as the ids say: nested loops, a recursive call in every fourth."""
    depth = (F.col("doc_id") % 6).cast("int")
    heads = F.when(depth > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("for x in n:\n"))), "")).otherwise("")
    body = F.concat(F.repeat(F.lit("    "), depth + 1), F.when(F.col("doc_id") % 4 == 0, "f(n)\n").otherwise("n.append(1)\n"))
    return _docs(spark, sf_dir, "doc_id").select("doc_id", F.concat(F.lit("def f(n):\n"), heads, body).alias("src"))


#: Programs of every kind of statement that a metric knows; what is expected of them was worked out by hand.
PROGRAMS = (
    "def fact(n):\n    if n < 2:\n        return 1\n    return n * fact(n - 1)\n",
    "def scan(a):\n    i = 0\n    while i < len(a) and a[i]:\n        for x in a:\n            i += 1\n    else:\n        i = 2\n    return i\n",
    "class Box:\n    def get(self, k):\n        try:\n            return self.d[k]\n        except KeyError:\n            return None\n\n    def put(self, k, v=0, *r):\n        self.d[k] = v if v else r\n",
    "def pick(xs, y):\n    out = [x for x in xs if x > y or x == 0]\n    def inner(z):\n        return -z\n    for q in out:\n        if q:\n            with q:\n                inner(q)\n    return out\n",
    "x = 1\ny = x + 2 * x\n",
    "def f(:\n",
)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of PROGRAMS for each document."""
    return _docs(spark, sf_dir, "doc_id").withColumn("src", F.element_at(F.array(*map(F.lit, PROGRAMS)), (F.col("doc_id") % len(PROGRAMS) + 1).cast("int")))


def code_structure(spark, sf_dir):
    """All counts of one program a document: loops by depth, recursion, names, nesting, the complexities, Halstead's difficulty."""
    loops = F.array_join(F.transform(F.array_sort(F.map_entries("loops_at_depth")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",")
    kept = ["doc_id", "max_loop_depth", "total_loops", "for_loops", "while_loops", "has_recursion", "nested_block_depth", "cyclomatic", "functions_count", "token_cyclomatic", "parameters", "path_cyclomatic", "cognitive", "halstead_difficulty", "halstead_volume"]
    named = [loops.alias("loops"), F.array_join("recursive_functions", ",").alias("recursive"), F.array_join("function_names", ",").alias("names"), F.col("error").isNotNull().alias("failed")]
    return _rounded(code.code_metrics(programs(spark, sf_dir)).select(*kept, *named))


def code_metrics_baseline(spark, sf_dir):
    """Every tool's class by its metric alone."""
    return code.predictions(code.code_metrics(sources(spark, sf_dir)), "baseline").select("doc_id", "tool", "predicted_complexity")


def code_metrics_enhanced(spark, sf_dir):
    """Every tool's class by the structural tree."""
    return code.predictions(code.code_metrics(sources(spark, sf_dir)), "enhanced").select("doc_id", "tool", "predicted_complexity")


def code_metrics_prose(spark, sf_dir):
    """Metrics of the documents themselves: text that isn't a program has the defaults and an error."""
    measured = code.code_metrics(_docs(spark, sf_dir, "doc_id", F.col("text").alias("src")))
    return _rounded(measured.select("doc_id", "cyclomatic", "cognitive", "nested_block_depth", F.col("error").isNotNull().alias("failed")))


QUERIES = {f.__name__: f for f in (
    class_ladder, halstead_mi_nbd_ladders, structural_tree, accuracy, per_class_prf, weighted_macro_prf, confusion_matrix, classification_report, class_distribution, error_distribution, ordinal_distance,
    tool_summary, tool_report, speed_report, console_report, custom_mapper, timing_stats, tool_speed_rank, code_structure, code_metrics_baseline, code_metrics_enhanced, code_metrics_prose,
)}


# SQL, written from the rules and not from the programs above.


def _ladder(value: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a}" + ("" if b == math.inf else f" AND {value} < {b}") + f" THEN '{c}'" for a, b, c in rules) + " ELSE 'exponential' END"


_LINES = "length(text) - length(replace(text, chr(10), '')) + 1"
_TREE = """CASE WHEN {r} THEN CASE WHEN {d} >= 1 OR {b} > 5 THEN 'exponential' ELSE 'nlogn' END WHEN {d} >= 4 THEN 'exponential' WHEN {d} = 3 THEN 'cubic' WHEN {d} = 2 THEN 'quadratic'
  WHEN {d} = 1 THEN CASE WHEN {l} > 2 AND {b} > 8 THEN 'nlogn' WHEN {l} = 1 AND {b} > 10 THEN 'nlogn' ELSE 'linear' END WHEN {l} = 0 THEN CASE WHEN {b} > 10 THEN 'logn' ELSE 'constant' END ELSE 'linear' END"""
_PRED = f"""pred AS (SELECT doc_id, lang AS tool, CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE {_ladder('(n_chars // 150)', ladders.CYCLOMATIC)} END AS t,
  CASE WHEN doc_id % 17 <> 0 THEN {_ladder(f'({_LINES})', ladders.COGNITIVE)} END AS p, CAST(doc_id % 101 AS DOUBLE) / 1000 AS secs FROM documents),
v AS (SELECT * FROM pred WHERE p IS NOT NULL),
cls AS (SELECT unnest({list(CLASSES)!r}) AS label, unnest(range({len(CLASSES)})) AS ord)"""
_LABEL = """lab AS (SELECT label, (SELECT count(*) FROM v WHERE t = label AND p = label) AS hits, (SELECT count(*) FROM v WHERE t = label) AS support, (SELECT count(*) FROM v WHERE p = label) AS predicted
  FROM ({labels})),
sc AS (SELECT *, coalesce(CAST(hits AS DOUBLE) / nullif(predicted, 0), 0) AS precision, coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS recall FROM lab),
sf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM sc)"""
_SEVEN = _LABEL.format(labels="SELECT label FROM cls")
_UNION = _LABEL.format(labels="SELECT t AS label FROM v UNION SELECT p FROM v")
_R = lambda x, name: f"round(CAST({x} AS DOUBLE), 6) AS {name}"
_TIME = """count(*) AS total_samples, count(*) FILTER (WHERE s > 0) AS timed, round(coalesce(sum(s) FILTER (WHERE s > 0), 0), 6) AS total_time, round(coalesce(avg(s) FILTER (WHERE s > 0), 0), 6) AS mean_time,
  round(coalesce(quantile_cont(s, 0.5) FILTER (WHERE s > 0), 0), 6) AS median_time"""

ORACLES = {
    "class_ladder": f"""SELECT doc_id, CASE WHEN c BETWEEN 1 AND 4 THEN 'constant' WHEN c BETWEEN 6 AND 9 THEN 'linear' WHEN c BETWEEN 11 AND 19 THEN 'quadratic' WHEN c BETWEEN 21 AND 49 THEN 'cubic' ELSE 'exponential' END AS cyclomatic_class,
  CASE WHEN n BETWEEN 0 AND 4 THEN 'constant' WHEN n BETWEEN 6 AND 14 THEN 'linear' WHEN n BETWEEN 16 AND 29 THEN 'quadratic' WHEN n BETWEEN 31 AND 59 THEN 'cubic' ELSE 'exponential' END AS cognitive_class
  FROM (SELECT doc_id, n_chars // 150 AS c, {_LINES} AS n FROM documents)""",
    "halstead_mi_nbd_ladders": f"""SELECT doc_id, CASE WHEN x < 5 THEN 'constant' WHEN x < 10 THEN 'linear' WHEN x < 20 THEN 'quadratic' WHEN x < 40 THEN 'cubic' ELSE 'exponential' END AS halstead_class,
  CASE WHEN x >= 80 THEN 'constant' WHEN x >= 60 THEN 'linear' WHEN x >= 40 THEN 'quadratic' WHEN x >= 20 THEN 'cubic' ELSE 'exponential' END AS mi_class,
  CASE WHEN x >= 80 THEN 'A' WHEN x >= 60 THEN 'B' WHEN x >= 40 THEN 'C' WHEN x >= 20 THEN 'D' ELSE 'F' END AS mi_rank,
  CASE n WHEN 0 THEN 'constant' WHEN 1 THEN 'linear' WHEN 2 THEN 'quadratic' WHEN 3 THEN 'cubic' ELSE 'exponential' END AS nbd_class
  FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) / 100 AS x, {_LINES} AS n FROM documents)""",
    "structural_tree": f"""SELECT doc_id, {_TREE.format(r='r', d='d', l='l', b='b')} AS class, {_TREE.format(r='r', d='d', l='l', b='m')} AS mi_class
  FROM (SELECT doc_id, doc_id % 6 AS d, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id % 6 + doc_id % 4 END AS l, doc_id % 7 = 0 AS r, n_chars % 13 AS b, CAST(100 - n_chars % 101 AS DOUBLE) / 10 AS m FROM documents)""",
    "accuracy": f"WITH {_PRED} SELECT count(*) AS n, {_R('coalesce(avg(CASE WHEN t = p THEN 1 ELSE 0 END), 0)', 'accuracy')} FROM v",
    "per_class_prf": f"WITH {_PRED}, {_SEVEN} SELECT label, {_R('precision', 'precision')}, {_R('recall', 'recall')}, {_R('f1', 'f1')}, support FROM sf",
    "weighted_macro_prf": f"WITH {_PRED}, {_UNION} SELECT " + ", ".join(_R(f"sum({x} * support) / sum(support)", f"{x}_weighted") + ", " + _R(f"avg({x})", f"{x}_macro") for x in ("precision", "recall", "f1")) + " FROM sf",
    "confusion_matrix": f"WITH {_PRED} SELECT label AS t, " + ", ".join(f"count(*) FILTER (WHERE p = '{x}') AS {x}" for x in CLASSES) + " FROM cls LEFT JOIN v ON t = label GROUP BY label",
    "classification_report": f"""WITH {_PRED}, {_SEVEN}, al AS (
  SELECT label, precision, recall, f1, support FROM sf UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM sf
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM sf
  UNION ALL SELECT CASE WHEN (SELECT count(*) FROM v WHERE t NOT IN (SELECT label FROM cls)) > 0 THEN 'micro avg' ELSE 'accuracy' END, a, b, 2 * a * b / (a + b), s FROM (SELECT CAST(sum(hits) AS DOUBLE) / sum(predicted) AS a, CAST(sum(hits) AS DOUBLE) / sum(support) AS b, sum(support) AS s FROM sf))
SELECT label, {_R('precision', 'precision')}, {_R('recall', 'recall')}, {_R('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM al""",
    "class_distribution": f"""WITH {_PRED}, {_SEVEN} SELECT label, support AS true_count, predicted AS predicted_count, hits AS correct, {_R('100.0 * support / (SELECT count(*) FROM v)', 'true_percent')},
  {_R('100.0 * predicted / (SELECT count(*) FROM v)', 'predicted_percent')}, {_R('coalesce(100.0 * hits / nullif(support, 0), 0)', 'accuracy_for_class')} FROM sf""",
    "error_distribution": f"WITH {_PRED} SELECT t || '_as_' || p AS error, count(*) AS n FROM v WHERE t <> p GROUP BY 1",
    "ordinal_distance": f"""WITH {_PRED}, d AS (SELECT CAST(abs(a.ord - b.ord) AS DOUBLE) AS d FROM v JOIN cls a ON t = a.label JOIN cls b ON p = b.label)
SELECT count(*) AS pairs, {_R('avg(d)', 'mean_distance')}, {_R('median(d)', 'median_distance')}, {_R('max(d)', 'max_distance')}, {_R('stddev_pop(d)', 'std_distance')} FROM d""",
    "timing_stats": f"""SELECT event_type AS tool, {_TIME}, round(coalesce(min(s) FILTER (WHERE s > 0), 0), 6) AS min_time, round(coalesce(max(s) FILTER (WHERE s > 0), 0), 6) AS max_time,
  round(coalesce(stddev_pop(s) FILTER (WHERE s > 0), 0), 6) AS std_time, round(quantile_cont(s, 0.95) FILTER (WHERE s > 0), 6) AS p95_time, round(quantile_cont(s, 0.99) FILTER (WHERE s > 0), 6) AS p99_time,
  round(coalesce(count(*) / sum(s) FILTER (WHERE s > 0), 0), 6) AS samples_per_second FROM (SELECT event_type, value AS s FROM events) GROUP BY event_type""",
    "tool_speed_rank": "SELECT tool, round(m, 6) AS mean_time, row_number() OVER (ORDER BY m, tool) AS rank FROM (SELECT event_type AS tool, coalesce(avg(value) FILTER (WHERE value > 0), 0) AS m FROM events GROUP BY 1)",
    "tool_summary": f"""WITH {_PRED}, tm AS (SELECT tool, {_TIME}, round(coalesce(count(*) / sum(s) FILTER (WHERE s > 0), 0), 6) AS samples_per_second FROM (SELECT tool, secs AS s FROM pred) GROUP BY tool),
ac AS (SELECT tool, count(*) AS valid_predictions, {_R('avg(CASE WHEN t = p THEN 1 ELSE 0 END)', 'accuracy')} FROM v GROUP BY tool),
lb AS (SELECT tool, label, count(*) FILTER (WHERE t = label AND p = label) AS hits, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE p = label) AS predicted
  FROM (SELECT tool, t, p, unnest(list_distinct([t, p])) AS label FROM v) GROUP BY tool, label),
sc AS (SELECT *, coalesce(CAST(hits AS DOUBLE) / nullif(predicted, 0), 0) AS precision, coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS recall FROM lb),
av AS (SELECT tool, {', '.join(_R(f'sum({y} * support) / sum(support)', f'{x}_weighted') for x, y in (('f1', 'coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)'), ('precision', 'precision'), ('recall', 'recall')))} FROM sc GROUP BY tool),
ds AS (SELECT tool, {_R('avg(abs(a.ord - b.ord))', 'mean_distance')} FROM v JOIN cls a ON t = a.label JOIN cls b ON p = b.label GROUP BY tool)
SELECT tool, total_samples, total_time, mean_time, median_time, samples_per_second, valid_predictions, accuracy, f1_weighted, precision_weighted, recall_weighted, coalesce(mean_distance, 0) AS mean_distance
FROM tm JOIN ac USING (tool) JOIN av USING (tool) LEFT JOIN ds USING (tool)""",
    "code_structure": """SELECT doc_id, p.* EXCLUDE (k, halstead_difficulty, halstead_volume), round(CAST(halstead_difficulty AS DOUBLE), 6) AS halstead_difficulty, round(CAST(halstead_volume AS DOUBLE), 6) AS halstead_volume FROM documents JOIN (VALUES
  (0, 0, 0, 0, 0, true, 1, 2, 1, 2, 1, 2, 1, 3 * 6 / (2.0 * 4), 9 * log2(7), '', 'fact', 'fact', false),
  (1, 2, 2, 1, 1, false, 2, 5, 1, 4, 1, 3, 5, 3 * 6 / (2.0 * 5), 9 * log2(8), '1:1,2:1', '', 'scan', false),
  (2, 0, 0, 0, 0, false, 0, 3, 3, 2, 4, 3, 2, 1.0, 0.0, '', '', 'get,put', false),
  (3, 1, 1, 1, 0, false, 3, 6, 1, 6, 2, 4, 4, 4 * 7 / (2.0 * 6), 11 * log2(10), '1:1', '', 'inner,pick', false),
  (4, 0, 0, 0, 0, false, 0, 1, 0, 1, 0, 1, 0, 2 * 4 / (2.0 * 3), 6 * log2(5), '', '', '', false),
  (5, 0, 0, 0, 0, false, 0, 1, 0, 1, 0, 1, 0, 1.0, 0.0, '', '', '', true)
) p(k, max_loop_depth, total_loops, for_loops, while_loops, has_recursion, nested_block_depth, cyclomatic, functions_count, token_cyclomatic, parameters, path_cyclomatic, cognitive, halstead_difficulty, halstead_volume, loops, recursive, names, failed) ON doc_id % 6 = k""",
    "custom_mapper": """SELECT doc_id, tool, CASE WHEN tool = 'mccabe' THEN CASE WHEN doc_id % 6 = 1 THEN 'quadratic' ELSE 'constant' END WHEN doc_id % 6 = 1 THEN 'exponential' WHEN doc_id % 6 = 3 THEN 'linear' ELSE 'constant' END AS predicted_complexity
FROM documents, (SELECT unnest(['radon', 'mccabe']) AS tool)""",
    "code_metrics_baseline": f"""WITH s AS (SELECT doc_id, doc_id % 6 AS d FROM documents)
SELECT doc_id, tool, CASE WHEN tool IN ('radon', 'lizard', 'mccabe') THEN {_ladder('(1 + d)', ladders.CYCLOMATIC)} WHEN tool = 'complexipy' THEN {_ladder('(d * (d + 1) // 2)', ladders.COGNITIVE)}
  WHEN tool = 'nbd' THEN CASE d WHEN 0 THEN 'constant' WHEN 1 THEN 'linear' WHEN 2 THEN 'quadratic' WHEN 3 THEN 'cubic' ELSE 'exponential' END ELSE 'constant' END AS predicted_complexity
FROM s, (SELECT unnest(['radon', 'lizard', 'mccabe', 'complexipy', 'halstead', 'mi', 'nbd']) AS tool)""",
    "code_metrics_enhanced": f"""WITH s AS (SELECT doc_id, tool, doc_id % 6 AS d, doc_id % 4 = 0 AS r, CASE tool WHEN 'complexipy' THEN (doc_id % 6) * (doc_id % 6 + 1) // 2 WHEN 'halstead' THEN 1 WHEN 'mi' THEN 0 WHEN 'nbd' THEN doc_id % 6 ELSE 1 + doc_id % 6 END AS b
  FROM documents, (SELECT unnest(['radon', 'lizard', 'mccabe', 'complexipy', 'halstead', 'mi', 'nbd']) AS tool))
SELECT doc_id, tool, {_TREE.format(r='r', d='d', l='d', b='b')} AS predicted_complexity FROM s""",
    "code_metrics_prose": "SELECT doc_id, CAST(1 AS BIGINT) AS cyclomatic, CAST(0 AS BIGINT) AS cognitive, CAST(0 AS BIGINT) AS nested_block_depth, true AS failed FROM documents",
}
ORACLES["tool_report"] = f"""WITH s AS ({ORACLES['tool_summary']}) SELECT row_number() OVER (ORDER BY mean_time, tool) AS rank, printf('%-24s %.4f %.4f %10.3f ms', tool, accuracy, f1_weighted, mean_time * 1000) AS line FROM s"""
ORACLES["speed_report"] = f"""WITH s AS ({ORACLES['tool_summary']}) SELECT row_number() OVER (ORDER BY mean_time, tool) AS rank, printf('%-15s %12.2f s  %12.2f ms %14.2f', tool, total_time, mean_time * 1000, samples_per_second) AS line FROM s WHERE tool IS NOT NULL"""
ORACLES["console_report"] = f"""WITH s AS ({ORACLES['tool_summary']}), {_PRED}, m AS (SELECT tool, min(secs) FILTER (WHERE secs > 0) AS a, max(secs) FILTER (WHERE secs > 0) AS z FROM pred GROUP BY tool),
h AS (SELECT tool, unnest([upper(tool), printf('Accuracy             %.4f', accuracy), printf('F1 (weighted)        %.4f', f1_weighted), printf('Precision (weighted) %.4f', precision_weighted), printf('Recall (weighted)    %.4f', recall_weighted),
  printf('Valid                %d/%d', valid_predictions, total_samples), printf('Total time           %.2f s', total_time), printf('Mean time            %.2f ms', mean_time * 1000), printf('Median time          %.2f ms', median_time * 1000),
  printf('Least time           %.2f ms', a * 1000), printf('Most time            %.2f ms', z * 1000), printf('Samples a second     %.2f', samples_per_second), 'Class        True       Predicted    Right      Accuracy']) AS line, unnest(range(13)) AS ord FROM s JOIN m USING (tool)),
k AS (SELECT tool, label, ord, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE p = label) AS predicted, count(*) FILTER (WHERE t = label AND p = label) AS hits FROM v, cls GROUP BY ALL)
SELECT tool, ord, line FROM h UNION ALL SELECT tool, ord + 13, printf('%-12s %-10d %-12d %-10d %.1f%%', label, support, predicted, hits, coalesce(100.0 * hits / nullif(support, 0), 0)) FROM k WHERE tool IS NOT NULL AND (support > 0 OR predicted > 0)"""
