"""JSON lines: strict, skipping and raw-limited scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import code_of, long_enough
from textloom.operators.curate import curate
from textloom.schema import CODE_SAMPLE, SOLUTION_SAMPLE
from textloom.session import cut
from textloom.sources import files

#: What a missing corpus file gives.
FALLBACK = "The quick brown fox jumps over the lazy dog. " * 100


def read_strict(spark: SparkSession, path: str, schema: str = CODE_SAMPLE) -> DataFrame:
    """Every line has to be well-formed: a malformed one fails the job. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_skipping(spark: SparkSession, path: str, schema: str, n: int = -1, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """The first ``n`` well-formed rows (-1: all, 0: none), and all malformed lines of the files that were read for them."""
    shown = lambda lines: _parsed(lines.where(F.trim("value") != ""), schema, corrupt)
    lines = numbered_lines(spark, path) if n < 0 else enough(spark, path, n, lambda lines: shown(lines).where("ok"))
    parsed = shown(lines)
    good = parsed.where("ok").select("line", "r.*").drop(corrupt)
    return (good if n < 0 else good.orderBy("line").limit(n)), parsed.where("NOT ok").select("line", "value")


def enough(spark: SparkSession, path: str, n: int, accepted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The numbered lines of the first files, by name, that hold ``n`` rows which ``accepted`` makes of them; else of all files.

    One file is tried, then four times as many each time, so what is read follows ``n`` and the size of a file, not the
    number of files.
    """
    paths, k = files.listed(spark, path), 1
    while k < len(paths):
        lines = numbered_lines(spark, paths[:k])
        if accepted(lines).limit(max(n, 1)).count() >= n:
            return lines
        k *= 4
    return numbered_lines(spark, path)


def _parsed(lines: DataFrame, schema: str, corrupt: str = "_corrupt_record") -> DataFrame:
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt}))
    return parsed.withColumn("ok", F.col("r").isNotNull() & F.col(f"r.{corrupt}").isNull())


def read_accepted(spark: SparkSession, path: str, schema: str = SOLUTION_SAMPLE, n: int | None = None, **rules) -> tuple[DataFrame, int]:
    """The first ``n`` rows (None: all) that are well-formed and that ``curate`` accepts by ``rules``, and how many lines before the last of them weren't.

    No row at all is an error. Blank lines aren't counted.
    """
    shown = lambda lines: curate(_parsed(lines.where(F.trim("value") != ""), schema).where("ok").select("line", "r.*").drop("_corrupt_record"), **rules)
    lines = numbered_lines(spark, path) if n is None else enough(spark, path, n, shown)
    rows, lines = shown(lines), lines.where(F.trim("value") != "")
    rows = cut(rows if n is None else rows.orderBy("line").limit(n))
    told = rows.agg(F.count("*").alias("n"), F.max("line").alias("last")).first()
    if not told["n"]:
        raise ValueError(f"no row is accepted: {path}")
    seen = lines if n is None or told["n"] < n else lines.where(F.col("line") <= told["last"])
    return rows, seen.count() - told["n"]


def tokenizer_texts(spark: SparkSession, path: str, n: int = 1000, primary: str = "query_code", alternative: str = "query_dataclass_code") -> list[str]:
    """What a tokenizer is fitted on: code of more than 10 characters in the first ``n`` physical lines, in order.

    Blank and malformed lines count too. ``n`` bounds what comes to the driver.
    """
    lines = _parsed(head_raw(spark, path, n), f"{primary} string, {alternative} string").where("ok")
    code = code_of(F.col(f"r.{primary}"), F.col(f"r.{alternative}")).alias("code")
    return [x["code"] for x in lines.select("line", code).where(long_enough(F.col("code"), strict=True)).orderBy("line").collect()]


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, value): all lines, blank ones too, numbered from 0 in the order of file names and of places in them.

    Blocks of files are counted first (a row for each), so that the numbers don't hang on how blocks are dealt to tasks;
    they are summed up file by file, and a window over all sees a row for each file.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    blocks = read.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    preceding = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = blocks.groupBy("f").agg(F.sum("n").alias("n")).select("f", preceding(W.orderBy("f")).alias("far"))
    before = blocks.withColumn("near", preceding(W.partitionBy("f").orderBy("b"))).join(far, "f").select("f", "b", "first", (F.col("near") + F.col("far")).alias("before"))
    return read.join(before, ["f", "b"]).select((F.col("before") + F.col("i") - F.col("first")).alias("line"), "value")


def head_raw(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` physical lines, blank and malformed ones included."""
    return enough(spark, path, n, lambda lines: lines).where(F.col("line") < n) if n >= 0 else numbered_lines(spark, path)


def read_whole(spark: SparkSession, path: str, fallback: str = FALLBACK) -> DataFrame:
    """A text file as one row; a missing one gives ``fallback``, any other failure is an error."""
    if files.exists(spark, path):
        return spark.read.text(path, wholetext=True)
    return spark.createDataFrame([(fallback,)], "value string")


def default_path(spark: SparkSession, language: str, folder: str, named: dict[str, str] | None = None) -> str:
    """The data file of a language; an unknown language and a missing file are errors."""
    named = named or {"python": "python.jsonl", "java": "java.jsonl"}
    if language not in named:
        raise ValueError(f"unknown language: {language}")
    path = f"{folder}/{named[language]}"
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    return path
