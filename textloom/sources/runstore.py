"""A file store of runs: a text file for each metric, parameter and tag, and flat YAML for each run.

In place of a metric's file there may be a folder of the part files that Spark writes.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import files

_PART = "(?:/part-[^/]+)?$"
_PLACE = r"([^/]+)/([^/]+)/{}/([^/]+)" + _PART


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    got = spark.read.text(f"{path}/*/*/{kind}/*").withColumn("__p", F.col("_metadata.file_path"))
    place = _PLACE.format(kind)
    return got.select(*(F.regexp_extract("__p", place, k).alias(x) for k, x in ((1, "experiment"), (2, "run_id"), (3, "key"))), "value")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, run_id, key, ts, value, step): ``ts value step`` lines of runs, and of models with their run's id.

    Lines with another number of parts are skipped; repeated and out-of-order lines are kept.
    """
    parts = _files(spark, path, "metrics").withColumn("w", F.split("value", " "))
    model = spark.read.text(f"{path}/*/models/*/metrics/*") if files.exists(spark, f"{path}/*/models/*/metrics") else None
    made = (F.col("w")[0].cast("bigint").alias("ts"), F.col("w")[1].cast("double").alias("value"), F.col("w")[2].cast("bigint").alias("step"))
    out = parts.where(F.size("w") == 3).select("experiment", "run_id", "key", *made)
    if model is None:
        return out
    place = r"([^/]+)/models/[^/]+/metrics/([^/]+)" + _PART
    model = model.withColumns({"__p": F.col("_metadata.file_path"), "w": F.split("value", " ")}).where(F.size("w") == 4)
    return out.unionByName(model.select(F.regexp_extract("__p", place, 1).alias("experiment"), F.col("w")[3].alias("run_id"), F.regexp_extract("__p", place, 2).alias("key"), *made))


def read_params(spark: SparkSession, path: str, kind: str = "params") -> DataFrame:
    """(experiment, run_id, key, value) of parameters or ``tags``; values are texts."""
    return _files(spark, path, kind)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row a run: name, times, status, life-cycle stage, from its flat YAML."""
    got = spark.read.text(f"{path}/*/*/meta.yaml").withColumn("__p", F.col("_metadata.file_path"))
    place = r"([^/]+)/([^/]+)/meta\.yaml$"
    pairs = got.select(F.regexp_extract("__p", place, 1).alias("experiment"), F.regexp_extract("__p", place, 2).alias("run_id"), F.split("value", ":", 2).alias("w")).where(F.size("w") == 2)
    pairs = pairs.select("experiment", "run_id", F.trim(F.col("w")[0]).alias("key"), F.regexp_replace(F.trim(F.col("w")[1]), "^'|'$", "").alias("value"))
    names = ["run_name", "start_time", "end_time", "status", "lifecycle_stage", "deleted_time"]
    wide = pairs.groupBy("experiment", "run_id").pivot("key", names).agg(F.first("value"))
    return wide.withColumns({"start_time": F.expr("try_cast(start_time AS bigint)"), "end_time": F.expr("try_cast(end_time AS bigint)"), "status": F.expr("try_cast(status AS int)")})


def pivot_params(params: DataFrame, keys: list[str]) -> DataFrame:
    """One row a run with a column for each of ``keys``."""
    return params.groupBy("run_id").pivot("key", keys).agg(F.first("value"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run_id, key, ts, step, value) rows to a table, a folder a key."""
    metrics.select("run_id", "ts", "step", "value", "key").write.mode("append").partitionBy("key").parquet(path)


#: Codes of a run's status (fixed values of the file layout).
STATUS = {"running": 1, "finished": 3, "failed": 4}


class RunLog:
    """Writes one run of the store: parameters, tags and metric points as they come, then how it ended.

    What can't be written is told to ``report`` and does not end the run. Each metric has one open file up to the end.
    """

    def __init__(self, spark: SparkSession, path: str, experiment: str, run_id: str, name: str, report=lambda error: None, clock=lambda: int(time.time() * 1000)):
        self.spark, self.folder, self.run_id, self.name, self.report, self.clock = spark, f"{path}/{experiment}/{run_id}", run_id, name, report, clock
        self.began, self.open = clock(), {}
        self._meta("running", None)

    def _tried(self, action) -> None:
        try:
            action()
        except Exception as error:  # a log must not end what it logs
            self.report(error)

    def _write(self, place: str, text: str) -> None:
        self._tried(lambda: files.write_text(self.spark, f"{self.folder}/{place}", text))

    def _add(self, place: str, text: str) -> None:
        if place not in self.open:
            self.open[place] = files.Appended(self.spark, f"{self.folder}/{place}")
        self.open[place].add(text)

    def _meta(self, status: str, ended: int | None) -> None:
        lines = {"run_id": self.run_id, "run_name": self.name, "start_time": self.began, "end_time": "null" if ended is None else ended, "status": STATUS[status], "lifecycle_stage": "active"}
        self._write("meta.yaml", "".join(f"{k}: {v}\n" for k, v in lines.items()))

    def params(self, **values) -> None:
        for key, value in values.items():
            self._write(f"params/{key}", str(value))

    def tags(self, **values) -> None:
        for key, value in values.items():
            self._write(f"tags/{key}", str(value))

    def metrics(self, step: int, **values: float) -> None:
        """A line ``ts value step`` for each metric."""
        now = self.clock()
        for key, value in values.items():
            self._tried(lambda key=key, value=value: self._add(f"metrics/{key}", f"{now} {float(value)} {step}\n"))

    def end(self, status: str = "finished") -> None:
        for file in self.open.values():
            self._tried(file.close)
        self.open = {}
        self._meta(status, self.clock())
