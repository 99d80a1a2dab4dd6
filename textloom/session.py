"""Session with this engine's defaults; settings that a cluster has made are kept."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.sources import files


def session(name: str = "textloom", **settings: str) -> SparkSession:
    """A session with UTC times, Arrow and adaptive execution; keyword arguments name settings with ``__`` for a dot."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only in local mode where it names none (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "textloom-checkpoints")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in which checkpoints are written; it is set once, to the shared folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Workspace:
    """Tables in the shared folder that a job needs on its way; they are deleted where the ``with`` block ends.

    Tasks that are run again read the same rows. What leaves the block has to be cut (``cut``) within it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{checkpoint_dir(spark)}/work-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        files.delete(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed now and read from its table."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Without the table of ``kept``, which nothing may read any more."""
        files.delete(self.spark, self.paths[id(kept)][1])


def log_to(level: str = "INFO", path: str | None = None) -> logging.Logger:
    """The driver's root logger, set anew: to the console, and to a file if one is named."""
    root = logging.getLogger()
    for handler in list(root.handlers):
        root.removeHandler(handler)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        root.addHandler(handler)
    root.setLevel(level.upper())
    return root
