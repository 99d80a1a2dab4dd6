"""Name of each query, its DataFrame program and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import curation, evaluation, layers, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**evaluation.QUERIES, **curation.QUERIES, **training.QUERIES, **layers.QUERIES}
#: Not expressible in SQL, and tested otherwise: byte-pair encoding, and the run store, which isn't one of the tables.
ORACLES: dict[str, str] = {**evaluation.ORACLES, **curation.ORACLES, **training.ORACLES, **layers.ORACLES}
