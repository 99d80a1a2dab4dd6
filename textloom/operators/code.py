"""Code metrics and class predictions of many sources: one parse a source, whatever the number of tools."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.functions.codemetrics import SCHEMA, measure
from textloom.functions.ladders import BASELINE, ENHANCED, enabled_tools


def code_metrics(samples: DataFrame, source: str = "src") -> DataFrame:
    """``samples`` with the metrics of ``source`` and ``execution_time``, the seconds that its analysis took.

    Errors in a source don't fail the job: it has the default metrics and ``error``. A column of ``samples`` that has the
    name of a result gives way to it.
    """
    results = {x.lower() for x in StructType.fromDDL(SCHEMA).names} | {"execution_time"}
    samples = samples.select(*(F.col(f"`{x}`") for x in samples.columns if x.lower() not in results))
    names = [x.split(" ")[0] for x in StructType.fromDDL(SCHEMA).names]
    schema = StructType([*samples.schema.fields, *StructType.fromDDL(SCHEMA).fields, *StructType.fromDDL("execution_time double").fields])
    arrow, place = to_arrow_schema(schema), samples.columns.index(source)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, times = [], []
            for text in batch.column(place).to_pylist():
                began = time.perf_counter()
                rows.append(measure(text))
                times.append(time.perf_counter() - began)
            made = [pa.array([list(r[x].items()) if x == "loops_at_depth" else r[x] for r in rows], arrow.field(x).type) for x in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(times, pa.float64())], names=arrow.names)

    return samples.mapInArrow(run, schema)


def predictions(measured: DataFrame, mode: str = "enhanced", tools=None, mappers: dict | None = None) -> DataFrame:
    """A row for each sample and tool, with the tool's class; the ``baseline`` mode uses the tool's metric alone.

    ``mappers`` gives some tools another function from the columns of ``measured`` to a class.
    """
    registry = {**(BASELINE if mode == "baseline" else ENHANCED), **(mappers or {})}
    rows = [F.struct(F.lit(x).alias("tool"), registry[x]().alias("predicted_complexity")) for x in enabled_tools(tools)]
    return measured.withColumn("__t", F.explode(F.array(*rows))).select("*", "__t.tool", "__t.predicted_complexity").drop("__t")
