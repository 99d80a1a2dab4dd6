"""Writers of results: tidy tables, JSON documents, configurations."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

from textloom.sources import files


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")


def _json(document) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)


def write_summary(summary: DataFrame, path: str, key: str = "tool") -> None:
    """One indented JSON document, a member for each row. The table has one row a tool, so it may come to the driver."""
    rows = [x.asDict(recursive=True) for x in summary.collect()]
    files.write_text(summary.sparkSession, path, _json({x[key]: {k: v for k, v in x.items() if k != key} for x in rows}))


def write_documents(folder: str, key: str = "tool", **tables: DataFrame) -> list[str]:
    """One indented JSON document for each value of ``key``, ``<value>_results.json``: a member for each table.

    A table with one row a value gives an object, the others a list of objects. All have some dozen rows a value (scores,
    not predictions), so they may come to the driver.
    """
    documents: dict[str, dict] = {}
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        found: dict[str, list] = {}
        for row in table.collect():
            one = row.asDict(recursive=True)
            found.setdefault(one.pop(key), []).append(one)
        single = all(len(x) == 1 for x in found.values())
        for value, rows in found.items():
            documents.setdefault(value, {})[name] = rows[0] if single else rows
    paths = []
    for value, document in documents.items():
        paths.append(f"{folder}/{value}_results.json")
        files.write_text(spark, paths[-1], _json(document))
    return paths


def save_config(spark: SparkSession, config, path: str) -> None:
    """A dataclass as JSON."""
    files.write_text(spark, path, _json(dataclasses.asdict(config)))


def load_config(spark: SparkSession, kind, path: str):
    """A dataclass from JSON; members that it doesn't have are an error."""
    found = json.loads(files.read_text(spark, path))
    if unknown := set(found) - {x.name for x in dataclasses.fields(kind)}:
        raise ValueError(f"unknown members: {sorted(unknown)}")
    return kind(**found)
