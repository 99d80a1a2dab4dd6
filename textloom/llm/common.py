"""Shared helpers of the training-data operators: lineage cuts, Arrow batches, word arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import checkpoint_dir, cut

__all__ = ["BLOCK_BYTES", "blocks", "bounds", "checkpoint_dir", "coded", "cut", "fields", "flat", "fresh", "in_arrow", "mapped", "read", "remainder", "tidied", "words"]

#: Texts are handled in blocks of about this many bytes, so memory doesn't follow the batch size.
BLOCK_BYTES = 2 << 20


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """A table of the test-data layout, with just the named columns (all if none is named)."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow``; functions take their batches apart by ``blocks``, as texts may be long."""
    return df.mapInArrow(function, schema)


def tidied(function):
    """``function`` of a task's batches, after which the worker, which stays for other tasks, gives free memory back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return run


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The names ``wanted``, each with as many underscores before it as make it differ from all columns of ``df``."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(docs: DataFrame, keys: list[str], inputs: dict[str, Column], start: Callable, results: dict[str, str], tidy: bool = False) -> DataFrame:
    """``keys`` of each row and ``results`` (name: type), the arrays that ``start()`` makes of a block of ``inputs``.

    ``start`` is called once a task and returns the function for its blocks. Among the inputs is a ``text``. A key that
    has the name of a result gives way to it; other names clash with nothing, as keys are renamed on the way. With
    ``tidy`` workers give free memory back after each task.
    """
    keys = [x for x in keys if x.lower() not in {y.lower() for y in results}]
    kinds = [docs.select(F.col(f"`{x}`")).schema[0].dataType.simpleString() for x in keys]
    # A text that is also a key goes to Python once.
    sent = ["text" if (x, kind) == ("text", "string") else f"key{i}" for i, (x, kind) in enumerate(zip(keys, kinds, strict=True))]
    inner = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(keys, sent, strict=True) if y != "text"), *(c.alias(x) for x, c in inputs.items()))
    names = [*(f"key{i}" for i in range(len(keys))), *results]
    schema = ", ".join([*(f"key{i} {kind}" for i, kind in enumerate(kinds)), *(f"`{x}` {kind}" for x, kind in results.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([*(block.column(x) for x in sent), *function(block)], names=names)

    return in_arrow(inner, tidied(run) if tidy else run, schema).select(*(F.col(f"key{i}").alias(x) for i, x in enumerate(keys)), *(f"`{x}`" for x in results))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of ``column``; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast("int64"))
        part = np.cumsum(size) // limit
        ends = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The non-empty items of a list array and, for each, the row it stands in."""
    items = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    keep = pc.greater(pc.binary_length(items), 0)
    return items.filter(keep), rows[np.asarray(keep)]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased maximal runs of letters, marks and digits of each text, with their rows; null is empty."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast("large_string"), ""))
    return flat(pc.ascii_split_whitespace(pc.replace_substring_regex(lower, r"[^\pL\pM\pN]+", " ")))


def fields(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' parts between ASCII white space, as written, with their rows; null is empty."""
    return flat(pc.ascii_split_whitespace(pc.fill_null(texts.cast("large_string"), "")))


def coded(items: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct items and the index of each item among them."""
    found = items.dictionary_encode()
    return found.dictionary.to_pylist(), np.asarray(found.indices)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins (and ends) in the ascending array ``rows``."""
    return np.searchsorted(rows, np.arange(n + 1))
