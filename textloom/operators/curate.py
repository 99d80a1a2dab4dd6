"""Curation: filters, projections, limits and exact splits of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from textloom.functions.text import code_of, has_complexity, long_enough

_PREFIXES = 4  # hex digits, so at most 65,536 groups


def curate(samples: DataFrame, primary: str = "query_code", alternative: str = "query_dataclass_code", keep: Column | None = None, least: int = 10, need_complexity: bool = False) -> DataFrame:
    """Samples that a caller's predicate keeps, with ``code`` (one field, else the other) of ``least`` characters or more."""
    out = samples if keep is None else samples.where(keep)
    if need_complexity:
        out = out.where(has_complexity(F.col("time_complexity_inferred"), F.col("space_complexity_inferred")))
    return out.withColumn("code", code_of(F.col(primary), F.col(alternative))).where(long_enough(F.col("code"), least))


def metadata(samples: DataFrame) -> DataFrame:
    """Ids default to the empty text; complexity labels stay null where they are absent."""
    ids = {x: F.coalesce(F.col(x), F.lit("")) for x in ("problem_id", "solution_id")}
    return samples.withColumns(ids).withColumnsRenamed({"time_complexity_inferred": "time_complexity", "space_complexity_inferred": "space_complexity"})


def head(samples: DataFrame, n: int | None, order: str, rule: Column | None = None, raw: bool = False) -> DataFrame:
    """The first ``n`` rows by ``order``: of those that ``rule`` accepts, or (``raw``) of all rows before the rule; None, 0 or -1: all.

    By an integer ``order`` only the blocks of a table are read that hold the first rows (``reached``).
    """
    accepted = samples if rule is None else samples.where(rule)
    if not n or n < 0:
        return accepted
    if samples.schema[order].dataType in (ByteType(), ShortType(), IntegerType(), LongType()):
        last = reached(samples, n, order, None if raw else rule)
        if last is not None:
            samples = samples.where(F.col(order).isNull() | (F.col(order) <= last))
            accepted = samples if rule is None else samples.where(rule)
    if raw:
        first = samples.orderBy(order).limit(n)
        return first if rule is None else first.where(rule)
    return accepted.orderBy(order).limit(n)


def reached(samples: DataFrame, n: int, order: str, rule: Column | None = None) -> int | None:
    """A value of ``order`` up to which ``n`` rows that ``rule`` accepts stand; None if there are fewer than that in all.

    From the least value on (one column is read for it) a stretch of ``n`` values is tried, then each time one four times
    as wide. The bound reaches the scan, which passes over all blocks whose statistics lie above it: where blocks are
    sorted by ``order``, besides that column as much is read as holds the rows that are looked for, however large the
    table is. Of other tables more is read, with the same result.
    """
    accepted = samples if rule is None else samples.where(rule)
    least, width = samples.agg(F.min(order)).first()[0], n
    while least is not None and least + width < 2**62:
        last = least + width
        if accepted.where(F.col(order).isNull() | (F.col(order) <= last)).limit(n).count() >= n:
            return last
        if samples.where(F.col(order) > last).select(order).limit(1).isEmpty():
            return None
        width *= 4
    return None


def exact_split(samples: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """``samples`` with ``train``: exactly int(n * share) rows, by the order of md5(seed:key).

    Only rows that share the first hex digits of the hash are ranked together; groups' offsets come from their counts
    (at most 65,536), so no task orders all rows. Rows alike in key are ranked by nothing else: keys have to be unique.
    """
    hashed = samples.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("__g", F.substring("__h", 1, _PREFIXES))
    groups = hashed.groupBy("__g").agg(F.count("*").alias("__c"))
    every = W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.withColumn("__o", F.coalesce(F.sum("__c").over(every), F.lit(0))).withColumn("__n", F.sum("__c").over(W.partitionBy()))
    ranked = hashed.join(F.broadcast(offsets), "__g").withColumn("__r", F.row_number().over(W.partitionBy("__g").orderBy("__h", key)) + F.col("__o"))
    return ranked.withColumn("train", F.col("__r") <= F.floor(F.col("__n") * F.lit(float(share)))).drop("__h", "__g", "__c", "__o", "__n", "__r")


def ordinals(rows: DataFrame, order: str, width: int = 4096, tie: str | None = None) -> DataFrame:
    """``rows`` with ``ordinal``: 1 to n by an integer ``order`` column (then ``tie``), ranked in ranges of ``width`` values.

    The ranges' offsets are summed up in ranges of ``width`` ranges, and those by one window: it has a row for every
    ``width`` squared values, 16 million by default, so no task sees more than a sliver of a large table.
    """
    ranged = rows.withColumn("__g", F.floor(F.col(order) / F.lit(width)))
    groups = ranged.groupBy("__g").agg(F.count("*").alias("__c")).withColumn("__f", F.floor(F.col("__g") / F.lit(width)))
    sums = groups.groupBy("__f").agg(F.sum("__c").alias("__c"))
    preceding = lambda w: F.coalesce(F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = sums.select("__f", preceding(W.orderBy("__f")).alias("__p"))
    before = groups.select("__f", "__g", preceding(W.partitionBy("__f").orderBy("__g")).alias("__q")).join(far, "__f").select("__g", (F.col("__p") + F.col("__q")).alias("__o"))
    return ranged.join(before, "__g").withColumn("ordinal", F.row_number().over(W.partitionBy("__g").orderBy(order, *([tie] if tie else []))) + F.col("__o")).drop("__g", "__o")


def sequential_split(tokens: DataFrame, share: float, position: str = "ordinal") -> DataFrame:
    """``tokens`` with ``train``: whether a row's position (from 1) is in the first int(n * share)."""
    total = tokens.agg(F.count("*").alias("__n"))
    return tokens.join(F.broadcast(total), F.lit(True)).withColumn("train", F.col(position) <= F.floor(F.col("__n") * F.lit(float(share)))).drop("__n")
