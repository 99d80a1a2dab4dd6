"""The two end-to-end programs: analyse-classify-evaluate, and curate-tokenise-split-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import code, curate, evaluate, sequences, stats
from textloom.session import cut


def analyse(samples: DataFrame, mode: str = "enhanced", tools=None, limit: int | None = None, order: str = "ord", mappers: dict | None = None) -> dict[str, DataFrame]:
    """All results for ``samples`` (src, complexity, ...): predictions, scores, errors, distances, timing, summary.

    The predictions are computed once and checkpointed, so each source is parsed once whatever results are read; all
    scores come from one table of counts.
    """
    chosen = curate.head(samples, limit, order) if limit else samples
    rows = code.predictions(code.code_metrics(chosen), mode, tools, mappers).withColumnRenamed("complexity", "true_complexity")
    rows = cut(rows.withColumns({x: F.coalesce(F.col(x), F.lit("unknown")) for x in ("problem",) if x in rows.columns}))
    counts = cut(evaluate.pair_counts(rows, ["tool"]))
    return {
        "predictions": rows, "accuracy": evaluate.accuracy(counts, ["tool"]), "per_class": evaluate.per_class(counts, ["tool"]), "averages": evaluate.averages(counts, ["tool"]),
        "confusion": evaluate.confusion(counts, ["tool"]), "errors": evaluate.errors(counts, ["tool"]), "distances": evaluate.distances(counts, ["tool"]),
        "timing": stats.timing(rows, ["tool"]), "summary": stats.tool_summary(rows),
    }


def batches(samples: DataFrame, vocabulary: DataFrame, block: int, size: int, share: float = 0.9, seed: int = 42, key: str = "line", keep: Column | None = None, need_complexity: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training and validation batches of curated samples: the first shuffled and full only, the second in order."""
    coded = sequences.encode(curate.curate(samples, keep=keep, need_complexity=need_complexity), vocabulary, "code")
    coded = coded.withColumn("ids", sequences.truncate(F.col("ids"), block))
    split = curate.exact_split(coded, share, seed, key)
    shuffled = split.where("train").withColumn("__m", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint"))
    train = sequences.batched(curate.ordinals(shuffled, "__m", 1 << 16, key), size, drop_last=True)
    return sequences.collate(train, "ids", length=block), sequences.collate(sequences.batched(curate.ordinals(split.where("NOT train"), key), size), "ids", length=block)
