"""Timing and length statistics, value counts and the summary of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import fixed, pad_right, ratio
from textloom.operators import evaluate
from textloom.schema import CLASSES


#: Accuracy of the sketch that brackets a percentile; smaller groups are bracketed by their least and largest value.
ACCURACY = 10_000


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column a share): exact percentiles, linearly interpolated, with no group's values in one task.

    A sketch brackets each percentile; then only the values within its bracket (a few in ten thousand) are ranked, by
    value and count, and those below it are counted. Nulls are left out; keys may be null.
    """
    keys, n = list(keys), F.col("__n")
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    ends = [x for p in shares.values() for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    base = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__a"), F.max("__v").alias("__z"), F.percentile_approx("__v", ends, ACCURACY).alias("__b"))
    bracket = lambda i, p, name: F.struct(
        F.lit(name).alias("__p"), (F.lit(p) * (n - 1)).alias("__h"), F.when(n < 4 * ACCURACY, F.col("__a")).otherwise(F.col("__b")[2 * i]).alias("__lo"), F.when(n < 4 * ACCURACY, F.col("__z")).otherwise(F.col("__b")[2 * i + 1]).alias("__hi")
    )
    brackets = base.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.inline(F.array(*(bracket(i, p, name) for i, (name, p) in enumerate(shares.items())))))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = rows.join(brackets, same & (F.col("__v") <= F.col("__hi"))).groupBy(*keys, "__p", "__h", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__w")).agg(F.count("*").alias("__c"))
    ranked = inside.withColumn("__r", F.sum("__c").over(W.partitionBy(*keys, "__p").orderBy(F.col("__w").asc_nulls_first())))
    at = lambda rank: F.min(F.when(F.col("__r") > rank, F.col("__w")))
    found = ranked.groupBy(*keys, "__p", "__h").agg(at(F.floor("__h")).alias("__x"), at(F.ceil("__h")).alias("__y"))
    found = found.withColumn("__q", F.col("__x") + (F.col("__h") - F.floor("__h")) * (F.col("__y") - F.col("__x")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__p") == name, F.col("__q"))).alias(name) for name in shares))


def _with(frame: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``frame`` left-joined with ``other``, of one row a key; null keys meet."""
    named = other.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return frame.join(named, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def timing(samples: DataFrame, keys: list[str] = (), time: str = "execution_time") -> DataFrame:
    """Statistics over times above 0; samples_per_second is all samples by the summed time."""
    t = F.when(F.col(time) > 0, F.col(time).cast("double"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    plain = samples.groupBy(*keys).agg(
        F.count("*").alias("total_samples"), F.count(t).alias("timed"), zero(F.sum(t)).alias("total_time"), zero(F.avg(t)).alias("mean_time"), zero(F.min(t)).alias("min_time"), zero(F.max(t)).alias("max_time"),
        zero(F.stddev_pop(t)).alias("std_time"), ratio(F.count("*"), F.sum(t)).alias("samples_per_second"),
    )
    ranks = percentiles(samples.where(F.col(time) > 0), keys, time, {"median_time": 0.5, "p95_time": 0.95, "p99_time": 0.99})
    out = _with(plain, ranks, list(keys)).withColumn("median_time", zero(F.col("median_time")))
    return out.select(*keys, "total_samples", "timed", "total_time", "mean_time", "median_time", "min_time", "max_time", "std_time", "p95_time", "p99_time", "samples_per_second")


def lengths(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each length column: mean, population deviation, least, largest and median; null counts as 0."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    plain = long.groupBy("name").agg(F.count("*").alias("total"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return _with(plain, percentiles(long, ["name"], "v", {"median": 0.5}), ["name"])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, by value; nulls aren't counted."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def tool_summary(predictions: DataFrame, tool: str = "tool") -> DataFrame:
    """One row a tool: accuracy, weighted means, mean class distance and timing."""
    counts = evaluate.pair_counts(predictions, [tool])
    times = timing(predictions, [tool]).select(tool, "total_samples", "total_time", "mean_time", "median_time", "samples_per_second")
    scored = evaluate.accuracy(counts, [tool]).withColumnRenamed("n", "valid_predictions")
    scored = scored.join(evaluate.averages(counts, [tool]).select(tool, "f1_weighted", "precision_weighted", "recall_weighted"), tool)
    scored = scored.join(evaluate.distances(counts, [tool]).select(tool, "mean_distance"), tool, "left")
    out = times.join(scored, tool, "left")
    return out.na.fill(0.0, ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "mean_distance"]).na.fill(0, ["valid_predictions"])


def report_lines(summary: DataFrame, tool: str = "tool") -> DataFrame:
    """Fixed-width report lines, fastest tool first; times in milliseconds."""
    ranked = evaluate.rank_by_time(summary, tool)
    line = F.format_string("%-24s %s %s %10s ms", F.col(tool), fixed(F.col("accuracy"), 4), fixed(F.col("f1_weighted"), 4), fixed(F.col("mean_time") * 1000, 3))
    return ranked.select("rank", line.alias("line")).orderBy("rank")


def speed_lines(summary: DataFrame, tool: str = "tool") -> DataFrame:
    """(rank, line): total time in seconds, mean time in milliseconds and samples a second, fastest tool first; wider figures stay whole."""
    right = lambda text, width: F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))
    total, mean, rate = fixed(F.col("total_time"), 2), fixed(F.col("mean_time") * 1000, 2), fixed(F.col("samples_per_second"), 2)
    line = F.concat(pad_right(F.col(tool), 15), F.lit(" "), right(total, 12), F.lit(" s  "), right(mean, 12), F.lit(" ms "), right(rate, 14))
    return evaluate.rank_by_time(summary, tool).select("rank", line.alias("line"))


def report_blocks(predictions: DataFrame, tool: str = "tool", labels=CLASSES, places: int | None = None) -> DataFrame:
    """(tool, ord, line): a block for each tool, of scores, times (in milliseconds a sample) and a table of classes.

    ``places``: scores and times (in seconds) are rounded to so many places first, as a summary that was rounded has them.
    """
    counts = evaluate.pair_counts(predictions, [tool])
    rows = timing(predictions, [tool]).join(evaluate.accuracy(counts, [tool]).withColumnRenamed("n", "valid"), tool, "left").join(evaluate.averages(counts, [tool]), tool, "left").na.fill(0)
    if places is not None:
        rows = rows.withColumns({c: F.round(c, places) for c, kind in rows.dtypes if kind == "double"})
    ms = lambda x: F.col(x) * 1000
    scores = {"Accuracy": "accuracy", "F1 (weighted)": "f1_weighted", "Precision (weighted)": "precision_weighted", "Recall (weighted)": "recall_weighted"}
    times = {"Mean time": "mean_time", "Median time": "median_time", "Least time": "min_time", "Most time": "max_time"}
    said = [
        F.upper(tool), *(F.concat(F.lit(f"{name:<21}"), fixed(F.col(c), 4)) for name, c in scores.items()), F.format_string("Valid                %d/%d", F.col("valid"), F.col("total_samples")),
        F.concat(F.lit("Total time           "), fixed(F.col("total_time"), 2), F.lit(" s")), *(F.concat(F.lit(f"{name:<21}"), fixed(ms(c), 2), F.lit(" ms")) for name, c in times.items()),
        F.concat(F.lit("Samples a second     "), fixed(F.col("samples_per_second"), 2)), F.lit(f"{'Class':<12} {'True':<10} {'Predicted':<12} {'Right':<10} Accuracy"),
    ]
    lines = F.array(*(F.struct(F.lit(i).alias("ord"), line.alias("line")) for i, line in enumerate(said)))
    head = rows.select(tool, F.inline(lines))
    scores = evaluate.per_class(counts, [tool], labels).where("support > 0 OR predicted > 0")
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") + len(said) - 1
    table = scores.select(tool, place.alias("ord"), F.format_string("%-12s %-10d %-12d %-10d %s%%", F.col("label"), F.col("support"), F.col("predicted"), F.col("hits"), fixed(F.col("recall") * 100, 1)).alias("line"))
    return head.unionByName(table)
