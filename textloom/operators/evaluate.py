"""Quality of class predictions. Everything follows from one small table of counts by (keys, true, predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import ratio
from textloom.schema import CLASSES, ordinal


def pair_counts(predictions: DataFrame, keys: list[str] = (), true: str = "true_complexity", predicted: str = "predicted_complexity") -> DataFrame:
    """(keys, t, p, n) of the rows that have a prediction: the one shuffle of the evaluation."""
    return predictions.where(F.col(predicted).isNotNull()).groupBy(*keys, F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def accuracy(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of right predictions; labels outside the classes count as wrong ones."""
    right = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), ratio(right, F.sum("n")).alias("accuracy"))


def label_counts(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, label, hits, support, predicted) over every label that occurs on either side."""
    side = counts.select(*keys, F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"))
    other = counts.select(*keys, F.col("p").alias("label"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"))
    return side.unionAll(other).groupBy(*keys, "label").agg(*(F.sum(x).alias(x) for x in ("hits", "support", "predicted")))


def _scores(frame: DataFrame) -> DataFrame:
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return frame.withColumns({"precision": precision, "recall": recall}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class(counts: DataFrame, keys: list[str] = (), labels=CLASSES) -> DataFrame:
    """Precision, recall, F1 and support of each of ``labels`` for each key; 0 where a label doesn't occur."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(x,) for x in labels], "label string")
    # The dimension is fixed and tiny, the left side one row a key: the product has one row for each key and label.
    frame = counts.select(*keys).distinct().withColumn("label", F.explode(F.array(*map(F.lit, labels)))) if keys else dim
    found = frame.join(label_counts(counts, keys), [*keys, "label"], "left").na.fill(0, ["hits", "support", "predicted"])
    return _scores(found)


def averages(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Weighted and plain means over all labels that occur: the weights are the supports."""
    scored = _scores(label_counts(counts, keys))
    weighted = [ratio(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(f"{x}_weighted") for x in ("precision", "recall", "f1")]
    return scored.groupBy(*keys).agg(*weighted, *(F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{x}_macro") for x in ("precision", "recall", "f1")))


def confusion(counts: DataFrame, keys: list[str] = (), labels=CLASSES) -> DataFrame:
    """A row and a column for each label, whether it occurs or not; pairs with another label are left out."""
    frame = counts.select(*keys).distinct().withColumn("t", F.explode(F.array(*map(F.lit, labels)))) if keys else counts.sparkSession.createDataFrame([(x,) for x in labels], "t string")
    inside = counts.where(F.col("t").isin(*labels) & F.col("p").isin(*labels))
    named = inside.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("t").alias("__t")).pivot("p", list(labels)).agg(F.sum("n"))
    same = F.col("t") == F.col("__t")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return frame.join(named, same, "left").select(*keys, "t", *labels).na.fill(0, list(labels))


def report(counts: DataFrame, labels=CLASSES) -> DataFrame:
    """Long report: a row for each label, then the means over ``labels``, and accuracy or, with other labels, micro average."""
    rows = per_class(counts, labels=labels)
    measures = ("precision", "recall", "f1")
    lone = rows.select("label", *measures, "support")
    macro = rows.agg(*(F.avg(x).alias(x) for x in measures), F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *measures, "support")
    weighted = rows.agg(*(ratio(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in measures), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *measures, "support")
    total = rows.agg(F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    extra = counts.agg(F.coalesce(F.max((~F.col("t").isin(*labels) | ~F.col("p").isin(*labels)).cast("int")), F.lit(0)).alias("extra"))
    micro = _scores(total).join(extra, F.lit(True)).select(F.when(F.col("extra") == 1, "micro avg").otherwise("accuracy").alias("label"), *measures, "support")
    return lone.unionByName(macro).unionByName(weighted).unionByName(micro)


def distribution(counts: DataFrame, labels=CLASSES) -> DataFrame:
    """For each label: true and predicted counts, hits, percentages of all rows, and recall in percent."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    percent = lambda a, b: F.lit(100.0) * ratio(F.col(a), F.col(b))
    return per_class(counts, labels=labels).join(F.broadcast(total), F.lit(True)).select(
        "label", F.col("support").alias("true_count"), F.col("predicted").alias("predicted_count"), F.col("hits").alias("correct"),
        percent("support", "total").alias("true_percent"), percent("predicted", "total").alias("predicted_percent"), percent("hits", "support").alias("accuracy_for_class"),
    )


def errors(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts of wrong predictions by ``true_as_predicted``."""
    return counts.where("t <> p").groupBy(*keys, F.concat("t", F.lit("_as_"), "p").alias("error")).agg(F.sum("n").alias("n"))


def distances(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean, median, largest and population deviation of the distance in class order; other labels are left out."""
    known = counts.withColumn("d", F.abs(ordinal(F.col("t")) - ordinal(F.col("p"))).cast("double")).where(F.col("d").isNotNull())
    mean = F.sum(F.col("d") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("d") * F.col("d") * F.col("n")) / F.sum("n")
    return known.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(mean, F.lit(0.0)).alias("mean_distance"), F.percentile("d", F.lit(0.5), F.col("n")).alias("median_distance"),
        F.coalesce(F.max("d"), F.lit(0.0)).alias("max_distance"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_distance"),
    )


def rank_by_time(timing: DataFrame, tool: str = "tool") -> DataFrame:
    """Tools by rising mean time; the table has one row a tool, so one window over it is small."""
    return timing.withColumn("rank", F.row_number().over(W.orderBy("mean_time", tool)))
