"""Analysis of training runs: loss curves, early stopping, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from textloom.functions.text import fixed, pad_right, preview, ratio


def rolling_mean(rows: DataFrame, value: str, order: str, n: int, keys: list[str] = ()) -> DataFrame:
    """``rows`` with the mean of the last ``n`` values (fewer at the beginning)."""
    return rows.withColumn("rolling_mean", F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)))


def running_best(rows: DataFrame, value: str, order: str, keys: list[str] = ()) -> DataFrame:
    """``rows`` with the least value before each (null at first), the least so far, and whether it improved strictly."""
    before = F.min(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("best_before", before)
    return out.withColumns({"improved": F.col("best_before").isNull() | (F.col(value) < F.col("best_before")), "best": F.least(F.col(value), F.col("best_before"))})


def early_stopping(rows: DataFrame, value: str, order: str, patience: int, keys: list[str] = ()) -> DataFrame:
    """``rows`` up to the first at which ``patience`` rows have passed without improvement, with ``waited``."""
    run = W.partitionBy(*keys).orderBy(order)
    out = running_best(rows, value, order, keys).withColumn("__i", F.sum(F.col("improved").cast("int")).over(run))
    out = out.withColumn("waited", (F.row_number().over(W.partitionBy(*keys, "__i").orderBy(order)) - 1).cast("int"))
    out = out.withColumn("__stop", F.min(F.when(F.col("waited") >= patience, F.col(order))).over(W.partitionBy(*keys)))
    return out.where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).withColumn("stopped", F.coalesce(F.col(order) == F.col("__stop"), F.lit(False))).drop("__i", "__stop")


def periodic(rows: DataFrame, step: str, every: int, last: bool = False, keys: list[str] = ()) -> DataFrame:
    """Rows whose step is a multiple of ``every``; ``last`` keeps the last step too."""
    due = F.pmod(F.col(step), F.lit(every)) == 0
    if not last:
        return rows.where(due)
    out = rows.withColumn("__last", F.max(step).over(W.partitionBy(*keys)))
    return out.where(due | (F.col(step) == F.col("__last"))).drop("__last")


def clean_metrics(metrics: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Metric rows without repeats; with ``runs`` only those of active runs that finished (status 3)."""
    out = metrics.dropDuplicates(["run_id", "key", "ts", "step", "value"])
    if runs is None:
        return out
    return out.join(runs.where((F.col("lifecycle_stage") == "active") & (F.col("status") == 3)).select("run_id"), "run_id", "left_semi")


def sessions(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", seconds_a_turn: float = 0.5) -> DataFrame:
    """A row a session: steps in order, characters given and made, time, characters a second, and a preview."""
    grouped = turns.groupBy(key).agg(
        F.count("*").alias("steps"), F.sum(F.when(F.col("role") == "user", F.length(text)).otherwise(0)).alias("prompt_length"), F.sum(F.when(F.col("role") == "user", 0).otherwise(F.length(text))).alias("generated_length"),
        F.min_by(text, order).alias("first_text"),
    )
    time = F.col("steps") * F.lit(seconds_a_turn)
    return grouped.select(key, "steps", "prompt_length", "generated_length", time.alias("total_time"), ratio(F.col("generated_length"), time).alias("per_second"), preview(F.col("first_text")).alias("preview"))


def session_records(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """A row a session with its steps in order, each with its place, role and text; a session is one generation."""
    step = F.struct(F.col(order).alias("step"), F.col("role").alias("role"), F.col(text).alias("token_text"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def metric_table(rows: DataFrame, name: str, value: str, width: int = 24, digits: int = 4) -> DataFrame:
    """Fixed-width lines of named values; long names stay whole, and thousands are grouped."""
    return rows.select(F.concat(pad_right(F.col(name), width), F.lit(" | "), fixed(F.col(value), digits, grouped=True)).alias("line"))


def call_back(rows: DataFrame, callback, step: str = "step", names: list[str] | None = None) -> int:
    """``callback(step, metrics)`` for each row, by rising step: rows come to the driver a partition at a time. How many."""
    names, n = names or [x for x in rows.columns if x != step], 0
    for n, row in enumerate(rows.select(step, *names).orderBy(step).toLocalIterator(), 1):  # noqa: B007
        callback(row[step], {x: row[x] for x in names})
    return n


def observed(rows: DataFrame, **metrics: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``rows`` as they are, and a function that gives the metrics of them once a job has run over them.

    Tasks gather the metrics while they do the job's own work; no row comes to the driver and nothing is computed twice.
    """
    watch = Observation()
    return rows.observe(watch, *(c.alias(x) for x, c in metrics.items())), lambda: watch.get


class _Steps(StreamingQueryListener):
    def __init__(self, name: str, callback: Callable[[int, dict], None], names: list[str]):
        self.name, self.callback, self.names = name, callback, names

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.callback(event.progress.batchId, {x: found[x] for x in self.names})


@contextmanager
def each_step(stream: DataFrame, callback: Callable[[int, dict], None], name: str = "steps", **metrics: Column) -> Iterator[DataFrame]:
    """Within the block: ``stream`` as it is, where after each step (a micro-batch, from 0) ``callback(step, metrics)`` is called, in order.

    Metrics are aggregates of the step's rows, gathered by the tasks; queries of the block have to have ended (or to have processed
    all that was there) before it does.
    """
    listener = _Steps(name, callback, list(metrics))
    stream.sparkSession.streams.addListener(listener)
    try:
        yield stream.observe(name, *(c.alias(x) for x, c in metrics.items()))
    finally:
        stream.sparkSession._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        stream.sparkSession.streams.removeListener(listener)


def held(points: DataFrame, run: str, step: str, value: str, grid: int) -> DataFrame:
    """(``run``, ``step``, ``value``) at each multiple of ``grid`` from a run's first point to its last: the latest value at or before it.

    Each point stands for the multiples up to the next one of its run, so nothing is joined and runs of other steps align.
    Points without a step or value don't count; of several at one step the largest value does.
    """
    once = points.where(F.col(step).isNotNull() & F.col(value).isNotNull()).groupBy(run, step).agg(F.max(value).alias(value))
    after = F.lead(step).over(W.partitionBy(run).orderBy(step))
    first, last = F.ceil(F.col(step) / F.lit(grid)), F.floor((F.coalesce(after, F.col(step) + 1) - 1) / F.lit(grid))
    spans = once.select(run, value, first.alias("__from"), last.alias("__to")).where(F.col("__from") <= F.col("__to"))
    return spans.select(run, value, F.explode(F.sequence("__from", "__to")).alias("__at")).select(run, (F.col("__at") * grid).cast("bigint").alias(step), value)


def compare(points: DataFrame, run: str, step: str, value: str, grid: int) -> DataFrame:
    """A row a run: its value at the last step that all runs have reached, its rank by that (least first, then by name), and its best so far.

    Steps are those of ``held``. Columns: ``run``, compared_step, final, best, steps, rank, behind (the difference to the first).
    Runs that end before another begins have no common step: then there is no row.
    """
    aligned = held(points, run, step, value, grid)
    ends = aligned.groupBy(run).agg(F.min(step).alias("a"), F.max(step).alias("z")).agg(F.max("a").alias("__a"), F.min("z").alias("__z"))
    common = aligned.join(F.broadcast(ends), F.col(step) <= F.col("__z")).where(F.col("__a") <= F.col("__z"))
    each = common.groupBy(run, "__z").agg(F.max_by(value, step).alias("final"), F.min(value).alias("best"), F.count("*").alias("steps"))
    # Runs are configurations: some hundreds.
    order = W.orderBy("final", run)
    ranked = each.withColumns({"rank": F.row_number().over(order), "behind": F.col("final") - F.first("final").over(order)})
    return ranked.select(run, F.col("__z").alias("compared_step"), "final", "best", "steps", "rank", "behind")


def parameter_counts(parameters: DataFrame, kind: str = "kind", size: str = "numel", trainable: str = "trainable", embedding: str = "embedding") -> DataFrame:
    """A row for each kind of module and one for all (kind null): weights, those trained, and those outside embeddings."""
    some = lambda rule: F.coalesce(F.sum(F.when(rule, F.col(size))), F.lit(0)).cast("bigint")
    return parameters.rollup(F.col(kind).alias("kind")).agg(some(F.lit(True)).alias("total"), some(F.col(trainable)).alias("trained"), some(F.col(kind) != embedding).alias("without_embedding"))
