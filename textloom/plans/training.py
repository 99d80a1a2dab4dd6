"""Queries of training-run analysis, over ``events`` and ``conversations``.

Stand-ins: the mean value of an event type's day is its loss, the event type the run, the day the step; conversations
are generation sessions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import schedule, text
from textloom.operators import runs
from textloom.plans.evaluation import _rounded
from textloom.session import cut, shared_folder
from textloom.sources import runstore
from textloom.sources.files import delete, move, write_text

WINDOW, PATIENCE, EVERY, STEPS, RATE = 5, 4, 3, 1000, 3e-4


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, loss), the loss rounded so that engines order ties alike."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return events.groupBy(F.col("event_type").alias("run_id"), day.alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"))


def rolling_train_loss(spark, sf_dir):
    return _rounded(runs.rolling_mean(losses(spark, sf_dir), "loss", "step", WINDOW, ["run_id"]).select("run_id", "step", "rolling_mean"))


def best_val_loss(spark, sf_dir):
    return _rounded(runs.running_best(losses(spark, sf_dir), "loss", "step", ["run_id"]).select("run_id", "step", "best", "improved"))


def early_stopping(spark, sf_dir):
    return _rounded(runs.early_stopping(losses(spark, sf_dir), "loss", "step", PATIENCE, ["run_id"]).select("run_id", "step", "waited", "stopped"))


def periodic_checkpoints(spark, sf_dir):
    return _rounded(runs.periodic(losses(spark, sf_dir), "step", EVERY, last=True, keys=["run_id"]).select("run_id", "step"))


def perplexity(spark, sf_dir):
    scaled = losses(spark, sf_dir).withColumn("x", F.col("loss") / F.lit(100.0))
    return _rounded(scaled.groupBy("run_id").agg(F.avg("x").alias("mean_loss"), schedule.perplexity(F.col("x")).alias("perplexity")))


def lr_schedule(spark, sf_dir):
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % (STEPS + 1)).alias("step")).distinct()
    return _rounded(steps.select("step", *((schedule.learning_rate(k, F.col("step"), STEPS, RATE) * 1000).alias(k) for k in ("cosine", "linear", "constant"))))


def param_estimate(spark, sf_dir):
    """Weights of decoders whose sizes come from ``nation``."""
    sizes = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") + 1).cast("bigint").alias("layers"), ((F.col("n_regionkey") + 1) * 64).cast("bigint").alias("width"))
    return sizes.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), schedule.transformer_parameters(F.lit(500).cast("bigint"), F.col("width"), F.col("layers")).alias("parameters"))


def param_formulas(spark, sf_dir):
    """The counts that go by other formulas, for the same sizes."""
    big = lambda c: c.cast("bigint")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(big(F.col("n_nationkey")).alias("n_nationkey"), big(F.col("n_nationkey") + 1).alias("l"), big((F.col("n_regionkey") + 1) * 64).alias("w"))
    v, b, w, layers = F.lit(500).cast("bigint"), F.lit(256).cast("bigint"), F.col("w"), F.col("l")
    tied = schedule.tied_parameters(v, b, w, layers, 4 * w)
    rotary = schedule.tied_parameters(v, b, w, layers, 4 * w, rotary=True)
    return n.select("n_nationkey", big(tied).alias("tied"), big(schedule.adapted_parameters(rotary, w, layers, 2, 16, 4, 32)).alias("adapted"), big(schedule.estimated_parameters(v, b, w, layers, 4, 0.5, 7)).alias("estimated"))


def parameter_counts(spark, sf_dir):
    """Weights by kind of module: regions of ``nation`` are the kinds, the first one the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("string").alias("kind"), (F.col("n_nationkey") * 100 + 7).cast("bigint").alias("numel"), (F.col("n_nationkey") % 3 != 0).alias("trainable"))
    return runs.parameter_counts(rows, embedding="0")


def run_names(spark, sf_dir):
    """Names of runs by the moment of an event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return rows.select("event_id", text.run_name(F.col("ts"), "model").alias("name"))


def generation_sessions(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return _rounded(runs.sessions(turns))


def config_comparison(spark, sf_dir):
    """Runs whose steps differ (each lacks others of its days), aligned by the week and ranked."""
    rows = losses(spark, sf_dir)
    kept = rows.where(F.pmod(F.col("step") * 7 + F.length("run_id"), F.lit(5)) != 0)
    return _rounded(runs.compare(kept, "run_id", "step", "loss", 7))


def aligned_losses(spark, sf_dir):
    """The same runs at each week: the latest loss."""
    rows = losses(spark, sf_dir)
    return runs.held(rows.where(F.pmod(F.col("step") * 7 + F.length("run_id"), F.lit(5)) != 0), "run_id", "step", "loss", 7)


def _configs(spark, sf_dir) -> DataFrame:
    """Configurations whose members follow from the keys of orders; many break rules."""
    k = F.col("o_orderkey").cast("bigint")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("key"), (k % 7 * 64).cast("int").alias("width"), (k % 5).cast("int").alias("heads"), (k % 11).cast("int").alias("layers"), ((k % 13) / F.lit(10.0)).alias("dropout"), ((k % 17) / F.lit(16.0)).alias("share"), (k % 3 - 1).cast("double").alias("rate"),
        F.when(k % 6 == 0, "z").otherwise("q").alias("target"),
    ).withColumn("targets", F.array("target")).drop("target")


def judged_configs(spark, sf_dir):
    """The rules that each configuration breaks."""
    return config.judged(_configs(spark, sf_dir)).select("key", F.size("broken").cast("bigint").alias("n_broken"), F.array_join("broken", "; ").alias("broken"))


def valid_configs(spark, sf_dir):
    """Configurations that break none, checked within the plan."""
    good = config.judged(_configs(spark, sf_dir)).where(F.size("broken") == 0).drop("broken")
    return config.validated(good, "key").select("key", F.col("width").cast("bigint").alias("width"), F.col("heads").cast("bigint").alias("heads"), F.col("layers").cast("bigint").alias("layers"))


def run_params_pivot(spark, sf_dir):
    """A run store of all events written and read: clean metrics of finished active runs, with their parameters."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    _write_store(spark, sf_dir, path)
    metrics = runs.clean_metrics(runstore.read_metrics(spark, path), runstore.read_runs(spark, path))
    last = metrics.groupBy("run_id", "key").agg(F.count("*").alias("points"), F.max_by("value", "step").alias("last_value"))
    rows = cut(last.join(runstore.pivot_params(runstore.read_params(spark, path), ["vocab_size", "n_layer"]), "run_id"))
    delete(spark, path)
    return rows


def logged_metrics(spark, sf_dir):
    """Losses logged twice to a table of metrics, with one point repeated at a later time; read, cleaned, and summed up by run."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    points = losses(spark, sf_dir).select("run_id", F.lit("loss").alias("key"), (F.col("step").cast("bigint") * 86_400_000).alias("ts"), "step", F.col("loss").alias("value"))
    later = points.where("step % 10 = 0").select("run_id", "key", (F.col("ts") + 1).alias("ts"), "step", "value")
    for rows in (points, points, later):
        runstore.append_metrics(rows, path)
    clean = runs.clean_metrics(spark.read.parquet(path))
    rows = cut(clean.groupBy("run_id", "key").agg(F.count("*").alias("points"), F.count_distinct("step").alias("steps"), F.max_by("value", "ts").alias("last_value"), F.min("value").alias("best_value")))
    delete(spark, path)
    return _rounded(rows)


def _write_store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A store whose runs are event types and whose losses are all their events, every tenth of them logged twice.

    Every hundredth event is also a metric of a model of its run. Of five runs, by name, the fourth failed and the fifth is deleted.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("run_id"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("step"))
    events = events.where("run_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL")
    twice = events.withColumn("__k", F.explode(F.sequence(F.lit(1), F.when(F.col("step") % 10 == 0, 2).otherwise(1))))
    twice.select("run_id", F.concat_ws(" ", "ts", "value", F.col("step").cast("string")).alias("line")).write.partitionBy("run_id").text(f"{path}/.losses")
    events.where("step % 100 = 0").select(F.concat_ws(" ", "ts", "value", F.col("step").cast("string"), "run_id").alias("line")).write.text(f"{path}/1/models/m-1/metrics/final")
    counts = events.groupBy("run_id").agg(F.count("*").alias("n")).orderBy("run_id").collect()  # a row an event type
    for k, (name, n) in enumerate(counts):
        move(spark, f"{path}/.losses/run_id={name}", f"{path}/1/{name}/metrics/loss")
        status, stage = runstore.STATUS["failed" if k % 5 == 3 else "finished"], "deleted" if k % 5 == 4 else "active"
        write_text(spark, f"{path}/1/{name}/meta.yaml", f"run_name: {name}\nstart_time: {k}\nend_time: {k + n}\nstatus: {status}\nlifecycle_stage: {stage}\n")
        write_text(spark, f"{path}/1/{name}/params/vocab_size", str(n))
        write_text(spark, f"{path}/1/{name}/params/n_layer", str(len(name)))


QUERIES = {f.__name__: f for f in (rolling_train_loss, best_val_loss, early_stopping, periodic_checkpoints, perplexity, lr_schedule, param_estimate, param_formulas, parameter_counts, run_names, generation_sessions, run_params_pivot, logged_metrics, config_comparison, aligned_losses, judged_configs, valid_configs)}

_LOSS = "loss AS (SELECT event_type AS run_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, round(avg(value), 6) AS loss FROM events GROUP BY ALL)"
_BEST = "b AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM loss)"

#: Runs without a fifth of their days, at the multiples of 7 from their first day to their last, by an as-of join.
_HELD = f"""{_LOSS}, k AS (SELECT * FROM loss WHERE (step * 7 + length(run_id)) % 5 <> 0), r AS (SELECT run_id, min(step) AS a, max(step) AS z FROM k GROUP BY run_id),
g AS (SELECT run_id, CAST(s * 7 AS BIGINT) AS step FROM (SELECT run_id, a, z, unnest(range(a // 7, z // 7 + 1)) AS s FROM r) WHERE s * 7 >= a), h AS (SELECT g.run_id, g.step, k.loss FROM g ASOF JOIN k ON g.run_id = k.run_id AND g.step >= k.step)"""
_CONFIGS = """c AS (SELECT o_orderkey AS key, o_orderkey % 7 * 64 AS width, o_orderkey % 5 AS heads, o_orderkey % 11 AS layers, o_orderkey % 13 AS dropout10, o_orderkey % 17 AS share16, o_orderkey % 3 - 1 AS rate, o_orderkey % 6 = 0 AS odd FROM orders),
b AS (SELECT key, width, heads, layers, list_filter([CASE WHEN layers <= 0 THEN 'vocabulary, block, layers and batch have to be above 0' END, CASE WHEN heads = 0 OR width % greatest(heads, 1) <> 0 THEN 'width has to be a multiple of heads' END,
  CASE WHEN dropout10 > 10 THEN 'dropout has to be from 0 to 1' END, CASE WHEN share16 = 0 OR share16 >= 16 THEN 'share has to be between 0 and 1' END, CASE WHEN rate <= 0 THEN 'rate has to be above 0' END,
  CASE WHEN odd THEN 'targets have to be of q, k, v, o and ffn' END], lambda x: x IS NOT NULL) AS broken FROM c)"""

ORACLES = {
    "aligned_losses": f"WITH {_HELD} SELECT run_id, step, loss FROM h",
    "config_comparison": f"""WITH {_HELD}, e AS (SELECT max(a) AS a, min(z) AS z FROM (SELECT run_id, min(step) AS a, max(step) AS z FROM h GROUP BY run_id)),
f AS (SELECT run_id, max(e.z) AS compared_step, arg_max(loss, step) AS final, min(loss) AS best, count(*) AS steps FROM h, e WHERE step <= e.z AND e.a <= e.z GROUP BY run_id)
SELECT run_id, compared_step, round(final, 6) AS final, round(best, 6) AS best, steps, row_number() OVER w AS rank, round(final - first_value(final) OVER w, 6) AS behind FROM f WINDOW w AS (ORDER BY final, run_id)""",
    "logged_metrics": f"""WITH {_LOSS} SELECT run_id, 'loss' AS key, count(*) + count(*) FILTER (WHERE step % 10 = 0) AS points, count(*) AS steps, round(arg_max(loss, step), 6) AS last_value, round(min(loss), 6) AS best_value FROM loss GROUP BY run_id""",
    "judged_configs": f"WITH {_CONFIGS} SELECT key, len(broken) AS n_broken, array_to_string(broken, '; ') AS broken FROM b",
    "valid_configs": f"WITH {_CONFIGS} SELECT key, width, heads, layers FROM b WHERE len(broken) = 0",
    "rolling_train_loss": f"WITH {_LOSS} SELECT run_id, step, round(avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM loss",
    "best_val_loss": f"WITH {_LOSS}, {_BEST} SELECT run_id, step, round(least(loss, coalesce(prev, loss)), 6) AS best, prev IS NULL OR loss < prev AS improved FROM b",
    "early_stopping": f"""WITH {_LOSS}, {_BEST}, g AS (SELECT *, sum(CASE WHEN prev IS NULL OR loss < prev THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step) AS island FROM b),
w AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY step) - 1 AS waited FROM g), s AS (SELECT run_id, min(step) AS stop FROM w WHERE waited >= {PATIENCE} GROUP BY run_id)
SELECT w.run_id, step, waited, coalesce(step = stop, false) AS stopped FROM w LEFT JOIN s ON w.run_id = s.run_id WHERE stop IS NULL OR step <= stop""",
    "periodic_checkpoints": f"WITH {_LOSS} SELECT run_id, step FROM (SELECT *, max(step) OVER (PARTITION BY run_id) AS m FROM loss) WHERE step % {EVERY} = 0 OR step = m",
    "perplexity": f"WITH {_LOSS} SELECT run_id, round(avg(loss / 100), 6) AS mean_loss, round(exp(avg(loss / 100)), 6) AS perplexity FROM loss GROUP BY run_id",
    "lr_schedule": f"""SELECT DISTINCT step, round(1000 * (1e-6 + ({RATE} - 1e-6) * (1 + cos(pi() * step / {STEPS})) / 2), 6) AS cosine, round(1000 * {RATE}::DOUBLE * (1 - 0.9::DOUBLE * step / {STEPS}), 6) AS linear, round(1000 * {RATE}::DOUBLE, 6) AS constant
FROM (SELECT CAST(event_id % {STEPS + 1} AS DOUBLE) AS s, event_id % {STEPS + 1} AS step FROM events)""",
    "param_estimate": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(2 * 500 * w + l * (4 * w * w + 8 * w * w + 5 * w + 4 * w) + 2 * w AS BIGINT) AS parameters
FROM (SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS l, CAST((n_regionkey + 1) * 64 AS BIGINT) AS w FROM nation)""",
    "param_formulas": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(500 * w + 256 * w + l * (2 * w + 4 * w * w + 2 * w + 2 * w * 4 * w) + 2 * w AS BIGINT) AS tied,
  CAST(500 * w + l * (2 * w + 4 * w * w + 2 * w + 2 * w * 4 * w) + 2 * w + l * 2 * (w * 16 * 2) + 4 * 32 + w * 4 AS BIGINT) AS adapted, CAST(500 * w + 256 * w + floor(0.75 * l * (4 * w * w + 2 * w * 4 * w)) + w * 500 + w * 7 AS BIGINT) AS estimated
FROM (SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS l, CAST((n_regionkey + 1) * 64 AS BIGINT) AS w FROM nation)""",
    "parameter_counts": """SELECT CAST(n_regionkey AS VARCHAR) AS kind, CAST(sum(n_nationkey * 100 + 7) AS BIGINT) AS total, CAST(coalesce(sum(n_nationkey * 100 + 7) FILTER (WHERE n_nationkey % 3 <> 0), 0) AS BIGINT) AS trained,
  CAST(coalesce(sum(n_nationkey * 100 + 7) FILTER (WHERE n_regionkey <> 0), 0) AS BIGINT) AS without_embedding FROM nation GROUP BY ROLLUP (n_regionkey)""",
    "run_names": "SELECT event_id, 'model_' || strftime(ts, '%Y%m%d_%H%M%S') AS name FROM events",
    "run_params_pivot": """WITH e AS (SELECT DISTINCT event_type AS run_id, event_id AS step, epoch_ms(ts) AS ms, value FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT run_id, count(*) AS n, row_number() OVER (ORDER BY run_id) - 1 AS k FROM (SELECT event_type AS run_id FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL) GROUP BY run_id),
p AS (SELECT run_id, 'loss' AS key, step, value FROM e UNION ALL SELECT run_id, 'final', step, value FROM e WHERE step % 100 = 0)
SELECT p.run_id, key, count(*) AS points, arg_max(value, step) AS last_value, CAST(any_value(n) AS VARCHAR) AS vocab_size, CAST(length(p.run_id) AS VARCHAR) AS n_layer FROM p JOIN r ON p.run_id = r.run_id WHERE k % 5 < 3 GROUP BY p.run_id, key""",
    "generation_sessions": """SELECT conv_id, count(*) AS steps, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt_length, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END) AS BIGINT) AS generated_length,
  round(count(*) * CAST(0.5 AS DOUBLE), 6) AS total_time, round(sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END) / (count(*) * CAST(0.5 AS DOUBLE)), 6) AS per_second,
  CASE WHEN length(arg_min(text, turn)) > 200 THEN substring(arg_min(text, turn), 1, 200) || '...' ELSE arg_min(text, turn) END AS preview FROM conversations GROUP BY conv_id""",
}
