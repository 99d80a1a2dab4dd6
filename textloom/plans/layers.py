"""Queries of vector operators, over ``embeddings`` and ``documents``.

Stand-ins: an embedding (times 8) is a token's logits over 64 classes, its label the target; embeddings with small ids
are the rows of weight matrices, detectors and experts; a character's vector is the embedding of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import fixed
from textloom.operators import merges, sequences, vectors
from textloom.plans.curation import _VOCAB, BLOCK, _encoded

SCALE, PADDING, PLACES, RANK, WIDTH, OUT, TASKS = 8, -100, 8, 8, 64, 48, ("analysis", "generation", "comparison", "translation")


def _vectors(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *columns)


def _tokens(spark, sf_dir) -> DataFrame:
    """A row a token: logits, and a target that every eleventh token lacks."""
    logits = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    target = F.when(F.col("vec_id") % 11 == 0, PADDING).otherwise(F.col("label"))
    return _vectors(spark, sf_dir, "embedding", "label").select("vec_id", logits.alias("logits"), target.alias("target"))


def token_cross_entropy(spark, sf_dir):
    """The loss of each token; none where the target is padding."""
    return _tokens(spark, sf_dir).select("vec_id", F.round(vectors.cross_entropy(F.col("logits"), F.col("target"), PADDING), 6).alias("loss"))


def sequence_losses(spark, sf_dir):
    """Sequences of eight tokens, of which a mask leaves out some more: losses, and perplexity, of four sets of them."""
    token = F.struct("vec_id", "logits", "target", (F.col("vec_id") % 5 != 0).cast("int").alias("mask"))
    rows = _tokens(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / PLACES).alias("sequence")).agg(F.array_sort(F.collect_list(token)).alias("t"))
    rows = rows.select("sequence", F.inline(F.array(vectors.sequence_loss(F.col("t.logits"), F.col("t.target"), F.col("t.mask"), PADDING))))
    mean = vectors.mean_loss(F.col("total"), F.col("tokens"))
    return rows.groupBy((F.col("sequence") % 4).alias("part")).agg(F.sum("tokens").alias("tokens"), F.round(mean, 6).alias("loss"), F.round(F.exp(mean), 4).alias("perplexity"))


def embedding_lookup(spark, sf_dir):
    """The vectors of each text's first ids: how many, and sums that tell their order."""
    ids = _encoded(spark, sf_dir).select("doc_id", sequences.truncate(F.col("ids"), BLOCK).alias("ids"))
    found = vectors.lookup(ids, _vectors(spark, sf_dir, "embedding"), "doc_id", id_="vec_id", vector="embedding")
    ordered = lambda i: F.aggregate(F.zip_with("vectors", F.sequence(F.lit(1), F.greatest(F.size("vectors"), F.lit(1))), lambda v, p: F.get(v, F.lit(i)).cast("double") * p), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return found.select("doc_id", F.size("vectors").cast("bigint").alias("n"), F.round(ordered(0), 4).alias("first_sum"), F.round(ordered(63), 4).alias("last_sum"))


def _matrix(spark, sf_dir, first: int, n: int, width: int = WIDTH) -> list[list[float]]:
    """A few embeddings, with ids from ``first`` on, on the driver."""
    rows = _vectors(spark, sf_dir, F.slice(F.col("embedding").cast("array<double>"), 1, width).alias("v")).where(F.col("vec_id").between(first, first + n - 1))
    return [x["v"] for x in rows.orderBy("vec_id").collect()]


def mean_pool_head(spark, sf_dir):
    """Embeddings of the documents of each language, pooled, and the class that a head of seven rows gives them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "lang")
    pooled = vectors.mean_pool(docs.join(_vectors(spark, sf_dir, "embedding"), "vec_id"), ["lang"], "embedding", WIDTH)
    logits = vectors.head(F.col("pooled"), _matrix(spark, sf_dir, 0, 7), [i / 1000 for i in range(7)])
    made = pooled.withColumn("logits", logits)
    return made.select("lang", "n", F.round(F.col("pooled")[0], 6).alias("first"), F.round(F.array_max("logits"), 6).alias("logit"), sequences.argmax(F.col("logits")).cast("bigint").alias("class"))


def low_rank_linear(spark, sf_dir):
    """Each embedding through a product of rank eight with 48 rows, scaled between the two, with a bias."""
    every = _vectors(spark, sf_dir, "embedding")
    part = lambda first, n, width: every.where(F.col("vec_id").between(first, first + n - 1)).select((F.col("vec_id") - first).alias("row"), F.slice("embedding", 1, width).alias("values"))
    made = vectors.low_rank(every, part(0, RANK, WIDTH), part(RANK, OUT, RANK), "vec_id", "embedding", "out", [1 + i / 8 for i in range(RANK)], WIDTH, [i / 100 for i in range(OUT)], block=24, group=10)
    total = F.aggregate("out", F.lit(0.0), lambda s, x: s + x)
    return made.select("vec_id", F.size("out").cast("bigint").alias("n"), F.round(total, 5).alias("total"), F.round(F.col("out")[0], 6).alias("first"), F.round(F.col("out")[OUT - 1], 6).alias("last"))


def expert_mixture(spark, sf_dir):
    """The task that each embedding looks like, by four detectors, and the mixture of four experts."""
    made = vectors.mixed(F.transform("embedding", lambda x: x.cast("double") * SCALE), _matrix(spark, sf_dir, 0, 4), _matrix(spark, sf_dir, 4, 4), list(TASKS))
    # By inline the struct is computed once a row, not once a field.
    rows = _vectors(spark, sf_dir, "embedding").select("vec_id", F.inline(F.array(made)))
    return rows.select("vec_id", "task", F.round("share", 6).alias("share"), F.size("mixed").cast("bigint").alias("n"), F.round(F.col("mixed")[0], 6).alias("first"), F.round(F.col("mixed")[63], 6).alias("last"))


def bpe_merges(spark, sf_dir):
    """Byte-pair merges learnt from all texts, line by line, until there are 200 tokens."""
    _, found = merges.learn(merges.each_piece(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")), 200)
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(found)], "rank bigint, left string, right string, n bigint")


def exact_formats(spark, sf_dir):
    """Values that often end in a half, at each number of places, and with thousands apart."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 9 - 3).cast("double"))).alias("v"), ((F.col("event_id") % 4001 - 2000) / F.lit(16.0)).alias("h"))
    return rows.select("event_id", *(fixed(F.col("h"), k).alias(f"half{k}") for k in range(4)), fixed(F.col("v"), 6).alias("places6"), fixed(F.col("v") * 1000, 2, grouped=True).alias("grouped2"))


QUERIES = {f.__name__: f for f in (token_cross_entropy, sequence_losses, embedding_lookup, mean_pool_head, low_rank_linear, expert_mixture, bpe_merges, exact_formats)}

_LOSS = f"""l AS (SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) * {SCALE} AS m, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * {SCALE}) AS z, label, vec_id % 11 = 0 AS pad FROM embeddings),
t AS (SELECT vec_id, CASE WHEN NOT pad THEN m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) - z[label + 1] END AS loss FROM l)"""

ORACLES = {
    "token_cross_entropy": f"WITH {_LOSS} SELECT vec_id, round(loss, 6) AS loss FROM t",
    "sequence_losses": f"""WITH {_LOSS} SELECT vec_id // {PLACES} % 4 AS part, count(loss) FILTER (WHERE vec_id % 5 <> 0) AS tokens, round(avg(loss) FILTER (WHERE vec_id % 5 <> 0), 6) AS loss,
  round(exp(avg(loss) FILTER (WHERE vec_id % 5 <> 0)), 4) AS perplexity FROM t GROUP BY part""",
    "embedding_lookup": f"""WITH {_VOCAB}, p AS (SELECT doc_id, unnest(ids[1:{BLOCK}]) AS id, generate_subscripts(ids[1:{BLOCK}], 1) AS pos FROM enc)
SELECT d.doc_id, count(pos) AS n, round(coalesce(sum(pos * CAST(embedding[1] AS DOUBLE)), 0), 4) AS first_sum, round(coalesce(sum(pos * CAST(embedding[64] AS DOUBLE)), 0), 4) AS last_sum
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN embeddings e ON e.vec_id = p.id GROUP BY d.doc_id""",
    "mean_pool_head": f"""WITH x AS (SELECT lang, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM documents JOIN embeddings ON doc_id = vec_id), m AS (SELECT lang, i, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM x GROUP BY lang, i),
p AS (SELECT lang, list(x ORDER BY i) AS p, max(n) AS n FROM m GROUP BY lang), l AS (SELECT lang, n, p[1] AS first, vec_id, list_inner_product(p, CAST(embedding AS DOUBLE[])) + CAST(vec_id AS DOUBLE) / 1000 AS logit FROM p, embeddings WHERE vec_id < 7)
SELECT lang, max(n) AS n, round(max(first), 6) AS first, round(max(logit), 6) AS logit, arg_max(vec_id, logit) AS class FROM l GROUP BY lang""",
    "low_rank_linear": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT x.vec_id, list(list_inner_product(x.v, d.v) * (1 + d.vec_id / 8.0::DOUBLE) ORDER BY d.vec_id) AS h FROM e x, e d WHERE d.vec_id < {RANK} GROUP BY x.vec_id),
o AS (SELECT h.vec_id, list(list_inner_product(h, u.v[1:{RANK}]) + (u.vec_id - {RANK}) / 100.0::DOUBLE ORDER BY u.vec_id) AS o FROM h, e u WHERE u.vec_id BETWEEN {RANK} AND {RANK + OUT - 1} GROUP BY h.vec_id)
SELECT vec_id, len(o) AS n, round(list_sum(o), 5) AS total, round(o[1], 6) AS first, round(o[{OUT}], 6) AS last FROM o""",
    "expert_mixture": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT x.vec_id, d.vec_id AS task, {SCALE} * list_inner_product(x.v, d.v) AS l FROM e x, e d WHERE d.vec_id < 4),
p AS (SELECT vec_id, task, l, exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS p FROM l WINDOW w AS (PARTITION BY vec_id))
SELECT p.vec_id, {list(TASKS)}[arg_max(task, l) + 1] AS task, round(max(p), 6) AS share, CAST(64 AS BIGINT) AS n, round(sum(p * v[1]), 6) AS first, round(sum(p * v[64]), 6) AS last FROM p JOIN e ON e.vec_id = p.task + 4 GROUP BY p.vec_id""",
    "exact_formats": """SELECT event_id, printf('%.0f', h) AS half0, printf('%.1f', h) AS half1, printf('%.2f', h) AS half2, printf('%.3f', h) AS half3, printf('%.6f', v) AS places6,
  regexp_replace(reverse(regexp_replace(reverse(split_part(g, '.', 1)), '(\\d{3})', '\\1,', 'g')), '^(-?),', '\\1') || '.' || split_part(g, '.', 2) AS grouped2
FROM (SELECT *, printf('%.2f', v * 1000) AS g FROM (SELECT event_id, CAST(value AS DOUBLE) * pow(CAST(10 AS DOUBLE), event_id % 9 - 3) AS v, (event_id % 4001 - 2000) / CAST(16 AS DOUBLE) AS h FROM events))""",
}
