"""Queries of curation, statistics, splits and sequences, over ``documents``, ``labels`` and ``embeddings``.

Stand-ins: a document's text is the code, its source the alternative field, its labels the complexity labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import curate, sequences, stats
from textloom.operators.tokenizers import PairTokenizer
from textloom.plans.evaluation import _rounded
from textloom.session import cut, shared_folder
from textloom.sources import files, jsonl

BLOCK, BATCH, SEED, SHARE = 128, 16, 42, 0.9


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def _joined(ids):
    """Arrays as text, which engines compare alike."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def strict_projection(spark, sf_dir):
    """Required and defaulted fields."""
    docs = _docs(spark, sf_dir, "doc_id", "lang", "source", F.col("n_chars"))
    return docs.select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("problem"), F.coalesce("source", F.lit("")).alias("solution_id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def complexity_present_filter(spark, sf_dir):
    """Rows with a label, where every fifth says 'Unknown'."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    said = lambda x: F.when(F.col("doc_id") % 5 == 0, "Unknown").otherwise(F.col(x).cast("string"))
    rows = _docs(spark, sf_dir, "doc_id").join(labels, "doc_id", "left").withColumns({"time": said("quality"), "space": F.when(F.col("doc_id") % 7 == 0, "").otherwise(said("toxic"))})
    return rows.where(T.has_complexity(F.col("time"), F.col("space"))).select("doc_id", "time", "space")


def code_fallback(spark, sf_dir):
    """The alternative stands in for null and empty code, not for white space."""
    given = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 13 == 0, "   ").otherwise(F.col("text"))
    return _docs(spark, sf_dir, "doc_id", "text", "source").select("doc_id", T.code_of(given, F.col("source")).alias("code"))


def min_length_filter(spark, sf_dir):
    """Both length rules, with the stripped length."""
    code = F.concat(F.lit("\t  "), F.col("text"), F.lit(" \n"))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.length(T.strip(code)).cast("bigint").alias("stripped"), T.long_enough(code).alias("dataset"), T.long_enough(code, strict=True).alias("tokenizer"))


def dataset_length_stats(spark, sf_dir):
    """Lengths in characters and words."""
    docs = _docs(spark, sf_dir, F.length("text").alias("code_length"), F.size(F.split("text", " ", -1)).alias("token_length"))
    return _rounded(stats.lengths(docs, "code_length", "token_length"))


def value_counts(spark, sf_dir):
    return stats.value_counts(_docs(spark, sf_dir, "lang"), "lang")


def limit_semantics(spark, sf_dir):
    """First 50 of all rows, of the accepted rows, and of the rows before acceptance."""
    docs, rule = _docs(spark, sf_dir, "doc_id", "n_chars"), F.col("n_chars") >= 600
    parts = {"loaded": curate.head(docs, 50, "doc_id"), "accepted": curate.head(docs, 50, "doc_id", rule), "raw": curate.head(docs, 50, "doc_id", rule, raw=True)}
    named = [df.select(F.lit(name).alias("meaning"), "doc_id") for name, df in parts.items()]
    return named[0].unionAll(named[1]).unionAll(named[2])


def seeded_split(spark, sf_dir):
    """An exact split by hash order."""
    return curate.exact_split(_docs(spark, sf_dir, "doc_id"), SHARE, SEED, "doc_id").select("doc_id", "train")


def sequential_split(spark, sf_dir):
    """The first part of the rows, by id."""
    return curate.sequential_split(curate.ordinals(_docs(spark, sf_dir, "doc_id"), "doc_id"), SHARE).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "train")


def char_vocab(spark, sf_dir):
    return sequences.char_vocabulary(_docs(spark, sf_dir, "text")).select("token", F.col("id").cast("bigint").alias("id"))


def _encoded(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    return sequences.encode(docs, sequences.char_vocabulary(docs))


def char_encode(spark, sf_dir):
    """Whole texts as ids; md5 of the joined ids keeps the result small."""
    return _encoded(spark, sf_dir).select("doc_id", F.size("ids").cast("bigint").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


def char_roundtrip(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text")
    vocabulary = sequences.char_vocabulary(docs)
    back = sequences.decode(sequences.encode(docs, vocabulary), vocabulary)
    return back.select("doc_id", F.md5("decoded").alias("decoded_md5"))


def token_density(spark, sf_dir):
    """Characters, words and words a character, by language."""
    docs = _docs(spark, sf_dir, "lang", F.length("text").cast("bigint").alias("c"), F.size(F.split("text", " ", -1)).cast("bigint").alias("t"))
    return docs.groupBy("lang").agg(F.sum("c").alias("chars"), F.sum("t").alias("tokens"), F.round(T.ratio(F.sum("t"), F.sum("c")), 6).alias("density"))


def truncate_shift(spark, sf_dir):
    x, y = sequences.shift(sequences.truncate(F.col("ids"), BLOCK))
    return _encoded(spark, sf_dir).select("doc_id", _joined(x).alias("input_ids"), _joined(y).alias("target_ids"))


def pad_and_mask(spark, sf_dir):
    x, _ = sequences.shift(sequences.truncate(F.col("ids"), BLOCK))
    ids, mask = sequences.pad(x, BLOCK)
    return _encoded(spark, sf_dir).select("doc_id", _joined(ids).alias("input_ids"), F.aggregate(mask, F.lit(0), lambda a, b: a + b).cast("bigint").alias("real"))


def sliding_windows(spark, sf_dir):
    """All windows of each text, summed up: how many, and the sums of their first and last inputs and last targets."""
    rows = sequences.window_ends(_encoded(spark, sf_dir).select("doc_id", "ids"), "ids", BLOCK)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.sum(F.col(x).cast("bigint")).alias(x) for x in ("x_first", "x_last", "y_last")))


def context_crop(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", _joined(sequences.crop(F.col("ids"), BLOCK)).alias("ids"))


def batches_drop_last(spark, sf_dir):
    """Full batches of the hash-ordered training rows."""
    ranked = curate.ordinals(_docs(spark, sf_dir, "doc_id", F.length("text").alias("n")), "doc_id")
    rows = sequences.batched(ranked, BATCH, drop_last=True)
    return rows.groupBy("batch").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("n").cast("bigint").alias("longest"))


def collated_batches(spark, sf_dir):
    """Padded batches: inputs of one batch as text, the number of real ids."""
    rows = curate.ordinals(_encoded(spark, sf_dir).select("doc_id", sequences.truncate(F.col("ids"), BLOCK).alias("ids")), "doc_id")
    made = sequences.collate(sequences.batched(rows, BATCH), "ids", length=BLOCK)
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return made.select("batch", F.size("input_ids").cast("bigint").alias("rows"), total("input_ids").alias("input_sum"), total("target_ids").alias("target_sum"), total("attention_mask").alias("real"))


def widest_batches(spark, sf_dir):
    """Batches padded to their own longest sequence."""
    rows = curate.ordinals(_encoded(spark, sf_dir).select("doc_id", sequences.truncate(F.col("ids"), F.col("doc_id").cast("int") % 50 + 1).alias("ids")), "doc_id")
    made = sequences.collate(sequences.batched(rows, BATCH), "ids")
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return made.select("batch", F.size(F.col("input_ids")[0]).cast("bigint").alias("width"), F.size(F.flatten("input_ids")).cast("bigint").alias("cells"), total("attention_mask").alias("real"))


def curated_samples(spark, sf_dir):
    """Samples that a caller's predicate keeps, with their code and its length."""
    docs = _docs(spark, sf_dir, "doc_id", "source", "lang", "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    kept = curate.curate(docs, "text", "source", keep=(F.col("lang") != "en") | (F.col("n_chars") > 2000), least=5)
    return kept.select("doc_id", F.length("code").cast("bigint").alias("length"), F.md5("code").alias("code_md5"))


def jsonl_scan(spark, sf_dir):
    """JSON lines written and read back, of which every seventh is malformed and every eleventh blank."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    docs = _docs(spark, sf_dir, "doc_id", "n_chars", "text")
    line = F.when(F.col("doc_id") % 7 == 0, "{malformed").when(F.col("doc_id") % 11 == 0, " ").otherwise(F.to_json(F.struct("doc_id", "n_chars", "text")))
    docs.select(line.alias("value")).write.text(path)
    good, bad = jsonl.read_skipping(spark, path, "doc_id bigint, n_chars bigint, text string")
    rows = cut(good.select("doc_id", "n_chars", F.md5("text").alias("text_md5")).unionAll(bad.agg(F.lit(-1).cast("bigint"), F.count("*"), F.lit("malformed"))))
    files.delete(spark, path)
    return rows


def accumulation(spark, sf_dir):
    """Optimizer steps of batches, the trailing group left out."""
    rows = sequences.accumulation_steps(curate.ordinals(_docs(spark, sf_dir, "doc_id"), "doc_id"), 7)
    return rows.select("doc_id", F.col("optimizer_step").cast("bigint").alias("optimizer_step"))


def embedding_argmax(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vectors.select("vec_id", sequences.argmax(F.col("embedding")).cast("bigint").alias("place"))


def line_split(spark, sf_dir):
    """Lines with their ends."""
    lines = T.lines(F.col("text"))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.md5(F.array_join(lines, "|")).alias("lines_md5"))


def random_windows(spark, sf_dir):
    """Four seeded windows of each text: where they start, and the ends of inputs and targets."""
    rows = sequences.random_windows(_encoded(spark, sf_dir).select("doc_id", "ids"), "ids", BLOCK, 4, SEED, "doc_id")
    end = lambda c, k: F.element_at(c, k).cast("bigint")
    return rows.select("doc_id", F.col("draw").cast("bigint").alias("draw"), F.col("start").cast("bigint").alias("start"), F.size("x").cast("bigint").alias("n"), end("x", 1).alias("x_first"), end("y", -1).alias("y_last"))


def multinomial_sample(spark, sf_dir):
    """A seeded draw from the softmax of each embedding (times 8)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("logits"))
    return vectors.select("vec_id", sequences.multinomial(sequences.softmax(F.col("logits")), SEED, F.col("vec_id")).cast("bigint").alias("place"))


def number_formats(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") * 1234).alias("v"))
    return rows.select("event_id", *(c.alias(x) for x, c in T.number_formats(F.col("v")).items()))


def padded_names(spark, sf_dir):
    """Fixed-width names, trimmed texts with separators of every kind, and their cases."""
    docs = _docs(spark, sf_dir, "doc_id", "source", "lang")
    return docs.select("doc_id", T.pad_right(F.col("source"), 6).alias("padded"), T.strip(F.concat(F.lit("\x1c \x1f\u00a0"), F.col("source"), F.lit("\u2003\x1d\n"))).alias("bare"), F.upper("lang").alias("upper"), F.lower(F.upper("source")).alias("lower"))


def bpe_encode(spark, sf_dir):
    """Byte-pair ids by a tokenizer fitted on those of the first 1,000 texts that are long enough; the limit is the fit's own."""
    docs = _docs(spark, sf_dir, "doc_id", "text")
    first = curate.head(docs, 1000, "doc_id").where(T.long_enough(F.col("text"), strict=True))
    # Texts are joined by line feeds, so each but the last one ends with one more.
    last = first.agg(F.max("doc_id")).first()[0]
    joined = first.select(F.when(F.col("doc_id") < last, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    tokenizer = PairTokenizer.learn(joined, 500).serialized
    coded = sequences.bpe_decode(sequences.bpe_encode(docs, tokenizer).select("doc_id", "ids"), tokenizer)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"), F.md5("decoded").alias("decoded_md5"))


QUERIES = {f.__name__: f for f in (
    strict_projection, complexity_present_filter, code_fallback, min_length_filter, dataset_length_stats, value_counts, limit_semantics, seeded_split, sequential_split, char_vocab, char_encode, char_roundtrip,
    token_density, truncate_shift, pad_and_mask, sliding_windows, context_crop, batches_drop_last, collated_batches, widest_batches, curated_samples, jsonl_scan, accumulation, embedding_argmax, line_split, random_windows, multinomial_sample, number_formats, padded_names, bpe_encode,
)}

_VOCAB = """voc AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents WHERE text <> '')),
enc AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM (SELECT doc_id, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents WHERE text <> '') JOIN voc USING (token) GROUP BY doc_id)"""
_CUT = f"cut AS (SELECT doc_id, ids[1:{BLOCK}] AS ids FROM enc)"
_SHIFT = "sh AS (SELECT doc_id, CASE WHEN len(ids) <= 1 THEN ids ELSE ids[1:len(ids) - 1] END AS x, CASE WHEN len(ids) <= 1 THEN ids ELSE ids[2:len(ids)] END AS y FROM cut)"

#: The number that the first eight digits of an md5 sum give.
_HEX = "list_sum(list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', substring(md5({text}), CAST(k AS BIGINT), 1)) - 1 AS BIGINT) * (CAST(1 AS BIGINT) << (4 * (8 - k)))))"

ORACLES = {
    "strict_projection": "SELECT doc_id, coalesce(lang, 'unknown') AS problem, coalesce(source, '') AS solution_id, coalesce(n_chars, 0) AS n_chars FROM documents",
    "complexity_present_filter": """SELECT doc_id, time, space FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'Unknown' ELSE CAST(quality AS VARCHAR) END AS time,
  CASE WHEN d.doc_id % 7 = 0 THEN '' WHEN d.doc_id % 5 = 0 THEN 'Unknown' ELSE CAST(toxic AS VARCHAR) END AS space FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
WHERE coalesce(time, '') NOT IN ('', 'Unknown', 'UNKNOWN') OR coalesce(space, '') NOT IN ('', 'Unknown', 'UNKNOWN')""",
    "code_fallback": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 OR text IS NULL OR (text = '' AND doc_id % 13 <> 0) THEN source WHEN doc_id % 13 = 0 THEN '   ' ELSE text END AS code FROM documents",
    "min_length_filter": "SELECT doc_id, length(s) AS stripped, length(s) >= 10 AS dataset, length(s) > 10 AS tokenizer FROM (SELECT doc_id, regexp_replace(text, '^[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g') AS s FROM documents)",
    "dataset_length_stats": """SELECT name, count(*) AS total, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median
FROM (SELECT 'code_length' AS name, CAST(length(text) AS DOUBLE) AS v FROM documents UNION ALL SELECT 'token_length', CAST(len(string_split(text, ' ')) AS DOUBLE) FROM documents) GROUP BY name""",
    "value_counts": "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "limit_semantics": """SELECT 'loaded' AS meaning, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) UNION ALL SELECT 'accepted', doc_id FROM (SELECT doc_id FROM documents WHERE n_chars >= 600 ORDER BY doc_id LIMIT 50)
UNION ALL SELECT 'raw', doc_id FROM (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50) WHERE n_chars >= 600""",
    "seeded_split": f"SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) <= floor((SELECT count(*) FROM documents) * CAST({SHARE} AS DOUBLE)) AS train FROM documents",
    "sequential_split": f"SELECT doc_id, r AS ordinal, r <= floor((SELECT count(*) FROM documents) * CAST({SHARE} AS DOUBLE)) AS train FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)",
    "char_vocab": f"WITH {_VOCAB} SELECT token, id FROM voc",
    "char_encode": f"WITH {_VOCAB} SELECT d.doc_id, coalesce(len(ids), 0) AS n, md5(coalesce(array_to_string(ids, ','), '')) AS ids_md5 FROM documents d LEFT JOIN enc ON d.doc_id = enc.doc_id",
    "char_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS decoded_md5 FROM documents",
    "token_density": "SELECT lang, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(t) AS BIGINT) AS tokens, round(CAST(sum(t) AS DOUBLE) / sum(c), 6) AS density FROM (SELECT lang, length(text) AS c, len(string_split(text, ' ')) AS t FROM documents) GROUP BY lang",
    "truncate_shift": f"WITH {_VOCAB}, {_CUT}, {_SHIFT} SELECT d.doc_id, coalesce(array_to_string(x, ','), '') AS input_ids, coalesce(array_to_string(y, ','), '') AS target_ids FROM documents d LEFT JOIN sh ON d.doc_id = sh.doc_id",
    "pad_and_mask": f"WITH {_VOCAB}, {_CUT}, {_SHIFT} SELECT d.doc_id, array_to_string(list_concat(coalesce(x, []), list_transform(range({BLOCK} - coalesce(len(x), 0)), lambda i: 0)), ',') AS input_ids, coalesce(len(x), 0) AS real FROM documents d LEFT JOIN sh ON d.doc_id = sh.doc_id",
    "sliding_windows": f"""WITH {_VOCAB}, c AS (SELECT doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS i, len(ids) AS n FROM enc WHERE len(ids) > {BLOCK})
SELECT doc_id, max(n) - {BLOCK} AS n, CAST(sum(t) FILTER (WHERE i <= n - {BLOCK}) AS BIGINT) AS x_first, CAST(sum(t) FILTER (WHERE i >= {BLOCK} AND i < n) AS BIGINT) AS x_last, CAST(sum(t) FILTER (WHERE i > {BLOCK}) AS BIGINT) AS y_last FROM c GROUP BY doc_id""",
    "context_crop": f"WITH {_VOCAB} SELECT d.doc_id, coalesce(array_to_string(ids[greatest(1, len(ids) - {BLOCK - 1}):len(ids)], ','), '') AS ids FROM documents d LEFT JOIN enc ON d.doc_id = enc.doc_id",
    "batches_drop_last": f"""SELECT b AS batch, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id, max(n) AS longest FROM (SELECT doc_id, length(text) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS b FROM documents)
WHERE b < (SELECT count(*) FROM documents) // {BATCH} GROUP BY b""",
    "collated_batches": f"""WITH {_VOCAB}, {_CUT}, {_SHIFT}, r AS (SELECT d.doc_id, (row_number() OVER (ORDER BY d.doc_id) - 1) // {BATCH} AS batch, coalesce(x, []) AS x, coalesce(y, []) AS y FROM documents d LEFT JOIN sh ON d.doc_id = sh.doc_id)
SELECT batch, count(*) AS rows, CAST(sum(coalesce(list_sum(x), 0)) AS BIGINT) AS input_sum, CAST(sum(coalesce(list_sum(y), 0)) AS BIGINT) AS target_sum, CAST(sum(len(x)) AS BIGINT) AS real FROM r GROUP BY batch""",
    "widest_batches": f"""WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch, least(length(coalesce(text, '')), doc_id % 50 + 1) AS n FROM documents),
x AS (SELECT batch, CASE WHEN n <= 1 THEN n ELSE n - 1 END AS k FROM r) SELECT batch, CAST(max(k) AS BIGINT) AS width, CAST(max(k) * count(*) AS BIGINT) AS cells, CAST(sum(k) AS BIGINT) AS real FROM x GROUP BY batch""",
    "curated_samples": """SELECT doc_id, length(code) AS length, md5(code) AS code_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR coalesce(text, '') = '' THEN source ELSE text END AS code FROM documents WHERE lang <> 'en' OR n_chars > 2000)
WHERE length(regexp_replace(code, '^[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) >= 5""",
    "jsonl_scan": "SELECT doc_id, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 UNION ALL SELECT -1, count(*), 'malformed' FROM documents WHERE doc_id % 7 = 0",
    "accumulation": "SELECT doc_id, CASE WHEN s < (SELECT count(*) FROM documents) // 7 THEN s END AS optimizer_step FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 7 AS s FROM documents)",
    "embedding_argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place FROM embeddings",
    "random_windows": f"""WITH {_VOCAB}, d AS (SELECT doc_id, unnest(range(4)) AS draw, ids, len(ids) - {BLOCK} AS room FROM enc WHERE len(ids) > {BLOCK}),
s AS (SELECT *, CAST({_HEX.format(text=f"'{SEED}:' || draw || ':' || doc_id")} % room AS BIGINT) AS start FROM d)
SELECT doc_id, draw, start, CAST({BLOCK} AS BIGINT) AS n, ids[start + 1] AS x_first, ids[start + {BLOCK} + 1] AS y_last FROM s""",
    "multinomial_sample": f"""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT vec_id, i, exp((CAST(x AS DOUBLE) - max(CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id)) * 8) AS w FROM e),
c AS (SELECT vec_id, i, sum(w) OVER (PARTITION BY vec_id ORDER BY i) / sum(w) OVER (PARTITION BY vec_id) AS through, CAST({_HEX.format(text=f"'{SEED}:' || vec_id")} AS DOUBLE) / 4294967296 AS u FROM p)
SELECT vec_id, least(count(*) FILTER (WHERE through <= u), max(i) - 1) AS place FROM c GROUP BY vec_id""",
    "number_formats": "SELECT event_id, printf('%.4f', v) AS places4, printf('%.2f', v) AS places2, printf('%.2e', v) AS power, format('{:,}', CAST(floor(v) AS BIGINT)) AS thousands FROM (SELECT event_id, CAST(value AS DOUBLE) * 1234 AS v FROM events)",
    "padded_names": "SELECT doc_id, CASE WHEN length(source) < 6 THEN rpad(source, 6, ' ') ELSE source END AS padded, source AS bare, upper(lang) AS upper, source AS lower FROM documents",
    "line_split": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS n_lines, md5(CASE WHEN ends_with(text, chr(10)) THEN left(r, -1) ELSE r END) AS lines_md5 FROM (SELECT doc_id, text, replace(text, chr(10), chr(10) || '|') AS r FROM documents WHERE text IS NOT NULL)",
}
