"""The registered queries of this subpackage, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import annulus, cotrain, elkan, language, line_spread, lm_score, ngram_join, packing, prefix_forest, tiling, token_count, toxicity, url_filter
from textloom.llm.common import read, remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic passages of ``documents``, learnt from ``labels`` outside the held-out third."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), usable=~held_out)
    found = toxicity.detect(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "segments")


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that stand on several sites (``source``)."""
    return line_spread.remove_boilerplate(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: target are those labelled good, background are all."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    good = read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    return lm_score.score(docs, good, ["doc_id"])


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every 100th row of ``embeddings``."""
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return prefix_forest.search(vectors, F.col("vec_id") % 100 == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join.link_classes(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by two views that taught each other."""
    docs = read(spark, sf_dir, "documents")
    models = cotrain.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    found = cotrain.classify(docs, models, ["doc_id"])
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language.train(language.learnable(docs, ~held_out))
    return language.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as token sequences of 2048."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark``, also in pieces and in another order."""
    return tiling.find_contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return url_filter.judge(read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row of ``embeddings``; every seventh row has another label first."""
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return annulus.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of ``embeddings`` after three rounds, in integers."""
    return elkan.cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("calculations")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_spread": op2_line_spread,
    "op3_lm_score": op3_lm_score,
    "op4_prefix_forest": op4_prefix_forest,
    "op5_ngram_join": op5_ngram_join,
    "op6_cotraining": op6_cotraining,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_count": op12_token_count,
    "op13_elkan": op13_elkan,
}
ORACLES: dict[str, str] = {"op2_line_spread": line_spread.ORACLE, "op5_ngram_join": ngram_join.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_hard_negatives": annulus.ORACLE, "op13_elkan": elkan.ORACLE}
