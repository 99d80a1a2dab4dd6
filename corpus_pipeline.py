"""From raw documents to packed sequences: five stages, each of one operator, each working on all that is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language, line_spread, ngram_join, packing, tiling
from textloom.llm.common import checkpoint_dir, read
from textloom.sources import files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose main language has a smaller share of its letters is rejected.
MAIN_SHARE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of so many languages that none has MAIN_SHARE of the letters, go.

    So do null and empty texts. Repeated rows are judged alike; a null id, lang or source stays as it is; where no row has
    a language, or the table is empty, nothing is left. Columns other than those of documents are left out, in each stage.
    """
    model = language.train(language.learnable(docs, F.lit(True)))
    found = language.identify(docs, model, list(COLUMNS), spans=False)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MAIN_SHARE)).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go from all documents but the first; documents that had nothing else go too.

    Null and empty texts that had no such line stay; a null source is a site of its own; repeated rows are treated alike;
    of rows with a null id none keeps a line against others; an empty table stays empty.
    """
    cleaned = line_spread.remove_boilerplate(docs.select(*COLUMNS))
    kept = cleaned.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact and near copies the document with the smallest id stays, and one of its repeated rows.

    Null and empty texts, and rows with a null id, stay; an empty table stays empty.
    """
    return ngram_join.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows all of them.

    Null and empty texts, and rows with a null id, stay; an empty table stays empty.
    """
    return tiling.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, a row a piece.

    Null and empty texts are an end alone; repeated rows and rows with a null id are packed once each; an empty table
    gives no rows.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Language identification and packing can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next.

    A stage's table is deleted once the next one is written; the last one is what is returned.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(spark, f"{folder}/{k - 1}")
    return docs
