import json

import corpus_pipeline
import pytest
from helpers import ODD_IDS, keys, no_documents, odd_documents
from test_ngram_join import near_copies

from textloom.llm import ngram_join, packing


def columns(spark, df):
    return df.select(*corpus_pipeline.COLUMNS)


def test_stages(spark, sf_dir, tmp_path):
    """Each stage on what the one before left; all but the last return the columns of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
    classes = ngram_join.link_classes(docs)
    assert classes.where("doc_id <> class_id").count() == 0
    rows = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == {x.doc_id for x in docs.select("doc_id").collect()}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r.length <= packing.CAPACITY for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None


#: What each stage leaves of the odd documents (ids, in order; None last).
LEFT = {"language": [5, 6, 6, None], "line_dedup": ODD_IDS, "near_duplicates": [1, 2, 3, 4, 5, 6, None], "decontamination": ODD_IDS}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_and_empty_tables(spark, sf_dir, name, stage):
    assert stage(spark, columns(spark, no_documents(spark)), sf_dir).count() == 0
    docs = odd_documents(spark)
    rows = stage(spark, docs, sf_dir).collect()
    if name == "packing":
        tokens = {x.doc_id: x.doc_tokens for x in rows}
        assert keys(x for x in rows if x.start == 0) == ODD_IDS and tokens[1] == tokens[2] == 1
        return
    assert keys(rows) == LEFT[name] and list(rows[0].__fields__) == list(corpus_pipeline.COLUMNS)
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert all(x.text == texts[x.doc_id] for x in rows)


def test_stages_are_deleted(spark, sf_dir):
    from textloom.llm.common import checkpoint_dir
    from textloom.sources import files

    corpus_pipeline.run(spark, sf_dir)
    assert files.exists(spark, f"{checkpoint_dir(spark)}/pipeline-*/4") and not files.exists(spark, f"{checkpoint_dir(spark)}/pipeline-*/[0-3]")


def test_clean_documents_stay(spark, sf_dir):
    """Texts of their own pass all stages unchanged."""
    texts = [x for seed in range(12) for x in near_copies(1, seed=seed)]
    docs = columns(spark, odd_documents(spark, texts)).where("doc_id >= 100")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert sorted(json.dumps([x.doc_id, x.text]) for x in docs.collect()) == sorted(json.dumps([100 + i, x]) for i, x in enumerate(texts))
