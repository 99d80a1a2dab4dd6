import random

import numpy as np
from helpers import ODD_IDS, keys, no_documents, odd_documents

from textloom.llm import cotrain, queries

LABELS = "doc_id bigint, quality int, lang string"


def corpus(n=200):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(("the", "old", "house", "stands", "by", "river")) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(("AAA!!", "###", "zz***", "11%%")) for _ in range(40))
    return [bad() if i % 3 == 0 else good() for i in range(n)]


def test_learns_and_survives_odd_rows(spark):
    texts = corpus()
    docs = odd_documents(spark, texts)
    labels = spark.createDataFrame([(100 + i, int(i % 3 != 0), "x") for i in range(0, len(texts), 2)] + [(None, 1, "x"), (1, None, "x"), (2, 7, "x")], LABELS)
    models = cotrain.fit(docs, labels)
    rows = cotrain.classify(docs, models, ["doc_id"]).collect()
    assert keys(x for x in rows if x.doc_id is None or x.doc_id < 100) == ODD_IDS
    assert all(0 <= x.score <= 1 for x in rows)
    assert all((x.score >= 0.5) == ((x.doc_id - 100) % 3 != 0) for x in rows if x.doc_id and x.doc_id >= 100)


def test_one_class_or_none(spark):
    docs = odd_documents(spark, corpus(20))
    for labels in ([], [(100, 1, "x"), (101, 1, "x")]):
        models = cotrain.fit(docs, spark.createDataFrame(labels, LABELS))
        assert models is None and {x.score for x in cotrain.classify(docs, models, ["doc_id"]).collect()} == {0.5}
    assert cotrain.fit(no_documents(spark), spark.createDataFrame([], LABELS)) is None
    assert cotrain.classify(no_documents(spark), None, ["doc_id"]).count() == 0


def test_views_teach_each_other():
    """The label shows in either view; few rows have one."""
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 2000)
    view = lambda: np.stack([truth + rng.normal(0, 0.5, 2000), rng.normal(size=2000)], axis=1)
    text, meta = view(), view()
    label = np.where(np.arange(2000) < 250, truth, -1)
    a, b, mix = cotrain.co_train(text, meta, label)
    both = np.stack((np.ones(2000), a.logit(text), b.logit(meta)), axis=1) @ mix
    accuracy = lambda x: ((x > 0) == truth)[250:].mean()
    assert accuracy(a.logit(text)) > 0.78 and accuracy(b.logit(meta)) > 0.78 and accuracy(both) > 0.88


def test_held_out_accuracy(spark):
    """Fitted on every second label, measured on the others."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    models = cotrain.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = cotrain.classify(docs, models, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum((x.score >= 0.5) == (x.quality == 1) for x in rows) / len(rows) > 0.9


def test_query_covers_all(spark, sf_dir):
    assert queries.op6_cotraining(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_word_measures():
    classes = cotrain._classes()
    words = ["Hello,", "ABC!!!!", "x9", "aaaaaa", "aab", "\U0001f600\U0001f600", "\u00e9\u00c9", "z"]
    length, letters, upper, digits, ends, bucket = cotrain._word_measures(words, classes)
    assert length.tolist() == [len(w) for w in words] and letters.tolist() == [sum(c.isalpha() for c in w) for w in words]
    assert upper.tolist() == [sum(c.isupper() for c in w) for w in words] and digits.tolist() == [sum(c.isdigit() for c in w) for w in words]
    assert ends.tolist() == [float(w[-1] in ".,;:!?") for w in words]
    assert bucket[3] == bucket[4]  # both are two letters or more
    assert (cotrain._word_measures(words[::-1], classes)[5] == bucket[::-1]).all()


def test_all_unlabelled_rows_may_be_named(spark):
    """The pool is the whole table, at any size, and a table teaches as the same rows in memory do."""
    rng = np.random.default_rng(4)
    n = 45_000
    truth = rng.integers(0, 2, n)
    text, meta = (np.stack([truth + rng.normal(0, 0.5, n), rng.normal(size=n)], axis=1).astype(np.float16) for _ in range(2))
    label = np.where(np.arange(n) < 250, truth, -1)
    rows = [(text[i].tobytes(), meta[i].tobytes()) for i in range(250, n)]
    table = cotrain.TablePool(spark.createDataFrame(rows, "text binary, meta binary").repartition(5), (2, 2))
    here = cotrain.co_train(text.astype(float), meta.astype(float), label)
    there = cotrain.co_train(text[:250].astype(float), meta[:250].astype(float), label[:250], pool=table)
    assert table.size == n - 250 > 2 * cotrain.LABELLED
    assert all(np.allclose(a.weights, b.weights, atol=1e-6) for a, b in zip(here[:2], there[:2], strict=True))
    named = []
    surest = cotrain._surest
    cotrain._surest = lambda counts, ones, zeros: named.append((sum(counts.values()), ones + zeros)) or surest(counts, ones, zeros)
    try:
        cotrain.co_train(text.astype(float), meta.astype(float), label)
    finally:
        cotrain._surest = surest
    assert named[0][0] == n - 250 and abs(named[0][1] - 0.05 * (n - 250)) <= 2
    assert named[-1][0] < 0.9 * named[0][0]  # rounds name rows that weren't named before


def test_words_count_where_style_is_alike(spark):
    """Texts that differ only in which words they use: as many letters, no case, no marks."""
    rng = random.Random(3)
    kind = (("mono", "lake", "tree", "bird"), ("cash", "pill", "loan", "spam"))
    texts = [" ".join(rng.choices(kind[i % 2], k=30)) for i in range(160)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id bigint, quality int")
    rows = cotrain.classify(docs, cotrain.fit(docs, labels), ["doc_id"]).where("doc_id >= 80").collect()
    assert sum((x.text_score >= 0.5) == (x.doc_id % 2 == 0) for x in rows) >= 78


def test_contradicting_labels_teach_nothing(spark):
    docs = odd_documents(spark, corpus(60))
    labels = [(100 + i, int(i % 3 != 0), "x") for i in range(60)]
    plain = cotrain.fit(docs, spark.createDataFrame(labels[2:], LABELS))
    again = cotrain.fit(docs, spark.createDataFrame([*labels, (100, 1, "x"), (101, 0, "x"), *labels[2:5]], LABELS))
    assert all(np.allclose(a.weights, b.weights, atol=1e-6) for a, b in zip(plain[:2], again[:2], strict=True))


def test_query_against_the_same_rows_in_memory(spark, sf_dir):
    """All documents viewed at once and taught without Spark give the query's scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toArrow()
    label = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if x.quality in (0, 1)}
    text = cotrain.text_view(docs.column("text").combine_chunks(), cotrain._classes())
    meta = cotrain.meta_view(*(docs.column(x).to_pylist() for x in ("lang", "source", "n_chars")))
    y = np.array([label.get(x, -1) for x in docs.column("doc_id").to_pylist()])
    known, rest = np.flatnonzero(y >= 0), y < 0
    turn = known[np.lexsort((*text[known][:, :4].T, y[known]))]
    pool = cotrain.Pool((text[rest].astype(np.float16).astype(float), meta[rest].astype(np.float16).astype(float)))
    a, b, mix = cotrain.co_train(text[turn], meta[turn], y[turn], pool=pool)
    expected = 1 / (1 + np.exp(-np.clip(np.stack((np.ones(len(y)), a.logit(text), b.logit(meta)), axis=1) @ mix, -30, 30)))
    got = {x.doc_id: x.score for x in queries.op6_cotraining(spark, sf_dir).collect()}
    assert len(got) == len(y) and np.allclose([got[x] for x in docs.column("doc_id").to_pylist()], expected, atol=1e-4)
