import itertools
import random
import unicodedata

import numpy as np
import pytest
from helpers import ODD_IDS, keys, no_documents, odd_documents
from pyspark.sql import functions as F

from textloom.llm import language, queries

WORDS = {"aa": "bana lona mina sola tana rona".split(), "bb": "greft strank pluft schronk dreld blist".split(), "ru": "мама рама окно стена дорога".split()}


def brute_viterbi(score, switch):
    best = max(itertools.product(range(score.shape[1]), repeat=len(score)), key=lambda p: sum(score[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    return list(best)


def value(score, path, switch):
    return sum(score[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 7, 0, 6, 3, 7, 2]
    for switch in (0.5, 1.5, 3.0):
        score = rng.normal(0, 2, (sum(sizes), 3))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        path = language.viterbi(score, begins, switch)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            if b > a:
                assert abs(value(score[a:b], path[a:b], switch) - value(score[a:b], brute_viterbi(score[a:b], switch), switch)) < 1e-9


def training(spark):
    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choices(words, k=30))) for lang, words in WORDS.items() for _ in range(20)]
    return spark.createDataFrame([*rows, (None, "greft"), ("aa", None), ("aa", "")], "lang string, text string")


def test_spans_of_mixed_text(spark):
    model = language.train(training(spark))
    assert model.langs == ["aa", "bb", "ru"]
    text = " ".join(WORDS["aa"] * 5) + ". " + " ".join(WORDS["bb"] * 3) + "! " + " ".join(WORDS["ru"] * 2)
    docs = odd_documents(spark, [text, " ".join(WORDS["bb"]), "мама 2 дорога", "123 456"])
    rows = {x.doc_id: x for x in language.identify(docs, model, ["doc_id"]).collect()}
    assert [(s.lang, s.first_word, s.words) for s in rows[100].spans] == [("aa", 0, 30), ("bb", 30, 18), ("ru", 48, 10)]
    assert rows[100].lang_pred == "aa" and 0.3 < rows[100].score < 0.7
    assert rows[101].lang_pred == "bb" and rows[101].score > 0.9
    assert rows[102].lang_pred == "ru"  # one script, one language
    assert rows[103].lang_pred == "und" and rows[103].score == 0


def test_odd_rows(spark):
    model = language.train(training(spark))
    rows = language.identify(odd_documents(spark), model, ["doc_id", "label"]).collect()
    assert keys(rows) == ODD_IDS
    assert {x.doc_id: x.lang_pred for x in rows if x.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(0 <= x.score <= 1 for x in rows)


def test_nothing_learnt_and_empty_table(spark):
    model = language.train(training(spark).where("false"))
    assert {x.lang_pred for x in language.identify(odd_documents(spark), model, ["doc_id"]).collect()} == {"und"}
    assert language.identify(no_documents(spark), model, ["doc_id"]).count() == 0


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op7_language(spark, folder).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    share = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.98


def test_many_languages_share_a_bounded_table(spark, monkeypatch):
    """With fewer buckets languages are still told apart; with too many values ``lang`` is no language."""
    monkeypatch.setattr(language, "CELLS", 3 * 4096)
    monkeypatch.setattr(language, "HELD", 1)
    model = language.train(training(spark))
    assert model.table.shape == (4096, 3)
    docs = spark.createDataFrame([(lang, " ".join(words)) for lang, words in WORDS.items()], "spans string, text string")
    assert [x.lang_pred for x in language.identify(docs.withColumnRenamed("spans", "k"), model, ["k"]).orderBy("k").collect()] == ["aa", "bb", "ru"]
    monkeypatch.setattr(language, "LANGS", 2)
    with pytest.raises(ValueError, match="languages"):
        language.train(training(spark))


def test_keys_named_as_results_give_way(spark):
    docs = odd_documents(spark, ["bana lona"])
    got = language.identify(docs, language.train(training(spark)), ["doc_id", "score", "node", "__text", "text"])
    assert got.columns == ["doc_id", "node", "__text", "text", "lang_pred", "score", "spans"]
    assert {(x.node, x["__text"]) for x in got.collect()} == {(1, "y")} and got.where("text = 'bana lona'").first().lang_pred == "aa"


def test_scripts():
    """Each group's names are those that Unicode gives its letters."""
    names = {"GURMUKHI": "gurmukhi", "GUJARATI": "gujarati", "TELUGU": "telugu", "KANNADA": "kannada", "MALAYALAM": "malayalam", "LAO": "lao", "TIBETAN": "tibetan", "KHMER": "khmer", "CJK": "han", "FULLWIDTH LATIN": "latin", "HALFWIDTH KATAKANA": "kana", "HANGUL": "hangul", "CYRILLIC": "cyrillic", "GREEK": "greek", "LATIN": "latin", "HEBREW": "hebrew", "ARABIC": "arabic", "THAI": "thai", "MYANMAR": "myanmar", "GOTHIC": "gothic", "ADLAM": "adlam", "TANGUT": "tangut", "SINHALA": "sinhala", "ETHIOPIC": "ethiopic", "DEVANAGARI": "devanagari", "BENGALI": "bengali", "TAMIL": "tamil", "GEORGIAN": "georgian", "ARMENIAN": "armenian", "HIRAGANA": "kana", "KATAKANA": "kana", "BOPOMOFO": "bopomofo"}
    assert list(language.SCRIPTS) == sorted(language.SCRIPTS) and len(language.SCRIPTS) < 200
    missed = 0
    for point in range(0x41, 0x32400):
        name = unicodedata.name(chr(point), "")
        script = next((v for k, v in names.items() if name.startswith(k + " ") and "LETTER" in name + " LETTER" * (k in ("CJK", "HANGUL", "TANGUT"))), None)
        if script and unicodedata.category(chr(point)).startswith("L"):
            points, begins = language._points([chr(point)])
            missed += language._NAMES[language._scripts(points, begins)[0]] != script
    assert missed < 150  # letters in blocks of another script, or of none
