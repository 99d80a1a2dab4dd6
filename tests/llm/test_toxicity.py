import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from helpers import ODD_IDS, keys, no_documents, odd_documents
from pyspark.sql import functions as F

from textloom.llm import queries, toxicity
from textloom.llm.common import remainder

LABELS = "doc_id bigint, toxic int, lang string"


def brute_segments(scores):
    """Maximal scoring subsequences by their recursive definition."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    left = brute_segments(scores[:a])
    right = [(x + b, y + b) for x, y in brute_segments(scores[b:])]
    return left + [(a, b)] + right


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice((-3, -2, -1, 1, 2, 3)) + rng.random() / 100 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == brute_segments(scores)


def clean_and_toxic(n=120):
    rng = random.Random(5)
    common = ["".join(x) for x in itertools.product("bdfg", "aeiou", "lmnr")]
    texts = [" ".join(rng.choices(common, k=60)) for _ in range(n)]
    return [x + " vileword foulterm vileword" if i % 4 == 0 else x for i, x in enumerate(texts)]


def test_finds_planted_passages_and_survives_odd_rows(spark):
    texts = clean_and_toxic()
    docs = odd_documents(spark, texts)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0), "x") for i in range(len(texts))] + [(1, 1, "x"), (2, 0, "x"), (None, 1, "x"), (3, None, "x")], LABELS)
    model = toxicity.fit(docs, labels)
    got = toxicity.detect(docs, model, ["doc_id"])
    rows = got.collect()
    assert keys(rows)[: len(ODD_IDS) - 1] == ODD_IDS[:-1] and len(rows) == len(texts) + len(ODD_IDS)
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 100:
            assert (r.score >= 0.7) == (r.doc_id % 4 == 0)
            assert r.segments or r.doc_id % 4
        else:
            assert 0 <= r.score < 0.7 and not r.segments


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], LABELS)
    for docs in (no_documents(spark), odd_documents(spark)):
        model = toxicity.fit(docs, empty)
        assert toxicity.detect(docs, model, ["doc_id"]).where("score >= 0.7").count() == 0


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op1_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(x.toxic == x.predicted for x in got) / len(got)
    assert hit > 0.9
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = queries.op1_toxicity(spark, folder)
    assert whole.count() == docs.count() and whole.where(F.col("held_out") != (remainder("doc_id", 3) == 1)).count() == 0
    assert whole.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def chance_of_order(rows):
    """The chance that a row of label 1 has the higher score than one of label 0; a half where alike."""
    one, zero = ([x.score for x in rows if x.toxic == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))


@pytest.mark.parametrize(("folder", "least"), [("/root/testdata/sf0.001", 0.6), ("/root/testdata/sf0.01", 0.9)])
def test_held_out_labels_are_ranked(spark, folder, least):
    """Also where six toxic documents teach and their evidence, out of fold, tells nothing."""
    rows = queries.op1_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("toxic", "score").collect()
    assert chance_of_order(rows) > least


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_toxic_documents_teach(spark, n):
    """After two standard errors no word of so few documents would score."""
    texts = [x.replace("vileword", "fine").replace("foulterm", "fine") for x in clean_and_toxic(60)]
    texts = [x + " vileword foulterm rankphrase" if i < n or i % 10 == 9 else x for i, x in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < n), "x") for i in range(60) if i % 10 != 9], LABELS)
    rows = toxicity.detect(docs, toxicity.fit(docs, labels), ["doc_id"]).where("doc_id >= 3").withColumn("toxic", (F.col("doc_id") % 10 == 9).cast("int")).collect()
    assert chance_of_order(rows) > 0.9


def test_labels_of_held_out_rows_are_not_read(spark):
    texts = clean_and_toxic()
    docs = odd_documents(spark, texts)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0), "x") for i in range(len(texts))], LABELS)
    usable = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    turned = labels.withColumn("toxic", F.when(usable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.fit(docs, labels, usable).scores == toxicity.fit(docs, turned, usable).scores


def test_extreme_value_root():
    rate, scale = toxicity.extreme_values(np.array([5.0, 2.0, 993.0]), np.array([1.0, 3.0, -0.02]))
    p = np.array([0.005, 0.002])
    assert (p * np.exp(rate * np.array([1.0, 3.0]))).sum() + 0.993 * np.exp(-rate * 0.02) == pytest.approx(1.0, abs=1e-6)
    assert scale == pytest.approx(max(0.007 * np.exp(rate), 0.002 * np.exp(3 * rate)))


def brute_scores(docs, labels, keep):
    """Feature scores by plain counting over documents, of the folds in ``keep``."""
    ones, zeros, n = collections.Counter(), collections.Counter(), [0, 0]
    for text, label, fold in zip(docs, labels, keep, strict=True):
        if fold:
            got = set(re.findall(r"\w+", text.lower()))
            got |= {x[:k] + "*" for x in got for k in toxicity.STEMS if len(x) > k}
            (ones if label else zeros).update(got)
            n[label] += 1
    out = {}
    for f in set(ones) | set(zeros):
        a, b = ones[f], zeros[f]
        prior = toxicity.PRIOR * (a + b) / (n[0] + n[1])
        ratio = math.log((a + prior) / (n[1] + toxicity.PRIOR - a - prior)) - math.log((b + prior) / (n[0] + toxicity.PRIOR - b - prior))
        sure = abs(ratio) - toxicity.ERRORS * math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if sure > 0:
            out[f] = math.copysign(min(sure, toxicity.MOST), ratio)
    return out


def brute_evidence(text, model):
    """Evidence and segments of a text by the recursive definition over all its tokens."""
    tokens = re.findall(r"\w+", text.lower())
    scores = []
    for x in tokens:
        known = [x, *(x[:k] + "*" for k in reversed(toxicity.STEMS) if len(x) > k)]
        scores.append(next((model.scores[f] for f in known if f in model.scores), 0.0) - toxicity.DRIFT)
    found, normal, joint, everywhere = [], [], [], collections.Counter()
    for a, b in brute_segments(scores):
        if model.rate * sum(scores[a:b]) <= math.log(model.scale * len(tokens)):
            continue
        within, now, sums = collections.Counter(), [0.0, 0.0], [0.0, 0.0]
        for x, s in zip(tokens[a:b], scores[a:b], strict=True):
            if s > 0:
                within[x] += 1
                everywhere[x] += 1
            now = [max(0.0, now[0] + (s / within[x] if s > 0 else s)), max(0.0, now[1] + (s / everywhere[x] if s > 0 else s))]
            sums = [max(x) for x in zip(sums, now, strict=True)]
        found.append((a, b - a))
        normal.append(model.rate * sums[0] - math.log(model.scale * len(tokens)))
        joint.append(model.rate * sums[1] - math.log(model.scale * len(tokens)))
    if not found:
        return 0.0, []
    evidence, chosen = toxicity.significant(normal, joint)
    return evidence, [found[k] for k in chosen]


def test_whole_scores_agree_with_brute_force(spark):
    """The query's model and results at its own parameters: features counted, scored and scanned in plain Python."""
    rng = random.Random(6)
    texts = [f"{x} {rng.choice(('fine', 'vilewords', 'Vilewording'))} {' '.join(rng.choices(('kind', 'gentle', 'peace'), k=i % 4))}" for i, x in enumerate(clean_and_toxic(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(len(texts))], LABELS)
    model = toxicity.fit(docs, labels)
    expected = brute_scores(texts, [int(i % 4 == 0) for i in range(len(texts))], [True] * len(texts))
    assert model.scores.keys() == expected.keys() and all(model.scores[f] == pytest.approx(x) for f, x in expected.items())
    assert min(expected.values()) < 0 < max(expected.values())
    a, b = model.line
    for r in toxicity.detect(docs, model, ["doc_id", "text"]).collect():
        evidence, found = brute_evidence(r.text, model)
        assert r.evidence == pytest.approx(evidence, abs=1e-9) and [(x.first_word, x.words) for x in r.segments] == found
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(evidence)))))


def test_calibration_is_out_of_fold(spark):
    """Words that only single documents hold can't make the calibration surer: each is scored without its own counts."""
    rng = random.Random(2)
    texts = [" ".join(f"own{i}x{k}" for k in range(30)) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, rng.randrange(2), "x") for i in range(len(texts))], LABELS)
    assert toxicity.detect(docs, toxicity.fit(docs, labels), ["doc_id"]).where("score > 0.7").count() == 0


def test_joint_evidence():
    assert toxicity.joint_evidence([]) == (0.0, 0) and toxicity.joint_evidence([-1.0]) == (0.0, 0)
    assert toxicity.joint_evidence([1e6]) == (1e6, 1)  # no underflow
    assert toxicity.joint_evidence([4.0]) == (pytest.approx(4.0, abs=0.01), 1)
    several, n = toxicity.joint_evidence([4.0, 4.0, 4.0])
    assert n == 3 and 4 < several < 12
    assert all(toxicity.joint_evidence([x] * 50)[0] >= 0 for x in (0.01, 1.0, 800.0))


def test_very_long_toxic_text(spark):
    texts = clean_and_toxic()
    docs = odd_documents(spark, [*texts, " ".join(f"vileword foulterm w{i}" for i in range(20_000))])
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0), "x") for i in range(len(texts))], LABELS)
    row = toxicity.detect(docs, toxicity.fit(docs, labels), ["doc_id"]).where(F.col("doc_id") == 100 + len(texts)).first()
    assert row.score > 0.7 and row.segments


def test_each_significant_passage_is_found():
    """One that is significant alone stays beside a much stronger one, and repeats far away count in full."""
    import pyarrow as pa

    assert toxicity.significant([50.0, 3.0, -1.0], [50.0, 3.0, -1.0]) == (50.0, [0, 1])
    assert toxicity.significant([2.0, 2.0, 2.0], [2.0, 2.0, 2.0])[1] == [0, 1, 2]  # together only
    model = toxicity.ToxicModel({"vile": 4.0, "foul": 4.0, "rank": 4.0}, rate=1.0, scale=0.1)
    passage, clean = "vile foul rank ", "fine " * 1000
    text = (passage + clean) * 30
    _, found = toxicity._scored(model, pa.array([text, passage + "fine " * 3 + passage]))
    assert [x["first_word"] for x in found[0]] == [1003 * k for k in range(30)] and {round(x["score"], 9) for x in found[0]} == {12.0 - 3 * toxicity.DRIFT}
    assert [x["score"] for x in found[1]] == [pytest.approx(18.0 - (1.5 * 3 + 3) * toxicity.DRIFT)]  # within a segment they count half
