import collections
import math
import re

import pytest
from helpers import ODD_IDS, keys, no_documents, odd_documents

from textloom.llm import lm_score, queries


def brute(docs, good):
    """Losses by plain counting of all words and bigrams, at the operator's own parameters: n_tokens, target, background."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())

    def model(texts):
        pairs, lone = collections.Counter(), collections.Counter()
        for t in texts:
            chain = ["\n", *split(t), "\n"]
            lone.update(chain[1:])
            pairs.update(zip(chain, chain[1:], strict=False))
        total = sum(lone.values())
        share = lambda v: (lone[v] + lm_score.SEEN) / (total + lm_score.SEEN * lm_score.VOCABULARY)
        return lambda u, v: -math.log((pairs[u, v] + lm_score.WEIGHT * share(v)) / (lone[u] + lm_score.WEIGHT))

    a, b = model([t for i, t in docs if i in good]), model([t for _, t in docs])
    out = []
    for _, t in docs:
        chain = ["\n", *split(t), "\n"]
        pairs = list(zip(chain, chain[1:], strict=False))
        out.append((len(pairs) - 1, *(sum(m(u, v) for u, v in pairs) / len(pairs) for m in (a, b))))
    return out


def compare(rows, docs, good):
    expected = sorted(brute(docs, good))
    got = sorted((x.n_tokens, x.ce_target, x.ce_background) for x in rows)
    assert len(got) == len(expected)
    for x, y in zip(got, expected, strict=True):
        assert x == pytest.approx(y, abs=1e-9)
    assert all(x.score == pytest.approx(x.ce_target - x.ce_background) for x in rows)


@pytest.mark.parametrize("chunk_bytes", [lm_score.CHUNK_BYTES, 40])
def test_against_brute_force(spark, chunk_bytes):
    texts = ["red green red blue", "red red green", "blue", "one two three one", "Two red one", "three three", "red one blue", "", None, "rare red"] + ["red red red " * 30] * 5
    docs = [(None if i % 7 == 3 else i % 11, t) for i, t in enumerate(texts)]
    good = {0, 1, 2, 9}
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    rows = lm_score.score(frame, spark.createDataFrame([(x, 1) for x in [*good, 1, None]], "doc_id bigint, q int"), ["doc_id"], chunk_bytes).collect()
    compare(rows, docs, good)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    good = {x.doc_id for x in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    compare(queries.op3_lm_score(spark, sf_dir).collect(), docs, good)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = lm_score.score(docs, docs, ["doc_id", "score", "label", "node"]).collect()
    assert rows[0].__fields__ == ["doc_id", "label", "node", *lm_score.RESULTS]
    assert keys(rows) == ODD_IDS and all(math.isfinite(x.score) for x in rows)
    assert {x.doc_id: x.n_tokens for x in rows}[5] == 40_000
    assert lm_score.score(no_documents(spark), no_documents(spark), ["doc_id"]).count() == 0
    assert all(math.isfinite(x.score) for x in lm_score.score(docs, no_documents(spark), ["doc_id"]).collect())


def test_target_like_texts_score_lower(spark, sf_dir):
    folder = "/root/testdata/sf0.01"
    got = queries.op3_lm_score(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").avg("score").collect()
    mean = {x["quality"]: x["avg(score)"] for x in got}
    assert mean[1] < mean[0]
