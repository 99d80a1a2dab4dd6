import random

import public_tokenizers
import pytest
from helpers import no_documents, odd_documents

from textloom.llm import queries, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["word", " the", "  ", "\n", "\n\n\n", "'re", "'", "'l", "éè", "中文", "\U0001f600\U0001f601", "123", " 4567", "...", "<|endoftext|>", "<|endof", "\t", " ", "a" * 40, " " * 30, "́", "<|endoftext|><|endoftext|>", "x'll"]


def whole(texts, name="byte_bpe_50k.json"):
    """Every text at once, by the library as it is loaded."""
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode([x or "" for x in texts])]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def random_texts(n, parts, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(parts))) for _ in range(n)]


def expected(texts, counts):
    return sorted(((i, len((x or "").encode()), n, n > 1024) for i, (x, n) in enumerate(zip(texts, counts, strict=True))), key=str)


@pytest.mark.parametrize(("chunk", "overlap"), [(24, 12), (64, 8), (200, 30), (40, 1)])
def test_chunks_count_like_whole_texts(spark, chunk, overlap):
    """Chunks so short that they cut white space, contractions, special tokens and long runs; many overlaps have to grow."""
    texts = random_texts(80, 300) + ["", None, "a" * 5_000, " " * 3_000, "'" * 999, "<|endoftext|>" * 200, "中" * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = token_count.count_tokens(docs, PATH, ["doc_id"], huge=16, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(texts, whole(texts))


def test_boundaries_are_those_of_the_pattern():
    """Between any two boundaries stand the tokens of that part alone."""
    with open(PATH) as file:
        counter = token_count.Counter(file.read())
    for text in random_texts(60, 60, 1):
        places, before, n = counter.boundaries(text)
        assert n == counter.counts([text])[0] and counter.margin() == len("<|endoftext|>")
        for a, b in zip(places, before, strict=True):
            assert counter.counts([text[a:]])[0] == n - b


def test_a_wider_overlap_is_taken_where_it_is_needed(spark, monkeypatch):
    widths = []
    plain = token_count.spliced
    monkeypatch.setattr(token_count, "spliced", lambda *a: (widths.append(a[2:]), plain(*a))[1])
    texts = ["word " * 4_000, "b" * 3_000 + " c" * 4_000, "word " * 4_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = token_count.count_tokens(docs, PATH, ["doc_id"], huge=1_000, chunk=1_000, overlap=100)
    assert sorted(map(tuple, got.collect())) == expected(texts, whole(texts)) and widths == [(1_000, 100), (1_000, 400), (3_200, 1_600)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_take_whole_texts(spark, name):
    texts = random_texts(30, 80) + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = token_count.count_tokens(docs, public_tokenizers.path(name), ["doc_id"], huge=64, chunk=32, overlap=8)
    assert sorted(map(tuple, got.collect()), key=str) == expected(texts, whole(texts, name))


def test_odd_documents(spark):
    docs = odd_documents(spark, ["one", "two <|endoftext|>"])
    got = token_count.count_tokens(docs.selectExpr("*", "'x' AS n_tokens", "1 AS bytes", "2 AS k0"), PATH, ["doc_id", "n_chars", "n_tokens", "bytes", "k0", "__text"])
    assert got.columns == ["doc_id", "n_chars", "bytes", "k0", "__text", "n_bytes", "n_tokens", "over_limit"]
    texts = [x.text for x in docs.select("doc_id", "text").collect()]
    rows = zip([x.doc_id for x in docs.select("doc_id").collect()], texts, whole(texts), strict=True)
    assert sorted(((x.doc_id, x.n_bytes, x.n_tokens) for x in got.collect()), key=str) == sorted(((i, len((x or "").encode()), n) for i, x, n in rows), key=str)
    assert token_count.count_tokens(no_documents(spark), PATH, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="twice"):
        token_count.count_tokens(docs, PATH, ["doc_id"], chunk=5, overlap=4)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    """The registered query against the library on all texts, and with half of them doubled up to lengths that are cut."""
    import pyarrow.parquet as pq

    docs = pq.read_table(f"/root/testdata/{size}/documents.parquet").to_pydict()
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in queries.op12_token_count(spark, f"/root/testdata/{size}").collect()}
    assert got == {i: (len((x or "").encode()), n, n > 1024) for i, x, n in zip(docs["doc_id"], docs["text"], whole(docs["text"]), strict=True)}


def test_production_parameters_cut_and_agree(spark):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    long = ["\n".join(x or "" for x in texts[:300]), "".join(x or "" for x in texts[300:500]) + "z" * 2_000 + "\n" * 1_000 + "".join(x or "" for x in texts[500:])]
    docs = spark.createDataFrame(list(enumerate(long + long[:1])), "doc_id bigint, text string")
    got = sorted(map(tuple, token_count.count_tokens(docs, PATH, ["doc_id"]).collect()))
    assert got == expected(long + long[:1], whole(long + long[:1]))
