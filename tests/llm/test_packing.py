import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import no_documents, odd_documents
from tokenizers import Tokenizer

from textloom.llm import packing, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(FILE)


def check(rows, texts, capacity, segments=packing.SEGMENTS, loss=packing.LOSS):
    """Every id in exactly one piece; sequences gapless and within the three limits."""
    ids = [(*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1) for t in texts]
    expected, got = collections.Counter(), collections.Counter()
    for x in ids:
        expected[len(x)] += len(x)
    for r in rows:
        got[r.doc_tokens] += r.length
    assert expected == got
    sequences, bears = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, packing.PROMPT))
        bears[r.sequence_id] += r.loss_tokens
    assert max(bears.values()) <= loss and max(map(len, sequences.values())) <= segments
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences), sum(map(len, ids))


def test_round_trip_of_the_query(spark, sf_dir):
    rows = queries.op8_packing(spark, sf_dir).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    n, tokens = check(rows, docs.values(), packing.CAPACITY)
    assert n <= tokens / packing.CAPACITY * 1.02 + 1
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for key, text in docs.items():
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda x: x.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, FILE).collect()
    check(rows, [x.text for x in docs.collect()], packing.CAPACITY)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack_documents(no_documents(spark), FILE).count() == 0


def test_three_limits():
    rng = random.Random(4)
    packer = packing.Packer(capacity=64, segments=3, loss=40, waiting=20, least=4)
    docs = {k: np.arange(rng.randrange(1, 150)) for k in range(200)}
    loss = {k: np.array([rng.random() < 0.7 for _ in x], dtype=np.int64) for k, x in docs.items()}
    out = []
    for k, x in docs.items():
        out += packer.add(k, x, loss[k])
        assert len(packer.items) < 40
    out += packer.finish()
    bins, seen = collections.defaultdict(list), collections.defaultdict(list)
    for sequence, offset, key, start, ids, bears in out:
        bins[sequence].append((offset, len(ids), int(bears.sum())))
        seen[key] += ids.tolist()
        assert ids[0] == start
    assert all(sorted(seen[k]) == x.tolist() for k, x in docs.items())
    for pieces in bins.values():
        assert sum(n for _, n, _ in pieces) <= 64 and len(pieces) <= 3 and sum(b for _, _, b in pieces) <= 40
        assert [o for o, _, _ in sorted(pieces)] == list(np.cumsum([0, *(n for _, n, _ in sorted(pieces))])[:-1])


def test_dot_product_takes_the_piece_that_fits_the_room_best():
    packer = packing.Packer(capacity=10, segments=4, loss=6)
    ids = lambda n: np.arange(n)
    for key, n, bears in (("a", 4, 0), ("b", 6, 6), ("c", 3, 1)):
        list(packer.add(key, ids(n), np.array([1] * bears + [0] * (n - bears))))
    first = [x for x in packer.finish() if x[0] == 0]
    assert [x[2] for x in first] == ["b", "a"]


def test_limits_have_to_be_positive():
    with pytest.raises(ValueError, match="at least"):
        packing.Packer(loss=0)


def test_limits_bind_in_the_operator(spark):
    """Many short documents reach the limit of pieces, long ones that of tokens with loss; both are filled up."""
    short = spark.createDataFrame([(k, "a b c d e f g") for k in range(200)], "doc_id bigint, text string").coalesce(1)
    rows = packing.pack_documents(short, FILE, loss_from=2).collect()
    pieces = collections.Counter(r.sequence_id for r in rows)
    assert max(pieces.values()) == packing.SEGMENTS and len(pieces) == -(-200 // packing.SEGMENTS)
    assert {r.loss_tokens for r in rows} == {6}
    long = spark.createDataFrame([(k, "word " * 3_000) for k in range(40)], "doc_id bigint, text string").coalesce(1)
    rows = packing.pack_documents(long, FILE).collect()
    n, tokens = check(rows, ["word " * 3_000] * 40, packing.CAPACITY)
    bears = collections.Counter()
    for r in rows:
        bears[r.sequence_id] += r.loss_tokens
    assert max(bears.values()) == packing.LOSS and n <= tokens / packing.LOSS * 1.02 + 1


ODD = [
    "", " ", "\n", "a\u00a0 b", "a\u3000 b", "a\u2003\n b\u1680 c", "\u0085 x \u0085", "a\x1c b\x1f c", "\ufeff x \ufeffy", "\u180e a\u180e b", "ñ ñandú  él ’s 's I'm we'll", "漢字 か な。 。x", "😀 😀  a\t\tb \r\n c",
    "a\n\n b\n \nc", "1 2 33  4", "... !!! ? ", "\u00a0", "\x00 \x00", "é\n", "x\u0301 y",
]


@pytest.mark.parametrize("texts", [ODD, ["".join(random.Random(k).choices(["a", " ", "\n", "é", "\u00a0", "\u3000", "漢", "😀", "'s", "1", ".", "\u2003", "<|endoftext|>", "\t", "\u0085"], k=60)) for k in range(300)]])
def test_stretches_have_the_ids_of_the_whole(texts):
    encoder = packing.Encoder(open(FILE, encoding="utf-8").read())
    whole = [TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):  # the second time from memory
        for rows in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.array([*texts, None])):
            ids, count = encoder.encode(rows)
            assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])][: len(texts)] == whole
    parts, rows = packing.stretches(pa.array(texts, pa.large_string()))
    assert ["".join(x for x, r in zip(parts.to_pylist(), rows, strict=True) if r == k) for k in range(len(texts))] == texts


class Listening:
    """The library, and the texts that it was given."""

    def __init__(self):
        self.texts = []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return TOKENIZER.encode_batch_fast(texts, **more)


def test_the_library_gets_stretches_joined():
    """Not each stretch by a call of its own, which took most of a task's time."""
    encoder = packing.Encoder(open(FILE, encoding="utf-8").read())
    encoder.tokenizer = library = Listening()
    text = " ".join(f"w{k * 7919 % 10_007}é" for k in range(5_000))
    ids, count = encoder.encode(pa.array([text]))
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids and count.tolist() == [len(ids)]
    assert "".join(library.texts) == text and len(library.texts) <= 50
    again, _ = encoder.encode(pa.array([text]))
    assert again.tolist() == ids.tolist() and "".join(library.texts) == text


@pytest.mark.parametrize("met", [True, False])
def test_joined_stretches_keep_their_ids(met):
    """Beginnings of texts and ends with white space among them; also where ends aren't met and stretches go one by one."""
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices(["a", " ", "\n", "é", "\u00a0", "漢", "'s", "1", ".", "<|endoftext|>", "\t"], k=30)) for _ in range(300)]
    parts = sorted(set(packing.stretches(pa.array(texts, pa.large_string()))[0].to_pylist()))
    rng.shuffle(parts)
    encoder = packing.Encoder(open(FILE, encoding="utf-8").read())
    if not met:
        encoder.width[:] = 1
    ids, size = encoder._ids(pa.array(["zz", *parts], pa.large_string())[1:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [TOKENIZER.encode(x, add_special_tokens=False).ids for x in parts]


def test_ids_of_the_unmodified_tokenizer(spark):
    """Special tokens and very long runs of white space, in the query and in the pipeline's stage."""
    import corpus_pipeline

    end, blank = "<|endoftext|>", " " * 1_000_000
    texts = [f"a{end}b", end, f" {end}  {end}x {end}", "<|endoftext|", f"a{blank}b", f"a{blank}", f"{blank}\u3000{end}{blank}\n", "x" + "\n" * 1_000_000 + "'s", "\x1c" * 20_000 + " y", "w" * 20_000 + blank + "1" + blank + "."]
    texts += ["a" + " \t\n\r"[k % 4] * n + "b c" for k, n in enumerate((1, 2, 3, 9_999, 10_000, 10_001))]
    ids = {k: [*TOKENIZER.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(texts)}
    assert ids[0] == [64, 50256, 65, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in corpus_pipeline.packed(spark, docs, "").collect():
        piece = np.array(ids[row.doc_id][row.start : row.start + row.length], dtype="<u4")
        assert row.doc_tokens == len(ids[row.doc_id]) and row.length == len(piece) and row.ids_crc32 == zlib.crc32(piece.tobytes())
