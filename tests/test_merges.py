"""Byte-pair merges learnt by Spark, against a plain loop and the library."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from textloom.operators import merges, sequences, tokenizers


def plain(pieces, size, specials=sequences.SPECIALS):
    """The greedy rule with all pairs counted anew for each merge."""
    tokens = [*specials, *sorted({c for x in pieces for c in x})]
    words = [([tokens.index(c, len(specials)) for c in x], n) for x, n in pieces.items()]
    out = []
    while len(tokens) < size:
        counts = Counter()
        for ids, n in words:
            for p in zip(ids, ids[1:], strict=False):
                counts[p] += n
        if not counts:
            break
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        text = tokens[a] + tokens[b]
        out.append((tokens[a], tokens[b], n))
        if text not in tokens:
            tokens.append(text)
        c, changed = tokens.index(text), []
        for ids, m in words:
            new, i = [], 0
            while i < len(ids):
                two = ids[i : i + 2] == [a, b]
                new.append(c if two else ids[i])
                i += 1 + two
            changed.append((new, m))
        words = changed
    return tokens, out


def frame(spark, pieces):
    return spark.createDataFrame(list(pieces.items()), "piece string, n bigint").repartition(3)


def random_pieces(seed, letters="ab", n=60, longest=30):
    rng = random.Random(seed)
    return dict(Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)))


@pytest.mark.parametrize(("seed", "letters", "size"), [(1, "ab", 40), (2, "abcd ", 60), (3, "aé\U0001f600\n", 30)])
def test_same_as_a_plain_loop(spark, seed, letters, size):
    pieces = random_pieces(seed, letters)
    assert merges.learn(frame(spark, pieces), size) == plain(pieces, size)


def test_wrong_guesses_are_mended(spark, monkeypatch):
    """From three short pieces most guesses are wrong; the result is the same, in more passes."""
    passes = []
    check = merges.verified
    monkeypatch.setattr(merges, "verified", lambda *a: passes.append(check(*a)) or passes[-1])
    for name, value in (("WHOLE", 0), ("SAMPLE", 3), ("LONGEST", 6), ("AHEAD", 8), ("BLOCK_IDS", 50)):
        monkeypatch.setattr(merges, name, value)
    pieces = random_pieces(7, "abc", 50, 20)
    assert merges.learn(frame(spark, pieces), 30) == plain(pieces, 30) and min(passes) >= 1 and len(passes) > 3


def test_one_pass_where_the_sample_holds_all(spark, monkeypatch):
    passes = []
    check = merges.verified
    monkeypatch.setattr(merges, "verified", lambda *a: passes.append(check(*a)) or passes[-1])
    pieces = random_pieces(5, "abcdefgh ", 200, 60)
    assert merges.learn(frame(spark, pieces), 60) == plain(pieces, 60) and len(passes) == 1


@pytest.mark.parametrize("pieces", [{}, {"": 4}, {"a": 9}, {"aaaa": 1, "a": 2}, {"aaa": 3, "aa": 1}, {"abab": 2, "ba": 2}, {"ab": 1, "cd": 1}])
def test_few_pieces(spark, pieces):
    assert merges.learn(spark.createDataFrame([*pieces.items(), (None, 3)], "piece string, n bigint"), 12) == plain(pieces, 12)


def test_merges_in_place():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ids = np.append(rng.integers(0, 3, size=40), -1).astype(np.int64)
        a, b = rng.integers(0, 3, size=2)
        after, weight, pairs, change = merges.merged(ids, np.ones(41, np.int64), a, b, 9)
        count = lambda x: Counter((p << 32) | q for p, q in zip(x.tolist(), x.tolist()[1:], strict=False) if -1 not in (p, q))
        moved = count(after)
        moved.subtract(count(ids))
        assert dict(zip(pairs.tolist(), change.tolist(), strict=True)) == {p: n for p, n in moved.items() if n} and len(weight) == len(after)


def test_same_tokenizer_as_the_library(spark, sf_dir):
    """Merges, vocabulary and ids of whole texts, as the library learns them from the same lines; and a plain loop's merges."""
    texts = [x or "" for x in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()]
    docs = spark.createDataFrame([(x + "\n" * (i < len(texts) - 1),) for i, x in enumerate(texts)], "text string")
    made = tokenizers.PairTokenizer.learn(docs, 220)
    library = tokenizers.PairTokenizer.fit(texts, 220)
    mine, other = made.told()["tokenizer"]["model"], library.told()["tokenizer"]["model"]
    assert mine["vocab"] == other["vocab"] and [list(x) for x in mine["merges"]] == [list(x) for x in other["merges"]]
    rows = spark.createDataFrame(list(enumerate(texts[:40])), "id int, text string")
    assert made.encode(rows).collect() == library.encode(rows).collect()
    pieces = {x["piece"]: x["n"] for x in merges.pieces_of(docs).collect()}
    assert merges.learn(frame(spark, pieces), 130) == plain(pieces, 130)


def test_the_literal_pattern_cuts(spark):
    docs = spark.createDataFrame([("a(\\s)b\nc(\\s)(\\s)",), (None,)], "text string")
    assert sorted(x["piece"] for x in merges.pieces_of(docs).collect()) == ["(\\s)", "a(\\s)", "b\n", "c(\\s)"]


def test_cuts_go_where_no_merge_does(spark, monkeypatch):
    """Pieces are cut at rare pairs, by a count that is too high at first as well; the result is that of whole pieces."""
    pieces = random_pieces(9, "aaabbbccde ", 150, 60)
    want = plain(pieces, 26)
    cut = []
    fragments = merges._fragments
    monkeypatch.setattr(merges, "_fragments", lambda kept: cut.append(kept) or fragments(kept))
    assert merges.learn(frame(spark, pieces), 26) == want and cut[0] is not None
    cut.clear()
    monkeypatch.setattr(merges, "_rare", lambda *a: 4 * want[1][0][2])  # not even the first merge occurs so often
    assert merges.learn(frame(spark, pieces), 26) == want and len(cut) > 2
    (block,) = fragments([(ord("a") << 32) | ord("b")])(frame(spark, {"xabé😀ab": 2, "ab": 3}).coalesce(1).toArrow().combine_chunks().to_batches())
    assert dict(zip(*(c.to_pylist() for c in block.columns), strict=True)) == {"ab": 7}


def test_repeated_pieces_add_up(spark):
    rows = spark.createDataFrame([("abab", 1), ("ba", 1), ("abab", 1)], "piece string, n bigint")
    assert merges.learn(rows, 12) == plain({"abab": 2, "ba": 1}, 12)
