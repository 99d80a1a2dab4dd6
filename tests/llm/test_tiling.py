import random
import time

import numpy as np
from helpers import no_documents, odd_documents

from textloom.llm import queries, tiling

ITEMS = "item_id bigint, text string, doc_id bigint"


def brute_tiles(text, item, least):
    """Greedy string tiling by comparing all pairs of places."""
    text, item, out = list(text), list(item), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and item[i + n] >= 0:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j, n))
        if not found:
            return out
        for i, j, n in found:
            if all(x >= 0 for x in item[i : i + n]) and all(x >= 0 for x in text[j : j + n]):
                item[i : i + n], text[j : j + n] = [-1] * n, [-2] * n
                out.append((i, j, n))


def test_tiles_against_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        item = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 25))])
        text = np.array([rng.randrange(-1, 5) for _ in range(rng.randrange(1, 40))])
        least = rng.randrange(1, 5)
        assert sorted(tiling.tile(text, item, least)) == sorted(brute_tiles(text, item, least))


def sentence(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def planted(spark):
    rng = random.Random(9)
    items = [sentence(rng, 40) for _ in range(6)]
    noise = lambda n=200: sentence(rng, n)
    a = items[0]
    texts = [
        [*noise(), *a, *noise()],  # whole
        [*noise(), *a[20:], *noise(9), *a[:20], *noise()],  # halves, turned round
        [*noise(), *a[30:], *a[:10], *a[20:30], *a[10:20]],  # quarters, turned round
        [*noise(), *a[:15], *noise()],  # too little
        noise(),
        [w.upper() + "," for w in items[1]],  # other case and marks
        [*noise(30), *items[2], *items[3], *noise(30)],  # two items
    ]
    odd_items = [(0, " ".join(a)), (1, " ".join(items[1])), (2, " ".join(items[2])), (3, " ".join(items[3])), (7, None), (8, ""), (9, "..."), (10, "rare pair")]
    return odd_documents(spark, [" ".join(x) for x in [*texts, ["so", "rare", "pair", "it", "is"]]]), spark.createDataFrame([(k, x, 1) for k, x in odd_items], ITEMS)


def test_finds_reordered_passages(spark):
    docs, items = planted(spark)
    got = {(x.doc_id, x.item_id): x for x in tiling.find_contamination(docs, items).collect()}
    assert set(got) == {(100, 0), (101, 0), (102, 0), (105, 1), (106, 2), (106, 3)}
    assert sorted(x.item_id for x in tiling.short_items(items).collect()) == [7, 8, 9, 10]
    assert got[100, 0].coverage == 1 and got[100, 0].tiles == 1 and got[101, 0].tiles == 2 and got[102, 0].tiles == 4


def test_seeds_without_bits_change_nothing(spark, monkeypatch):
    """With few bits, all set, every window goes to the join: the result is the same."""
    docs, items = planted(spark)
    whole = sorted(map(tuple, tiling.find_contamination(docs, items).collect()))
    monkeypatch.setattr(tiling, "LG_BITS", 6)
    assert sorted(map(tuple, tiling.find_contamination(docs, items).collect())) == whole


def test_running_hashes_are_of_the_windows():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 3, 200)
    for n in (1, 5, 60, 200, 201):
        got, seen = tiling.running_hash(codes, n), {}
        assert len(got) == max(0, 201 - n)
        for i, h in enumerate(got.tolist()):
            assert seen.setdefault(h, codes[i : i + n].tolist()) == codes[i : i + n].tolist()
        assert len(seen) == len({tuple(codes[i : i + n]) for i in range(len(got))})


def test_many_repeats_take_little_time():
    began = time.perf_counter()
    tiles = tiling.tile(np.zeros(40_000, np.int64), np.zeros(100, np.int64))
    assert tiles == [(0, 0, 100)]
    item = np.arange(400) % 7
    assert sum(x[2] for x in tiling.tile(np.arange(40_000) % 7, item)) == 400
    assert time.perf_counter() - began < 5


def test_decontaminate_and_empty_tables(spark):
    docs, items = planted(spark)
    kept = tiling.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.where("doc_id >= 100").collect()) == [103, 104, 107] and kept.where("doc_id IS NULL").count() == 1
    none = spark.createDataFrame([], ITEMS)
    assert tiling.find_contamination(docs, none).count() == 0 and tiling.find_contamination(no_documents(spark), items).count() == 0
    assert tiling.decontaminate(docs, none).count() == docs.count()


def test_query_against_all_pairs(spark, sf_dir):
    """Each pair of a document and an item, tiled without seeds."""
    import pyarrow as pa

    from textloom.llm.common import words

    split = lambda t: words(pa.array([t]))[0].to_pylist()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    code = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in split(t)], dtype=np.int64)
    targets = [(x.item_id, coded(x.text)) for x in items]
    expected = set()
    for d in docs:
        text = coded(d.text)
        for k, item in targets:
            n = tiling.LEAST_TILE
            if len(item) >= n and np.isin(tiling.running_hash(item, n), tiling.running_hash(text, n)).any() and sum(x[2] for x in tiling.tile(text, item, n)) >= tiling.COVERAGE * len(item):
                expected.add((d.doc_id, k))
    assert {(x.doc_id, x.item_id) for x in queries.op9_decontamination(spark, sf_dir).collect()} == expected and expected


def test_what_most_texts_hold_does_not_tell():
    """Whatever is left out covers too little; each text that could reach the threshold holds a telling seed."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        windows, needed = rng.integers(0, 12, size=n), float(rng.integers(1, n + 6))
        rate = rng.integers(0, 9, size=12)
        told = set(tiling.telling(windows, rate[windows], 5, needed).tolist())
        cover = lambda some: len({i + k for i, x in enumerate(windows) if x in some for k in range(5)})
        left = set(windows.tolist()) - told
        assert cover(left) < needed and (not told or cover(set(windows.tolist())) >= needed)
        assert not told or not left or min(rate[list(left)]) >= max(rate[list(told)])


def test_a_prompt_that_all_share_makes_no_pairs(spark):
    """1,000 items and 100,000 documents begin with one prompt of seven words: the planted copies are found, within two minutes (10 seconds alone)."""
    import time

    from pyspark.sql import functions as F

    def texts(n, parts, name):
        body = F.concat_ws(" ", *(F.substring(F.sha2(F.concat_ws("/", F.lit(name), "id", F.lit(k)), 256), 1, 7) for k in range(14)))
        return spark.range(0, n, 1, parts).select("id", F.concat(F.lit("Which of the following statements is true? "), body).alias("text"))

    items = texts(1_000, 2, "item").withColumnRenamed("id", "item_id")
    docs = texts(100_000, 8, "doc").withColumnRenamed("id", "doc_id")
    planted = items.where("item_id % 100 = 0").select((F.col("item_id") + 1_000_000).alias("doc_id"), F.concat(F.lit("so they ask: "), "text", F.lit(" and no more")).alias("text"))
    began = time.perf_counter()
    got = sorted((x.doc_id, x.item_id) for x in tiling.find_contamination(docs.unionAll(planted), items).collect())
    assert got == [(1_000_000 + i, i) for i in range(0, 1_000, 100)] and time.perf_counter() - began < 120


def test_an_item_that_is_mostly_prompt_matches_all(spark):
    prompt = "which of the following statements is true about it"
    docs = spark.createDataFrame([(i, f"{prompt} number{i}") for i in range(40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, f"{prompt} or"), (2, f"{prompt} one two three four five six seven eight nine")], "item_id bigint, text string")
    assert sorted((x.doc_id, x.item_id) for x in tiling.find_contamination(docs, items).collect()) == [(i, 1) for i in range(40)]
