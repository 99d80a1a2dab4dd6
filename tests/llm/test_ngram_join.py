import collections
import random

import numpy as np
import pytest
from helpers import no_documents, odd_documents
from oracle import same

from textloom.llm import ngram_join, queries


def brute(rows):
    """(doc_id, copy_id, class_id, n_copies, n_links) of each row, from all pairs of rows."""
    sets, text = [], []
    for r in rows:
        w = (r.text or "").lower().split()
        text.append(tuple(w))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and r.doc_id is not None else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i, r in enumerate(rows):
        if sets[i] is None:
            out.append((r.doc_id, r.doc_id, r.doc_id, 1, 0))
            continue
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        alike = [j for j in range(n) if text[j] == text[i] and sets[j]]
        out.append((r.doc_id, min(rows[j].doc_id for j in alike), min(rows[j].doc_id for j in seen), len(alike), len(near[i])))
    return sorted(out, key=str)


def near_copies(n, words=120, changes=3, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def found(docs):
    return sorted(((x.doc_id, x.copy_id, x.class_id, x.n_copies, x.n_links) for x in ngram_join.link_classes(docs).collect()), key=str)


def test_against_brute_force(spark):
    texts = [*near_copies(20, changes=8), *near_copies(5, words=30, changes=2, seed=2), "Same Text\nhere", "a b c", "a b c", "a b c d", "A  B C"]
    docs = odd_documents(spark, texts)
    assert found(docs) == brute(docs.collect())


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    docs = odd_documents(spark, [*near_copies(90, changes=6), *near_copies(30, changes=4, seed=3)])
    assert found(docs) == brute(docs.collect())


def test_empty_table(spark):
    assert ngram_join.link_classes(no_documents(spark)).count() == 0
    assert ngram_join.keep_one(no_documents(spark)).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark, near_copies(10, changes=2))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and [x.doc_id for x in kept.where("doc_id >= 100").collect()] == [100]
    assert kept.where("doc_id IS NULL").count() == 1 and sorted(x.doc_id for x in kept.where("doc_id < 100").collect()) == [1, 2, 3, 4, 5, 6]


def test_keep_one_in_large_buckets(spark, monkeypatch):
    """Classes are those of all pairs, though rows are only compared until they are joined; a chain holds too."""
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    rng = random.Random(11)
    chain = [[f"c{i}" for i in range(150)]]
    for k in range(40):  # each link changes three words of its own, so the ends share nothing
        chain.append([*chain[-1][: 3 * k], *(f"n{k}x{j}" for j in range(3)), *chain[-1][3 * k + 3 :]])
    texts = [*near_copies(90, changes=6), *near_copies(60, words=90, changes=9, seed=3), *(" ".join(x) for x in chain)]
    rng.shuffle(texts)
    docs = odd_documents(spark, texts)
    expected = {x[2] for x in brute(docs.collect()) if x[0] is not None}
    assert sorted(x.doc_id for x in ngram_join.keep_one(docs).where("doc_id IS NOT NULL").collect()) == sorted(expected)


def test_near_copies_cost_few_comparisons(monkeypatch):
    """A block of near copies is compared about once a row."""
    import pyarrow as pa

    texts = near_copies(400, changes=3)
    block = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": texts})
    signed = next(ngram_join._signatures(5)([block]))
    sets = next(ngram_join._sets(5)([block]))
    n, compared = signed.num_rows, []
    prune = ngram_join.prune
    monkeypatch.setattr(ngram_join, "prune", lambda sig, a, b, band, least: compared.append(len(a)) or prune(sig, a, b, (sig[a] == sig[b]).reshape(len(a), -1, ngram_join.ROWS).all(axis=2).argmax(axis=1), least))
    rows = pa.table({"key": [1] * n, "node": signed.column("node"), "side": [0] * n, "label": signed.column("node"), "band": [0] * n, "sig": signed.column("sig"), "shingles": sets.column("shingles")})
    roots = ngram_join._one_of_blocks(0.8, 1e-6)(rows).column("root").to_pylist()
    assert len(set(roots)) == 1 and sum(compared) < 4 * n


def test_pruning_bound():
    least = ngram_join.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(0)
    # The posterior of reaching the threshold, by simulation, is below or above the tolerance on either side.
    coarse = ngram_join.least_matches(0.8, 0.05)
    for n in (8, 32, 96):
        draws = rng.beta(coarse[n] + 1, n - coarse[n] + 1, 200_000)
        assert (draws >= 0.8).mean() >= 0.05 - 0.005
        if coarse[n]:
            assert (rng.beta(coarse[n], n - coarse[n] + 2, 200_000) >= 0.8).mean() < 0.05 + 0.005
    assert (np.diff(least[ngram_join.STEP :: ngram_join.STEP]) >= 0).all()


def test_pairs_count_once():
    sig = np.zeros((2, ngram_join.HASHES), dtype=np.uint16)
    counted = sum(len(ngram_join.prune(sig, np.array([0]), np.array([1]), np.array([b]), ngram_join.least_matches())) for b in range(ngram_join.HASHES // ngram_join.ROWS))
    assert counted == 1


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_same_as_sql(spark, folder):
    same(queries.op5_ngram_join(spark, folder), ngram_join.ORACLE, folder)


def test_local_components():
    rng = random.Random(5)
    for _ in range(50):
        n = 30
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(40))]
        near = collections.defaultdict(set)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        a, b = (np.array(x, dtype=int) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int), np.empty(0, int))
        got = ngram_join._components(n, a, b)
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
            assert got[i] == min(seen)
