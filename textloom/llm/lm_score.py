"""Cross-entropy difference: target and background bigram models over one vocabulary, held in parts by all tasks together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounds, coded, words

#: Weight of a word's share in a bigram's probability; the count that every word has before any is seen, and how many
#: words the shared vocabulary is taken to hold.
WEIGHT, SEEN, VOCABULARY = 4.0, 0.1, 1 << 24
#: Bytes of text in a chunk, about: it asks once for each word and bigram that it holds. Rows of one id go to SPREAD chunks.
CHUNK_BYTES, SPREAD = 8 << 20, 8
RESULTS = {"n_tokens": "bigint", "ce_target": "double", "ce_background": "double", "score": "double"}

_EDGE = np.uint64(xxhash.xxh3_64_intdigest("\n"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@dataclass
class Chunk:
    """The grams of some texts: each token after a text's begin (its last one is the end) with the one before it."""

    rows: np.ndarray  # of each token, its text
    keys: np.ndarray  # distinct hashes of words and bigrams, ascending
    pair: np.ndarray  # of each token, where the bigram that it ends stands in keys
    own: np.ndarray  # where its word does
    before: np.ndarray  # where the word before it does

    @classmethod
    def of(cls, texts: pa.Array) -> Chunk:
        items, rows = words(texts)
        uniq, index = coded(items)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in uniq), dtype=np.uint64, count=len(uniq))
        n = len(texts)
        size = np.diff(bounds(rows, n)) + 2
        code = np.full(int(size.sum()), len(uniq), dtype=np.int32)
        code[np.arange(len(index)) + 2 * rows + 1] = index
        row = np.repeat(np.arange(n, dtype=np.int32), size)
        del items, uniq, index
        hashes = np.append(hashes, _EDGE)
        after = np.flatnonzero(row[1:] == row[:-1]) + 1 if len(row) else np.empty(0, np.int64)
        first, last = code[after - 1], code[after]
        pairs, pair = np.unique(first.astype(np.int64) * len(hashes) + last, return_inverse=True)
        pair = pair.astype(np.int32)
        u, v = np.divmod(pairs, len(hashes))
        told = np.concatenate((_mixed(hashes), _mixed(hashes[u] * _ODD + (hashes[v] ^ (hashes[v] >> np.uint64(31))) + np.uint64(1))))
        keys, place = np.unique(told, return_inverse=True)
        place = place.astype(np.int32)
        del pairs, u, v, told
        return cls(row[after], keys, place[len(hashes) :][pair], place[: len(hashes)][last], place[: len(hashes)][first])

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """How often each key occurs, by the weights of the texts."""
        w = weight[self.rows]
        n = len(self.keys)
        return (np.bincount(self.pair, weights=w, minlength=n) + np.bincount(self.own, weights=w, minlength=n)).astype(np.int64)

    def losses(self, count: np.ndarray, total: float) -> np.ndarray:
        """-log p of each token by a model's counts of the keys and of all tokens."""
        count = count.astype(np.float64)
        p = (count[self.own] + SEEN) / (total + SEEN * VOCABULARY)
        return -np.log((count[self.pair] + WEIGHT * p) / (count[self.before] + WEIGHT))


def _packed(x: np.ndarray) -> bytes:
    """The bytes of the numbers, those of the same rank together: the high ones of ascending or small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _texts(table: pa.Table) -> pa.Array:
    return table.column("text").combine_chunks().cast("large_string")


def _ask(parts: int):
    """What a chunk asks each part: its keys there, and how often the chunk has them in the target and in all texts."""

    def run(docs: pa.Table, target: pa.Table) -> pa.Table:
        names = ("part", "chunk", "keys", "target", "every")
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        chunk = Chunk.of(_texts(docs))
        good = pc.is_in(docs.column("id"), target.column("id").combine_chunks()).to_numpy().astype(float)
        mine = [chunk.counts(w) for w in (good, np.ones(docs.num_rows))]
        at = np.append(np.searchsorted(chunk.keys, np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)), len(chunk.keys))
        some = [p for p in range(parts) if at[p + 1] > at[p]]
        columns = [[_packed(x[at[p] : at[p + 1]]) for p in some] for x in (chunk.keys, *mine)]
        return pa.table([pa.array(x, k) for x, k in zip((some, [docs.column("chunk")[0].as_py()] * len(some), *columns), kinds, strict=True)], names=names)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The counts of a part's keys in all chunks, told to each chunk in the order in which it asked."""
    keys = [_unpacked(x) for x in table.column("keys").to_pylist()]
    begins = np.cumsum([0, *map(len, keys)])
    inverse = np.unique(np.concatenate(keys), return_inverse=True)[1]
    out = []
    for name in ("target", "every"):
        count = np.bincount(inverse, weights=np.concatenate([_unpacked(x) for x in table.column(name).to_pylist()]).astype(np.float64))[inverse]
        out.append([_packed(count[a:b].astype(np.uint64)) for a, b in zip(begins[:-1], begins[1:], strict=True)])
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "target": pa.array(out[0], pa.binary()), "every": pa.array(out[1], pa.binary())})


def _tell(totals: tuple[float, float], keys: int):
    """The mean losses of a chunk's texts, by the counts that its parts have told."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        kept = {f"key{i}": docs.column(f"key{i}") for i in range(keys)}
        n, mean = np.zeros(docs.num_rows, np.int64), np.zeros((2, docs.num_rows))
        if docs.num_rows:
            chunk = Chunk.of(_texts(docs))
            order = np.argsort(np.asarray(told.column("part")))
            n = np.bincount(chunk.rows, minlength=docs.num_rows)
            for k, name in enumerate(("target", "every")):
                blobs = told.column(name).to_pylist()
                count = np.concatenate([_unpacked(blobs[i]) for i in order])
                mean[k] = np.bincount(chunk.rows, weights=chunk.losses(count, totals[k]), minlength=docs.num_rows) / n
        return pa.table({**kept, "n_tokens": pa.array(n - 1, pa.int64()), "ce_target": mean[0], "ce_background": mean[1], "score": mean[0] - mean[1]})

    return run


def score(docs: DataFrame, target: DataFrame, keys: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``keys`` of each row of ``docs`` (doc_id, text) with n_tokens, the mean losses ce_target and ce_background, and their difference ``score``.

    The background are all rows, the target those whose doc_id is in ``target`` (doc_id). Every word and every bigram of
    all texts counts, however rare: p(v | u) = (c(u v) + WEIGHT p(v)) / (c(u) + WEIGHT), p(v) = (c(v) + SEEN) / (N + SEEN
    VOCABULARY), over one vocabulary for both. The lower the score, the more a text is like the target.

    Texts are dealt to chunks. A chunk asks for each of its distinct words and bigrams once; the counts are held in parts,
    by hashes (64 bits), and each part answers with the sums over all chunks. So no model has to fit in one place, and a
    frequent gram comes once a chunk. Chunks and parts grow in number with the corpus.

    Each word and the text's end has a loss, so a null or empty text has that of the end alone. Repeated rows give
    repeated results, and count each time; rows with a null id are background only; an empty table gives no rows. A key
    that has the name of a result gives way to it; other columns are ignored.
    """
    keys = [x for x in keys if x.lower() not in RESULTS]
    good = target.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("id")).where("id IS NOT NULL").distinct()
    # Words as ``words`` finds them, and one end for each text.
    sized = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[\p{L}\p{M}\p{N}]+")), F.lit(0)).alias("n"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("b"))
    tokens = lambda x: float(x or 0)
    known = sized.join(good.withColumn("good", F.lit(1)).hint("merge"), "id", "left")
    every = known.agg(F.sum(F.col("n") + 1).alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n") + 1)).alias("mine"), F.sum(F.col("b") + 64).alias("b")).first()
    base = max(1, -(-int(every["b"] or 0) // (chunk_bytes * SPREAD)))
    parts = base * SPREAD

    chunk = lambda x: F.pmod(F.xxhash64(x), F.lit(base)) * SPREAD
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    dealt = docs.select(*(F.col(f"`{x}`").alias(f"key{i}") for i, x in enumerate(keys)), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    # Rows without an id may be many: their texts deal them out.
    dealt = dealt.withColumn("chunk", (F.when(F.col("id").isNull(), chunk("text")).otherwise(chunk("id")) + salt).cast("int"))
    known = good.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda k: (chunk("id") + k).cast("int"))).alias("chunk"))
    asked = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_ask(parts), "part int, chunk int, keys binary, target binary, every binary")
    told = asked.groupBy("part").applyInArrow(_answer, "chunk int, part int, target binary, every binary")
    kinds = [*(f"key{i} {dealt.schema[i].dataType.simpleString()}" for i in range(len(keys))), *(f"{x} {kind}" for x, kind in RESULTS.items())]
    found = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_tell((tokens(every["mine"]), tokens(every["n"])), len(keys)), ", ".join(kinds))
    return found.select(*(F.col(f"key{i}").alias(x) for i, x in enumerate(keys)), *RESULTS)
