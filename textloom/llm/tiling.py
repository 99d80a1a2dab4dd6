"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, bounds, coded, cut, in_arrow, tidied, words

#: Shortest tile, in words; also the length of the seeds that a text and an item have to share. An item of fewer words
#: can't be told from common speech and matches nothing (``short_items`` lists them).
LEAST_TILE = 5
#: Share of an item's words that tiles have to cover.
COVERAGE = 0.6
#: lg of the bits by which windows without a seed are kept from the join: 8 MB, whatever the benchmark's size.
LG_BITS = 26
#: A seed's rows, and an item's, are dealt out to this many tasks: one passage may stand in a third of all documents.
SALTS = 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_OUT = {"doc_id": "bigint", "item_id": "bigint", "coverage": "double", "covered_words": "int", "item_words": "int", "tiles": "int"}


class Running:
    """Karp-Rabin values, modulo 2**64, of the windows of a sequence of codes, all from one set of prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power = np.full(n + 1, _BASE, dtype=np.uint64)
        back = np.full(n + 1, _INVERSE, dtype=np.uint64)
        power[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64)))

    def windows(self, length: int) -> np.ndarray:
        """The values of all windows of ``length`` codes (none where the codes are fewer)."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]


def running_hash(codes: np.ndarray, length: int) -> np.ndarray:
    return Running(codes).windows(length)


def tile(text: np.ndarray, item: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length) of non-overlapping matches, longest first.

    Codes below 0 match nothing. Each round looks, by halving, for the longest length at which unmarked windows of both
    have equal hashes (a match of n codes holds matches of all shorter lengths), and marks its matches; windows are
    compared code by code before, so equal hashes of unequal windows do no harm. Ties go to the first in the item, then
    in the text. A window of the text is passed by once it is marked, so the time follows the lengths, not their pairs.
    """
    free_item, free_text = item >= 0, text >= 0
    of_item, of_text = Running(item), Running(text)
    tiles: list[tuple[int, int, int]] = []

    def unmarked(free: np.ndarray, length: int) -> np.ndarray:
        marked = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(marked[length:] == marked[:-length]) if len(free) >= length else np.empty(0, np.int64)

    def common(length: int) -> bool:
        a, b = unmarked(free_item, length), unmarked(free_text, length)
        return bool(len(a) and len(b) and np.isin(of_item.windows(length)[a], of_text.windows(length)[b]).any())

    most = min(len(item), len(text))
    while most >= least and common(least):
        fit, out = least, most + 1
        while out - fit > 1:
            mid = (fit + out) // 2
            fit, out = (mid, out) if common(mid) else (fit, mid)
        hash_item, hash_text = of_item.windows(fit), of_text.windows(fit)
        at = unmarked(free_text, fit)
        at = at[np.argsort(hash_text[at], kind="stable")]
        keys = hash_text[at]
        next_: dict[int, int] = {}
        for i in unmarked(free_item, fit).tolist():
            if not free_item[i : i + fit].all():
                continue
            h = hash_item[i]
            k = next_.get(int(h), int(np.searchsorted(keys, h)))
            while k < len(at) and keys[k] == h and not free_text[at[k] : at[k] + fit].all():
                k += 1
            next_[int(h)] = k
            while k < len(at) and keys[k] == h:
                j = int(at[k])
                if free_text[j : j + fit].all() and np.array_equal(item[i : i + fit], text[j : j + fit]):
                    free_item[i : i + fit] = free_text[j : j + fit] = False
                    tiles.append((i, j, fit))
                    break
                k += 1
        most = fit - 1
    return tiles


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the rows."""
    found, rows = words(texts)
    uniq, index = coded(found)
    return (np.fromiter((xxhash.xxh3_64_intdigest(x) for x in uniq), dtype=np.uint64, count=len(uniq))[index] if uniq else np.empty(0, np.uint64)), rows


def _seeds(least: int, bits: np.ndarray | None = None):
    """For each text with a seed (whose bit is set in ``bits``, if they are given) its words, seeds and how often each occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        set_ = None if bits is None else bits.value
        for block in blocks(batches):
            hashes, rows = _word_hashes(block.column("text"))
            at = bounds(rows, block.num_rows)
            seed = running_hash(hashes, least)
            whole = np.flatnonzero(rows[least - 1 :] == rows[: len(seed)]) if len(seed) else np.empty(0, np.int64)
            if set_ is not None and len(whole):
                bit = seed[whole] & np.uint64((1 << LG_BITS) - 1)
                whole = whole[(set_[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
            own = rows[whole]
            some = np.unique(own)
            begins = np.searchsorted(own, some)
            lists, counts = [], []
            for a, b in zip(begins, np.append(begins[1:], len(own))[: len(begins)], strict=True):
                value, n = np.unique(seed[whole[a:b]].view(np.int64), return_counts=True)
                lists.append(value)
                counts.append(n)
            keep = pa.array(some)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + some), block.column("id").take(keep), block.column("text").take(keep), pa.array(np.diff(at)[some]), pa.array(lists, kind), pa.array(counts, kind)],
                names=["row", "id", "text", "words", "seeds", "times"],
            )
            number += block.num_rows

    return run


_SEEDED = "row bigint, id bigint, text string, words bigint, seeds array<bigint>, times array<bigint>"
_TARGET = "row bigint, id bigint, text string, words bigint, windows array<bigint>"


def _targets(least: int):
    """For each item of enough words its seeds, in the order of their places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for block in blocks(batches):
            hashes, rows = _word_hashes(block.column("text"))
            at = bounds(rows, block.num_rows)
            some = np.flatnonzero(np.diff(at) >= least)
            lists = pa.array([running_hash(hashes[at[i] : at[i + 1]], least).view(np.int64) for i in some], pa.list_(pa.int64()))
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays([pa.array(number + some), block.column("id").take(keep), block.column("text").take(keep), pa.array(np.diff(at)[some]), lists], names=[x.split()[0] for x in _TARGET.split(", ")])
            number += block.num_rows

    return run


def telling(windows: np.ndarray, often: np.ndarray, least: int, needed: float) -> np.ndarray:
    """The seeds of an item of which a text has to hold one, if tiles are to cover ``needed`` of its words.

    ``often`` says how many texts hold the seed at each place. Seeds that most texts hold are left out, one after the other,
    as long as all that are left out cover too few words together: a text that holds no other can't reach the threshold.
    """
    seeds, first, which = np.unique(windows, return_index=True, return_inverse=True)
    places = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[places], np.arange(len(seeds) + 1))
    covered, total = np.zeros(len(windows) + least - 1, dtype=bool), 0
    order = np.lexsort((seeds, -often[first]))
    for k, j in enumerate(order):
        for i in places[begins[j] : begins[j + 1]]:
            total += least - int(covered[i : i + least].sum())
            covered[i : i + least] = True
        if total >= needed:
            return seeds[order[k:]]
    return seeds[:0]


def _telling(least: int, coverage: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("item", "words", "windows", "often")]
            found = [(item, x) for item, words_, windows, often in zip(*columns, strict=True) for x in telling(np.array(windows, dtype=np.int64), np.array(often, dtype=np.int64), least, coverage * words_).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["item", "seed"])

    return run


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The set bits as words of 64; at most 2**LG_BITS / 64 rows come to the driver."""
    bit = seeds.select(F.col("seed").bitwiseAND(F.lit((1 << LG_BITS) - 1)).alias("bit"))
    rows = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toPandas()
    out = np.zeros(1 << (LG_BITS - 6), dtype=np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64).view(np.uint64)
    return out


def _tiled(least: int, coverage: float):
    """The pairs of a text and an item whose tiles cover enough of the item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = []
            texts, text_rows = words(block.column("text"))
            items, item_rows = words(block.column("item"))
            code = pa.chunked_array([texts.cast("large_string"), items.cast("large_string")]).combine_chunks().dictionary_encode().indices
            code = np.asarray(code).astype(np.int64)
            text, item = code[: len(texts)], code[len(texts) :]
            a, b = bounds(text_rows, block.num_rows), bounds(item_rows, block.num_rows)
            for k, (doc, target) in enumerate(zip(block.column("id").to_pylist(), block.column("item_id").to_pylist(), strict=True)):
                mine, own = text[a[k] : a[k + 1]], item[b[k] : b[k + 1]]
                tiles = tile(_windows(np.where(np.isin(mine, own), mine, -1), least), own, least)
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * len(own):
                    found.append((doc, target, covered / len(own), covered, len(own), len(tiles)))
            columns = list(zip(*found, strict=True)) or [()] * len(_OUT)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=list(_OUT))

    return run


def _windows(codes: np.ndarray, least: int) -> np.ndarray:
    """``codes`` without the runs of fewer than ``least`` known codes, which can't hold a tile; each gap is one -1."""
    known = np.concatenate(([0], (codes >= 0).astype(np.int8), [0]))
    step = np.diff(known)
    parts = [np.append(codes[a:b], -1) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True) if b - a >= least]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def short_items(benchmark: DataFrame, least: int = LEAST_TILE) -> DataFrame:
    """The items (item_id, text) of fewer than ``least`` words, null and empty ones too: nothing is matched with them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keep = pa.array(np.diff(bounds(words(block.column("text"))[1], block.num_rows)) < least)
            yield pa.RecordBatch.from_arrays([block.column(x).filter(keep) for x in ("item_id", "text")], names=["item_id", "text"])

    return in_arrow(benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")), run, "item_id bigint, text string")


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text) where tiles cover the item's words.

    Seeds are windows of ``least`` words. Those of the documents that may be an item's (by a bitmap of bounded size) are
    counted, and joined with the ones of each item that tell it from others (``telling``): what most documents hold, like
    a common prompt, makes no pairs unless it covers enough of the item by itself. Of the pairs found those are tiled whose shared seeds
    cover enough of the item's words. Words of a tile all stand in shared seeds, so no other pair can reach the threshold.

    Items and documents that are null, empty or of fewer than ``least`` words match nothing. Repeated documents give
    repeated rows, repeated items a row each; a null id stays null; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    targets = benchmark.select(F.col("item_id").cast("bigint").alias("id"), F.col("text").cast("string"))
    targets = cut(targets.transform(in_arrow, _targets(least), _TARGET))
    places = targets.select(F.col("row").alias("item"), "words", F.posexplode("windows").alias("place", "seed"))
    bits = spark.sparkContext.broadcast(_bitmap(places))
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"))
    seeded = cut(source.transform(in_arrow, tidied(_seeds(least, bits)), _SEEDED))

    salt = lambda x: F.pmod(F.xxhash64(x), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    here = seeded.select("row", salt("row"), F.explode("seeds").alias("seed"))
    counts = here.groupBy("seed").count()
    dated = places.join(counts, "seed", "left").groupBy("item", "words").agg(F.array_sort(F.collect_list(F.struct("place", "seed", F.coalesce("count", F.lit(0)).alias("often")))).alias("x"))
    told = dated.select("item", "words", F.col("x.seed").alias("windows"), F.col("x.often").alias("often")).transform(in_arrow, _telling(least, coverage), "item bigint, seed bigint")
    found = here.join(told.select("*", salts), ["seed", "salt"]).select("row", "item").distinct()
    # What the shared seeds cover, place by place.
    held = found.join(seeded.select("row", "seeds"), "row").join(targets.select(F.col("row").alias("item"), "words", "windows"), "item")
    common = F.array_intersect("windows", "seeds")
    at = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.array_contains("common", F.get("windows", i)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + least - 1)))))
    pairs = held.withColumn("common", common).where(covered >= F.lit(coverage) * F.col("words")).select("row", "item", salt("row"))
    texts = seeded.select("row", "id", "text").join(pairs, "row")
    wanted = targets.select(F.col("row").alias("item"), F.col("id").alias("item_id"), F.col("text").alias("target"), salts)
    both = texts.join(wanted, ["item", "salt"]).select("id", "text", "item_id", F.col("target").alias("item"))
    return both.transform(in_arrow, tidied(_tiled(least, coverage)), ", ".join(f"{x} {kind}" for x, kind in _OUT.items()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; documents with a null doc_id are kept.

    All columns are handed on; empty tables and items are as in ``find_contamination``.
    """
    found = find_contamination(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*(F.col(f"`{x}`") for x in docs.columns))
