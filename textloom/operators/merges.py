"""Byte-pair merges learnt by Spark: pieces cut where no merge can go, merges guessed on a bounded sample and verified over all."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions.text import lines
from textloom.operators.sequences import SPECIALS
from textloom.session import Workspace

#: Up to WHOLE ids in all are taken as they are to guess the next merges, and then every guess is right; of more, a sample of
#: about so many, of SAMPLE pieces at most and LONGEST ids of each. True counts of KNOWN pairs guide the guess.
SAMPLE, LONGEST, KNOWN, WHOLE = 1 << 21, 4_096, 8_192, 1 << 23
#: Pieces, and characters of each, that tell how rare the last merge may be; the share of its likely count that is taken for it.
FIRST, FIRST_LONGEST, SURE = 4_096, 1_024, 0.8
#: Merges that are guessed at once, at most, and ids that a task holds at once (one piece stays whole).
AHEAD, BLOCK_IDS = 256, 1 << 20

#: Between two pieces; no pair goes over it.
_END = -1


def merged(ids: np.ndarray, weight: np.ndarray, a: int, b: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` with every pair a, b (from left to right) as c, their weights, the pairs that changed and by how much.

    A pair is ``left << 32 | right``. Pairs that only moved don't count as changed.
    """
    at = np.flatnonzero(ids[:-1] == a)
    at = at[ids[at + 1] == b]
    if a == b and len(at):  # in a run every second one
        first = np.concatenate(([True], np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
    if not len(at):
        return ids, weight, np.empty(0, np.int64), np.empty(0, np.int64)
    lost = np.unique(np.concatenate((at - 1, at, at + 1)))
    kept = np.ones(len(ids), dtype=bool)
    kept[at + 1] = False
    after, new_weight = ids[kept], weight[kept]
    place = at - np.arange(len(at))  # each merge before one moves it by a place
    after[place] = c
    gained = np.unique(np.concatenate((place - 1, place)))
    pairs, change = zip(_pairs(ids, weight, lost, -1), _pairs(after, new_weight, gained, 1), strict=True)
    return after, new_weight, *_added(np.concatenate(pairs), np.concatenate(change))


def _pairs(ids: np.ndarray, weight: np.ndarray, at: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at some places, with their signed weights."""
    at = at[(at >= 0) & (at < len(ids) - 1)]
    at = at[(ids[at] != _END) & (ids[at + 1] != _END)]
    return (ids[at].astype(np.int64) << 32) | ids[at + 1], sign * weight[at]


def _added(pairs: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their sums, those of 0 left out. Sums are integers."""
    order = np.argsort(pairs, kind="stable")
    pairs, change = pairs[order], change[order]
    begins = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.empty(0, np.int64)
    sums = np.add.reduceat(change, begins) if len(begins) else change
    return pairs[begins][sums != 0], sums[sums != 0]


def _flat(lists: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces with ends between them, and how often the piece of each stands in the corpus."""
    size = np.diff(np.asarray(lists.offsets))
    ids = np.insert(np.asarray(lists.flatten()).astype(np.int32), np.cumsum(size), _END)
    return ids, np.repeat(n.astype(np.int64), size + 1)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK_IDS ids, or bytes of text."""
    for batch in batches:
        if batch.num_rows:
            size = pc.binary_length(batch.column("piece")) if "piece" in batch.schema.names else pc.list_value_length(batch.column("ids"))
            part = np.cumsum(np.asarray(size)) // BLOCK_IDS
            ends = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                yield batch.slice(a, b - a)


def _changes(merges: list[tuple[int, int, int]]) -> Callable:
    """(step, pair, change) of the pairs that each of the merges in turn changes; step 0 without merges: all pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, weight = _flat(block.column("ids"), np.asarray(block.column("n")))
            if not merges:
                found = [(0, *_added(*_pairs(ids, weight, np.arange(len(ids)), 1)))]
            else:
                found = []
                for step, (a, b, c) in enumerate(merges, 1):
                    ids, weight, pairs, change = merged(ids, weight, a, b, c)
                    found.append((step, pairs, change))
            steps = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))], names=["step", "pair", "change"])

    return run


def _applied(merges: list[tuple[int, int, int]]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, n = _flat(block.column("ids"), np.asarray(block.column("n")))
            weight = np.zeros(len(ids), dtype=np.int64)
            for a, b, c in merges:
                ids, weight, *_ = merged(ids, weight, a, b, c)
            ends = np.flatnonzero(ids == _END)
            offsets = np.concatenate(([0], ends - np.arange(len(ends))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[ids != _END], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, block.column("n")], names=["ids", "n"])

    return run


def _points(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all pieces with ends between them, and how many the piece has that each stands in, its end too."""
    size = np.asarray(pc.utf8_length(pieces)).astype(np.int64)
    points = np.frombuffer(b"".join(x.encode("utf-32-le") for x in pieces.to_pylist()), dtype=np.uint32).astype(np.int64)
    return np.insert(points, np.cumsum(size), _END), size + 1


def _characters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the pairs of code points in all pieces; a character c that stands in one is the pair -1 - c, however often."""
    for block in _blocks(batches):
        points, size = _points(block.column("piece"))
        weight = np.repeat(np.asarray(block.column("n")).astype(np.int64), size)
        pairs, n = _added(*_pairs(points, weight, np.arange(len(points)), 1))
        single = -1 - np.unique(points[points != _END])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((pairs, single))), pa.array(np.concatenate((n, np.ones(len(single), np.int64))))], names=["pair", "n"])


def _fragments(kept: list[int] | None) -> Callable:
    """(piece, n): the pieces cut between the characters of each pair that isn't kept (None: nowhere), alike ones of a block together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if kept is None else np.array(sorted(kept), dtype=np.int64)
        for block in _blocks(batches):
            pieces, n = block.column("piece"), np.asarray(block.column("n")).astype(np.int64)
            if some is not None:
                points, size = _points(pieces)
                pair = (points[:-1] << 32) | points[1:]
                place = np.minimum(np.searchsorted(some, pair), max(0, len(some) - 1))
                held = (some[place] == pair if len(some) else np.zeros(len(pair), bool)) & (points[:-1] != _END)
                begins = np.flatnonzero(np.concatenate(([True], ~held)))
                ends = np.append(begins[1:], len(points))
                long = ends - begins > 1  # an end, or a character alone, has no pair
                begins, ends = begins[long], ends[long]
                width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
                width[points == _END] = 0
                at = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
                data = b"".join(x.encode() for x in pieces.to_pylist())
                n = np.repeat(n, size)[begins]
                pieces = pa.array([data[a:b] for a, b in zip(at[begins].tolist(), at[ends].tolist(), strict=True)], pa.binary()).cast("string")
            found = pieces.dictionary_encode()
            sums = np.bincount(np.asarray(found.indices), weights=n, minlength=len(found.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(sums)], names=["piece", "n"])

    return run


def _coded(letters: list[int], first: int) -> Callable:
    """(ids, n) of pieces: the place of each character among ``letters`` (rising), plus ``first``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.array(letters, dtype=np.int64)
        for block in _blocks(batches):
            points, size = _points(block.column("piece"))
            ids = (np.searchsorted(every, points[points != _END]) + first).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(size - 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), block.column("n")], names=["ids", "n"])

    return run


class Vocabulary:
    """Tokens by id; a merge whose text is a token already gives that token's id."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.ids = list(tokens), {x: i for i, x in enumerate(tokens)}

    def of(self, a: int, b: int) -> int:
        text = self.tokens[a] + self.tokens[b]
        if text not in self.ids:
            self.ids[text] = len(self.tokens)
            self.tokens.append(text)
        return self.ids[text]

    def copy(self) -> Vocabulary:
        return Vocabulary(self.tokens)


def guessed(ids: np.ndarray, weight: np.ndarray, true: dict[int, int], words: Vocabulary, size: int, most: int, likely: list[float] | None = None) -> list[tuple[int, int, int]]:
    """Up to ``most`` merges as the greedy rule makes them on a sample, whose counts are scaled to those that are known.

    The first one is the best of the known pairs. Pairs that a merge makes are scaled as the merged pair was. ``likely`` gets the scaled
    count of each merge.
    """
    counts = dict(zip(*(x.tolist() for x in _added(*_pairs(ids, weight, np.arange(len(ids)), 1))), strict=True))
    scale = {p: true[p] / c for p, c in counts.items() if p in true}
    usual = sum(true.values()) / max(1, sum(counts.get(p, 0) for p in true))
    told = lambda p: counts[p] * scale.get(p, usual)
    heap = [(-told(p), p) for p in counts]
    heapq.heapify(heap)
    out, best = [], min(true, key=lambda p: (-true[p], p), default=None)
    while best is not None and len(out) < most and len(words.tokens) < size:
        a, b = best >> 32, best & 0xFFFFFFFF
        c = words.of(a, b)
        out.append((a, b, c))
        if likely is not None:
            likely.append(true[best] if len(out) == 1 else told(best))
        ids, weight, pairs, change = merged(ids, weight, a, b, c)
        own = scale.get(best, usual)
        for p, x in zip(pairs.tolist(), change.tolist(), strict=True):
            if p not in counts:
                counts[p], scale[p] = 0, own
            counts[p] += x
            if counts[p] > 0:
                heapq.heappush(heap, (-told(p), p))
        counts[best], best = 0, None
        while heap and best is None:
            value, p = heapq.heappop(heap)
            if counts[p] > 0 and -value == told(p):
                best = p
    return out


def verified(counts: DataFrame, changes: DataFrame, merges: list[tuple[int, int, int]]) -> int:
    """How many of the merges, from the first on, are those of the greedy rule: the largest count, ties to the smaller pair.

    ``counts`` are those before the first merge, ``changes`` what each makes of them. A pair's count holds from the step
    that made it up to the next that changes it; it is compared with that of each merge chosen in that stretch.
    """
    pair = [(a << 32) | b for a, b, _ in merges]
    history = counts.select("pair", F.lit(0).alias("step"), F.col("n").alias("change")).unionAll(changes.select("pair", "step", "change"))
    by = W.partitionBy("pair").orderBy("step")
    held = history.select("pair", "step", F.sum("change").over(by).alias("count"), F.coalesce(F.lead("step").over(by), F.lit(len(merges))).alias("until"))
    # Merge i (from 0) is chosen at step i, when i merges have been made.
    own = held.where(F.col("pair").isin(pair))
    bars = [0] * len(merges)
    for x in own.collect():  # some rows for each merge
        for i in range(x["step"], x["until"]):
            if pair[i] == x["pair"]:
                bars[i] = x["count"]
    chosen, bar = (F.array(*(F.lit(v).cast("bigint") for v in values)) for values in (pair, bars))
    beats = lambda i: (F.col("count") > bar[i]) | ((F.col("count") == bar[i]) & (F.col("pair") < chosen[i]))
    near = held.where((F.col("count") >= min(bars)) & (F.col("step") < F.col("until")) & (F.col("count") > 0))
    wrong = near.select(F.array_min(F.filter(F.sequence("step", F.col("until") - 1), beats)).alias("i")).agg(F.min("i")).first()[0]
    empty = next((i for i, x in enumerate(bars) if x < 1), len(merges))
    return min(len(merges) if wrong is None else wrong, empty)


def literal_pieces(piece: Column) -> Column:
    """A line as the literal pattern cuts it: after each ``(\\s)`` that stands in it as it is written here."""
    return F.filter(F.split(piece, r"(?<=\(\\s\))"), lambda x: x != "")


def each_piece(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): the lines (with their ends) of all texts, cut by the literal pattern, a row each; n is 1."""
    split = docs.select(F.explode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line"))
    return split.select(F.explode(literal_pieces(F.col("line"))).alias("piece"), F.lit(1).cast("bigint").alias("n"))


def pieces_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): the distinct pieces of all texts, and how often each occurs."""
    return each_piece(docs, text).groupBy("piece").agg(F.sum("n").alias("n"))


def learn(pieces: DataFrame, size: int, specials: tuple[str, ...] = SPECIALS) -> tuple[list[str], list[tuple[str, str, int]]]:
    """Byte-pair merges of ``pieces`` (piece, n): all tokens by id, and for each merge its two texts and its count.

    The greedy rule: specials and characters (in code-point order) have the first ids; then, until there are ``size`` tokens or no
    pair is left, the adjacent pair with the largest count over all pieces is merged, ties to the smaller pair of ids. A
    pair that overlaps itself counts at each place. Null and empty pieces have no pair; no piece gives specials only. Pieces
    may be repeated.

    Pieces are cut between two characters whose pair occurs fewer than ``rare`` times: a pair of tokens that meet there, whatever
    merges made them, can't occur more often, so while merges occur ``rare`` times or more none goes over a cut, and nothing is
    lost. What is left is short and often alike, and alike ones count as one. A first sample tells a likely ``rare``; once a merge
    is rarer, pieces are cut anew by a lower one, and the merges so far are made in them.

    Pieces stand as ids in a table of the shared folder. In each pass the driver guesses up to AHEAD merges on a sample,
    tasks make them one after the other and tell which pairs each one changes, and the counts so gained decide how many
    of the guesses were right. So the result doesn't hang on the samples, whose quality only decides how
    many passes are needed: one for each AHEAD merges where it holds all (WHOLE ids or fewer). The driver holds merges, tokens and the sample.
    """
    spark = pieces.sparkSession
    with Workspace(spark) as tables:
        rows = pieces.where(F.coalesce(F.col("piece"), F.lit("")) != "").select("piece", F.col("n").cast("bigint").alias("n"))
        summed = lambda df, key="pair": df.groupBy(key).agg(F.sum("n").alias("n")).where("n > 0")
        found = tables.keep(summed(rows.mapInArrow(_characters, "pair bigint, n bigint")))
        letters = sorted(-1 - x["pair"] for x in found.where("pair < 0").collect())
        words = Vocabulary([*specials, *map(chr, letters)])
        first = len(specials)

        def begun(rare: int) -> tuple[DataFrame, DataFrame]:
            """The pieces cut by ``rare`` after all merges so far, and their pairs."""
            kept = None if rare <= 1 else [x["pair"] for x in found.where(F.col("pair") >= 0).where(F.col("n") >= rare).select("pair").collect()]
            cut = summed(rows.mapInArrow(_fragments(kept), "piece string, n bigint"), "piece")
            coded = cut.mapInArrow(_coded(letters, first), "ids array<int>, n bigint")
            state = tables.keep(coded.mapInArrow(_applied(made), "ids array<int>, n bigint") if made else coded)
            return state, tables.keep(summed(state.mapInArrow(_changes([]), "step int, pair bigint, change bigint").select("pair", F.col("change").alias("n"))))

        done: list[tuple[str, str, int]] = []
        made: list[tuple[int, int, int]] = []
        rare = _rare(rows, found, letters, words.copy(), first, size)
        state, counts = begun(rare)
        ahead = AHEAD
        while len(words.tokens) < size:
            true = {x["pair"]: x["n"] for x in counts.orderBy(F.desc("n"), "pair").limit(KNOWN).collect()}
            enough = bool(true)
            if true:
                merges = guessed(*_sampled(state), true, words.copy(), size, ahead)
                changes = tables.keep(state.mapInArrow(_changes(merges), "step int, pair bigint, change bigint").groupBy("step", "pair").agg(F.sum("change").alias("change")).where("change <> 0"))
                right = verified(counts, changes, merges)
                pairs = [(a << 32) | b for a, b, _ in merges[:right]]
                base = {x["pair"]: x["n"] for x in counts.where(F.col("pair").isin(pairs)).collect()}
                had = {(x["pair"], x["step"]): x["change"] for x in changes.where(F.col("pair").isin(pairs) & (F.col("step") <= right)).collect()}
                times = [base.get(p, 0) + sum(had.get((p, k), 0) for k in range(1, i + 1)) for i, p in enumerate(pairs)]
                known = next((i for i, n in enumerate(times) if n < rare), right)
                enough = known == right and right > 0
                merges = merges[:known]
                ahead = min(AHEAD, max(16, 4 * right))  # fewer where most guesses fail
                for (a, b, _), n in zip(merges, times, strict=False):
                    done.append((words.tokens[a], words.tokens[b], n))
                    words.of(a, b)
                made += merges
            if enough:
                newer = tables.keep(state.mapInArrow(_applied(merges), "ids array<int>, n bigint"))
                told = counts.unionAll(changes.where(F.col("step") <= right).select("pair", F.col("change").alias("n")))
                fresh = tables.keep(summed(told))
            elif rare <= 1:
                break
            else:
                rare = rare // 4
                newer, fresh = begun(rare)
            for old in (state, counts, *([changes] if true else [])):
                tables.drop(old)
            state, counts = newer, fresh
    return words.tokens, done


def _sampled(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of all pieces, where they are WHOLE ids at most; or else of those that occur k times or more, and of the
    others a share of n / k, by their hash, each counted k times, for the least power of two k that leaves about so many.
    """
    steps = range(32)
    size, share = F.size("ids"), lambda j: F.least(F.lit(1.0), F.col("n") / F.lit(float(1 << j)))
    left = state.agg(*(F.sum(size * share(j)).alias(f"k{j}") for j in steps)).first()
    j = next((j for j in steps if (left[j] or 0) <= WHOLE), steps[-1])
    if j:
        k = F.lit(1 << j).cast("bigint")
        state = state.where(F.pmod(F.xxhash64("ids"), k) < F.col("n")).limit(SAMPLE).select(F.slice("ids", 1, LONGEST).alias("ids"), F.greatest("n", k).alias("n"))
    flat = [_flat(b.column("ids"), np.asarray(b.column("n"))) for b in state.select("ids", "n").toArrow().combine_chunks().to_batches()]
    ids, weight = zip(*flat, strict=True) if flat else ([np.empty(0, np.int32)], [np.empty(0, np.int64)])
    return np.concatenate(ids), np.concatenate(weight)


def _rare(rows: DataFrame, found: DataFrame, letters: list[int], words: Vocabulary, first: int, size: int) -> int:
    """A count that the last merge will likely reach; 1 if pairs run out before, or nothing is known of it."""
    place = {x: first + i for i, x in enumerate(letters)}
    pairs = found.where(F.col("pair") >= 0).orderBy(F.desc("n"), "pair").limit(KNOWN).collect()
    true = {(place[x["pair"] >> 32] << 32) | place[x["pair"] & 0xFFFFFFFF]: x["n"] for x in pairs}
    some = rows.limit(FIRST).select(F.substring("piece", 1, FIRST_LONGEST).alias("piece"), "n").toArrow().combine_chunks().to_batches()
    coded = [_flat(b.column("ids"), np.asarray(b.column("n"))) for b in _coded(letters, first)(some)]
    if not coded or not true:
        return 1
    likely: list[float] = []
    ids, weight = zip(*coded, strict=True)
    guessed(np.concatenate(ids), np.concatenate(weight), true, words, size, max(0, size - len(words.tokens)), likely)
    return max(1, int(SURE * likely[-1])) if likely and len(words.tokens) >= size else 1


def serialized(tokens: list[str], merges: list[tuple[str, str, int]], specials: tuple[str, ...] = SPECIALS) -> str:
    """The tokenizer as the document that the ``tokenizers`` library reads; its pre-tokenizer's pattern is a literal text."""
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    added = [{"id": i, "content": x, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, x in enumerate(specials)]
    told = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": {"type": "Split", "pattern": {"String": r"(\s)"}, "behavior": "MergedWithPrevious", "invert": False}}
    return json.dumps({**told, "post_processor": None, "decoder": None, "model": {**model, "vocab": {x: i for i, x in enumerate(tokens)}, "merges": [[a, b] for a, b, _ in merges]}}, ensure_ascii=False)
