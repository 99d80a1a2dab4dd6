"""Vector bin packing of token sequences: dot-product placement under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, in_arrow

#: Limits of a sequence: tokens, pieces of documents, and tokens that bear loss. The first PROMPT ids of a document are
#: its prompt and bear none.
CAPACITY, SEGMENTS, LOSS, PROMPT = 2048, 16, 2032, 16
#: Ends of documents that wait for a place in one task; it bounds a task's memory.
WAITING = 4096
#: Gaps below this many tokens are padded, not filled by cutting another document.
LEAST_PIECE = 16
#: Distinct stretches of text whose ids a task remembers, and the bytes of the longest one that it does.
REMEMBERED, SHORT = 500_000, 64
#: Bytes of the joined stretches that the library gets as one text, and how many such texts it gets at once.
JOINED, AT_ONCE = 2048, 64
#: More tokens than any document has.
FAR = 1e15

_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


class Packer:
    """Places pieces in sequences; one instance for each task.

    Items are stretches of documents (ids, and a 0/1 array of those that bear loss). A bin is filled item by item: of
    the waiting items that fit in all three remaining limits, the one with the largest dot product of its share of each
    limit and the bin's remaining share goes in; ties go to the item that came first. What is left when nothing fits is
    filled by cutting the item that fills most of it, if the gap is worth it.
    """

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, waiting: int = WAITING, least: int = LEAST_PIECE):
        self.capacity, self.segments, self.loss = capacity, segments, capacity if loss is None else loss
        if min(self.capacity, self.segments, self.loss) < 1:
            raise ValueError("each limit of a sequence has to be 1 at least")
        self.waiting, self.least = waiting, least
        self.items: list[tuple] = []  # key, ids, loss, its sums, from, to
        self.next = 0

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple]:
        """Take a document; yields the pieces (sequence, offset, key, start, ids, loss) of the bins that are closed."""
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(loss)))
        at, n = 0, len(ids)
        while n - at >= self.capacity and sums[at + self.capacity] - sums[at] <= self.loss:
            yield self.next, 0, key, at, ids[at : at + self.capacity], loss[at : at + self.capacity]
            self.next += 1
            at += self.capacity
        while at < n:
            to = max(at + 1, self._end(sums, at, min(n, at + self.capacity), self.loss))
            self.items.append((key, ids, loss, sums, at, to))
            at = to
        if len(self.items) >= self.waiting:
            yield from self._close(self.waiting // 2)

    def finish(self) -> Iterator[tuple]:
        yield from self._close(0)

    @staticmethod
    def _end(sums: np.ndarray, at: int, to: int, most: int) -> int:
        """How far, up to ``to``, ids from ``at`` on bear loss ``most`` times at most."""
        return at + int(np.searchsorted(sums[at + 1 : to + 1], sums[at] + most, side="right"))

    def _lead(self, item: tuple) -> int:
        """Ids without loss that the item begins with."""
        return self._end(item[3], item[4], item[5], 0) - item[4]

    def _close(self, left: int) -> Iterator[tuple]:
        items = self.items
        # Floats hold these exactly and need no conversion for each piece. An item that is placed never fits again (FAR).
        tokens = np.array([x[5] - x[4] for x in items], dtype=np.float64)
        bears = np.array([x[3][x[5]] - x[3][x[4]] for x in items], dtype=np.float64)
        lead = np.array([self._lead(x) for x in items], dtype=np.float64)
        value, share = np.empty(len(items)), np.empty(len(items))
        waiting = len(items)
        while waiting > left:
            room, segments, loss, offset = self.capacity, self.segments, self.loss, 0
            while True:
                if room < 1 or segments < 1 or not waiting:
                    break
                np.multiply(tokens, room / self.capacity**2, out=value)
                np.multiply(bears, loss / self.loss**2, out=share)
                value += share
                value += segments / self.segments**2
                np.putmask(value, (tokens > room) | (bears > loss), -1.0)
                at = int(np.argmax(value))
                if value[at] >= 0:
                    key, ids, mark, _, start, to = items[at]
                    tokens[at], bears[at] = -FAR, FAR
                    waiting -= 1
                else:
                    if room < self.least:
                        break
                    # About as much as each item would fill of the room; of those alike the longest one is cut.
                    np.minimum(np.minimum(lead + loss, room), tokens, out=value)
                    at = int(np.argmax(value + tokens / (1.0 + 2 * self.capacity)))
                    key, ids, mark, sums, start, end = items[at]
                    to = self._end(sums, start, min(end, start + room), loss)
                    if to - start < self.least or to >= end:
                        break
                    items[at] = (key, ids, mark, sums, to, end)
                    tokens[at], bears[at], lead[at] = end - to, sums[end] - sums[to], self._lead(items[at])
                yield self.next, offset, key, start, ids[start:to], mark[start:to]
                offset += to - start
                room, segments, loss = room - (to - start), segments - 1, loss - int(mark[start:to].sum())
            self.next += 1
        self.items = [x for x, n in zip(items, tokens.tolist(), strict=True) if n > 0]


def stretches(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The texts (none null) cut before each blank or line feed that follows a character that surely isn't white space,
    and the row of each part.

    No token of a byte-level BPE whose pattern keeps white space before other characters goes over such a place, nor
    does a special token without white space in it: the parts have the ids that they have in the whole. What may be
    white space to some pattern (code points below U+0021, U+0080 to U+00BF, U+1000 to U+2FFF, U+3000) isn't cut after.
    """
    data, start = _bytes_of(texts)
    begins = np.zeros(len(data) + 1, dtype=bool)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    begins[at[_after_sure(data, at)]] = True
    begins[start] = True
    cuts = np.flatnonzero(begins[:-1])
    ends = np.append(cuts, len(data)).astype(np.int64) if len(cuts) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(start, cuts, side="right") - 1


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and where each begins in them, and the end."""
    offsets = np.frombuffer(texts.buffers()[1] or bytes(8), dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _after_sure(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` in UTF-8 follow a character that surely isn't white space (see ``stretches``)."""
    before = np.concatenate((np.zeros(4, np.uint8), data))
    one, two, three, four = (before[at + 4 - k] for k in (1, 2, 3, 4))
    high, leads = one >= 0x80, two >= 0xC0
    of_two = leads & (two >= 0xC3)
    of_three = ~leads & (three >= 0xE3) & ~((three == 0xE3) & (two == 0x80) & (one == 0x80))
    of_four = ~leads & (three < 0xC0) & (four >= 0xF0)
    return ((one > 0x20) & (one < 0x7F)) | (high & (of_two | of_three | of_four))


class Encoder:
    """Ids of texts by a ``tokenizers`` file, each distinct stretch of a block once."""

    def __init__(self, told: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(told)
        # The remembered stretches, their ids (all in one array) and how many each has.
        self.known = pa.array([], pa.large_string())
        self.ids, self.size = np.empty(0, np.int32), np.empty(0, np.int64)
        state = self.tokenizer.pre_tokenizer.__class__.__name__, self.tokenizer.normalizer
        added = self.tokenizer.get_added_tokens_decoder()
        special = [x.content for x in added.values()]
        if state != ("ByteLevel", None) or any(c.isspace() for x in special for c in x):
            raise ValueError("only byte-level vocabularies without a normalizer, and special tokens without white space, are supported")
        # How many bytes each id stands for; a vocabulary of the byte level has a character for each.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(1 + max([*vocabulary.values(), *added], default=-1), np.int64)
        self.width[np.fromiter(vocabulary.values(), np.int64, len(vocabulary))] = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        for k, x in added.items():
            self.width[k] = len(x.content.encode())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one after the other, and how many each has."""
        parts, rows = stretches(pc.fill_null(texts.cast("large_string"), ""))
        found = parts.dictionary_encode()
        names, index = found.dictionary, np.asarray(found.indices)
        # The block's stretches are fewer than the remembered ones: Arrow hashes what is searched in.
        hits = np.asarray(pc.fill_null(pc.index_in(self.known, names), -1))
        hit = np.flatnonzero(hits >= 0)
        place = np.full(len(names), -1, dtype=np.int64)
        place[hits[hit]] = hit
        unknown = np.flatnonzero(place < 0)
        fresh = names.take(pa.array(unknown))
        new, size = self._ids(fresh)
        place[unknown] = len(self.size) + np.arange(len(fresh))
        every = np.concatenate((self.ids, new))
        sizes = np.concatenate((self.size, size))
        own, begins = sizes[place][index], (np.cumsum(sizes) - sizes)[place][index]
        ids = every[np.repeat(begins - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        kept = np.flatnonzero(np.asarray(pc.binary_length(fresh)) <= SHORT)[: REMEMBERED - len(self.known)]
        self.known = pa.concat_arrays([self.known, fresh.take(pa.array(kept))])
        mask = np.zeros(len(fresh), bool)
        mask[kept] = True
        self.ids = np.concatenate((self.ids, new[np.repeat(mask, size)]))
        self.size = np.concatenate((self.size, size[mask]))
        return ids, np.bincount(rows, weights=own, minlength=len(texts)).astype(np.int64)

    def _ids(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of stretches, one after the other, and how many each has.

        A call costs more than a stretch, so the library gets them joined wherever ``stretches`` would cut them apart
        again: there they have the ids that they have alone. Ends are found by the bytes that ids stand for; if they
        aren't all met, which other settings of a file might cause, stretches go one by one.
        """
        if not len(parts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        data, start = _bytes_of(parts)
        begins, ends, whole = start[:-1], start[1:], data.tobytes()
        joins = ((data[begins] == 0x20) | (data[begins] == 0x0A)) & _after_sure(data, begins)
        joins &= np.diff(begins // JOINED, prepend=-1) == 0
        ids = self._library(whole, [*begins[~joins].tolist(), len(whole)])
        reach = np.cumsum(self.width[ids])
        if reach[-1:].tolist() == [len(data)]:
            last = np.searchsorted(reach, ends)
            if np.array_equal(reach[last], ends):
                return ids, np.diff(last, prepend=-1)
        each = [self._library(whole, [a, b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _library(self, data: bytes, ends: list[int]) -> np.ndarray:
        """The ids of the texts between ``ends``."""
        out = [np.empty(0, np.int32)]
        for k in range(0, len(ends) - 1, AT_ONCE):
            cut = ends[k : k + AT_ONCE + 1]
            texts = [data[a:b].decode() for a, b in zip(cut, cut[1:], strict=False)]
            out += [np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(out)


def packed_rows(pieces: Iterable[tuple], partition: int, totals: dict) -> Iterator[tuple]:
    for sequence, offset, (key, number), start, ids, loss in pieces:
        yield key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), totals[number], (partition << 33) + sequence, offset, int(loss.sum())


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = LOSS, loss_from: int = PROMPT
) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack them into sequences; one row a piece.

    A document's ids are those of its whole text, then ``end_id``; a null or empty text is ``end_id`` alone. The ids
    before ``loss_from`` (a prompt) bear no loss. A sequence holds ``capacity`` tokens, ``segments`` pieces and
    ``loss_limit`` tokens that bear loss at most (None: as many as tokens). Each task packs what it reads: full sequences
    go out at once, ends wait in a bounded pool, so no shuffle is needed and a lost task is packed again alike. Sequence
    ids hold the partition number in their upper bits. Repeated rows are packed once each; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names.

    ``tokenizer`` is the path of a file of ``tokenizers`` for a byte-level BPE, used as it is loaded (its special tokens
    count in a text); the driver reads it (some MB) and sends it to the tasks.
    """
    with open(tokenizer, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = Encoder(sent.value)
        packer, totals, number = Packer(capacity, segments, loss_limit), {}, 0
        partition = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _PIECE.split(", ")]

        def batch_of(pieces) -> pa.RecordBatch:
            rows = list(packed_rows(pieces, partition, totals))
            waiting = {x[0][1] for x in packer.items}
            for k in [k for k in totals if k not in waiting]:
                del totals[k]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

        for block in blocks(batches):
            pieces = []
            ids, count = encoder.encode(block.column("text"))
            ids = ids.astype(np.int64)
            ends = np.cumsum(count)
            for key, a, b in zip(block.column("doc_id").to_pylist(), (ends - count).tolist(), ends.tolist(), strict=True):
                own = np.append(ids[a:b], end_id)
                totals[number] = len(own)
                pieces += packer.add((key, number), own, (np.arange(len(own)) >= loss_from).astype(np.int64))
                number += 1
            yield batch_of(pieces)
        yield batch_of(list(packer.finish()))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(in_arrow, run, _PIECE)
