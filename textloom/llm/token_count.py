"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both surely agree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import blocks, cut, fresh, in_arrow
from textloom.session import Workspace

#: Texts of more bytes than HUGE are encoded in chunks of CHUNK characters that reach OVERLAP characters into the next one.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 512
#: An overlap that holds no common boundary is made so many times as wide, and chunks with it, if need be.
WIDER = 4
#: Characters after a boundary that a byte-level pattern can look at before it decides on it: a contraction has three.
LOOKS = 4

_CHUNK = "key string, chunk bigint, last boolean, start bigint, text string"
_SEAM = "key string, seam bigint, side int, places array<bigint>, before array<bigint>, tokens bigint"


class Counter:
    """Tokens of texts by a file of ``tokenizers`` (its text) or of ``sentencepiece`` (its bytes), as the library counts them."""

    def __init__(self, told: str | bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if isinstance(told, bytes):
            import sentencepiece

            self.pieces, self.tokenizer = sentencepiece.SentencePieceProcessor(model_proto=told), None
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(told)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        if self.tokenizer is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def margin(self) -> int | None:
        """How far what is after a boundary can change it; None where boundaries can't be proven.

        They can where a text is first cut by added tokens and then, from left to right, by the byte-level pattern, which
        looks back at nothing: from a common boundary on two chunks go on alike. An added token that takes in the white
        space beside it, or a normalizer, would look back.
        """
        if self.tokenizer is None:
            return None
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None and self.tokenizer.pre_tokenizer.use_regex and not self.tokenizer.pre_tokenizer.add_prefix_space
        if not plain or any(x.lstrip or x.rstrip or x.single_word for x in added):
            return None
        return max([LOOKS, *(len(x.content) for x in added)])

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pieces of the pattern (and added tokens) begin in a text, how many tokens stand before each, and all tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if x is None else x for x in found.word_ids], dtype=np.int64)
        begins = np.flatnonzero(np.diff(words, prepend=-2) != 0)
        if not len(words):
            return np.empty(0, np.int64), begins, 0
        ends = np.array([x[1] for x in found.offsets], dtype=np.int64)
        return np.concatenate(([0], ends[begins[1:] - 1])), begins, len(words)


def loaded(path: str) -> str | bytes:
    """A tokenizer's file: text for .json, bytes for .model."""
    with open(path, "rb") as file:
        data = file.read()
    return data if path.endswith(".model") else data.decode("utf-8")


def _whole(sent: Broadcast) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for block in blocks(batches):
            found = counter.counts([x or "" for x in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(block.column(i) for i in range(block.num_columns - 1)), pa.array(found, pa.int64())], names=[*block.schema.names[:-1], "tokens"])

    return run


def _chunked(chunk: int, overlap: int) -> Callable:
    """A row for each chunk of a text: the last one, too, holds more than the overlap that the one before reaches into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for key, text in zip(block.column("key").to_pylist(), block.column("text"), strict=True):
                text = text.as_py()
                n = max(1, (len(text) - overlap) // chunk)
                for i in range(0, n, 32):
                    own = range(i, min(n, i + 32))
                    parts = [text[k * chunk : len(text) if k == n - 1 else (k + 1) * chunk + overlap] for k in own]
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(own), "chunk": own, "last": [k == n - 1 for k in own], "start": [k * chunk for k in own], "text": parts})

    return run


def _encoded(sent: Broadcast, chunk: int, overlap: int) -> Callable:
    """For each chunk and each seam that it touches: its boundaries within the overlap, and the tokens before them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        margin = counter.margin()
        for block in blocks(batches):
            out: list[tuple] = []
            for key, k, last, start, text in zip(*(block.column(x).to_pylist() for x in ("key", "chunk", "last", "start", "text")), strict=True):
                places, before, tokens = counter.boundaries(text)
                if k:
                    head = places < overlap
                    out.append((key, k - 1, 1, places[head] + start, before[head], 0))
                # What may still change by what follows the chunk is no boundary.
                tail = (places >= chunk) & (places + margin <= len(text)) & (not last)
                out.append((key, k, 0, places[tail] + start, before[tail], tokens if last else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()), strict=True)], names=[x.split()[0] for x in _SEAM.split(", ")])

    return run


def spliced(texts: DataFrame, sent: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """(key, tokens) of each text, encoded in chunks; tokens is null where a seam has no boundary that both sides share.

    A text's tokens are those of each chunk between its two splices: summed up over the seams, the tokens before the splice
    in the chunk that ends there less those before it in the chunk that begins there, and all tokens of the last chunk.
    """
    chunks = texts.transform(in_arrow, _chunked(chunk, overlap), _CHUNK).repartition(F.col("key"), F.col("chunk"))
    seams = chunks.transform(in_arrow, _encoded(sent, chunk, overlap), _SEAM)
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("places", "before", "tokens")))
    met = seams.groupBy("key", "seam").agg(side(0).alias("a"), side(1).alias("b"))
    common = F.get(F.array_intersect("a.places", "b.places"), F.lit(0))
    at = lambda x: F.get(F.col(f"{x}.before"), (F.array_position(F.col(f"{x}.places"), F.col("p")) - 1).cast("int"))
    part = F.when(F.col("a.tokens").isNotNull(), F.col("a.tokens")).otherwise(at("a") - at("b"))
    each = met.withColumn("p", common).select("key", part.alias("n"))
    return each.groupBy("key").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, keys: list[str], limit: int = 1024, text: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keys`` of each row, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of its whole text.

    Tokens are those that the library of the file gives for the text as a whole, without begin or end; strings of special
    tokens within it count as the file says. A null text is empty; repeated rows are counted each; keys that have the name of a result
    give way to it, others are kept whatever their names; an empty table gives no row.

    Texts of more than ``huge`` bytes are cut in chunks of ``chunk`` characters that overlap by ``overlap``; chunks are dealt
    out to all tasks, encoded, and spliced at the first boundary in the overlap that both sides share and that nothing
    beyond the chunk's end can change. By induction the tokens after it are those of the whole text. Where a text has a
    seam without one (a run of letters longer than the overlap), overlap and, where they are less than twice that, chunks grow by four
    times for this text, in the end to the whole text. Equal texts are one. Vocabularies whose boundaries can't be proven (``Counter.margin``) take whole texts only.
    """
    spark: SparkSession = docs.sparkSession
    told = loaded(tokenizer)
    sent = spark.sparkContext.broadcast(told)
    keys = [x for x in keys if x.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    names = fresh(docs.select(*(F.col(f"`{x}`") for x in keys)), *(f"k{i}" for i in range(len(keys))))
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(keys, names, strict=True)), F.octet_length(content).cast("bigint").alias("bytes"), content.alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    shown = lambda df: df.select(*(F.col(f"`{y}`").alias(x) for x, y in zip(keys, names, strict=True)), F.col("bytes").alias("n_bytes"), F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))

    if Counter(told).margin() is None:
        return shown(rows.transform(in_arrow, _whole(sent), f"{kinds}, tokens bigint"))
    if overlap < 1 or chunk < 2 * overlap or huge < 4:
        raise ValueError("chunks have to be twice as long as their overlap at least")
    large = rows.where(F.col("bytes") > huge).withColumn("key", F.sha2("text", 256))
    texts, found = large.select("key", "text"), None
    with Workspace(spark) as tables:
        while True:
            counted = tables.keep(spliced(texts, sent, chunk, overlap))
            done = counted.where("tokens IS NOT NULL")
            found = done if found is None else found.unionAll(done)
            open_ = counted.where("tokens IS NULL").select("key")
            if open_.isEmpty():
                break
            overlap *= WIDER
            chunk = max(chunk, 2 * overlap)
            texts = large.select("key", "text").join(open_, "key", "left_semi")
        totals = cut(found)
    small = rows.where(F.col("bytes") <= huge).transform(in_arrow, _whole(sent), f"{kinds}, tokens bigint")
    joined = large.drop("text").join(totals, "key").select(*names, "bytes", "tokens")
    return shown(small.unionAll(joined))
