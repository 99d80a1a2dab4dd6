"""Vocabularies, encoding, and training sequences: truncate, shift, pad, window, batch."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    """Code points in order; none of an empty or null text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, id): the distinct characters in code-point order, from 0. Unicode bounds their number."""
    found = docs.select(F.explode(F.array_distinct(characters(F.col(text)))).alias("token")).distinct()
    return found.withColumn("id", (F.row_number().over(W.orderBy("token")) - 1).cast("int"))


def encode(docs: DataFrame, vocabulary: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text's characters; a character outside the vocabulary becomes 0.

    The vocabulary (bounded by Unicode) comes to the driver and becomes a constant array by code point: a character
    costs one array access, whatever the vocabulary's size.
    """
    ids = {ord(x["token"]): x["id"] for x in vocabulary.collect()}
    table = F.split(F.lit(",".join(str(ids.get(i, 0)) for i in range(max(ids, default=0) + 1))), ",").cast("array<int>")
    return docs.withColumn(to, F.transform(characters(F.col(text)), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0))))


def decode(docs: DataFrame, vocabulary: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; an unknown id gives nothing."""
    tokens = {x["id"]: x["token"] for x in vocabulary.collect()}
    table = F.from_json(F.lit(json.dumps([tokens.get(i, "") for i in range(max(tokens, default=-1) + 1)])), "array<string>")
    return docs.withColumn(to, F.array_join(F.transform(F.col(ids), lambda i: F.coalesce(F.get(table, i), F.lit(""))), ""))


def truncate(ids: Column, block: int) -> Column:
    return F.slice(ids, 1, block)


def shift(ids: Column) -> tuple[Column, Column]:
    """Inputs and targets of next-token prediction; a sequence of at most one id is both."""
    n = F.size(ids)
    return F.when(n <= 1, ids).otherwise(F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.when(n <= 1, ids).otherwise(F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))))


def pad(ids: Column, length: Column | int, by: int = 0) -> tuple[Column, Column]:
    """Ids filled up to ``length``, and the mask of real ids; longer ones are cut."""
    length = F.lit(length) if isinstance(length, int) else length
    kept = F.slice(ids, F.lit(1), length)
    rest = F.greatest(length - F.size(kept), F.lit(0))
    return F.concat(kept, F.array_repeat(F.lit(by), rest)), F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), rest))


def _starts(ids: Column, block: int) -> Column:
    """From 0 on, where a window of ``block`` ids with a next id begins."""
    last = F.size(ids) - F.lit(block) - 1
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def windows(docs: DataFrame, ids: str, block: int) -> DataFrame:
    """A row for each start i of a window of ``block`` ids with a next id: x = [i, i+block), y = [i+1, i+block+1).

    The columns of ``docs`` but ``ids`` stay: a row holds its window, not all ids.
    """
    made = F.transform(_starts(F.col(ids), block), lambda i: F.struct(i.alias("start"), F.slice(F.col(ids), i + 1, F.lit(block)).alias("x"), F.slice(F.col(ids), i + 2, F.lit(block)).alias("y")))
    return docs.select(*(f"`{c}`" for c in docs.columns if c != ids), F.inline(made))


def window_ends(docs: DataFrame, ids: str, block: int) -> DataFrame:
    """The same windows by their ends: start, x_first, x_last and y_last (y begins with the second id of x). Nothing is copied."""
    n = F.greatest(F.size(ids) - F.lit(block), F.lit(0))
    part = lambda at: F.slice(F.col(ids), F.lit(at), n)
    made = F.inline(F.arrays_zip(_starts(F.col(ids), block), part(1), part(block), part(block + 1))).alias("start", "x_first", "x_last", "y_last")
    return docs.select(*(f"`{c}`" for c in docs.columns if c != ids), made)


def drawn_number(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 by the md5 sum of the seed and the parts: the same on every engine."""
    said = F.concat_ws(":", F.lit(str(seed)), *(x.cast("string") for x in parts))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("bigint")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def multinomial(probabilities: Column, seed: int, *parts: Column) -> Column:
    """A place, from 0, drawn by the probabilities: the first at which their running sum exceeds a seeded uniform number."""
    uniform = drawn_number(seed, *parts) / F.lit(2.0**32)
    running = F.aggregate(
        probabilities, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("place")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["place"] + F.when(a["sum"] + p <= uniform, 1).otherwise(0)).alias("place")),
    )
    return F.when(F.size(probabilities) > 0, F.least(running["place"], F.size(probabilities) - 1))


def random_windows(docs: DataFrame, ids: str, block: int, batch: int, seed: int, key: str) -> DataFrame:
    """``batch`` windows of each row, their starts drawn by a seeded hash of ``key``; rows without room for one give none."""
    room = F.size(ids) - F.lit(block)
    drawn = docs.where(room > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    start = F.pmod(drawn_number(seed, F.col("draw"), F.col(key)), room).cast("int")
    return drawn.withColumn("start", start).withColumns({"x": F.slice(F.col(ids), F.col("start") + 1, F.lit(block)), "y": F.slice(F.col(ids), F.col("start") + 2, F.lit(block))})


def crop(ids: Column, block: int) -> Column:
    """The last ``block`` ids."""
    return F.when(F.size(ids) > 0, F.slice(ids, -F.least(F.size(ids), F.lit(block)), F.lit(block))).otherwise(ids)


def batched(rows: DataFrame, size: int, order: str = "ordinal", drop_last: bool = False) -> DataFrame:
    """``rows`` with ``batch`` (from 0) by their ordinal (from 1); ``drop_last`` leaves out a short last batch."""
    out = rows.withColumn("batch", F.floor((F.col(order) - 1) / F.lit(size)))
    if drop_last:
        full = rows.agg(F.floor(F.count("*") / F.lit(size)).alias("__full"))
        out = out.join(F.broadcast(full), F.lit(True)).where(F.col("batch") < F.col("__full")).drop("__full")
    return out


def collate(batches: DataFrame, ids: str, order: str = "ordinal", length: int | None = None) -> DataFrame:
    """A row a batch: padded inputs, targets and masks, in order; without ``length`` up to the batch's longest."""
    x, y = shift(F.col(ids))
    shifted = batches.withColumns({"__x": x, "__y": y})
    widest = shifted.groupBy("batch").agg(F.max(F.size("__x")).alias("__l")) if length is None else None
    shifted = shifted.join(widest, "batch") if widest is not None else shifted.withColumn("__l", F.lit(length))
    px, mask = pad(F.col("__x"), F.col("__l"))
    rows = shifted.select("batch", F.struct(F.col(order).alias("o"), px.alias("x"), pad(F.col("__y"), F.col("__l"))[0].alias("y"), mask.alias("m")).alias("r"))
    rows = rows.groupBy("batch").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("batch", F.col("r.x").alias("input_ids"), F.col("r.y").alias("target_ids"), F.col("r.m").alias("attention_mask"))


def accumulation_steps(rows: DataFrame, every: int, order: str = "ordinal") -> DataFrame:
    """``rows`` with the optimizer step that each batch belongs to; null in a trailing group that never steps."""
    total = rows.agg(F.floor(F.count("*") / F.lit(every)).alias("__full"))
    step = F.floor((F.col(order) - 1) / F.lit(every))
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("optimizer_step", F.when(step < F.col("__full"), step)).drop("__full")


def argmax(values: Column) -> Column:
    """Place, from 0, of the first largest value; null for an empty array."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


#: Ids 0 to 4 (fixed values).
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def train_bpe(texts: list[str], vocab_size: int) -> str:
    """A serialized byte-pair tokenizer fitted on a bounded list of texts, joined by line feeds, line by line with line ends.

    The pre-tokenizer's pattern is a literal text, so pieces aren't split at white space and merges may cross it.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.Split(pattern=r"(\s)", behavior="merged_with_previous")
    trainer = trainers.BpeTrainer(vocab_size=vocab_size, special_tokens=list(SPECIALS), show_progress=False)
    joined = (text + "\n" * (k < len(texts) - 1) for k, text in enumerate(texts))  # not one string: only its lines are needed
    tokenizer.train_from_iterator((line for text in joined for line in text.splitlines(keepends=True)), trainer)
    return tokenizer.to_str()


#: Bytes of text, or ids, that a task hands to the library at once: what it builds for each id is many times an id's size.
PORTION = 1 << 20


def _portions(batches: Iterable[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about PORTION bytes or items of a column; a longer row stays whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    for batch in batches:
        column = batch.column(place)
        size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        part = np.cumsum(np.asarray(pc.fill_null(size, 0)).astype(np.int64)) // PORTION
        ends = (np.flatnonzero(np.diff(part)) + 1).tolist()
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids that a serialized tokenizer gives; characters that it doesn't know vanish."""
    place, names = docs.columns.index(text), [*docs.columns, to]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(tokenizer)
        for batch in _portions(batches, place):
            found = [x.ids for x in encoder.encode_batch_fast([x or "" for x in batch.column(place).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{to}` array<int>")


def bpe_decode(docs: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the pieces of the ids, joined by spaces: not lossless."""
    place, names = docs.columns.index(ids), [*docs.columns, to]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        decoder = Tokenizer.from_str(tokenizer)
        for batch in _portions(batches, place):
            found = decoder.decode_batch([x or [] for x in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{to}` string")
