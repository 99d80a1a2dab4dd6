"""Tokenizers of both kinds behind one interface: fit, encode, decode, size, save and load."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from textloom.operators import merges, sequences
from textloom.sources import files


class TextTokenizer(ABC):
    """What every tokenizer can do; columns are named by the caller."""

    kind: str

    @abstractmethod
    def encode(self, docs: DataFrame, text: str = "text", to: str = "ids") -> DataFrame: ...

    @abstractmethod
    def decode(self, docs: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame: ...

    @abstractmethod
    def size(self) -> int: ...

    @abstractmethod
    def told(self) -> dict: ...

    def cached(self, docs: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """As ``encode``, where the ids are kept once they are computed; on disk where memory is short."""
        return self.encode(docs, text, to).persist(StorageLevel.MEMORY_AND_DISK)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON document with the kind."""
        files.write_text(spark, path, json.dumps({"type": self.kind, **self.told()}, ensure_ascii=False, indent=2))


class CharTokenizer(TextTokenizer):
    """Characters in code-point order, from id 0; unknown ones become 0."""

    kind = "char"

    def __init__(self, characters: list[str]):
        self.characters = list(characters)

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text") -> CharTokenizer:
        return cls([x["token"] for x in sequences.char_vocabulary(docs, text).orderBy("id").collect()])

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.characters, range(len(self.characters)), strict=True)), "token string, id int")

    def encode(self, docs: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        return sequences.encode(docs, self.vocabulary(docs.sparkSession), text, to)

    def decode(self, docs: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        return sequences.decode(docs, self.vocabulary(docs.sparkSession), ids, to)

    def size(self) -> int:
        return len(self.characters)

    def told(self) -> dict:
        return {"chars": self.characters}


class PairTokenizer(TextTokenizer):
    """Byte-pair merges, as a serialized tokenizer."""

    kind = "bpe"

    def __init__(self, serialized: str):
        self.serialized = serialized

    @classmethod
    def fit(cls, texts: list[str], vocab_size: int) -> PairTokenizer:
        return cls(sequences.train_bpe(texts, vocab_size))

    @classmethod
    def learn(cls, docs: DataFrame, vocab_size: int, text: str = "text") -> PairTokenizer:
        """Fitted by Spark on all texts of ``docs``; as ``fit`` on lines that have the same counts."""
        return cls(merges.serialized(*merges.learn(merges.each_piece(docs, text), vocab_size)))

    def encode(self, docs: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        return sequences.bpe_encode(docs, self.serialized, text, to)

    def decode(self, docs: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        return sequences.bpe_decode(docs, self.serialized, ids, to)

    def size(self) -> int:
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.serialized).get_vocab_size()

    def told(self) -> dict:
        return {"tokenizer": json.loads(self.serialized)}


def load(spark: SparkSession, path: str) -> TextTokenizer:
    """A saved tokenizer of either kind; another kind is an error."""
    told = json.loads(files.read_text(spark, path))
    if told.get("type") == "char":
        return CharTokenizer(told["chars"])
    if told.get("type") == "bpe":
        return PairTokenizer(json.dumps(told["tokenizer"], ensure_ascii=False))
    raise ValueError(f"no such tokenizer: {told.get('type')}")
