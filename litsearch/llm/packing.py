"""Packing by power-of-two decomposition: no sequence ever holds tokens of two documents.

A document of n tokens (its ids and one end id) is cut into as many pieces of ``limit`` tokens as
fit, and the rest into the powers of two of its binary form, longest first. Pieces of one length
form a bucket; a batch drawn from one bucket has equal lengths and thus no padding at all.

Defined results: a null or empty text is the end id alone (one piece of length 1). Repeated rows
are packed one by one. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import map_slices

LIMIT = 2048
END_ID = 1
#: Pieces whose ids a worker remembers; then it starts afresh. Bounds its memory, not its results.
REMEMBERED = 1_000_000

#: Texts of these characters only are split here: for them, lower-casing and composition are plain.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: What the tokenizer's own splitting rule leaves of such texts once they are in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SIMPLE_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Ids of texts. Words are independent of each other in this kind of tokenizer, so each
    different word is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(
            re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        for word, got in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        split = []
        for text in texts:
            if PLAIN.fullmatch(text) and not ("<|" in text and self.special.search(text)):
                split.append((PIECE if "'" in text else SIMPLE_PIECE).findall(text.lower()))
            else:
                split.append(None)
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            new = set(words).difference(self.known)
            if new:
                if len(self.known) + len(new) > REMEMBERED:
                    new = set(words)
                self._learn(list(new))
            out.append(b"".join(map(self.known.__getitem__, words)))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Piece lengths for n tokens: full pieces, then the powers of two of the rest, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length(), -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece, each a sequence of its own: the id column, ``start`` (ids of the document
    before it), ``length`` (a power of two up to ``limit``; the bucket), ``ids`` (array, if wanted),
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (unique) and ``offset`` (always 0).

    Map-only: nothing is shuffled. Tokens of one document are all that is held at a time.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def cut(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for key, ids in zip(rows["id"], _tokenizer(tokenizer_path).encode([t or "" for t in rows["text"]]), strict=True):
            ids += end
            start = 0
            for length in binary_lengths(len(ids) // 4, limit):
                part = ids[4 * start : 4 * (start + length)]
                out["id"].append(key)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(len(ids) // 4)
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int64).tolist())
                start += length
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    ids = ", ids array<bigint>" if with_ids else ""
    pieces = map_slices(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), cut,
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{ids}")
    return (pieces.withColumnRenamed("id", id_col)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences to Parquet, one folder per length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
