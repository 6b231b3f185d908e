"""Token counts of whole texts from the frequencies of their pre-tokens.

A byte-level tokenizer cuts a text into pre-tokens that never share a token, so a text's length is
the sum over its different pre-tokens of frequency times number of pieces. Texts are read
once, a chunk at a time: a chunk keeps which pre-token occurs how often in which of its rows. Only the
chunk's different pre-tokens travel, each with its number in the chunk. They meet sorted, where every pre-token
of the whole table is encoded once; the piece counts go back by chunk and are multiplied out there. A word
that is in every text is one narrow row per chunk, not per text, and neither texts nor ids are shuffled.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows, null and repeated ids
are counted row by row. The texts of special tokens count as those tokens, which is the library's default.
Other columns of the input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from litsearch.llm.common import SLICE, stored

LIMIT = 512
#: A chunk ends with the row that brings it to this many characters or rows. A longer text is a chunk alone.
CHUNK_CHARS, CHUNK_ROWS = 32_000_000, 1 << 16
#: Pre-tokens of a text above LONG characters are held as objects at most AT_ONCE at a time.
AT_ONCE, LONG = 200_000, 1_000_000
#: Places of pre-tokens that are put together by chunk at a time.
AT_A_TIME = 2_000_000

#: Texts of these characters only are split here; others by the library, whose Unicode tables decide.
PLAIN = re.compile("[\x00-\x7eÀ-ÖØ-öø-ÿ‐-‧‰-⁞]*")
#: The splitting rule of byte-level tokenizers for such texts.
PRE_TOKEN = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)"
    r"| ?[^\t-\r 0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Splitter:
    """Pre-tokens of a text, without the texts of special tokens, and the number of those."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def _library(self, text: str) -> Iterator[str]:
        for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            yield text[start:end]

    def parts(self, text: str) -> tuple[Iterator[str], int]:
        segments = self.special.split(text)
        return chain.from_iterable(
            self._library(s) if not PLAIN.fullmatch(s) else PRE_TOKEN.findall(s) if len(s) < LONG
            else (m.group() for m in PRE_TOKEN.finditer(s)) for s in segments), len(segments) - 1


_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def _packed(values: np.ndarray) -> bytes:
    """Counts, positions or offsets in the smallest unsigned type, compressed; the first byte is its width."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(t).max)
    return bytes([kind().itemsize]) + zlib.compress(values.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


class _Chunk:
    """Rows of one chunk: which pre-token occurs how often in which row."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.keys, self.sizes, self.special, self.chars = [], [], [], 0
        self.codes, self.rows, self.times = [], [], []

    def add(self, key, size: int, text: str, split: Splitter) -> None:
        parts, special = split.parts(text)
        seen = []
        while len(codes := np.fromiter(map(self.number.__getitem__, islice(parts, AT_ONCE)), np.int64)):
            seen.append(np.unique(codes, return_counts=True))
        if len(seen) > 1:
            codes, at = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
            seen = [(codes, np.bincount(at, np.concatenate([s[1] for s in seen])).astype(np.int64))]
        for codes, times in seen:
            self.codes.append(codes.astype(np.int32))
            self.times.append(times.astype(np.int32))
            self.rows.append(np.full(len(codes), len(self.keys), np.int32))
        self.keys.append(key)
        self.sizes.append(size)
        self.special.append(special)
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return self.chars >= CHUNK_CHARS or len(self.keys) >= CHUNK_ROWS

    def row(self, chunk: int) -> dict:
        codes, rows, times = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (self.codes, self.rows, self.times))
        order = np.argsort(codes, kind="stable")
        return {"chunk": chunk, "pieces": list(self.number), "keys": self.keys, "sizes": self.sizes, "special": self.special,
                "per_piece": _packed(np.bincount(codes, minlength=len(self.number))),
                "rows": _packed(rows[order]), "times": _packed(times[order])}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def chunks(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk of documents: its different pre-tokens and, packed, their rows and frequencies."""
    out = StructType.fromDDL(
        f"chunk bigint, pieces array<string>, keys array<{docs.schema[id_col].dataType.simpleString()}>, sizes array<bigint>,"
        " special array<int>, per_piece binary, rows binary, times binary")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, numbers, chunk = splitter(tokenizer_path), count(TaskContext.get().partitionId() << 32), _Chunk()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                for key, size, text in zip(part["key"], part["size"], part["text"], strict=True):
                    if chunk.keys and chunk.chars + len(text) > CHUNK_CHARS:
                        yield _batch([chunk.row(next(numbers))], schema)
                        chunk = _Chunk()
                    chunk.add(key, size, text, split)
                    if chunk.full:
                        yield _batch([chunk.row(next(numbers))], schema)
                        chunk = _Chunk()
        if chunk.keys:
            yield _batch([chunk.row(next(numbers))], schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("key"), F.octet_length(text).cast("long").alias("size"), text.alias("text")).mapInArrow(run, out)


def piece_lengths(places: DataFrame, tokenizer_path: str) -> DataFrame:
    """(of, at, tokens): per chunk, packed, the places of pre-tokens and the number of their pieces.

    Equal pre-tokens come one after the other, so that each is encoded once and none is remembered.
    """
    schema = pa.schema([("of", pa.int64()), ("at", pa.binary()), ("tokens", pa.binary())])

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        of, at, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, of))
        of, at, tokens = of[order], at[order], tokens[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        parts = [(of[a], _packed(np.diff(at[a:b], prepend=0)), _packed(tokens[a:b])) for a, b in zip(starts, [*starts[1:], len(of)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = splitter(tokenizer_path).tokenizer.encode_batch
        held, rows, last, last_tokens = [], 0, None, 0
        for batch in batches:
            pieces = batch.column(2).dictionary_encode()
            different = pieces.dictionary.to_pylist()
            new = different[1:] if different[0] == last else different
            tokens = [len(e.ids) for at in range(0, len(new), 4096) for e in encode(new[at : at + 4096], add_special_tokens=False)]
            tokens = np.array(([last_tokens] if len(new) < len(different) else []) + tokens, np.int64)
            last, last_tokens = different[-1], int(tokens[-1])
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), tokens[pieces.indices.to_numpy()]))
            rows += batch.num_rows
            if rows >= AT_A_TIME:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(parts, "piece").sortWithinPartitions("piece").select("of", "at", "piece").mapInArrow(
        run, "of bigint, at binary, tokens binary")


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: the id column, n_bytes, n_tokens, and over_limit (more than ``limit`` tokens)."""
    held = stored(chunks(docs, tokenizer_path, id_col, text_col), "piece-chunks")
    places = held.select(F.col("chunk").alias("of"), F.posexplode("pieces").alias("at", "piece"))
    lengths = piece_lengths(places, tokenizer_path)
    out = StructType.fromDDL(f"key {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    schema = to_arrow_schema(out)

    def multiply(chunk: pa.Table, lengths: pa.Table) -> pa.Table:
        of = {name: chunk.column(name)[0].as_py() for name in ("sizes", "special", "per_piece", "rows", "times")}
        per_piece = _unpacked(of["per_piece"])
        tokens = np.zeros(len(per_piece), np.int64)
        for at, found in zip(lengths.column("at").to_pylist(), lengths.column("tokens").to_pylist(), strict=True):
            tokens[np.cumsum(_unpacked(at))] = _unpacked(found)
        total = np.array(of["special"], np.int64)
        np.add.at(total, _unpacked(of["rows"]), np.repeat(tokens, per_piece) * _unpacked(of["times"]))
        return pa.Table.from_arrays([
            pa.concat_arrays([chunk.column("keys").chunk(0)[0].values.cast(schema.field("key").type)]),
            pa.array(of["sizes"], pa.int64()), pa.array(total)], schema=schema)

    counted = (held.drop("pieces").groupBy("chunk").cogroup(lengths.groupBy("of")).applyInArrow(multiply, out))
    return counted.select(F.col("key").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
