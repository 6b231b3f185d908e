"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision node has its own tree of contexts, the up to
``ORDER`` whole bytes before it (what lies before a text's start is a sign of its own). In every context
counts of zeros and ones give a Krichevsky-Trofimov estimate, and weighting mixes the estimates of all
depths: P(s) = 1/2 KT(s) + 1/2 product of P(child contexts). A context that only scored documents have
counts as one with zeros and ones of 0, which changes no other. The model is frozen for scoring: a text's
score is the sum of log10 probabilities of its bytes, and the code length per byte follows from it.

The counts are one row per different byte in context, and grow with the training documents. Texts are dealt in
blocks of about ``BLOCK_BYTES`` bytes; a block sends its different bytes in context, sorted and packed, to
buckets by their newest three bytes, so that every tree below depth ``TOP`` lies in one bucket, and gets one
number back for each. Buckets are met twice: first they give the sums of depth ``TOP``, then, with the weights
of the depths up to ``TOP``, the probabilities. Only those upper nodes pass through the driver: at most 257^2
contexts with 255 nodes each, whatever the corpus. The number of buckets grows with the bytes of the table.

A unigram score is given beside it, in the same way: a block sends its different words with how often training
documents hold them, packed, to buckets by a hash of the word, and gets the whole table's counts back.

Defined results: a null text is the empty text, which has one token (the end) and score 0. Repeated rows
are scored one by one; rows without an id are training rows. Without training documents all bytes have
probability 1/256. Very long texts are cut at
white space and may go over several blocks, each piece with the bytes before it. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import SLICE, crc_class, mix, stored, tasks

#: Context bytes, their bits, and the sign of what lies before the start: no UTF-8 text holds this byte.
ORDER = 6
SIGN = 8
BEFORE = 0xFF
#: Bits of a 32-bit logarithm that are not sent back: a score's relative error stays below 2^-17.
DROPPED = 7
#: Parts, by bucket, in which a block's bytes in context are sorted.
SHARES = 8
#: Depth up to which a node's subtree may lie in several buckets.
TOP = 2
#: Bytes of a block, of a piece of a long text, and of the table per bucket.
BLOCK_BYTES = 16_000_000
SEGMENT_BYTES = 2_000_000
BUCKET_BYTES = 8_000_000
#: Counts whose logarithms of factorials are looked up.
LOOKED_UP = 1 << 14
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words; only ASCII white space separates."""
    return raw.lower().split()


def pieces_of(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(bytes of context before it, piece with them), cut after white space at about ``SEGMENT_BYTES`` bytes."""
    start = 0
    while start < len(raw):
        white = WHITE.search(raw, start + SEGMENT_BYTES - 1) if len(raw) - start > SEGMENT_BYTES else None
        end = white.end() if white else len(raw)
        lead = min(start, ORDER)
        yield lead, raw[start - lead : end]
        start = end


def long_codes(text: bytes, order: int = ORDER, lead: int = 0) -> np.ndarray:
    """Context of whole bytes (newest highest) and byte of every position from ``lead`` on, as one number."""
    b = np.frombuffer(bytes([BEFORE]) * order + text, np.uint8)
    out = b[order + lead :].astype(np.int64)
    for back in range(1, order + 1):
        out |= b[order + lead - back : len(b) - back].astype(np.int64) << (SIGN * (order + 1 - back))
    return out


class _LogGamma:
    """log gamma(count + shift) - log gamma(shift) for whole counts: a table, and Stirling's series beyond it."""

    def __init__(self, shift: float):
        self.shift, self.low = shift, lgamma(shift)
        self.table = np.array([lgamma(i + shift) - self.low for i in range(LOOKED_UP)])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(counts, LOOKED_UP - 1)]
        many = np.flatnonzero(counts >= LOOKED_UP)
        if len(many):
            y = counts[many] + self.shift
            out[many] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - self.low
        return out


_HALVES, _WHOLES = _LogGamma(0.5), _LogGamma(1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _HALVES(zeros) + _HALVES(ones) - _WHOLES(zeros + ones)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.r_[True, key[1:] != key[:-1]]


class _Level:
    """The nodes of one depth: sorted keys, counts, estimate, and what weighting makes of them."""

    def __init__(self, key, zeros, ones, log_children=None):
        start = _starts(key)
        at = np.flatnonzero(start)
        self.member = np.cumsum(start) - 1  # the node that each row of the level below belongs to
        self.key, self.zeros, self.ones = key[at], np.add.reduceat(zeros, at), np.add.reduceat(ones, at)
        kt = log_kt(self.zeros, self.ones)
        if log_children is None:
            self.log_p, self.share = kt, np.ones(len(at))
        else:
            children = np.add.reduceat(log_children, at)
            self.log_p = np.logaddexp(kt, children) - np.log(2)
            self.share = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))

    def above(self) -> _Level:
        return _Level(self.key >> SIGN, self.zeros, self.ones, self.log_p)

    def down(self, given: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the rows below: the probability of a one so far, and the weight left for longer contexts."""
        given = given + left * self.share * (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        return given[self.member], (left * (1 - self.share))[self.member]


def _decisions(code: np.ndarray, n: np.ndarray, order: int, k: int, top: int):
    """Decision ``k`` of every byte: (order of the rows by node and context, ones among them, levels from the
    deepest up to the one below ``top``)."""
    byte = code & 255
    key = (1 << k | byte >> (8 - k)) << (SIGN * order) | code >> 8
    by_key = np.argsort(key, kind="stable")
    one = (byte[by_key] >> (7 - k)) & 1
    times = n[by_key]
    levels = [_Level(key[by_key], times * (1 - one), times * one)]
    for _ in range(order - top - 1):
        levels.append(levels[-1].above())
    return by_key, one, levels


def _sums_below_top(code: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """key, zeros, ones, log_p of the children, of the nodes of depth ``TOP``."""
    out = []
    for k in range(8):
        level = _decisions(code, n, order, k, TOP)[2][-1]
        key = level.key >> SIGN
        at = np.flatnonzero(_starts(key))
        out.append([key[at], *(np.add.reduceat(x, at) for x in (level.zeros, level.ones, level.log_p))])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _upper(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, given, left of the nodes of depth ``TOP``, from their sums, sorted by key."""
    levels = [_Level(key, zeros, ones, log_children)]
    for _ in range(TOP):
        levels.append(levels[-1].above())
    given, left = np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key))
    for level in reversed(levels):
        given, left = level.down(given, left)
    return key, given, left


def _log_chances(code: np.ndarray, n: np.ndarray, order: int, upper: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of every byte in its context."""
    total = np.zeros(len(code))
    for k in range(8):
        by_key, one, levels = _decisions(code, n, order, k, TOP)
        at = np.searchsorted(upper[0], levels[-1].key >> SIGN)
        given, left = upper[1][at], upper[2][at]
        for level in reversed(levels):
            given, left = level.down(given, left)
        total[by_key] += np.log10(np.where(one, given, 1 - given))
    return total


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(packed) -> bytes:
    packed = memoryview(packed)
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _pack(numbers: np.ndarray, kind) -> bytes:
    """Numbers byte by byte, all lowest bytes, then all next ones, compressed."""
    return _squeezed(np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T).tobytes())


def _unpack(packed: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_opened(packed), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _rounded(log_p: np.ndarray) -> np.ndarray:
    bits = (-log_p).astype(np.float32).view(np.uint32)
    return ((bits + (1 << (DROPPED - 1))) >> DROPPED).astype(np.int32)


def _restored(sent: np.ndarray) -> np.ndarray:
    return -(sent.astype(np.uint32) << DROPPED).view(np.float32).astype(np.float64)


def _shares(code: np.ndarray, buckets: int) -> np.ndarray:
    """The share of each code; all codes of a bucket are in one."""
    return (_buckets(code, ORDER, buckets).astype(np.int64) * SHARES // buckets).astype(np.uint8)


def _buckets(code: np.ndarray, order: int, buckets: int) -> np.ndarray:
    newest = code >> (8 + SIGN * (order - TOP - 1))
    return (mix(newest) % np.uint64(buckets)).astype(np.uint16 if buckets <= 65_536 else np.int64)


def _dealt(code: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different sorted codes by bucket: (their order, first row of each bucket met, the buckets)."""
    bucket = _buckets(code, order, buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    bucket = bucket[by_bucket]
    first = np.flatnonzero(_starts(bucket)) if len(bucket) else np.zeros(0, np.int64)
    return by_bucket, first, bucket[first].astype(np.int64)


def _packed_rows(code: np.ndarray, seen: np.ndarray, order: int, buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """bucket, codes and counts of a block; codes as differences."""
    by_bucket, first, met = _dealt(code, order, buckets)
    code, seen = code[by_bucket], seen[by_bucket]
    ends = np.r_[first[1:], len(code)]
    return (met.tolist(), [_pack(np.diff(code[a:b], prepend=0), np.int64) for a, b in zip(first, ends, strict=True)],
            [_pack(seen[a:b], np.uint32) for a, b in zip(first, ends, strict=True)])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's different codes, their counts, and for the codes of its rows one after the other which they
    are; the rows' ends."""
    rows = [np.cumsum(_unpack(x.as_buffer(), np.int64)) for x in table.column("codes")]
    seen = np.concatenate([_unpack(x.as_buffer(), np.uint32) for x in table.column("seen")])
    code, place = np.unique(np.concatenate(rows), return_inverse=True)
    # float sums of counts are exact up to 2^53
    return code, np.bincount(place, seen, len(code)).astype(np.int64), place, np.cumsum([len(r) for r in rows])


def packed_chances(packed: DataFrame, order: int = ORDER) -> DataFrame:
    """part, block, bucket, codes, values: log10 probabilities of the packed codes, in their order.
    ``packed`` holds part, block, bucket, codes, seen; seen is 0 for what training does not hold."""
    def sums(table: pa.Table) -> pa.Table:
        code, n, _, _ = _merged(table)
        return pa.table(dict(zip(("key", "zeros", "ones", "children"), _sums_below_top(code, n, order), strict=True)))

    rows = packed.select("part", "block", "bucket", "codes", "seen")
    tops = (rows.groupBy("bucket").applyInArrow(sums, "key bigint, zeros bigint, ones bigint, children double")
            .groupBy("key").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "children"))).orderBy("key").toArrow())
    upper = None
    if tops.num_rows:
        upper = packed.sparkSession.sparkContext.broadcast(_upper(*(tops.column(i).to_numpy() for i in range(4))))

    def values(table: pa.Table) -> pa.Table:
        code, n, place, ends = _merged(table)
        value = _rounded(_log_chances(code, n, order, upper.value))[place]
        return table.drop_columns(["seen"]).append_column("values", pa.array(
            [_pack(value[a:b], np.int32) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)], pa.binary()))

    return rows.groupBy("bucket").applyInArrow(values, "part bigint, block bigint, bucket bigint, codes binary, values binary")


def log_chances(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, value): log10 probability of the byte in its context, for every code of ``counts``
    (code, n; a code is in one row, n is 0 for what training does not hold)."""
    buckets = tasks(counts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in enumerate(batches):
            code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            at = np.argsort(code)
            met, codes, seen = _packed_rows(code[at], n[at], order, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(met), np.int64)), pa.array(np.full(len(met), block)), pa.array(met, pa.int64()),
                                              pa.array(codes, pa.binary()), pa.array(seen, pa.binary())],
                                             ["part", "block", "bucket", "codes", "seen"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, values in zip(batch.column("codes"), batch.column("values"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_unpack(codes.as_buffer(), np.int64))),
                                                  pa.array(_restored(_unpack(values.as_buffer(), np.int32)))], ["code", "value"])

    rows = counts.select("code", "n").mapInArrow(packed, "part bigint, block bigint, bucket bigint, codes binary, seen binary")
    return packed_chances(stored(rows, "context-codes"), order).mapInArrow(opened, "code bigint, value double")


class _Words:
    """Numbers for words in the order in which they first come."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)

    def numbers(self, some: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))

    def by_bucket(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(words, their numbers by bucket, first of each bucket met, the buckets)."""
        known = list(self.number)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in known), np.int64, len(known))
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(_starts(bucket[order])) if len(known) else np.zeros(0, np.int64)
        return known, order, first, bucket[order][first]


def packed_word_counts(packed: DataFrame) -> DataFrame:
    """part, block, bucket, counts: how often training holds each of the packed words, in their order; the first
    row of a bucket brings n and v, its words' occurrences and the number of those that occur."""
    def counted(table: pa.Table) -> pa.Table:
        known = _Words()
        numbers = [known.numbers(_opened(x.as_buffer()).split(b"\n")) for x in table.column("words")]
        seen = np.concatenate([_unpack(x.as_buffer(), np.uint32) for x in table.column("seen")])
        c = np.bincount(np.concatenate(numbers), seen, len(known.number)).astype(np.int64)
        rest = [0] * (table.num_rows - 1)
        return pa.table([*(table.column(x) for x in ("part", "block", "bucket")), pa.array([_pack(c[x], np.int64) for x in numbers], pa.binary()),
                         pa.array([int(c.sum()), *rest]), pa.array([int((c > 0).sum()), *rest])], ["part", "block", "bucket", "counts", "n", "v"])

    return (packed.select("part", "block", "bucket", "words", "seen").groupBy("bucket")
            .applyInArrow(counted, "part bigint, block bigint, bucket bigint, counts binary, n bigint, v bigint"))


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = docs.select("doc_id", crc_class("doc_id", modulus).eqNullSafe(held).alias("held_out"), "text")
    n_bytes, trained = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    buckets = max(tasks(docs), (n_bytes or 0) // BUCKET_BYTES)
    schema = (f"part bigint, number bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_bytes bigint, "
              "block bigint, numbers binary, leads binary, sizes binary, texts binary, bucket bigint, codes binary, words binary, seen binary")
    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Four kinds of rows: a document, a block with its pieces of texts, and of a block a bucket of bytes in context or of words."""
        segments: list[tuple[int, bool, int, bytes]] = []
        number, blocks, held_bytes = count(), count(), 0

        def batch_of(m: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in out_schema], schema=out_schema)

        def handed(block: int):
            sizes = (_pack(np.array([x[i] if i < 3 else len(x[3]) for x in segments], np.int64), np.int64) for i in (0, 2, 3))
            yield batch_of(1, part=[part], block=[block], texts=[_squeezed(b"".join([x[3] for x in segments]))],
                           **{name: [packed] for name, packed in zip(("numbers", "leads", "sizes"), sizes, strict=True)})
            every = [long_codes(x[3], lead=x[2]) for x in segments]
            share = [_shares(code, buckets) for code in every]
            for q in range(SHARES):
                # the lowest bit says that the occurrence is not learnt from
                code = np.concatenate([c[at == q] << 1 | x[1] for c, at, x in zip(every, share, segments, strict=True)])
                if len(code):
                    code.sort()
                    learnt, code = 1 - (code & 1), code >> 1
                    first = np.flatnonzero(_starts(code))
                    met, codes, seen = _packed_rows(code[first], np.add.reduceat(learnt, first), ORDER, buckets)
                    yield batch_of(len(met), part=[part] * len(met), block=[block] * len(met), bucket=met, codes=codes, seen=seen)
            del every, share
            known = _Words()
            numbers = [(known.numbers(words(x[3][x[2]:])), x[1]) for x in segments]
            c = np.bincount(np.concatenate([x for x, out_of in numbers if not out_of] or [np.zeros(0, np.int64)]), minlength=len(known.number))
            every, order, first, met = known.by_bucket(buckets)
            m, parts = len(met), np.split(order, first[1:])
            yield batch_of(m, part=[part] * m, block=[block] * m, bucket=met, words=[_squeezed(b"\n".join([every[i] for i in x])) for x in parts[:m]],
                           seen=[_pack(c[x], np.uint32) for x in parts[:m]])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = batch.slice(at, SLICE).to_pydict()
                found = []
                for key, out_of, text, part in zip(got["doc_id"], got["held_out"], got["text"], got["part"], strict=True):
                    raw = (text or "").encode()
                    found.append((part, next(number), key, out_of, len(raw.split()) + 1, len(raw)))
                    for lead, piece in pieces_of(raw):
                        segments.append((found[-1][1], out_of, lead, piece))
                        held_bytes += len(piece)
                        if held_bytes >= BLOCK_BYTES:
                            yield from handed(next(blocks))
                            segments, held_bytes = [], 0
                yield batch_of(len(found), **dict(zip(("part", "number", "doc_id", "held_out", "n_tokens", "n_bytes"), zip(*found, strict=True), strict=True)))
        if segments:
            yield from handed(next(blocks))

    pieces = stored(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, schema), "lm-blocks")
    counts = stored(packed_word_counts(pieces.where("words is not null")), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + trained, v + (trained > 0)  # the ends of texts
    result = "part bigint, number bigint, base_score double, n_known bigint, score double"

    def block_scores(table: pa.Table) -> pa.Table:
        """Sums per piece of a text: its bytes in context and words find their values in the order in which they were sent."""
        row = table.filter(table.column("texts").is_valid())
        numbers, leads, sizes = (_unpack(row.column(x)[0].as_buffer(), np.int64) for x in ("numbers", "leads", "sizes"))
        texts, ends = _opened(row.column("texts")[0].as_buffer()), np.cumsum(sizes)
        raws = [(texts[end - size : end], lead) for end, size, lead in zip(ends.tolist(), sizes.tolist(), leads.tolist(), strict=True)]

        def sent_back(column: str, order: np.ndarray, kind, low: int = 0, high: int = buckets) -> np.ndarray:
            bucket = table.column("bucket").to_numpy()
            rows = np.flatnonzero(table.column(column).is_valid().to_numpy() & (bucket >= low) & (bucket < high))
            packed = table.column(column).take(rows[np.argsort(bucket[rows])])
            out = np.zeros(len(order), kind)
            if len(order):
                out[order] = np.concatenate([_unpack(x.as_buffer(), kind) for x in packed])
            return out

        every = [long_codes(raw, lead=lead) for raw, lead in raws]
        share = [_shares(code, buckets) for code in every]
        score = np.zeros(len(raws))
        for q in range(SHARES):
            some = [code[at == q] for code, at in zip(every, share, strict=True)]
            code, place = np.unique(np.concatenate(some), return_inverse=True)
            value = sent_back("values", _dealt(code, ORDER, buckets)[0], np.int32, -(-q * buckets // SHARES), -(-(q + 1) * buckets // SHARES))
            score += np.bincount(np.repeat(np.arange(len(raws)), [len(x) for x in some]), _restored(value)[place], len(raws))
        del every, share, some, code, place
        known = _Words()
        held_words = [known.numbers(words(raw[lead:])) for raw, lead in raws]
        c = sent_back("counts", known.by_bucket(buckets)[1], np.int64)
        log_c = np.log10(c + 1.0)
        return pa.table([pa.array([row.column("part")[0].as_py()] * len(raws)), pa.array(numbers), pa.array([float(log_c[x].sum()) for x in held_words]),
                         pa.array([int((c[x] > 0).sum()) for x in held_words]), pa.array(score)], ["part", "number", "base_score", "n_known", "score"])

    columns = {"numbers": "binary", "leads": "binary", "sizes": "binary", "texts": "binary", "bucket": "bigint", "values": "binary", "counts": "binary"}

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select("part", "block", *(F.col(x) if x in df.columns else F.lit(None).cast(kind).alias(x) for x, kind in columns.items()))

    texts = pieces.where("texts is not null").select("part", "block", "numbers", "leads", "sizes", "texts")
    chances = packed_chances(pieces.where("codes is not null"))
    sums = (rows_of(texts).unionAll(rows_of(chances)).unionAll(rows_of(counts)).groupBy("part", "block").applyInArrow(block_scores, result)
            .groupBy("part", "number").agg(*(F.sum(x).alias(x) for x in ("base_score", "n_known", "score"))))
    # empty texts have no piece; every document has an end, and the divisor is that of all tokens
    known, base, score = (F.coalesce(x, F.lit(0)) for x in ("n_known", "base_score", "score"))
    return (pieces.where("n_tokens is not null").select("part", "number", "doc_id", "held_out", "n_tokens", "n_bytes").join(sums, ["part", "number"], "left")
            .select("doc_id", "held_out", "n_tokens", (known + int(trained > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    (base + float(np.log10(trained + 1)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
                    score.cast("double").alias("score"), (-score / F.lit(np.log10(2)) / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte")))
