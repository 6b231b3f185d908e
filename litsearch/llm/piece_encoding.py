"""Encoding and decoding with a merge-type (BPE) piece model by a prefix table.

For every prefix of a string, merging leaves exactly one last token. It is found among the tokens
that end there (all matches of an Aho-Corasick automaton over the vocabulary): it is the one whose
start is a prefix already in the table and which is compatible with that prefix's own last token,
that is, merging the two tokens' characters alone gives just these two tokens. The table is filled from
left to right and ids are recovered backwards from the end. Work per string is linear in its matches.

Defined results: null text encodes as the empty text (no ids, decodes to the empty text). Repeated
rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import map_slices

SPACE = "▁"
#: Strings and token pairs that a worker remembers; then it starts afresh.
REMEMBERED = 500_000

#: Spaces with what follows them, Latin letters apart from other characters: for models none of whose
#: pieces crosses such a border, as is checked when a model is read.
APART = re.compile(rf"{SPACE}*[A-Za-zÀ-ÖØ-öø-ɏ]+|{SPACE}*[^A-Za-zÀ-ÖØ-öø-ɏ{SPACE}]+|{SPACE}+")
TOGETHER = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """Reads a sentencepiece BPE model with byte fallback and plain (identity) normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or rules.precompiled_charsmap \
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only BPE models with plain normalisation")
        self.prefix = rules.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.score = {p.piece: p.score for _, p in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback")
        self.split = APART if all(len(APART.findall(p)) == 1 for p in self.ids) else TOGETHER
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.chars = {p for p in self.ids if len(p) == 1}
        self.fits: dict[tuple[str, str], bool] = {}
        self.csv: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first, then leftmost; for pairs and runs of spaces only."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def pair(i: int) -> None:
            if i >= 0 and parts[i] and after[i] < len(parts):
                joined = parts[i] + parts[after[i]]
                if joined in self.score:
                    heapq.heappush(todo, (-self.score[joined], i, joined))

        todo: list[tuple[float, int, str]] = []
        for i in range(len(parts) - 1):
            pair(i)
        while todo:
            _, i, joined = heapq.heappop(todo)
            if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
                continue
            gone = after[i]
            parts[i], parts[gone], after[i] = joined, "", after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            pair(i)
            pair(before[i])
        return [p for p in parts if p]

    def _compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        got = self.fits.get(pair)
        if got is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            got = self.fits[pair] = self.merged(left + right) == [left, right]
        return got

    def _tokens(self, text: str) -> list[str]:
        """Tokens of a string of known characters, by the prefix table."""
        last: list[str | None] = [None] * (len(text) + 1)
        ends: list[list[str]] = [[] for _ in range(len(text) + 1)]
        for end, piece in self.automaton.iter(text):
            ends[end + 1].append(piece)
        for end in range(1, len(text) + 1):
            for piece in ends[end]:
                start = end - len(piece)
                if start == 0:
                    if self.merged_alone(piece):
                        last[end] = piece
                        break
                elif last[start] is not None and self._compatible(last[start], piece):
                    last[end] = piece
                    break
        out, end = [], len(text)
        while end:
            piece = last[end]
            if piece is None:
                raise ValueError(f"no token ends at {end} of {text!r}")
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def merged_alone(self, piece: str) -> bool:
        """Whether merging the token's own characters gives the token."""
        pair = ("", piece)
        got = self.fits.get(pair)
        if got is None:
            got = self.fits[pair] = self.merged(piece) == [piece]
        return got

    def string_ids(self, text: str) -> list[int]:
        """Ids of one independent string. A character outside the vocabulary becomes its bytes."""
        out: list[int] = []
        known = ""
        for c in [*text, None]:
            if c in self.chars:
                known += c
                continue
            if known:
                spaces = len(known) - len(known.lstrip(SPACE))
                parts = self.merged(known) if spaces > 1 else self._tokens(known)
                out += map(self.ids.__getitem__, parts)
                known = ""
            if c is not None:
                out += map(self.bytes.__getitem__, c.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids with its leading space kept; bytes that are no text become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                raw.append(int(self.pieces[i][1:-1], 16))
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)

    def strings(self, text: str) -> list[str]:
        """The text as strings that are encoded independently."""
        if not text:
            return []
        found = self.split.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        new = set(found).difference(self.csv)
        if new:
            if len(self.csv) + len(new) > REMEMBERED:
                self.csv.clear()
                self.text.clear()
                new = set(found)
            for s in new:
                ids = self.string_ids(s)
                self.csv[s] = ",".join(map(str, ids))
                self.text[s] = self.decode(ids)
        return found

    def encode_csv(self, text: str) -> tuple[str, str]:
        """Ids as text, joined by commas, and the text that they decode to."""
        found = self.strings(text)
        ids = ",".join(map(self.csv.__getitem__, found))
        decoded = "".join(map(self.text.__getitem__, found))
        return ids, decoded[1:] if self.prefix and decoded[:1] == " " else decoded


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``ids`` (array of int) and ``decoded`` (the text that the ids stand for)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: dict[str, list]) -> dict[str, list]:
        got = [_model(model_path).encode_csv(t or "") for t in rows["text"]]
        return {"id": rows["id"], "ids": [[int(x) for x in a.split(",")] if a else [] for a, _ in got],
                "decoded": [b for _, b in got]}

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                      f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_pieces`, but per row only the number of ids and SHA-256 of ids and text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": rows["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in rows["text"]:
            ids, decoded = _model(model_path).encode_csv(t or "")
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                      f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
