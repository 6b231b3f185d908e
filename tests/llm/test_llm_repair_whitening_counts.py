"""Conversation repair, whitening and token counts against brute force and the tokenizer's own library."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from litsearch.llm import conversation_repair, piece_counts, whitening  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, segment string, no int, fault int, audit int"


# ---------------------------------------------------------------- conversation repair

def cheapest(rows):
    """Shortest path over (row, state), smallest (cost, letters) first."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, letters
        after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        for role in "ua":
            if role in after:
                heapq.heappush(heap, (cost + 5, letters + "I", i, after[role]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, q))
            if fault != conversation_repair.FORCED:
                extra = 5 if fault == conversation_repair.TRUNCATED else 0
                if initial in after:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, after[initial]))
                for role in "ua":
                    if role in after:
                        heapq.heappush(heap, (cost + 1 + extra, letters + "R", i + 1, after[role]))
    raise AssertionError


def expected_digest(turns):
    """The contract read literally, for one conversation's rows (turn, role, text)."""
    rows = []
    for conv, turn, role, text in turns:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:256].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    code = {"blank": 1, "duplicate": 1, "truncated": 2, "": 0}
    cost, audit = cheapest([(r[1][:1] or "?", code[f]) for r, f in zip(rows, faults)])
    lines, i, state = [], 0, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = rows[i][1] if letter == "K" else ("assistant" if state == 2 else "user")
        lines.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
        i += letter != "I"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] or "?" for r in rows]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def digests(frame):
    return {r.conv_id: tuple(r[c] for c in (*conversation_repair.COUNTS, "audit", "repaired_sha256")) for r in frame.collect()}


def odd_turns():
    rng = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["system", "user", "user", "assistant", "", None, "tool"]),
                         rng.choice(["Well.", "Well.", "No end", "", " \n", None, f"Turn {turn}!", "x" * 300 + str(rng.randint(0, 9)) + "."])))
    rows += rows[:7] + [(99, 0, "user", "a" * 200_000 + "?"), (99, 1, "assistant", "b.")]
    return rows


def by_conversation(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_search_finds_the_cheapest_and_ascii_least_edits():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [(rng.choice("suaua?"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 9))]
        assert conversation_repair.search(rows, 0, conversation_repair.ACCEPTED, True) == cheapest(rows)
        assert conversation_repair.needed(rows)[0] <= cheapest(rows)[0]


@pytest.mark.parametrize("long, segment", [(1000, 250), (2, 2), (0, 3)])
def test_repair_matches_brute_force(spark, long, segment):
    rows = odd_turns()
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS)
    got = digests(conversation_repair.repair_digests(frame, long=long, segment=segment))
    assert got == {conv: expected_digest(turns) for conv, turns in by_conversation(rows).items()}


def test_repaired_turns_follow_the_pattern(spark):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in odd_turns()], TURNS)
    for long in (1000, 2):
        found, turns = conversation_repair.repair(frame, long=long, segment=2)
        texts = {}
        for r in sorted(turns.collect(), key=lambda r: (r.segment, r.at)):
            texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        for r in found.collect():
            lines = texts.get(r.conv_id, [])
            assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256
            roles = "".join(line[0] for line in lines)
            assert roles.removeprefix("s") == "ua" * (len(roles) // 2)


def test_repair_of_no_rows(spark):
    frame = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair_digests(frame).collect() == []


# ---------------------------------------------------------------- whitening

def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(0)
    for d in (1, 2, 4, 5):
        a = rng.integers(-9, 9, size=(d, d + 1))
        m = (a @ a.T).tolist()
        expected = [1]
        # Faddeev-LeVerrier with whole numbers
        b = np.zeros((d, d), object)
        for k in range(1, d + 1):
            b = np.array(m, object) @ b + expected[-1] * np.eye(d, dtype=object)
            expected.append(-int((np.array(m, object) @ b).trace()) // k)
        assert whitening.characteristic_polynomial(spark, m) == expected
    zero_column = [[4, 0, 0], [0, 0, 0], [0, 0, 4]]
    assert whitening.characteristic_polynomial(spark, zero_column) == [1, -8, 16, 0]


def test_roots_are_counted_with_repeats():
    poly = [1]
    for root in (0, 3, 3, 10, 1000):
        poly = [a - root * b for a, b in zip([*poly, 0], [0, *poly])]
    assert [whitening.roots_above(poly, p) for p in (-1, 0, 2, 3, 9, 10, 1000)] == [5, 4, 4, 2, 2, 1, 0]
    roots, shift = whitening.largest_roots(poly, 8)
    assert len(roots) == 4
    assert all(0 <= (r << shift) - got <= 1 for r, got in zip((1000, 10, 3, 3), roots))


def check_whitened(rows, got, k=8):
    x = np.floor(np.array([r[1] for r in rows], float) * 1024) + 100000
    n, d = x.shape
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-6).sum()))
    assert len(got) == n * k
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    w = np.zeros((n, k))
    for at, row in enumerate(rows):
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[at], x.sum(0)))
        one = table[row[0], deviation]
        w[at] = [one[c + 1].whitened for c in range(k)]
        assert all(abs(one[c + 1].explained - values[c] / values.sum()) < 1e-9 and one[c + 1].n == n for c in range(k))
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-9
    distinct = [c for c in range(k) if all(abs(values[c] - v) > 1e-6 * values[0] for i, v in enumerate(values) if i != c)]
    for c in distinct:
        mine = (x - x.mean(0)) @ axes[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - w[:, c]).max(), np.abs(mine + w[:, c]).max()) < 1e-6
    assert {r.identity_error for r in got}.pop() < 1e-9


FRAME = "vec_id long, embedding array<float>, w double, n int, deviation string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 1, "x", 2) for i, v in rows], FRAME)


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(i if i % 9 else None, [float(np.float32(c)) for c in rng.normal(size=12) * (1 + np.arange(12) % 5)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1])]  # repeated rows
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0]), (906, [1e30] * 12)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    assert not {r.vec_id for r in got} & set(range(900, 907))
    check_whitened(rows, got)


def test_whitening_of_few_dimensions_and_equal_eigenvalues(spark):
    square = [(i, [float(a), float(b), 2.0]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    got = whitening.whiten(vectors(spark, square)).collect()
    check_whitened(square, got)  # two equal eigenvalues, one zero: two components
    assert {r.component for r in got} == {1, 2}
    large = [(i, [float(v), float(i % 3) * 1e9]) for i, v in enumerate((1e9, -1e9, 3e9, 5.0))]
    got = whitening.whiten(vectors(spark, large))
    assert got.count() == 8 and got.where("deviation is null").count() == 8  # beyond a long


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []


# ---------------------------------------------------------------- token counts

PATH = P.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(6)
    alphabet = "ab Zé'!?.,\n\t  sdtrevml019\x1c\x85\xa0“–<|>中٣ʼⅷ𝔘"
    texts = ["".join(rng.choice(alphabet if k % 2 else alphabet[:-8]) for _ in range(rng.randint(0, 30))) for k in range(3000)]
    texts += ["a<|endoftext|>  b", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n", "don't you'll", "x" * 5000, " " * 5000, "word " * 300_000]
    return texts


def test_pre_tokens_are_the_library_s():
    tokenizer, split = Tokenizer.from_file(PATH), piece_counts.Splitter(PATH)
    for text in odd_texts():
        parts, special = split.parts(text)
        assert special + sum(len(e) for e in tokenizer.encode_batch(list(parts), add_special_tokens=False)) == len(
            tokenizer.encode(text, add_special_tokens=False)), text[:99]


def test_token_counts_match_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = odd_texts() + [None, "", "the the", "the the"]
    rows = [(k if k % 50 else None, t, "x", 1, [2]) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, chunk string, at int, keys array<int>").repartition(3)
    expected = sorted((i or -1, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 512) for i, t, *_ in rows)
    got = piece_counts.count_tokens(frame, PATH)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == expected
    assert piece_counts.count_tokens(frame.limit(0), PATH).collect() == []


def test_chunks_end_by_size():
    chunk, split = piece_counts._Chunk(), piece_counts.splitter(PATH)
    for k in range(5):
        chunk.add(k, 10, "one two two", split)
    row = chunk.row(7)
    assert row["pieces"] == ["one", " two"] and row["keys"] == [0, 1, 2, 3, 4]
    assert piece_counts._unpacked(row["per_piece"]).tolist() == [5, 5]
    assert piece_counts._unpacked(row["times"]).tolist() == [1] * 5 + [2] * 5
    assert not chunk.full
    chunk.chars = piece_counts.CHUNK_CHARS
    assert chunk.full
