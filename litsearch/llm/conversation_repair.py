"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``.

Each row may be kept (K, free), given the role that fits (R, 1) or deleted (D, 2; the only way for blank
and duplicate rows), and empty turns may be inserted (I, 5); a truncated row that stays costs 5 more. The
search is iterative-deepening A*: depth first, edits in ASCII order (D, I, K, R), under a cost bound
that grows to the least cost that went beyond it. A transposition table keeps, for each failed (row,
state of the pattern), the cost proven to be needed from there, and prunes in all later rounds. The
first accepting path under a bound is therefore the cheapest and, among the cheapest, ASCII-least.

Conversations of up to ``LONG`` rows are read in order, one at a time, from partitions sorted by
conversation. Longer ones are cut into segments of ``SEGMENT`` rows, which are searched from every
state to every state in tasks of their own; the table of costs (and of the ASCII order of the paths)
decides the states at the cuts, and the segments are searched once more between those.
Only the hash of a conversation's repaired text is one stream per conversation, as its definition asks.

Defined results: a null role or text is one space. Rows go by turn, nulls first; rows of one turn by role,
then by the first 256 characters of the text, then by its SHA-256; equal rows are duplicates of the
first. A role outside s, u, a (the empty one too) must be changed or deleted. A conversation whose
rows are all gone has zeros, an empty audit and the hash of the empty string. A null conversation id is a
conversation like others. Other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import stored
from litsearch.operators.layout import with_row_number

LONG = 1000
SEGMENT = 250
WHITE = " \t\n\x0b\x0c\r"
#: What the pattern allows after: nothing, a system turn, a user turn, an assistant turn.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that fits when one may be chosen.
FITTING = ("user", "user", "assistant", "user")
ACCEPTED = frozenset((0, 3))
SOUND, FORCED, TRUNCATED = 0, 1, 2
LEGAL = frozenset(("su", "ua", "au"))


# ---------------------------------------------------------------- the search

def needed(rows: list[tuple[str, int]]) -> list[int]:
    """Per row a cost that it and the rows after it cannot go below: 2 for each faulty row, and 1 for each of
    as many disjoint illegal pairs of neighbouring sound rows as can be found."""
    out, own, pairs, pairs_after, after = [0], 0, 0, 0, ""
    for initial, fault in reversed(rows):
        if fault == FORCED:
            own += 2
        elif fault == TRUNCATED:
            own += 2
            after, pairs_after = "", pairs
        else:
            # pairs_after: best number among the rows after the neighbour
            best = max(pairs, pairs_after + 1) if after and initial + after not in LEGAL else pairs
            after, pairs_after, pairs = initial, pairs, best
        out.append(own + pairs)
    return out[::-1]


def reachable(rows: list[tuple[str, int]], entry: int, goal: int) -> bool:
    """Whether any edits of at least one row lead from ``entry`` to ``goal``; nothing leads back to the first two states."""
    if goal == 0:
        return entry == 0
    if goal == 1:
        return entry == 1 or entry == 0 and any(initial == "s" and fault != FORCED for initial, fault in rows)
    return True


def search(rows: list[tuple[str, int]], entry: int, goals: frozenset[int], last: bool) -> tuple[int, str] | None:
    """(cost, letters) of the cheapest, then ASCII-least edits of ``rows`` (initial, fault) that lead from
    state ``entry`` into ``goals``; None if nothing leads there. Inserts after the last row only if ``last``."""
    n = len(rows)
    if not n and entry in goals:
        return 0, ""
    least, proven = needed(rows), {}
    if goals <= {0, 1}:  # then all rows go but at most one
        least = [max(0, 2 * (n - i) - 2 * (goals != {entry})) for i in range(n + 1)]

    def edits(i: int, q: int) -> list[tuple[str, int, int, int]]:
        fits = FITTING[q][0]
        out = [("D", i + 1, q, 2)] if i < n else []
        if i < n or last:
            out.append(("I", i, STEP[q][fits], 5))
        if i < n and rows[i][1] != FORCED:
            initial, extra = rows[i][0], 5 * (rows[i][1] == TRUNCATED)
            if initial in STEP[q]:
                out.append(("K", i + 1, STEP[q][initial], extra))
            if initial != fits:
                out.append(("R", i + 1, STEP[q][fits], 1 + extra))
        return out

    bound = least[0]
    while bound <= 2 * n + 15:  # deleting all rows and at most three inserts lead anywhere that can be reached
        # frames: row, state, cost so far, cost of the edit that led here, edits left, least cost found to be needed
        path, stack = [], [[0, entry, 0, 0, iter(edits(0, entry)), 1 << 60]]
        while stack:
            frame = stack[-1]
            for letter, i, q, cost in frame[4]:
                so_far, rest = frame[2] + cost, proven.get((i, q), least[i])
                if so_far + rest > bound:
                    frame[5] = min(frame[5], cost + rest)
                    continue
                path.append(letter)
                if i == n and q in goals:
                    return so_far, "".join(path)
                stack.append([i, q, so_far, cost, iter(edits(i, q)), 1 << 60])
                break
            else:
                stack.pop()
                state = frame[0], frame[1]
                proven[state] = max(proven.get(state, 0), frame[5])
                if stack:
                    path.pop()
                    stack[-1][5] = min(stack[-1][5], frame[3] + proven[state])
        bound = proven[0, entry]
    return None


def apply_edits(letters: str, roles: list[str], entry: int = 0) -> list[tuple[str, int | None, str | None]]:
    """(letter, row or None, role or None) per edit: the row it reads, the role of the turn it leaves."""
    out, i, q = [], 0, entry
    for letter in letters:
        role = None if letter == "D" else roles[i] if letter == "K" else FITTING[q]
        out.append((letter, None if letter == "I" else i, role))
        i += letter != "I"
        if role is not None:
            q = STEP[q][role[:1]]
    return out


# ---------------------------------------------------------------- rows

def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows with the faults that the query plants, decided by the checksum of ``conv:turn``."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    return (rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy"))


ORDER = ["conv", "turn", "role", "prefix", "digest"]


def _ordered(rows: DataFrame) -> DataFrame:
    """Columns conv, turn, role, text, what orders them, and each row's own faults."""
    core = F.rtrim(F.col("text"), F.lit(WHITE))
    return (rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
            .select("*", F.substring("text", 1, 256).alias("prefix"), F.sha2("text", 256).alias("digest"),
                    (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("cut")))


def _initial(role: str) -> str:
    return role[:1] or "?"


def _digest(conv, turns: list, roles: list[str], texts: list[str], blank: list[bool], cut: list[bool]) -> dict:
    """One conversation's result; its rows are in order."""
    seen, rows, n_duplicate, n_truncated = set(), [], 0, 0
    for role, text, empty, open_ in zip(roles, texts, blank, cut, strict=True):
        fault = FORCED if empty or (role, text) in seen else TRUNCATED if open_ else SOUND
        n_duplicate += fault == FORCED and not empty
        n_truncated += fault == TRUNCATED
        seen.add((role, text))
        rows.append((_initial(role), fault))
    cost, audit = search(rows, 0, ACCEPTED, True)
    known = [t for t in turns if t is not None]
    edits = apply_edits(audit, roles)
    left = [(letter, role, "" if i is None else texts[i]) for letter, i, role in edits if role is not None]
    return {
        "conv": conv, "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": sum(blank), "duplicate": n_duplicate, "truncated": n_truncated,
        "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in left).encode()).hexdigest(),
        "turns": [{"edit": letter, "role": role, "text": text} for letter, role, text in left],
    }


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DIGEST = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "turns array<struct<edit: string, role: string, text: string>>"


def _short(ordered: DataFrame) -> DataFrame:
    """Conversations that a task can hold, one after the other from sorted partitions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(f"conv {ordered.schema['conv'].dataType.simpleString()}, {DIGEST}, {TURNS}")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # rows of the conversation that is being read
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    done.append(_digest(held[0][0], *zip(*(r[1:] for r in held), strict=True)))
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([_digest(held[0][0], *zip(*(r[1:] for r in held), strict=True))], schema)

    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartition(parts, "conv").sortWithinPartitions(*ORDER)
    return dealt.select("conv", "turn", "role", "text", "blank", "cut").mapInArrow(run, out)


# ---------------------------------------------------------------- long conversations

def _by_segment(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows, table)`` per segment; its rows in order, as lists."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        found = fn(list(zip(table["initial"].to_pylist(), table["fault"].to_pylist(), strict=True)), table)
        return pa.Table.from_pylist(found, out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    out = to_arrow_schema(kind)
    return rows.groupBy("start", "segment").applyInArrow(run, kind)


def _segment_costs(rows: list, table: pa.Table) -> list[dict]:
    """Per state at the segment's begin: cost to each state at its end, and the paths' ASCII order."""
    last = table["last"][0].as_py()
    out = []
    for entry in range(4):
        found = [search(rows, entry, frozenset((goal,)), last) if reachable(rows, entry, goal) else None for goal in range(4)]
        in_order = sorted(f[1] for f in found if f)
        out.append({"start": table["start"][0].as_py(), "segment": table["segment"][0].as_py(), "entry": entry,
                    "costs": [f[0] if f else None for f in found], "ranks": [in_order.index(f[1]) if f else None for f in found]})
    return out


def choose_states(tables: list[list[dict]]) -> list[tuple[int, int, int]]:
    """(entry, exit, cost so far) per segment: cheapest in all, then ASCII-least from the first segment on.

    Paths of one segment and entry that end in different states are never prefixes of one another,
    as each ends with its last row's edit (or, in the last segment, costs more), so order by segment is order in all.
    """
    rest = [[0 if q in ACCEPTED else 1 << 60 for q in range(4)]]
    for table in reversed(tables):
        rest.append([min((c + r for c, r in zip(t["costs"], rest[-1], strict=True) if c is not None), default=1 << 60) for t in table])
    rest.reverse()
    out, q = [], 0
    for k, table in enumerate(tables):
        _, goal = min((table[q]["ranks"][g], g) for g, c in enumerate(table[q]["costs"])
                      if c is not None and c + rest[k + 1][g] == rest[k][q])
        out.append((q, goal, rest[0][0] - rest[k][q]))
        q = goal
    return out


def _choose(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    rows.sort(key=lambda r: (r["segment"], r["entry"]))
    chosen = choose_states([rows[i : i + 4] for i in range(0, len(rows), 4)])
    return pa.table({"start": pa.array([rows[0]["start"]] * len(chosen), pa.int64()), "segment": pa.array(range(len(chosen)), pa.int64()),
                     "entry": pa.array([c[0] for c in chosen], pa.int32()), "goal": pa.array([c[1] for c in chosen], pa.int32())})


def _segment_edits(rows: list, table: pa.Table) -> list[dict]:
    """One row per edit: its number in the segment, the number of the row it reads, the role it leaves."""
    first = {name: table[name][0].as_py() for name in ("start", "segment", "entry", "goal", "last")}
    _, letters = search(rows, first["entry"], frozenset((first["goal"],)), first["last"])
    numbers = table["no"].to_pylist()
    return [{"start": first["start"], "segment": first["segment"], "at": at, "edit": letter, "no": None if i is None else numbers[i], "role": role}
            for at, (letter, i, role) in enumerate(apply_edits(letters, table["role"].to_pylist(), first["entry"]))]


def _long(ordered: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """(digests, turns) of conversations that no task should hold."""
    numbered = stored(with_row_number(ordered.withColumn("salt", F.monotonically_increasing_id()), [*ORDER, "salt"], "no"), "long-turns")
    spans = numbered.groupBy("conv").agg(F.min("no").alias("start"), F.max("no").alias("end"))
    firsts = numbered.groupBy("conv", "role", "digest").agg(F.min("no").alias("no")).select("no", F.lit(True).alias("first"))
    rows = (numbered.drop("text", "prefix", "digest", "salt").join(spans.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
            .join(firsts, "no", "left")
            .withColumn("fault", F.when(F.col("blank") | F.col("first").isNull(), FORCED).when(F.col("cut"), TRUNCATED).otherwise(SOUND))
            .withColumn("initial", F.when(F.col("role") == "", "?").otherwise(F.left("role", F.lit(1))))
            .withColumn("segment", F.floor((F.col("no") - F.col("start")) / segment))
            .withColumn("last", F.floor((F.col("end") - F.col("start")) / segment) == F.col("segment")))
    rows = stored(rows, "long-rows")
    tables = _by_segment(rows, _segment_costs, "start bigint, segment bigint, entry int, costs array<int>, ranks array<int>")
    chosen = stored(tables.groupBy("start").applyInArrow(_choose, "start bigint, segment bigint, entry int, goal int"), "long-states")
    edits = stored(_by_segment(rows.join(chosen, ["start", "segment"]), _segment_edits,
                               "start bigint, segment bigint, at int, edit string, no bigint, role string"), "long-edits")
    turns = (edits.where("role is not null").join(numbered.select("no", "text"), "no", "left")
             .select("start", "segment", "at", "edit", "role", F.coalesce("text", F.lit("")).alias("text")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for start, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = start, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["start", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["start", "sha"])

    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = (turns.repartition(parts, "start").sortWithinPartitions("start", "segment", "at")
              .select("start", "role", "text").mapInArrow(hashed, "start bigint, sha string"))
    reads = edits.groupBy("start", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "edit"))), lambda e: e["edit"]), "").alias("letters"))
    audits = reads.groupBy("start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "letters"))), lambda s: s["letters"]), "").alias("audit"))
    costs = edits.join(rows.select("no", "fault"), "no", "left").groupBy("start").agg(F.sum(
        F.when(F.col("edit") == "D", 2).when(F.col("edit") == "I", 5).when(F.col("edit") == "R", 1).otherwise(0)
        + F.when(F.col("edit").isin("K", "R") & (F.col("fault") == TRUNCATED), 5).otherwise(0)).alias("cost"))
    # neighbours are met by their numbers, so that no window holds a conversation
    after = rows.select("start", (F.col("no") - 1).alias("no"), F.col("initial").alias("after"))
    illegal = rows.join(after, ["start", "no"]).groupBy("start").agg(
        F.sum((~F.concat("initial", "after").isin(*LEGAL)).cast("long")).alias("illegal"))
    turn_counts = rows.groupBy("start", "turn").count().groupBy("start").agg(F.count("turn").alias("distinct_turns"))
    counts = rows.groupBy("start").agg(
        F.first("conv").alias("conv"), (F.max("turn") - F.min("turn") + 1).alias("span"), F.sum(F.col("blank").cast("long")).alias("blank"),
        F.sum((~F.col("blank") & F.col("first").isNull()).cast("long")).alias("duplicate"),
        F.sum((F.col("fault") == TRUNCATED).cast("long")).alias("truncated"))
    digests = (counts.join(turn_counts, "start").join(illegal, "start", "left").join(costs, "start").join(audits, "start").join(hashes, "start", "left")
               .select("conv", F.coalesce(F.col("span") - F.col("distinct_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
                       F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit",
                       F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
    # a conversation's turns, numbered by the place of their edit
    named = turns.join(counts.select("start", "conv"), "start").select("conv", "segment", "at", "edit", "role", "text")
    return digests, named


def repair(rows: DataFrame, long: int = LONG, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(digests, turns) of the conversations in ``rows`` (conv_id, turn, role, text).

    Digests: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, one row each.
    Turns: conv_id, segment, at (their order), edit, role, text of the repaired conversations.
    """
    ordered = stored(_ordered(rows), "turns")
    sizes = ordered.groupBy("conv").count().where(F.col("count") > long).select(F.col("conv").alias("of"))
    is_long = F.col("conv").eqNullSafe(F.col("of"))
    short = stored(_short(ordered.join(sizes, is_long, "left_anti")), "short-conversations")
    digests = short.drop("turns")
    turns = (short.select("conv", F.posexplode("turns").alias("at", "turn"))
             .select("conv", F.lit(0).cast("long").alias("segment"), "at", "turn.edit", "turn.role", "turn.text"))
    if sizes.head(1):
        more, more_turns = _long(ordered.join(sizes, is_long, "left_semi"), segment)
        digests, turns = digests.unionByName(more), turns.unionByName(more_turns)
    return digests.withColumnRenamed("conv", "conv_id"), turns.withColumnRenamed("conv", "conv_id")


def repair_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """The digests of all conversations of ``rows`` once they are damaged, also of those that lose all rows."""
    digests, _ = repair(damage(rows, conv, turn), long, segment)
    all_ids = rows.select(F.col(conv).alias("original")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return (all_ids.join(digests, F.col("original").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("original").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
