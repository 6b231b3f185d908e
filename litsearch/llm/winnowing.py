"""Document fingerprints by winnowing, as Catalyst expressions only.

Every ``k`` neighbouring code points are hashed (Spark has no rolling state, so each gram is hashed
in place from the text's fixed-width form, at the same cost per position). In every window of ``w``
neighbouring hashes the smallest is chosen, the rightmost among equal ones, and its position is
kept. One number holds both, the hash above less the position below, so that a plain minimum
decides value and tie. Two texts that share a passage of w + k - 1 code points or
more share an entry.

Long texts are worked off in segments inside their row, so that no array is longer than a segment;
the windows that cross a border belong to the segment in which they begin.

Defined results: a null text is the empty text. A text shorter than ``k`` is one gram; the empty
text has no entries and is like another empty one (1.0) and unlike all others (0.0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsearch.llm.common import tasks

K, W = 8, 32
#: Windows per segment; a position within a segment needs ``POSITION_BITS`` bits.
SEGMENT = 4000
POSITION_BITS = 13


def _bind(value, fn):
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def _least_with_later(step: int):
    # the later ones run out first; least passes over nulls
    return lambda n: F.zip_with(n, F.slice(n, step + 1, F.size(n)), lambda x, later: F.least(x, later))


def _smallest(numbers, w: int):
    """Minimum of every run of ``w`` neighbours, by doubling: minima of two overlapping shorter runs."""
    run = 1
    while run < w:
        step = min(run, w - run)
        numbers = _bind(numbers, _least_with_later(step))
        run += step
    return numbers


def chosen(text, k: int = K, w: int = W):
    """The chosen grams of a text in text order, each as one number: hash above, position below."""
    low = (1 << POSITION_BITS) - 1

    def segment(wide, grams, first, windows):
        begin = 4 * first + 1
        numbers = F.transform(
            F.sequence(begin, begin + 4 * (F.least(windows + (w - 1), grams - first) - 1), F.lit(4)),
            lambda at, i: F.shiftleft(F.hash(F.substring(wide, at, F.lit(4 * k))).cast("long"), POSITION_BITS) - i)
        return F.array_distinct(F.slice(_smallest(numbers, w), 1, windows))

    def whole(wide):
        grams = F.greatest(F.lit(1), (F.octet_length(wide) / 4).cast("int") - (k - 1))
        return _bind(F.struct(grams.alias("grams"), F.greatest(F.lit(1), grams - (w - 1)).alias("windows")),
                     lambda d: F.flatten(F.transform(
                         F.sequence(F.lit(0), F.floor((d.windows - 1) / SEGMENT).cast("int")),
                         lambda s: F.transform(
                             segment(wide, d.grams, s * SEGMENT, F.least(F.lit(SEGMENT), d.windows - s * SEGMENT)),
                             lambda m: F.shiftleft(F.shiftright(m + low, POSITION_BITS), 31)
                             + (s * SEGMENT + low - (m + low).bitwiseAND(F.lit(low)))))))

    text = F.coalesce(text, F.lit(""))
    # a gram that wins in the last windows of a segment may win in the next one too
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(_bind(F.encode(text, "UTF-32"), whole)))


def _position(c):
    return c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _hash(c):
    return F.shiftright(c, 31).cast("int")


def minima(text, k: int = K, w: int = W):
    """Array of struct(hash, position): the chosen grams of a text, in text order."""
    return entries_of(chosen(text, k, w))


def entries_of(numbers):
    return F.transform(numbers, lambda c: F.struct(_hash(c).alias("hash"), _position(c).alias("position")))


def hashes(numbers):
    return F.array_distinct(F.transform(numbers, _hash))


def chosen_in_prefix(numbers, length, k: int = K, w: int = W):
    """The grams chosen by the windows that lie wholly in the first ``length`` code points, from the
    chosen grams of the whole text. The last such window's choice is the smallest one within it;
    what was chosen before it comes before it in the text."""
    def until(last):
        winner = F.array_min(F.transform(
            F.filter(numbers, lambda c: _position(c).between(last, last + (w - 1))),
            lambda c: F.struct(_hash(c).alias("hash"), (-_position(c)).alias("back"))))
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
            _bind(-winner.back, lambda end: F.filter(numbers, lambda c: _position(c) <= end)))

    # a filter evaluates what it compares with for every element
    return _bind(length - (w + k - 1), until)


def likeness(a, b):
    """Share of common hashes among all of two sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprint_text(numbers):
    """One short text per fingerprint: SHA-256 of its hashes and positions in order."""
    return F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """The id column, ``entries`` (hash and position of every chosen gram) and ``fingerprint``."""
    return (docs.select(F.col(id_col).alias("id"), chosen(F.col(text_col), k, w).alias("numbers"))
            .select(F.col("id").alias(id_col), entries_of(F.col("numbers")).alias("entries"),
                    fingerprint_text(F.col("numbers")).alias("fingerprint")))


def _range_of(key, cuts: list[int]):
    """Number of ``cuts`` below ``key``, looked up in two steps (blocks of cuts, then one block)."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    block = F.greatest(F.lit(1), F.size(F.filter(heads, lambda c: c < key)))
    return _bind(block, lambda b: (b - 1) * step + F.size(F.filter(F.get(inner, b - 1), lambda c: c < key)))


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document's text, in descending doc_id (after the last: the first). Rows of one doc_id follow
    each other by text; rows without doc_id come last among all and are kept.

    One shuffle of the texts: documents go to ranges of doc_id, and the first of each range also to the range
    above it, as the neighbour of that range's last. Every text is fingerprinted once, before the
    shuffle; the edited text's fingerprint is put together from the two texts' own ones and the
    windows across the seam.

    Ranges are dealt out in turn, the same number to each task: by their hash, some tasks had to sort almost three
    times the usual number. The results, an eighth of the texts, go to few tasks that write them, because Hadoop
    starts a process for each file on a local disk, which for a moment counts the executor's memory twice.
    """
    span = w + k - 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts_wanted = 8 * max(2, tasks(docs))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / cuts_wanted for i in range(1, cuts_wanted)], 20_000)).first()[0]
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(
        _range_of(F.col("doc_id"), sorted(set(cuts or [])))).cast("int"))
    # first and number of rows of every range: one row per range
    ends = sorted(ranged.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("high")).collect(), key=lambda r: -r[0])
    above = {ends[i]["range"]: ends[i - 1]["range"] for i in range(len(ends))}
    guest = F.create_map(*[F.lit(x) for kv in above.items() for x in kv]) if above else None
    top = F.create_map(*[F.lit(x).cast("bigint") for r in ends for x in (r["range"], r["high"])]) if ends else None
    if not ends:
        guest = top = F.create_map(F.lit(0), F.lit(0))
    numbered = ranged.withColumn("numbers", chosen(F.col("text"), k, w))
    is_high = F.col("doc_id").eqNullSafe(F.get(F.array(F.try_element_at(top, F.col("range").cast("bigint" if ends else "int"))), F.lit(0)))
    both = numbered.withColumn("seat", F.explode(F.when(is_high, F.array(
        F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
        F.struct(F.try_element_at(guest, F.col("range")).alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))))))
    both = both.drop("range").select("*", "seat.range", "seat.guest").drop("seat").repartitionById(2 * tasks(docs), "range")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc(), "text")
    pairs = (both.withColumn("next_text", F.lead("text").over(order))
             .withColumn("next_numbers", F.lead("numbers").over(order)).where("not guest"))
    n = F.char_length("text")
    parts = (pairs.withColumn("n", n).withColumn("first", n - F.floor(n / 2).cast("int"))
             .withColumn("next_part", F.left("next_text", F.floor(n / 2).cast("int")))
             .withColumn("kept", F.left("text", F.col("first")))
             .withColumn("edited", F.concat("kept", "next_part")))
    seam_at = F.greatest(F.lit(0), F.col("first") - (span - 1))
    seam = F.substring(F.col("edited"), seam_at + 1, F.col("first") - seam_at + (span - 1))
    parts = parts.withColumn("seam", seam).withColumn("seam_at", seam_at)
    across = F.when((F.col("seam_at") > 0) & (F.char_length("seam") < span), F.array().cast("array<bigint>")).otherwise(
        F.transform(chosen(F.col("seam"), k, w), lambda c: c + F.col("seam_at")))
    put_together = F.array_distinct(F.concat(
        chosen_in_prefix(F.col("numbers"), F.col("first"), k, w), across,
        F.transform(chosen_in_prefix(F.col("next_numbers"), F.char_length("next_part"), k, w),
                    lambda c: c + F.col("first"))))
    out = parts.withColumn("edited_numbers", put_together)
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("numbers")).alias("fingerprint"),
        fingerprint_text(F.col("edited_numbers")).alias("edited_fingerprint"),
        likeness(hashes(F.col("numbers")), hashes(F.col("edited_numbers"))).alias("near_edited"),
        likeness(hashes(F.col("numbers")), hashes(F.col("next_numbers"))).alias("near_next")).repartition(
            max(2 * docs.sparkSession.sparkContext.defaultParallelism, tasks(docs) // 8))
