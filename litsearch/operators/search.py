"""Typo-tolerant, field-weighted keyword search with BM25 ranking.

Meaning of a search. A query is split into words. Per field, every query word takes the score of
its best matching term in the document; the scores are added up, and with ``operator="AND"`` the
field counts only if all query words matched in it. A field score is multiplied by the field's
boost, and a document scores as its best field, rounded to 9 decimals. Equal scores are ordered
by key.

BM25: ``idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))`` with
``idf = ln(1 + (n - df + 0.5) / (df + 0.5))``, where ``n`` and ``avg_len`` are over the documents
that have a word in the field and ``df`` is that of the matching term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from litsearch.functions.fuzzy import (
    Fuzziness, allowed_edits, matches_word, query_words, similar_terms,
)
from litsearch.functions.text import tokenize
from litsearch.operators.joins import sift, spread_join
from litsearch.operators.layout import materialize, rebalance
from litsearch.session import by_key, remove_path, scratch_path, shuffles_removed

K1, B = 1.2, 0.75
SCORE_DIGITS = 9
DEFAULT_BOOSTS = {"title": 2.0, "abstract": 1.0, "body": 1.0}
HIT_COLUMNS = ["title", "authors", "abstract", "body", "url", "publish_time"]
# Terms longer than this share one folder of a stored vocabulary.
MAX_LENGTH_BUCKET = 24
# Folders per field that stored postings are dealt to by the hash of their term.
TERM_BUCKETS = 32
# A document is a candidate of a query if it has so many of its rarest words.
RARE_WORDS = 5
# Columns of 64 bits that tell sets of words apart.
MARKS = 2
# Postings are placed, and many queries scored, so many at a time, within a limit as each share scans all of them.
SHARE_ROWS, MOST_SHARES = 20_000_000, 4


# ---------------------------------------------------------------- postings

def field_tokens(df: DataFrame, key: str, fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(key, field, tokens, field_len), one row per document and field, from one scan."""
    per_field = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            tokenize(F.coalesce(F.col(f), F.lit("")), 1).alias("tokens"),
        )
        for f in fields
    ])
    return df.select(key, *carry, F.inline(per_field)).withColumn("field_len", F.size("tokens"))


def build_postings(df: DataFrame, key: str, fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(key, field, term, tf, field_len): how often each term is in each field of each document.

    ``carry`` names columns of the document that every posting keeps.

    The text is shuffled once by key (fewer bytes than one row per term would be); counting the
    terms of a document then stays inside its partition.
    """
    tokens = field_tokens(by_key(df.select(key, *fields, *carry), key), key, fields, carry)
    return (
        tokens.select(key, *carry, "field", "field_len", F.explode("tokens").alias("term"))
        .groupBy(key, "field", "term")
        .agg(
            F.count("*").alias("tf"), F.first("field_len").alias("field_len"),
            *[F.first(c).alias(c) for c in carry],
        )
    )


def field_stats(postings: DataFrame, key: str) -> DataFrame:
    """(field, n_docs, avg_len) over the documents that have a word in the field."""
    return (
        postings.groupBy(key, "field").agg(F.max("field_len").alias("_len"))
        .groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("_len").alias("avg_len"))
    )


@dataclass
class SearchIndex:
    """Stored postings and vocabulary.

    ``postings`` are (key, field, term, weight, carried columns) rows in folders by field and term
    bucket; ``weight`` is the BM25 weight without its idf. ``terms`` has one (field, term, df, idf,
    bucket) row per term, in folders by field and term length.
    """

    postings: DataFrame
    terms: DataFrame
    key: str
    fields: tuple[str, ...]


def write_index(
    df: DataFrame, key: str, fields: Sequence[str], path: str,
    carry: Mapping[str, Column] | None = None, buckets: int = TERM_BUCKETS,
) -> SearchIndex:
    """Build and store an index, laid out so that a search opens only the files it needs.

    The counted postings are written out first: frequencies, statistics and weights are made from
    there, so the texts are split into words once. The idf stays with the vocabulary, where a search
    meets it anyway, so that postings are not joined to it and move once, to their folder. A search
    finds the terms it wants in the vocabulary, whose folders are by field and term length (edit
    distance bounds the length), and then opens the postings folders those terms are in. Adaptive
    execution splits large folders, so a very common term fills many files. A large table goes to its
    folders in several passes, so that only a part of its postings is shuffled at a time. ``carry`` names
    expressions over ``df`` that postings keep, for document boosts.
    """
    spark = df.sparkSession
    carry = dict(carry or {})
    counted_path = scratch_path(spark, "postings")
    counted = materialize(build_postings(df.withColumns(carry), key, fields, list(carry)), counted_path)
    length = F.least(F.length("term"), F.lit(MAX_LENGTH_BUCKET))
    bucket = F.pmod(F.hash("term"), F.lit(buckets))
    stats = materialize(field_stats(counted, key).coalesce(1))  # one row per field name given by the caller
    with shuffles_removed(spark):
        (
            counted.groupBy("field", "term").agg(F.count("*").alias("df"))
            .join(F.broadcast(stats), "field")
            .select("field", "term", "df", _idf().alias("idf"), bucket.alias("bucket"), length.alias("len_bucket"))
            .repartitionByRange("field", "len_bucket", "term")
            .sortWithinPartitions("field", "len_bucket", "term")
            .write.mode("overwrite").partitionBy("field", "len_bucket").parquet(f"{path}/terms")
        )
        passes = _shares(counted)
        for n in range(passes):
            dealt = counted.withColumn("bucket", bucket)
            (
                rebalance(
                    (dealt if passes == 1 else dealt.filter(F.col("bucket") % passes == n))
                    .join(F.broadcast(stats), "field")
                    .select(key, *carry, "field", "term", _tf_weight().alias("weight"), "bucket"),
                    "field", "bucket",
                )
                .sortWithinPartitions("field", "bucket", "term")
                .write.mode("append" if n else "overwrite").partitionBy("field", "bucket").parquet(f"{path}/postings")
            )
    remove_path(spark, counted_path)
    return load_index(spark, path, key, fields)


def _shares(stored: DataFrame) -> int:
    """How many shares stored rows are worked on in; they are counted from the files' footers."""
    return min(MOST_SHARES, 1 + stored.count() // SHARE_ROWS)


def load_index(spark: SparkSession, path: str, key: str, fields: Sequence[str]) -> SearchIndex:
    postings, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    return SearchIndex(postings, terms, key, tuple(fields))


# ---------------------------------------------------------------- scoring

def _idf() -> Column:
    df, n = F.col("df"), F.col("n_docs")
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def _tf_weight(tf: str = "tf", field_len: str = "field_len") -> Column:
    """The part of a BM25 weight that does not depend on how many documents have the term."""
    tf, field_len, avg_len = map(F.col, [tf, field_len, "avg_len"])
    return (K1 + 1) * tf / (tf + K1 * ((1 - B) + B * field_len / avg_len))


def _bm25_weight(tf: str = "tf", field_len: str = "field_len") -> Column:
    """Weight of a term in a field, from the named columns and df, n_docs and avg_len.

    It grows with tf and falls with field_len.
    """
    return _idf() * _tf_weight(tf, field_len)


def _boost(boosts: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for field, boost in boosts.items() for x in (field, float(boost))]
    return F.create_map(*pairs)[F.col("field")]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _matched_words(words: Sequence[str], fuzziness: Fuzziness) -> Column:
    """Positions of the query words that ``term`` matches."""
    tests = [
        F.when(matches_word(F.col("term"), w, allowed_edits(w, fuzziness)), F.lit(i))
        for i, w in enumerate(words)
    ]
    return F.array_compact(F.array(*tests))


def _score_documents(
    scored: DataFrame, key: Sequence[str], boosts: Mapping[str, float], operator: str
) -> DataFrame:
    """(key, score) from (key, needed, field, word_no, times, s) rows partitioned by key.

    ``needed`` is the number of words of the query. The three aggregations find their rows in
    place: being clustered by key, they are also clustered by key and field and word.
    """
    if operator not in ("AND", "OR"):
        raise ValueError(f"operator must be 'AND' or 'OR', got {operator!r}")
    best = scored.groupBy(*key, "needed", "field", "word_no", "times").agg(F.max("s").alias("s"))
    per_field = best.groupBy(*key, "needed", "field").agg(
        F.sum(F.col("s") * F.col("times")).alias("s"), F.count("*").alias("_matched")
    )
    if operator == "AND":
        per_field = per_field.filter(F.col("_matched") == F.col("needed"))
    # rounded, so that equal documents tie however their parts were added up
    score = F.round(F.max(F.col("s") * _boost(boosts)), SCORE_DIGITS)
    return per_field.groupBy(*key).agg(score.alias("score"))


def _words_of(query: str) -> tuple[list[str], list[int]]:
    counts = Counter(query_words(query))
    return list(counts), list(counts.values())


def _empty_hits(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).limit(0).select(key, F.lit(0.0).alias("score"))


def _rank_query(
    matched: DataFrame, key: str, words: Sequence[str], times: Sequence[int],
    boosts: Mapping[str, float], operator: str,
) -> DataFrame:
    """(key, score) from the postings of matching terms, ``word_nos`` being the words they match."""
    counts = F.array(*[F.lit(t) for t in times])
    scored = (
        matched.withColumn("word_no", F.explode("word_nos"))
        .select(
            key, F.lit(len(words)).alias("needed"), "field", "word_no",
            counts[F.col("word_no")].alias("times"), "s",
        )
        .repartition(key)
    )
    return _score_documents(scored, [key], boosts, operator)


def matching_scores(
    df: DataFrame, key: str, query: str, boosts: Mapping[str, float] = DEFAULT_BOOSTS,
    fuzziness: Fuzziness = "AUTO", operator: str = "AND", doc_boost: Column | None = None,
) -> DataFrame:
    """(key, score) of every document that matches, straight from the documents.

    One pass over the text: the scan keeps only the words that match the query, plus the first
    word of each field as a marker that carries the field's length. These few narrow rows are
    written out, in files of even size, and the statistics and the ranking are made from them.
    """
    words, times = _words_of(query)
    fields = list(boosts)
    if not words:
        return _empty_hits(df, key)
    hit = _any([matches_word(F.col("term"), w, allowed_edits(w, fuzziness)) for w in words])
    docs = df.withColumn("_doc_boost", F.lit(1.0) if doc_boost is None else doc_boost.cast("double"))
    tokens = field_tokens(docs.select(key, "_doc_boost", *fields), key, fields, ["_doc_boost"])
    found = materialize(rebalance(
        tokens.select(key, "_doc_boost", "field", "field_len", F.posexplode("tokens").alias("_pos", "term"))
        .select(
            key, "_doc_boost", "field", "field_len",
            F.when(hit, F.col("term")).alias("term"), (F.col("_pos") == 0).alias("_first"),
        )
        .filter(F.col("_first") | F.col("term").isNotNull())
    ))
    stats = (
        found.filter("_first").groupBy("field")
        .agg(F.count("*").alias("n_docs"), F.avg("field_len").alias("avg_len"))
    )
    matched = (
        found.filter("term IS NOT NULL").groupBy(key, "field", "term")
        .agg(
            F.count("*").alias("tf"), F.first("field_len").alias("field_len"),
            F.first("_doc_boost").alias("_doc_boost"),
        )
    )
    frequency = matched.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = (
        spread_join(matched, frequency, ["field", "term"], "df", key)
        .join(F.broadcast(stats), "field")
        .withColumn("s", _bm25_weight() * F.col("_doc_boost"))
        .withColumn("word_nos", _matched_words(words, fuzziness))
    )
    return _rank_query(scored, key, words, times, boosts, operator)


def index_scores(
    index: SearchIndex, query: str, boosts: Mapping[str, float] | None = None,
    fuzziness: Fuzziness = "AUTO", operator: str = "AND", doc_boost: Column | None = None,
) -> DataFrame:
    """(key, score) of every document that matches, from a stored index.

    The vocabulary is searched first and the terms found are written out, so that their size is
    known when they meet the postings. Only their buckets are opened; the list of these is never
    longer than the number of buckets. ``doc_boost`` may use the columns the postings carry.
    """
    boosts = dict(boosts or {f: DEFAULT_BOOSTS.get(f, 1.0) for f in index.fields})
    words, times = _words_of(query)
    if not words:
        return _empty_hits(index.postings, index.key)
    edits = [allowed_edits(w, fuzziness) for w in words]
    in_fields = F.col("field").isin(list(boosts))
    lengths = {n for w, k in zip(words, edits) for n in range(len(w) - k, len(w) + k + 1)}
    near = F.col("len_bucket").isin(sorted({min(n, MAX_LENGTH_BUCKET) for n in lengths}))
    hit = _any([matches_word(F.col("term"), w, k) for w, k in zip(words, edits)])
    terms = materialize(
        index.terms.filter(in_fields & near).filter(hit)
        .select("field", "term", "df", "idf", "bucket", _matched_words(words, fuzziness).alias("word_nos"))
    )
    wanted = sorted(r.bucket for r in terms.select("bucket").distinct().collect())
    postings = index.postings.filter(in_fields & F.col("bucket").isin(wanted)).drop("bucket")
    boost = F.lit(1.0) if doc_boost is None else doc_boost.cast("double")
    found = spread_join(postings, terms.drop("bucket"), ["field", "term"], "df", index.key)
    scored = found.withColumn("s", F.col("idf") * F.col("weight") * boost)
    return _rank_query(scored, index.key, words, times, boosts, operator)


def top_hits(scores: DataFrame, key: str, size: int = 20, offset: int = 0) -> DataFrame:
    return scores.orderBy(F.desc("score"), key).offset(offset).limit(size)


def with_columns(hits: DataFrame, df: DataFrame, key: str, columns: Sequence[str] = HIT_COLUMNS) -> DataFrame:
    """Hits with the stored columns of their documents.

    Spark knows the size of a limited page and broadcasts it by itself.
    """
    found = df.select(key, *columns).join(hits, key)
    return found.select(key, *columns, "score").orderBy(F.desc("score"), key)


def search(
    source: DataFrame | SearchIndex, query: str, key: str | None = None,
    boosts: Mapping[str, float] | None = None, fuzziness: Fuzziness = "AUTO",
    operator: str = "AND", offset: int = 0, size: int = 20, doc_boost: Column | None = None,
) -> DataFrame:
    """One page of (key, score) hits, best first, from documents or from a stored index.

    ``doc_boost`` is over the columns of the documents, or over those that the index carries.
    """
    if isinstance(source, SearchIndex):
        scores, key = index_scores(source, query, boosts, fuzziness, operator, doc_boost), source.key
    else:
        if key is None:
            raise ValueError("searching documents needs the name of their key column")
        scores = matching_scores(
            source, key, query, boosts or DEFAULT_BOOSTS, fuzziness, operator, doc_boost
        )
    return top_hits(scores, key, size, offset)


def prefer_complete(weight: float = 0.1, columns: Sequence[str] = ("abstract", "url")) -> Column:
    """A document boost for papers that have an abstract and a url."""
    filled = [F.when(F.coalesce(F.col(c), F.lit("")) != "", weight).otherwise(0.0) for c in columns]
    return reduce(lambda a, b: a + b, filled, F.lit(1.0))


def to_response(hits: DataFrame, key: str, columns: Sequence[str] = HIT_COLUMNS) -> DataFrame:
    """The JSON envelope {"status": 200, "papers": [...]} of one page of hits, best first."""
    paper = F.struct(*columns, "score")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), key, paper.alias("paper"))))
    return hits.agg(ranked.alias("r")).select(
        F.to_json(
            F.struct(F.lit(200).alias("status"), F.col("r.paper").alias("papers")),
            {"ignoreNullFields": "false"},
        ).alias("response")
    )


# ---------------------------------------------------------------- many queries

def search_batch(
    index: SearchIndex, queries: DataFrame, query_id: str, text: str,
    boosts: Mapping[str, float] | None = None, fuzziness: Fuzziness = "AUTO",
    operator: str = "AND", size: int = 20,
) -> DataFrame:
    """The best ``size`` hits of every query in a table: (query, key, score, rank).

    ``query_id`` must be unique in ``queries``.

    With ``operator="AND"`` every hit has all words of its query in one field, so it also has
    the query's rarest ones: candidates are read from the postings of those words only, and the
    other words are checked on the candidates. With "OR" every posting of a word is a hit. Either
    way postings of terms that no query reaches are left out first. A large index is scored in shares
    of its documents, one after the other, so that what is shuffled for one share is gone before the next.
    """
    key = index.key
    boosts = dict(boosts or {f: DEFAULT_BOOSTS.get(f, 1.0) for f in index.fields})
    postings = index.postings.filter(F.col("field").isin(list(boosts)))
    tokens = queries.select(query_id, tokenize(F.col(text), 1).alias("_words"))
    words = (
        tokens.select(
            query_id, F.size(F.array_distinct("_words")).alias("needed"), F.explode("_words").alias("word")
        )
        .groupBy(query_id, "needed", "word").agg(F.count("*").alias("times"))
    )
    vocabulary = index.terms.filter(F.col("field").isin(list(boosts)))
    similar = similar_terms(words.select("word").distinct(), vocabulary.select("term").distinct(), fuzziness)
    # written out, as it is used several times below and costs the fuzzy join to make
    reach = materialize(
        words.join(similar, "word").join(vocabulary, "term")
        .select(query_id, "needed", "word", "times", "field", "term", "df", "idf")
    )
    wanted = reach.groupBy("field", "term").agg(
        F.max("df").alias("df"), F.max("idf").alias("idf"), F.collect_set("word").alias("words"), *_marks("words"))
    reach = reach.drop("idf")
    postings = postings.select(key, "field", "term", "weight")
    candidates = _candidates(postings, reach, key, query_id) if operator == "AND" else None
    # Spark keeps only `size` rows per query in each task before the rows are brought together
    best_first = Window.partitionBy(query_id).orderBy(F.desc("score"), key)

    def ranked(scores: DataFrame) -> DataFrame:
        return scores.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= size)

    def of_share(df: DataFrame, share: int) -> DataFrame:
        return df if shares == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(shares)) == share)

    def scored(share: int) -> DataFrame:
        rows = of_share(postings, share)
        if candidates is not None:
            rows = sift(rows, of_share(candidates, share), [key, "field"])
        s = (F.col("idf") * F.col("weight")).alias("s")
        reached = ["words", *[f"words_{i}" for i in range(MARKS)]]
        stored = spread_join(rows, wanted, ["field", "term"], "df", key)
        matched = (
            _candidate_postings(stored.select(key, "field", *reached, s), of_share(candidates, share), reach, key, query_id)
            if candidates is not None
            else spread_join(stored.select(key, "field", "term", s), reach, ["field", "term"], "df", key)
        )
        by_word = matched.select(query_id, key, "needed", "field", F.col("word").alias("word_no"), "times", "s")
        return _score_documents(by_word.repartition(query_id, key), [query_id, key], boosts, operator)

    shares = _shares(postings)
    if shares == 1:
        return ranked(scored(0))
    found = [materialize(ranked(scored(share)).drop("rank")) for share in range(shares)]
    return ranked(reduce(DataFrame.unionByName, found))


def _candidates(postings: DataFrame, reach: DataFrame, key: str, query_id: str) -> DataFrame:
    """(query, needed, key, field) of the documents that have the rarest words of a query in a field."""
    sizes = reach.groupBy(query_id, "needed", "field", "word").agg(F.sum("df").alias("n"))
    of_query = Window.partitionBy(query_id, "needed", "field")
    # a query with a word that is nowhere in a field has no hit in that field
    rarest = (
        sizes.withColumn("_matched", F.count("*").over(of_query))
        .withColumn("_rank", F.row_number().over(of_query.orderBy("n", "word")))
        .filter((F.col("_matched") == F.col("needed")) & (F.col("_rank") <= RARE_WORDS))
        .select(query_id, "needed", "field", "word", F.call_function("shiftleft", F.lit(1), F.col("_rank") - 1).alias("_bit"))
    )
    entries = materialize(rarest.join(reach.drop("needed"), [query_id, "field", "word"]).select(
        query_id, "needed", "field", "term", "df", "_bit"
    ))
    near = sift(postings.select(key, "field", "term"), entries, ["field", "term"])
    every = F.call_function("shiftleft", F.lit(1), F.least("needed", F.lit(RARE_WORDS))) - 1
    # written out, as its size tells how to meet the postings
    return materialize(
        spread_join(near, entries, ["field", "term"], "df", key)
        .groupBy(query_id, "needed", key, "field").agg(F.bit_or("_bit").alias("_bits"))
        .filter(F.col("_bits") == every).drop("_bits")
    )


def _candidate_postings(
    stored: DataFrame, candidates: DataFrame, reach: DataFrame, key: str, query_id: str
) -> DataFrame:
    """The postings of all words of a query on its candidates.

    A posting brings the words that its term matches and a candidate the words of its query, so that
    postings of other queries' words go where the two meet, before they are shuffled.
    """
    own = reach.select(query_id, "needed", "word", "times").distinct().groupBy(query_id, "needed")
    asked = own.agg(
        F.collect_list("word").alias("_asked"), *_marks("_asked"),
        F.map_from_entries(F.collect_list(F.struct("word", "times"))).alias("_times"))
    met = candidates.join(asked, [query_id, "needed"]).join(stored, [key, "field"])
    # marks settle most pairs without a look at the words
    met = met.filter(_any([F.col(f"words_{i}").bitwiseAND(F.col(f"_asked_{i}")) != 0 for i in range(MARKS)]))
    met = met.filter(F.arrays_overlap("words", "_asked"))
    # there is a word in every row; "outer" keeps the optimizer from testing that ahead of the filters
    met = met.select("*", F.explode_outer(F.array_intersect("words", "_asked")).alias("word"))
    return met.select(query_id, key, "needed", "field", "word", F.col("_times")[F.col("word")].alias("times"), "s")


def _marks(name: str) -> list[Column]:
    """Sets of words as bits by their hash, 64 in a column: sets without a common bit have no common word."""
    place = F.pmod(F.xxhash64("word"), F.lit(64 * MARKS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    return [F.bit_or(F.when(F.floor(place / 64) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"{name}_{i}")
            for i in range(MARKS)]
