"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsearch.functions.fuzzy import similar_terms
from litsearch.functions.text import tokenize
from litsearch.operators import (
    body, clean, dedup, forward, layout, news, profile, search, segments, store, summarize, tfidf, vector,
    vector_index,
)
from litsearch.plans.views import FEEDS_SQL, paper_files, papers, table
from litsearch.sources import files, tables
from litsearch.session import scratch_path
from litsearch.streaming.frequencies import read_model, update_frequencies
from litsearch.streaming.ingest import ingest_stream, read_current

QUERY = "thing thtion"
MISSPELT_QUERY = "thign thtoin"
TITLE_QUERY = "thing erble attion"
TFIDF_QUERY = "thing thtion erble attion unheardof"
KEYWORDS = ["thing", "attion ering", "The"]
STOPWORDS = ["the", "of", "and", "to", "in", "that", "it", "he", "de", "la", "der", "die", "und", "le", "que"]
FEED_RULES = {"en": "article__chunks", "fr": "storyContent", "de": "StoryBodyCompanionColumn"}
QUERY_VECTOR = [1.0 / (i + 1) - 0.05 for i in range(64)]
CHUNK_ROWS = 1000
BATCH_BYTES = 200_000
SAMPLE_FRACTION = 0.1
SENTENCES = 2
SLICE = (1000, 2999)
SLOT_ROWS = 128


def _r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---- sources and sinks

def parquet_roundtrip(spark, d):
    return layout.materialize(clean.clean_papers(papers(spark, d)))


def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    tables.write_csv(papers(spark, d).drop("doc_id"), path)
    cols = [c for c in tables.METADATA_COLUMNS if c != "pdf_json_files"]
    return tables.read_metadata_csv(spark, path, cols)


def csv_strings(spark, d):
    path = scratch_path(spark, "csv")
    tables.write_csv(papers(spark, d).drop("body"), path)
    return tables.read_csv_as_strings(spark, path)


def embeddings_csv(spark, d):
    path = scratch_path(spark, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("string"))
    table(spark, d, "embeddings").where("embedding is not null").select(
        F.concat_ws(",", F.col("vec_id").cast("string"), F.array_join(values, ",")).alias("value")).write.text(path)
    found = tables.read_embeddings(spark, "cord19", path, "vec_id", dim=64)
    return found.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.posexplode("embedding").alias("place", "x")).select("vec_id", "place", F.round(F.col("x").cast("double"), 6).alias("x"))


def dataset_scan(spark, d):
    """A catalog table is made, filled and read whole."""
    source = table(spark, d, "events")
    path = scratch_path(spark, "dataset")
    name = "scan_" + path.rstrip("/").split("/")[-1].replace("-", "_")
    tables.create_dataset(spark, name, source.schema, path)
    source.write.insertInto(name)
    return tables.scan_all(spark, name)


def bulk_actions(spark, d):
    return files.to_bulk_actions(_docs(spark, d), "papers", "doc_id")


def bulk_actions_auto_id(spark, d):
    return files.to_bulk_actions(_docs(spark, d), "papers", doc_type="record")


def bulk_deletes(spark, d):
    return files.to_bulk_deletes(table(spark, d, "labels").filter("toxic = 1"), "papers", "doc_id")


def upsert_merge(spark, d):
    events = table(spark, d, "events")
    clicks = F.col("event_type").eqNullSafe("click")
    base = store.latest_per_key(events.filter(~clicks), ["user_id"], ["ts", "event_id"])
    return store.upsert(base, events.filter(clicks), ["user_id"], ["ts", "event_id"])


def append_union(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return store.append(_docs(spark, d).select("doc_id", "text"), turns)


def delete_by_id(spark, d):
    ids = table(spark, d, "labels").filter("toxic = 1")
    return store.delete_by_id(_docs(spark, d), ids, "doc_id")


def get_by_ids(spark, d):
    ids = table(spark, d, "labels").filter("quality = 1")
    return store.get_by_ids(_docs(spark, d), ids, "doc_id")


def embedding_dim_check(spark, d):
    return vector.dimension_report(table(spark, d, "embeddings"))


def ingest_events(spark, d):
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    sink = scratch_path(spark, "sink")
    ingest_stream(
        stream, sink, scratch_path(spark, "stream"), ["user_id"], ["ts", "event_id"]
    ).awaitTermination()
    return read_current(spark, sink, ["user_id"], ["ts", "event_id"])


# ---- filters and missing values

def papers_clean(spark, d):
    return clean.clean_papers(papers(spark, d))


def _gappy_events(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", None)
        .when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") == "view", None).otherwise(F.col("props")).alias("props"),
    )


def fill_typed(spark, d):
    return clean.fill_missing_typed(_gappy_events(spark, d))


def missing_flags(spark, d):
    return clean.missing_flags(_gappy_events(spark, d), ["value", "props"]).drop("value", "props")


def keyword_filter(spark, d):
    return clean.keyword_filter(papers(spark, d), "body", KEYWORDS).select("doc_id", "title", "abstract")


def contains_filter(spark, d):
    found = clean.contains_filter(papers(spark, d), "abstract", "thing")
    return found.select("doc_id", "abstract", "body")


def pattern_filter(spark, d):
    return clean.contains_filter(_docs(spark, d), "text", "th(ing|tion)s? ", regex=True).select("doc_id", "lang")


def point_lookup(spark, d):
    return clean.lookup_equal(_docs(spark, d), "doc_id", 42)


def news_topic_filter(spark, d):
    return news.topic_filter(_entries(spark, d), ["The", "the", "attion"])


# ---- bodies, feeds, articles

def assemble_body(spark, d):
    turns = table(spark, d, "conversations")
    fulltext = (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "turn", "text",
            F.when(F.col("role") == "user", "Abstract").otherwise(F.col("role")).alias("section"),
        ))).alias("t"))
        .select(
            F.concat(F.lit("p/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"),
            F.transform("t", lambda p: F.struct(p["text"].alias("text"), p["section"].alias("section"))).alias("body_text"),
        )
    )
    return body.assemble_body(paper_files(spark, d), fulltext, "conv_id").select("conv_id", "body")


def conversation_body(spark, d):
    return body.sections_to_text(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", ["system"])


def _entries(spark, d):
    feeds = spark.sql(FEEDS_SQL, pages=table(spark, d, "pages"))
    entry = F.transform(
        F.arrays_zip("titles", "links"),
        lambda e: F.struct(e["titles"].alias("title"), e["links"].alias("link")),
    )
    entries = news.feed_entries(feeds.select("feed", "title", entry.alias("entries")))
    return news.with_scrape_rule(entries, FEED_RULES)


def feed_entries(spark, d):
    return _entries(spark, d)


def feeds_without_rule(spark, d):
    return news.without_scrape_rule(_entries(spark, d))


def article_text(spark, d):
    return news.extract_article_text(table(spark, d, "pages")).select("page_id", "body")


def article_text_two(spark, d):
    """Pages put together with their successors: two containers in each."""
    pages = table(spark, d, "pages")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("more"))
    both = pages.join(after, "page_id").select("page_id", F.concat("html", "more").alias("html"))
    return news.extract_article_text(both).select("page_id", "body")


def article_text_nested(spark, d):
    pages = table(spark, d, "pages").withColumn("class_pattern", F.lit(""))
    return news.extract_nested_article_text(pages, container="article").select("page_id", "body")


def article_filename(spark, d):
    return papers(spark, d).select(
        "doc_id", news.article_filename(F.col("title")).alias("filename"),
        news.feed_folder(F.to_date("publish_time")).alias("folder"),
    )


def sentence_match(spark, d):
    return summarize.sentences_matching(_docs(spark, d), "doc_id", "text", "thing")


def token_truncate(spark, d):
    cut = summarize.truncate_tokens(_docs(spark, d), "text", 512)
    return cut.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def summarize_extractive(spark, d):
    return summarize.summarize_extractive(_docs(spark, d), "doc_id", "text", SENTENCES)


def infer_batches(spark, d):
    scored = summarize.infer_batches(
        _docs(spark, d).select("doc_id", "text"), ["text"], lambda: {"unit": 2},
        lambda model, batch: pd.Series(batch["text"].str.len() * model["unit"]), "prediction", "bigint",
    )
    return scored.select("doc_id", "prediction")


# ---- text and TF-IDF

def token_counts(spark, d):
    return tfidf.token_counts(_docs(spark, d), "text")


def stopword_filter(spark, d):
    kept = clean.stopword_filter(_docs(spark, d), "text", words=STOPWORDS)
    return kept.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def clean_text(spark, d):
    docs = _docs(spark, d)
    forms = tfidf.token_counts(docs, "text").filter("length(term) > 3 AND term LIKE '%s'")
    lemmas = forms.select(F.col("term").alias("form"), F.regexp_replace("term", "s$", "").alias("lemma"))
    return clean.clean_text(docs, "doc_id", "text", lemmas, stopwords=STOPWORDS).select("doc_id", "cleaned")


def term_counts(spark, d):
    return tfidf.term_counts(_docs(spark, d), "doc_id", "text")


def tfidf_idf(spark, d):
    return tfidf.fit_tfidf(_docs(spark, d), "text").select("term", "df", _r6("idf"), "n_docs")


def tfidf_incremental(spark, d):
    """All documents come with another text first, then in two batches with their own; one batch runs twice."""
    docs, path = _docs(spark, d), scratch_path(spark, "frequencies")
    odd = F.col("doc_id") % 2 == 1
    batches = [docs.withColumn("text", F.concat_ws(" ", "source", "lang")), docs.where(odd), docs.where(odd), docs.where(~odd)]
    for number, batch in zip([0, 1, 1, 2], batches, strict=True):
        update_frequencies(batch, number, path, "doc_id", "text", [])
    return read_model(spark, path).select("term", "df", _r6("idf"), "n_docs")


def _weights(spark, d):
    docs = _docs(spark, d)
    return tfidf.transform_tfidf(docs, "doc_id", "text", tfidf.fit_tfidf(docs, "text"))


def tfidf_weights(spark, d):
    return _weights(spark, d).select("doc_id", "term", _r6("weight"))


def tfidf_query_vector(spark, d):
    path = scratch_path(spark, "tfidf")
    tfidf.save_tfidf(tfidf.fit_tfidf(_docs(spark, d), "text"), path)
    model = tfidf.load_tfidf(spark, path)
    return tfidf.tfidf_query_vector(model, TFIDF_QUERY).select("term", _r6("weight"))


def tfidf_title_abstract(spark, d):
    kept = clean.clean_papers(papers(spark, d))
    parts = [
        tfidf.transform_tfidf(kept, "doc_id", col, tfidf.fit_tfidf(kept, col, STOPWORDS), STOPWORDS)
        .select("doc_id", F.lit(col).alias("field"), "term", _r6("weight"))
        for col in ("title", "abstract")
    ]
    return parts[0].unionByName(parts[1])


def _forward(spark, d):
    return forward.write_forward(_docs(spark, d), "doc_id", ["text"], scratch_path(spark, "forward"))


def forward_counts(spark, d):
    return forward.forward_term_counts(_forward(spark, d)).drop("field")


def forward_model(spark, d):
    return forward.forward_model(_forward(spark, d)).select("term", "df", _r6("idf"), "n_docs")


def forward_weights(spark, d):
    return forward.forward_weights(_forward(spark, d)).select("doc_id", "term", _r6("weight"))


def forward_title_abstract(spark, d):
    """Both columns in one pass over the papers."""
    kept = clean.clean_papers(papers(spark, d))
    index = forward.write_forward(kept, "doc_id", ["title", "abstract"], scratch_path(spark, "forward"), STOPWORDS)
    return forward.forward_weights(index).select("doc_id", "field", "term", _r6("weight"))


def forward_stats(spark, d):
    return forward.forward_stats(_forward(spark, d)).drop("field")


def forward_search(spark, d):
    return forward.forward_search(_forward(spark, d), TFIDF_QUERY, "text").select("doc_id", _r6("score"))


def tfidf_stats(spark, d):
    return tfidf.tfidf_stats(_weights(spark, d), "doc_id")


def tfidf_search(spark, d):
    docs = _docs(spark, d)
    model = layout.materialize(tfidf.fit_tfidf(docs, "text"))
    weights = tfidf.transform_tfidf(docs, "doc_id", "text", model, frequent=tfidf.frequent_terms(model))
    hits = tfidf.tfidf_search(weights, tfidf.tfidf_query_vector(model, TFIDF_QUERY), "doc_id")
    return hits.select("doc_id", _r6("score"))


# ---- search

def postings(spark, d):
    return search.build_postings(papers(spark, d), "doc_id", list(search.DEFAULT_BOOSTS))


def fuzzy_terms(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(tokenize(F.col("text"), 1)).alias("word"))
    vocabulary = _docs(spark, d).select(F.explode(F.array_distinct(tokenize(F.col("text"), 1))).alias("term"))
    return similar_terms(words.distinct(), vocabulary.distinct())


def search_fuzzy(spark, d):
    found = papers(spark, d)
    hits = search.search(found, MISSPELT_QUERY.lower(), "doc_id")
    columns = ["doc_id", *search.HIT_COLUMNS, _r6("score")]
    return search.with_columns(hits, found, "doc_id").select(*columns)


def search_exact(spark, d):
    return search.search(papers(spark, d), QUERY, "doc_id", fuzziness=0).select("doc_id", _r6("score"))


def _index(spark, d):
    fields = list(search.DEFAULT_BOOSTS)
    return search.write_index(papers(spark, d), "doc_id", fields, scratch_path(spark, "index"))


def search_indexed(spark, d):
    return search.search(_index(spark, d), QUERY).select("doc_id", _r6("score"))


def search_indexed_fuzzy(spark, d):
    return search.search(_index(spark, d), MISSPELT_QUERY).select("doc_id", _r6("score"))


def search_prefer_complete_indexed(spark, d):
    carry = {"complete": search.prefer_complete(0.5)}
    fields = list(search.DEFAULT_BOOSTS)
    index = search.write_index(papers(spark, d), "doc_id", fields, scratch_path(spark, "index"), carry)
    return search.search(index, QUERY, doc_boost=F.col("complete")).select("doc_id", _r6("score"))


def _segmented(spark, docs):
    return segments.create_index(docs, "doc_id", list(search.DEFAULT_BOOSTS), scratch_path(spark, "segments"), slot_rows=SLOT_ROWS)


def index_upsert(spark, d):
    """Papers of one language come later, of another with a longer body: the index ends up with all papers."""
    now = papers(spark, d)
    before = now.filter("journal <> 'de'").withColumn("body", F.when(F.col("journal") == "en", F.col("abstract")).otherwise(F.col("body")))
    index = segments.index_upsert(_segmented(spark, before), now.filter("journal IN ('de', 'en')"))
    return segments.search_index(index, QUERY).select("doc_id", _r6("score"))


def index_delete(spark, d):
    toxic = table(spark, d, "labels").filter("toxic = 1")
    index = segments.index_delete(_segmented(spark, papers(spark, d)), toxic)
    return segments.search_index(index, QUERY).select("doc_id", _r6("score"))


def index_compacted(spark, d):
    """Papers come in batches, the Spanish ones twice; some are deleted, then all is merged."""
    now = papers(spark, d)
    spanish = now.filter("journal = 'es'")
    index = _segmented(spark, now.filter("journal NOT IN ('fr', 'de', 'es') OR journal IS NULL"))
    for batch in (now.filter("journal IN ('fr', 'de')"), spanish.withColumn("body", F.col("title")), spanish):
        index = segments.index_upsert(index, batch)
    index = segments.index_delete(index, table(spark, d, "labels").filter("toxic = 1"))
    return segments.search_index(segments.compact_index(index, all_segments=True), MISSPELT_QUERY).select("doc_id", _r6("score"))


def index_top(spark, d):
    index = _segmented(spark, papers(spark, d))
    return segments.search_index(index, QUERY, operator="OR", offset=5, size=30).select("doc_id", _r6("score"))


def search_title(spark, d):
    hits = search.search(papers(spark, d), TITLE_QUERY, "doc_id", {"title": 1}, 0, "OR")
    return hits.select("doc_id", _r6("score"))


def match_all(spark, d):
    return store.match_all(_docs(spark, d), "doc_id", 20)


def search_paged(spark, d):
    return search.search(papers(spark, d), QUERY, "doc_id", offset=20, size=30).select("doc_id", _r6("score"))


def search_response(spark, d):
    found = papers(spark, d)
    hits = search.search(found, QUERY, "doc_id").select("doc_id", _r6("score"))
    whole = search.with_columns(hits, found, "doc_id")
    return search.to_response(whole, "doc_id")


def search_prefer_complete(spark, d):
    hits = search.search(papers(spark, d), QUERY, "doc_id", doc_boost=search.prefer_complete(0.5))
    return hits.select("doc_id", _r6("score"))


def search_batch(spark, d):
    hits = search.search_batch(_index(spark, d), table(spark, d, "benchmark"), "item_id", "text")
    return hits.select("item_id", "doc_id", _r6("score"), "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


def vector_search(spark, d):
    return vector.vector_search(_vectors(spark, d), QUERY_VECTOR, "doc_id").select("doc_id", _r6("score"))


def vector_search_indexed(spark, d):
    index = vector_index.write_vectors(_vectors(spark, d), "doc_id", scratch_path(spark, "vectors"), folders=16)
    return vector_index.search_vectors(index, QUERY_VECTOR).select("doc_id", _r6("score"))


def vector_rerank(spark, d):
    hits = search.search(papers(spark, d), QUERY, "doc_id", size=50)
    return vector.rerank(hits, _vectors(spark, d), QUERY_VECTOR, "doc_id").select("doc_id", _r6("score"))


# ---- duplicates and profiles

def dup_groups(spark, d):
    return dedup.duplicate_groups(_docs(spark, d), ["text"], "doc_id")


def dup_members(spark, d):
    return dedup.duplicate_members(_docs(spark, d), ["text"], "doc_id")


def dedup_first(spark, d):
    return dedup.drop_duplicates(_docs(spark, d), ["text"], "doc_id", "first")


def dedup_none(spark, d):
    return dedup.drop_duplicates(_docs(spark, d), ["text"], "doc_id", "none")


def dedup_two_keys(spark, d):
    return dedup.dedup_report(_docs(spark, d), ["lang", "source"], "none")


def dedup_report(spark, d):
    return dedup.dedup_report(_docs(spark, d), ["text"])


def dedup_repeated_ids(spark, d):
    return dedup.drop_repeated_ids(table(spark, d, "events"), "user_id", "event_id")


def count_all(spark, d):
    return profile.shape(_docs(spark, d))


def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "events"), "event_type")


def null_columns(spark, d):
    return profile.null_columns(papers(spark, d))


def null_report(spark, d):
    return profile.null_report(_gappy_events(spark, d))


def null_cells(spark, d):
    return profile.null_cells(papers(spark, d), "doc_id")


def size_report(spark, d):
    return profile.size_report(_docs(spark, d))


def partition_total(spark, d):
    parts = profile.partition_report(layout.repartition_fixed(_docs(spark, d), 30))
    return parts.agg(F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"))


# ---- layout

def chunk_rows(spark, d):
    return layout.with_chunk_id(table(spark, d, "orders"), ["o_orderkey"], CHUNK_ROWS).select("o_orderkey", "chunk_id")


def chunk_bytes(spark, d):
    batches = layout.with_byte_batches(_docs(spark, d), ["doc_id"], BATCH_BYTES, F.octet_length("text"))
    return batches.select("doc_id", "batch_id", "oversize")


def row_slice(spark, d):
    return layout.row_slice(table(spark, d, "orders"), ["o_orderkey"], *SLICE)


def sample_rows(spark, d):
    return layout.sample_rows(table(spark, d, "events"), "event_id", SAMPLE_FRACTION, 7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        search_fuzzy, search_exact, search_indexed, search_indexed_fuzzy, search_title, search_paged, search_response,
        search_prefer_complete, search_prefer_complete_indexed, search_batch,
        index_upsert, index_delete, index_compacted, index_top, match_all, fuzzy_terms, postings, vector_search, vector_search_indexed,
        vector_rerank, forward_search, forward_weights, forward_title_abstract, forward_counts, forward_model, forward_stats,
        tfidf_search, tfidf_idf, tfidf_weights, tfidf_query_vector,
        tfidf_title_abstract, tfidf_stats, token_counts, term_counts, stopword_filter, clean_text,
        papers_clean, fill_typed, missing_flags, keyword_filter, contains_filter, pattern_filter,
        point_lookup, news_topic_filter, assemble_body, conversation_body, feed_entries,
        feeds_without_rule, article_text, article_text_two, article_text_nested, article_filename, sentence_match,
        token_truncate, summarize_extractive, infer_batches, parquet_roundtrip, csv_roundtrip,
        csv_strings, embeddings_csv, dataset_scan, tfidf_incremental,
        bulk_actions, bulk_actions_auto_id, bulk_deletes, upsert_merge, append_union, delete_by_id,
        get_by_ids, embedding_dim_check, ingest_events, dup_groups, dup_members, dedup_first,
        dedup_none, dedup_two_keys, dedup_report, dedup_repeated_ids, count_all, value_counts,
        null_columns, null_report, null_cells, size_report, partition_total, chunk_rows,
        chunk_bytes, row_slice, sample_rows,
    )
}
