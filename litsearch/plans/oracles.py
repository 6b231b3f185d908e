"""The same queries in DuckDB SQL, for checking results."""

from __future__ import annotations

from collections import Counter

from litsearch.functions.fuzzy import allowed_edits, query_words
from litsearch.functions.text import HTML_ENTITIES, WHITESPACE
from litsearch.operators.clean import PRONOUNS
from litsearch.operators.news import BLOCK_TAGS
from litsearch.plans import queries as q
from litsearch.plans.views import FEEDS_SQL, PAPER_FILES_SQL, PAPERS_SQL

PAPERS = PAPERS_SQL.format(documents="documents")
PAPER_FILES = PAPER_FILES_SQL.format(conversations="conversations")
FEEDS = FEEDS_SQL.format(pages="pages")
FIELDS = {"title": 2.0, "abstract": 1.0, "body": 1.0}

# DuckDB's edit distance counts bytes, so the letters beyond ASCII in the tables are written as
# capitals, which lower-cased terms do not use.
ASCII = "translate({0}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
NEAR = ("CASE WHEN abs(length(ascii) - length({0})) <= k THEN damerau_levenshtein(ascii, {0}) <= k"
        " ELSE false END")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def tok(col: str, n: int = 2) -> str:
    return f"regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]{{{n},}}')"


def list_if(col: str, words) -> str:
    return f"list_filter({col}, lambda t: NOT list_contains([{lits(words)}], t))"


KEPT = f"""SELECT doc_id, cord_uid, title, authors, coalesce(abstract, '') AS abstract, publish_time,
  coalesce(url, '') AS url, journal, body FROM ({PAPERS}) p
WHERE title IS NOT NULL AND (abstract IS NOT NULL OR url IS NOT NULL)
  AND authors IS NOT NULL AND publish_time IS NOT NULL"""


# ---- search

def post_ctes(fields=FIELDS) -> str:
    toks = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, unnest({tok(f'coalesce({f}, chr(32))', 1)}) AS term FROM papers"
        for f in fields
    )
    return f"""papers AS ({PAPERS}),
toks AS ({toks}),
post AS (SELECT doc_id, field, term, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT doc_id, field, cast(sum(tf) AS bigint) AS field_len FROM post GROUP BY ALL),
stats AS (SELECT field, count(*) AS n, avg(field_len) AS avg_len FROM lens GROUP BY ALL),
freq AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
vocab AS (SELECT term, {ASCII.format('term')} AS ascii FROM (SELECT DISTINCT term FROM post) v)"""


BM25 = ("ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf"
        " / (tf + 1.2 * (0.25 + 0.75 * field_len / avg_len))")


def scores_cte(query: str, fields=FIELDS, fuzziness="AUTO", operator="AND", doc_boost="1.0") -> str:
    words = Counter(query_words(query))
    rows = ", ".join(f"({lit(w)}, {allowed_edits(w, fuzziness)}, {n})" for w, n in words.items())
    having = f"HAVING count(*) = {len(words)}" if operator == "AND" else ""
    boosts = ", ".join(f"({lit(f)}, {b})" for f, b in fields.items())
    return f"""WITH {post_ctes(fields)},
words AS (SELECT * FROM (VALUES {rows}) v(word, k, times)),
boosts AS (SELECT * FROM (VALUES {boosts}) v(field, boost)),
near AS (SELECT word, times, term FROM vocab, words WHERE {NEAR.format('word')}),
best AS (SELECT doc_id, field, word, times, max({BM25} * ({doc_boost})) AS s
  FROM post JOIN near USING (term) JOIN lens USING (doc_id, field) JOIN stats USING (field)
  JOIN freq USING (field, term) JOIN papers USING (doc_id) GROUP BY ALL),
per_field AS (SELECT doc_id, field, sum(s * times) AS s FROM best GROUP BY ALL {having}),
scores AS (SELECT doc_id, round(max(s * boost), 9) AS score FROM per_field JOIN boosts USING (field)
  GROUP BY doc_id)"""


def page(size: int, offset: int = 0) -> str:
    return f"SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT {size} OFFSET {offset}"


def hits(query: str, size: int = 20, offset: int = 0, **kw) -> str:
    return f"{scores_cte(query, **kw)} SELECT doc_id, round(score, 6) AS score FROM ({page(size, offset)}) h"


ORACLES: dict[str, str] = {}

ORACLES["search_fuzzy"] = f"""{scores_cte(q.MISSPELT_QUERY)}
SELECT doc_id, title, authors, abstract, body, url, publish_time, round(score, 6) AS score
FROM ({page(20)}) h JOIN papers USING (doc_id)"""
ORACLES["search_exact"] = hits(q.QUERY, fuzziness=0)
ORACLES["search_indexed"] = hits(q.QUERY)
ORACLES["search_indexed_fuzzy"] = hits(q.MISSPELT_QUERY)
ORACLES["index_upsert"] = hits(q.QUERY)
# the papers that a delete by the toxic ids leaves
LEFT = f"SELECT * FROM ({PAPERS}) p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
ORACLES["index_delete"] = hits(q.QUERY).replace(f"papers AS ({PAPERS})", f"papers AS ({LEFT})")
ORACLES["index_compacted"] = hits(q.MISSPELT_QUERY).replace(f"papers AS ({PAPERS})", f"papers AS ({LEFT})")
ORACLES["index_top"] = hits(q.QUERY, 30, 5, operator="OR")
ORACLES["search_title"] = hits(q.TITLE_QUERY, fields={"title": 1.0}, fuzziness=0, operator="OR")
ORACLES["search_paged"] = hits(q.QUERY, 30, 20)
ORACLES["search_prefer_complete"] = hits(
    q.QUERY,
    doc_boost="1 + CASE WHEN coalesce(abstract, '') <> '' THEN 0.5 ELSE 0 END"
              " + CASE WHEN coalesce(url, '') <> '' THEN 0.5 ELSE 0 END",
)
ORACLES["search_prefer_complete_indexed"] = ORACLES["search_prefer_complete"]
ORACLES["search_response"] = f"""{scores_cte(q.QUERY)},
hits AS (SELECT doc_id, round(score, 6) AS score FROM ({page(20)}) h)
SELECT concat('{{"status":200,"papers":[', string_agg(cast(to_json({{
  'title': title, 'authors': authors, 'abstract': abstract, 'body': body, 'url': url,
  'publish_time': publish_time, 'score': score}}) AS varchar), ',' ORDER BY score DESC, doc_id), ']}}') AS response
FROM hits JOIN papers USING (doc_id)"""
ORACLES["search_batch"] = f"""WITH {post_ctes()},
words AS (SELECT item_id, word, count(*) AS times,
  CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS k
  FROM (SELECT item_id, unnest({tok('text', 1)}) AS word FROM benchmark) b GROUP BY ALL),
needed AS (SELECT item_id, count(*) AS needed FROM words GROUP BY ALL),
near AS (SELECT word, term FROM vocab, (SELECT DISTINCT word, k, {ASCII.format('word')} AS ascii_word FROM words) w
  WHERE {NEAR.format('ascii_word')}),
boosts AS (SELECT * FROM (VALUES ('title', 2.0), ('abstract', 1.0), ('body', 1.0)) v(field, boost)),
scored AS (SELECT doc_id, field, term, {BM25} AS s FROM post JOIN lens USING (doc_id, field)
  JOIN stats USING (field) JOIN freq USING (field, term)),
by_word AS (SELECT doc_id, field, word, max(s) AS s FROM scored JOIN near USING (term) GROUP BY ALL),
per_field AS (SELECT item_id, doc_id, field, sum(s * times) AS s, count(*) AS c
  FROM by_word JOIN words USING (word) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, round(max(s * boost), 9) AS score
  FROM per_field JOIN needed USING (item_id) JOIN boosts USING (field) WHERE c = needed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, doc_id, round(score, 6) AS score, cast(rank AS int) AS rank FROM ranked WHERE rank <= 20"""
ORACLES["match_all"] = "SELECT * FROM documents ORDER BY doc_id LIMIT 20"
ORACLES["fuzzy_terms"] = f"""WITH words AS (SELECT word, {ASCII.format('word')} AS ascii_word,
  CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS k
  FROM (SELECT DISTINCT unnest({tok('text', 1)}) AS word FROM benchmark) b),
vocab AS (SELECT term, {ASCII.format('term')} AS ascii FROM (
  SELECT DISTINCT unnest({tok('text', 1)}) AS term FROM documents) v)
SELECT word, term FROM vocab, words WHERE {NEAR.format('ascii_word')}"""
ORACLES["postings"] = f"""WITH {post_ctes()}
SELECT doc_id, field, term, tf, cast(field_len AS int) AS field_len FROM post JOIN lens USING (doc_id, field)"""

VECTOR = "[" + ", ".join(f"cast({v!r} AS double)" for v in q.QUERY_VECTOR) + "]"
COSINE = f"list_cosine_similarity(cast(embedding AS double[]), {VECTOR})"
ORACLES["vector_search"] = f"""SELECT vec_id AS doc_id, round({COSINE} + 1, 6) AS score
FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 20"""
ORACLES["vector_search_indexed"] = ORACLES["vector_search"]
ORACLES["vector_rerank"] = f"""{scores_cte(q.QUERY)}
SELECT h.doc_id, round({COSINE} + 1, 6) AS score
FROM ({page(50)}) h LEFT JOIN embeddings e ON e.vec_id = h.doc_id"""


# ---- TF-IDF and text

def tfidf_ctes(source: str, col: str, name: str = "", stopwords=()) -> str:
    words = tok(f"coalesce({col}, '')")
    words = list_if(words, stopwords) if stopwords else words
    return f"""tf{name} AS (SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({words}) AS term FROM ({source}) s) t GROUP BY ALL),
n{name} AS (SELECT count(*) AS n_docs FROM ({source}) s),
idf{name} AS (SELECT term, count(*) AS df, ln((1 + n_docs) / (1 + count(*))) + 1 AS idf, n_docs
  FROM tf{name}, n{name} GROUP BY term, n_docs),
raw{name} AS (SELECT doc_id, term, tf * idf AS x FROM tf{name} JOIN idf{name} USING (term)),
weights{name} AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw{name})"""


def query_cte() -> str:
    rows = ", ".join(f"({lit(w)}, {n})" for w, n in Counter(query_words(q.TFIDF_QUERY)).items())
    return f"""q0 AS (SELECT term, n * idf AS x FROM (VALUES {rows}) v(term, n) JOIN idf USING (term)),
qv AS (SELECT term, x / sqrt(sum(x * x) OVER ()) AS weight FROM q0)"""


DOCS = "SELECT doc_id, text FROM documents"
ORACLES["token_counts"] = f"""SELECT term, count(*) AS n
FROM (SELECT unnest({tok('text')}) AS term FROM documents) t GROUP BY term"""
ORACLES["term_counts"] = f"WITH {tfidf_ctes(DOCS, 'text')} SELECT * FROM tf"
ORACLES["tfidf_idf"] = f"WITH {tfidf_ctes(DOCS, 'text')} SELECT term, df, round(idf, 6) AS idf, n_docs FROM idf"
ORACLES["tfidf_incremental"] = ORACLES["tfidf_idf"]
ORACLES["tfidf_weights"] = f"""WITH {tfidf_ctes(DOCS, 'text')}
SELECT doc_id, term, round(weight, 6) AS weight FROM weights"""
ORACLES["tfidf_stats"] = f"""WITH {tfidf_ctes(DOCS, 'text')}
SELECT count(DISTINCT term) AS n_terms, count(*) AS n_values, 8 * count(*) AS value_bytes FROM weights"""
ORACLES["tfidf_query_vector"] = f"""WITH {tfidf_ctes(DOCS, 'text')}, {query_cte()}
SELECT term, round(weight, 6) AS weight FROM qv"""
ORACLES["tfidf_search"] = f"""WITH {tfidf_ctes(DOCS, 'text')}, {query_cte()}
SELECT doc_id, round(score, 6) AS score FROM (
  SELECT w.doc_id, round(sum(w.weight * coalesce(qv.weight, 0)), 9) AS score
  FROM weights w LEFT JOIN qv USING (term) GROUP BY w.doc_id ORDER BY score DESC, w.doc_id LIMIT 10) s"""
ORACLES["tfidf_title_abstract"] = f"""WITH kept AS ({KEPT}),
{tfidf_ctes('SELECT * FROM kept', 'title', '_t', q.STOPWORDS)},
{tfidf_ctes('SELECT * FROM kept', 'abstract', '_a', q.STOPWORDS)}
SELECT doc_id, 'title' AS field, term, round(weight, 6) AS weight FROM weights_t
UNION ALL SELECT doc_id, 'abstract' AS field, term, round(weight, 6) AS weight FROM weights_a"""
for name, same in {"counts": "term_counts", "model": "tfidf_idf", "weights": "tfidf_weights", "stats": "tfidf_stats",
                   "search": "tfidf_search", "title_abstract": "tfidf_title_abstract"}.items():
    ORACLES[f"forward_{name}"] = ORACLES[same]
ORACLES["stopword_filter"] = f"""SELECT doc_id,
  array_to_string({list_if(tok('text'), q.STOPWORDS)}, ' ') AS tokens FROM documents"""
ORACLES["clean_text"] = f"""SELECT doc_id, array_to_string(list_transform(
  {list_if(tok('text', 1), sorted(set(q.STOPWORDS) | set(PRONOUNS)))},
  lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, -1) ELSE t END), ' ') AS cleaned FROM documents"""
ORACLES["token_truncate"] = f"""SELECT doc_id,
  array_to_string(list_slice({tok('text', 1)}, 1, 512), ' ') AS tokens FROM documents"""

SENTENCES = """(SELECT doc_id, generate_subscripts(string_split(text, '.'), 1) - 1 AS sentence_no,
  unnest(string_split(text, '.')) AS sentence FROM documents)"""
ORACLES["sentence_match"] = f"""SELECT doc_id, cast(sentence_no AS int) AS sentence_no, sentence
FROM {SENTENCES} s WHERE contains(sentence, 'thing')"""
STRIP = "trim({0}, " + lit(WHITESPACE) + ")"
ORACLES["summarize_extractive"] = f"""WITH {tfidf_ctes(DOCS, 'text')},
s AS {SENTENCES},
t AS (SELECT doc_id, sentence_no, unnest({tok('sentence')}) AS term FROM s),
c AS (SELECT doc_id, sentence_no, term, count(*) AS c FROM t GROUP BY ALL),
tfs AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, term) AS tf_in_sentences FROM c),
scored AS (SELECT doc_id, sentence_no, round(sum(c * tf_in_sentences * idf) / sum(c), 9) AS score
  FROM tfs JOIN idf USING (term) GROUP BY ALL),
picked AS (SELECT * FROM scored QUALIFY row_number() OVER (
  PARTITION BY doc_id ORDER BY score DESC, sentence_no) <= {q.SENTENCES}),
joined AS (SELECT doc_id, concat(string_agg({STRIP.format('sentence')}, '. ' ORDER BY sentence_no), '.') AS summary
  FROM picked JOIN s USING (doc_id, sentence_no) GROUP BY doc_id)
SELECT doc_id, coalesce(summary, '') AS summary FROM documents LEFT JOIN joined USING (doc_id)"""
ORACLES["infer_batches"] = "SELECT doc_id, 2 * length(text) AS prediction FROM documents"


# ---- filters and missing values

ORACLES["papers_clean"] = ORACLES["parquet_roundtrip"] = KEPT
NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'n/a', 'nan', 'null')"
ORACLES["csv_roundtrip"] = "SELECT " + ", ".join(
    f"CASE WHEN {c} IN {NA} THEN NULL ELSE {c} END AS {c}"
    for c in ("cord_uid", "title", "authors", "abstract", "publish_time", "url", "journal")
) + f" FROM ({PAPERS}) p"
GAPPY = """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click'
  THEN cast('NaN' AS double) ELSE value END AS value,
  CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events"""
ORACLES["fill_typed"] = f"""SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN -1 ELSE value END AS value,
  coalesce(props, '') AS props FROM ({GAPPY}) g"""
ORACLES["missing_flags"] = f"""SELECT event_id, value IS NULL OR isnan(value) AS value_missing,
  props IS NULL AS props_missing FROM ({GAPPY}) g"""
ORACLES["keyword_filter"] = f"""SELECT doc_id, title, abstract FROM ({PAPERS}) p WHERE list_has_any(
  list_transform(string_split(body, ' '), lambda w: {STRIP.format('lower(w)')}), ['thing', 'attion', 'ering', 'The'])"""
ORACLES["contains_filter"] = f"SELECT doc_id, abstract, body FROM ({PAPERS}) p WHERE contains(abstract, 'thing')"
ORACLES["pattern_filter"] = "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, 'th(ing|tion)s? ')"
ORACLES["point_lookup"] = "SELECT * FROM documents WHERE doc_id = 42"


# ---- bodies, feeds, articles

ORACLES["assemble_body"] = f"""WITH files AS ({PAPER_FILES}),
paragraphs AS (SELECT concat('p/', cast(conv_id AS varchar), '.json') AS path,
  string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations WHERE role <> 'user' GROUP BY conv_id),
wanted AS (SELECT conv_id, generate_subscripts(string_split(pdf_json_files, '; '), 1) AS pos,
  unnest(string_split(pdf_json_files, '; ')) AS path FROM files),
winner AS (SELECT conv_id, arg_min(body, pos) AS body FROM wanted JOIN paragraphs USING (path) GROUP BY conv_id)
SELECT conv_id, coalesce(body, '') AS body FROM files LEFT JOIN winner USING (conv_id)"""
ORACLES["conversation_body"] = """SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn)
  FILTER (WHERE role <> 'system'), '') AS body FROM conversations GROUP BY conv_id"""
RULE = "CASE feed " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in q.FEED_RULES.items()) + " END"
ENTRIES = f"""SELECT feed, feed_title, title, link, {RULE} AS class_pattern FROM (
  SELECT feed, title AS feed_title, unnest(titles) AS title, unnest(links) AS link FROM ({FEEDS}) f) e"""
ORACLES["feed_entries"] = ENTRIES
ORACLES["feeds_without_rule"] = f"SELECT feed, count(*) AS n FROM ({ENTRIES}) x WHERE class_pattern IS NULL GROUP BY feed"
ORACLES["news_topic_filter"] = f"""SELECT * FROM ({ENTRIES}) x WHERE list_has_any(
  list_transform(string_split(title, ' '), lambda w: {STRIP.format('lower(w)')}), ['The', 'the', 'attion'])"""


def entities(col: str) -> str:
    for entity, char in HTML_ENTITIES:
        col = f"replace({col}, {lit(entity)}, {lit(char)})"
    return col


PARAGRAPH = entities(
    f"regexp_replace(regexp_replace(p, '(?is)(</p\\s*>|<({'|'.join(BLOCK_TAGS)})\\b).*$', ''), '(?s)<[^>]*>', '', 'g')"
)
ORACLES["article_text"] = ORACLES["article_text_nested"] = f"""WITH a AS (SELECT page_id,
  regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, flatten(list_transform(
  regexp_extract_all(h, '(?is)<article\\b[^>]*>(.*?)(</article\\s*>|$)', 1),
  lambda c: regexp_split_to_array(c, '(?i)<p(\\s[^>]*)?>')[2:])) AS ps FROM a)
SELECT page_id, coalesce(array_to_string(list_transform(ps, lambda p: {PARAGRAPH} || chr(10)), ''), '') AS body FROM b"""
ORACLES["article_text_two"] = f"""WITH one AS ({ORACLES["article_text"]})
SELECT a.page_id, concat(a.body, b.body) AS body FROM one a JOIN one b ON b.page_id = a.page_id + 1"""
ORACLES["article_filename"] = f"""SELECT doc_id, replace(replace(title, ' ', '_'), '/', '_') || '.txt' AS filename,
  CASE WHEN publish_time IS NULL THEN NULL ELSE 'rss_feeds_' || strftime(cast(publish_time AS date), '%m-%d-%Y') END AS folder
FROM ({PAPERS}) p"""


# ---- writes by key

def doc_json(action: str) -> str:
    return f"""SELECT concat({action}, chr(10), cast(to_json({{'doc_id': doc_id, 'text': text, 'lang': lang,
  'source': source, 'n_chars': n_chars}}) AS varchar)) AS value FROM documents"""


ORACLES["bulk_actions"] = doc_json(
    """'{"index":{"_index":"papers","_id":"' || doc_id || '"}}'"""
)
ORACLES["bulk_actions_auto_id"] = doc_json("""'{"index":{"_index":"papers","_type":"record"}}'""")
ORACLES["bulk_deletes"] = """SELECT '{"delete":{"_index":"papers","_id":"' || doc_id || '"}}' AS value
FROM labels WHERE toxic = 1"""
LATEST = "SELECT * FROM events WHERE {0} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
ORACLES["upsert_merge"] = f"""WITH base AS ({LATEST.format("event_type IS DISTINCT FROM 'click'")}),
upd AS ({LATEST.format("event_type = 'click'")})
SELECT * FROM upd UNION ALL SELECT * FROM base WHERE user_id NOT IN (SELECT user_id FROM upd)"""
ORACLES["append_union"] = "SELECT doc_id, text FROM documents UNION ALL SELECT conv_id, text FROM conversations"
ORACLES["delete_by_id"] = "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
ORACLES["get_by_ids"] = "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
ORACLES["embedding_dim_check"] = "SELECT cast(len(embedding) AS int) AS dim, count(*) AS n FROM embeddings GROUP BY 1"
ORACLES["ingest_events"] = LATEST.format("true")


# ---- duplicates and profiles

KEY = "md5(coalesce(concat(length(text), ':', text), '-'))"
GROUPS = f"SELECT {KEY} AS key_hash, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY 1"
ORACLES["dup_groups"] = f"{GROUPS} HAVING count(*) > 1"
ORACLES["dup_members"] = f"""SELECT {KEY} AS key_hash, doc_id FROM documents
WHERE {KEY} IN (SELECT key_hash FROM ({GROUPS}) g WHERE n_docs > 1)"""
ORACLES["dedup_first"] = "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
ORACLES["dedup_none"] = "SELECT * FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1"
REPORT = "SELECT cast(sum(n) AS bigint) AS n_before, {1} AS n_after FROM (SELECT count(*) AS n FROM documents GROUP BY {0}) g"
ORACLES["dedup_report"] = REPORT.format("text", "count(*)")
ORACLES["dedup_two_keys"] = REPORT.format("lang, source", "count(*) FILTER (WHERE n = 1)")
ORACLES["dedup_repeated_ids"] = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"
ORACLES["count_all"] = "SELECT count(*) AS n_rows, cast(5 AS int) AS n_cols FROM documents"
ORACLES["value_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
PAPER_COLUMNS = "doc_id cord_uid title authors abstract publish_time url journal body".split()
CELLS = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS \"column\" FROM ({PAPERS}) p WHERE {c} IS NULL" for c in PAPER_COLUMNS[1:]
)
ORACLES["null_cells"] = CELLS
ORACLES["null_columns"] = f"SELECT DISTINCT \"column\" FROM ({CELLS}) c"
ORACLES["null_report"] = f"""WITH g AS ({GAPPY})
SELECT 'event_id' AS "column", count(*) FILTER (WHERE event_id IS NULL) AS n_missing FROM g
UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL OR isnan(value)) FROM g
UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL) FROM g"""
ORACLES["size_report"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", cast(sum(strlen({c})) AS bigint) AS bytes FROM documents"
    for c in ("text", "lang", "source")
)
ORACLES["partition_total"] = """SELECT count(*) AS n_rows,
  cast(sum(strlen(text) + strlen(lang) + strlen(source)) AS bigint) AS bytes FROM documents"""


# ---- layout

ORACLES["chunk_rows"] = f"""SELECT o_orderkey,
  (row_number() OVER (ORDER BY o_orderkey) - 1) // {q.CHUNK_ROWS} AS chunk_id FROM orders"""
# steps from each batch's first row to the first row that no longer fits; blocks are 16 limits long
ORACLES["chunk_bytes"] = f"""WITH RECURSIVE s AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS b, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
r AS (SELECT *, sum(b) OVER (ORDER BY n) AS upto, (sum(b + 1) OVER (ORDER BY n) - b - 1) // {16 * q.BATCH_BYTES} AS block FROM s),
starts(block, first) AS (
  SELECT block, min(n) FROM r GROUP BY block
  UNION ALL
  SELECT t.block, min(x.n) FROM starts t JOIN r f ON f.n = t.first
  JOIN r x ON x.block = t.block AND x.n > t.first AND x.upto - (f.upto - f.b) > {q.BATCH_BYTES}
  GROUP BY t.block, t.first)
SELECT r.doc_id, cast(max(t.first) AS bigint) AS batch_id, any_value(r.b) > {q.BATCH_BYTES} AS oversize
FROM r JOIN starts t ON t.block = r.block AND t.first <= r.n GROUP BY r.doc_id"""
ORACLES["row_slice"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) o
WHERE rn BETWEEN {q.SLICE[0]} AND {q.SLICE[1]}"""
ORACLES["sample_rows"] = f"""SELECT * FROM events
WHERE cast(concat('0x', substring(md5(concat('7:', cast(event_id AS varchar))), 1, 8)) AS bigint) < {int(q.SAMPLE_FRACTION * 2**32)}"""
ORACLES["csv_strings"] = f"""SELECT cast(doc_id AS varchar) AS doc_id, * EXCLUDE (doc_id, body) FROM ({PAPERS}) p"""
ORACLES["embeddings_csv"] = """
SELECT vec_id, cast(place - 1 AS integer) AS place, round(cast(embedding[place] AS double), 6) AS x
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS place FROM embeddings WHERE embedding IS NOT NULL) e"""
ORACLES["dataset_scan"] = "SELECT * FROM events"
