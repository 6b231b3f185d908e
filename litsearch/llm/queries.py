"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.llm.common import table
from litsearch.llm.context_tree import score_documents
from litsearch.llm.conversation_repair import repair_digests
from litsearch.llm.lattice_dedup import near_duplicates
from litsearch.llm.ngram_join import jaccard_classes
from litsearch.llm.packing import pack_power_of_two
from litsearch.llm.pii import find_digests
from litsearch.llm.piece_counts import count_tokens
from litsearch.llm.piece_encoding import encode_digests
from litsearch.llm.resharding import reshard
from litsearch.llm.toxicity import score_toxicity
from litsearch.llm.url_filter import judge_urls
from litsearch.llm.whitening import whiten
from litsearch.llm.winnowing import compare_edited


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_digests(table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_power_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", F.array_join("patterns", ",").alias("patterns"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_lattice_dedup, op2_pii, op3_winnowing, op4_packing, op5_toxicity, op6_resharding, op7_ngram_join,
    op8_piece_encoding, op9_context_tree, op10_url_filter, op11_conversation_repair, op12_whitening, op13_token_counts)}

ORACLES = {
    "op10_url_filter": r"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS url, coalesce(url, '') AS raw,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
patterns(name, pattern) AS (VALUES
  ('spam_farm', '://([^/?#]*[.-])?spam-?farm[.:/]'),
  ('pill_shop', '://[^/?#]*\b(cheap|online|discount)-pills\b'),
  ('casino', '://[^/?#]*\bcasino\b'), ('poker', '://[^/?#]*\bpoker\b'),
  ('adult', '://[^/?#]*\b(xxx|porn)\b'),
  ('free_download', '/free-download\b'),
  ('ad_server', '://(ads?|adserver|banners?)\.'),
  ('doubleclick', '://[^/?#]*\bdoubleclick\.'),
  ('login', '/(wp-login|login|signin)(\.\w+)?([/?#]|$)'),
  ('session_id', '[?&;](phpsessid|jsessionid)='),
  ('calendar', '/calendar/\d{4}/\d{2}\b'),
  ('replytocom', '[?&]replytocom=\d+')),
fired AS (
  SELECT page_id, string_agg(name, ',' ORDER BY name) AS patterns
  FROM parts, patterns
  WHERE regexp_matches(url, pattern)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.rule_verdict, CASE WHEN x.patterns IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(x.patterns, '') AS patterns
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN fired x USING (page_id)
""",
    # the search as dynamic programming: the best path to each state after each row, inserts before the row
    "op11_conversation_repair": r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(256) r(b))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS key
  FROM conversations),
summed AS (
  SELECT keyed.*, xor(4294967295, list_reduce(
           list_transform(range(1, length(key) + 1), lambda i: cast(ord(substring(key, i, 1)) AS bigint)),
           lambda a, x: xor(a >> 8, t[xor(a % 256, x) + 1]), cast(4294967295 AS bigint))) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed),
placed AS (
  SELECT *, row_number() OVER w AS i, lead(role) OVER w AS next_role, count(*) OVER (PARTITION BY conv_id) AS n
  FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 256), sha256(text), copy)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (next_role IS NOT NULL AND left(role, 1) || left(next_role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- what up to two inserted turns do to a state (0 nothing, 1 system, 2 user, 3 assistant)
inserts(q, k, q2, lines) AS (VALUES
  (0, 0, 0, []), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []),
  (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
  (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])),
moves(q, letter, initial, q2, role) AS (VALUES
  (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
  (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
  (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')),
best AS (
  SELECT DISTINCT conv_id, cast(0 AS bigint) AS i, 0 AS q,
         {'cost': cast(0 AS bigint), 'audit': '', 'lines': cast([] AS varchar[])} AS p FROM faulty
  UNION ALL
  SELECT b.conv_id, f.i, m.q2, min({
    'cost': b.p.cost + 5 * n.k + CASE m.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
            + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': b.p.audit || repeat('I', cast(n.k AS int)) || m.letter,
    'lines': list_concat(b.p.lines, n.lines, CASE WHEN m.letter = 'D' THEN [] ELSE [coalesce(m.role, f.role) || ':' || f.text] END)})
  FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
  JOIN inserts n ON n.q = b.q JOIN moves m ON m.q = n.q2
  WHERE m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.letter = 'R' OR m.initial = left(f.role, 1))
  GROUP BY b.conv_id, f.i, m.q2),
ends AS (
  SELECT b.conv_id, min({'cost': b.p.cost + 5 * n.k, 'audit': b.p.audit || repeat('I', cast(n.k AS int)),
                         'lines': list_concat(b.p.lines, n.lines)}) AS p
  FROM best b JOIN inserts n ON n.q = b.q
  JOIN (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id) t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.n = b.i
  WHERE n.q2 IN (0, 3) GROUP BY b.conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(e.p.cost, 0) AS cost,
       coalesce(e.p.audit, '') AS audit, sha256(coalesce(array_to_string(e.p.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
