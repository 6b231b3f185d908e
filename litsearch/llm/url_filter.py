"""URL filters: host and path rules, and pattern rules indexed by rare literal tokens.

A pattern rule is a regular expression over the lower-cased URL with its alternatives: lists of literal
tokens (runs of letters and digits). Every match contains all tokens of at least one alternative, each as a
whole token. An alternative is indexed under its token that is rarest in the URLs at hand. A URL's own
tokens fetch its candidate rules by an equality join, and only those run their regular expression, once each.

Host and path rules (`example.com/de/`) fit their host and its subdomains where the URL's path starts
with the rule's; the longest wins, on equal length `block` before `allow`. Where one fits, it
decides; elsewhere a matching pattern rule blocks; what nothing fits is allowed.

Defined results: a null URL or one without `://` has empty host and path, no rule, and is allowed
unless a pattern rule fits its text. Repeated rows are judged one by one; other columns are ignored.
Everything is a Catalyst expression; the rule tables are small and given by the caller (at most
``RULE_LIMIT`` rules, checked), which is what allows their broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_LIMIT = 100_000

# The host and path rules of the query.
HOST_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]

#: Name, regular expression, alternatives of literal tokens. Advertising, unwanted shops, sessions and trackers.
PATTERN_RULES = [
    ("spam_farm", r"://([^/?#]*[.-])?spam-?farm[.:/]", [["spam", "farm"], ["spamfarm"]]),
    ("pill_shop", r"://[^/?#]*\b(cheap|online|discount)-pills\b", [["pills"]]),
    ("casino", r"://[^/?#]*\bcasino\b", [["casino"]]),
    ("poker", r"://[^/?#]*\bpoker\b", [["poker"]]),
    ("adult", r"://[^/?#]*\b(xxx|porn)\b", [["xxx"], ["porn"]]),
    ("free_download", r"/free-download\b", [["free", "download"]]),
    ("ad_server", r"://(ads?|adserver|banners?)\.", [["ad"], ["ads"], ["adserver"], ["banner"], ["banners"]]),
    ("doubleclick", r"://[^/?#]*\bdoubleclick\.", [["doubleclick"]]),
    ("login", r"/(wp-login|login|signin)(\.\w+)?([/?#]|$)", [["login"], ["signin"]]),
    ("session_id", r"[?&;](phpsessid|jsessionid)=", [["phpsessid"], ["jsessionid"]]),
    ("calendar", r"/calendar/\d{4}/\d{2}\b", [["calendar"]]),
    ("replytocom", r"[?&]replytocom=\d+", [["replytocom"]]),
]


def host_of(url):
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url):
    """Distinct runs of letters and digits of the lower-cased URL."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), 0))


def _small(rows: list, what: str) -> list:
    if len(rows) > RULE_LIMIT:
        raise ValueError(f"{len(rows)} {what}; at most {RULE_LIMIT} can be broadcast")
    return rows


def pattern_index(urls: DataFrame, url_col: str, rules: list[tuple[str, str, list[list[str]]]]) -> DataFrame:
    """(token, rule_name, pattern): every alternative of a rule under the one of its tokens that is
    rarest among ``urls``; ties go to the alphabetically first."""
    spark = urls.sparkSession
    literals = spark.createDataFrame(
        [(n, p, i, t) for n, p, ways in _small(rules, "pattern rules") for i, tokens in enumerate(ways) for t in tokens],
        "rule_name string, pattern string, way int, token string")
    counts = (urls.select(F.explode(url_tokens(F.col(url_col))).alias("token"))
              .join(F.broadcast(literals.select("token").distinct()), "token")
              .groupBy("token").agg(F.count("*").alias("n")))
    return (literals.join(counts, "token", "left").groupBy("rule_name", "pattern", "way")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
            .select(F.col("rarest.token").alias("token"), "rule_name", "pattern").distinct())


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               host_rules: list[tuple[str, str]] = HOST_RULES,
               pattern_rules: list[tuple[str, str, list[list[str]]]] = PATTERN_RULES) -> DataFrame:
    """The id column, host, path, rule (null where none fits), verdict, patterns (names of the
    pattern rules that match, in order)."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    index = pattern_index(urls, "url", pattern_rules)
    parts = [(r, r.split("/", 1)[0], "/" + r.split("/", 1)[1], v) for r, v in _small(host_rules, "host rules")]
    host_table = spark.createDataFrame(parts, "rule string, rule_host string, rule_path string, rule_verdict string")

    # candidate rules of a URL in one array, so that rows stay whole: url -> token -> rules
    by_token = (index.groupBy("token").agg(F.collect_list(F.struct("rule_name", "pattern")).alias("rules"))
                .agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index")))
    by_host = (host_table.groupBy("rule_host")
               .agg(F.collect_list(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"),
                                            "rule", "rule_path", "rule_verdict")).alias("rules"))
               .agg(F.map_from_entries(F.collect_list(F.struct("rule_host", "rules"))).alias("hosts")))

    def fetched(keys, mapping, fields):
        return F.flatten(F.filter(F.transform(keys, lambda k: F.try_element_at(mapping, k)), lambda r: r.isNotNull()))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.filter(fetched(suffixes, F.col("hosts"), None), lambda r: F.startswith(F.col("path"), r.rule_path))
    fired = F.filter(F.array_distinct(fetched(url_tokens(F.col("url")), F.col("index"), None)),
                     lambda r: F.regexp_like(F.lower("url"), r.pattern))
    judged = (urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
              .crossJoin(F.broadcast(by_token)).crossJoin(F.broadcast(by_host))
              .withColumn("best", F.array_max(fit))
              .withColumn("patterns", F.array_sort(F.coalesce(F.transform(fired, lambda r: r.rule_name),
                                                               F.array().cast("array<string>")))))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.when(F.size("patterns") > 0, "block").otherwise("allow")).alias("verdict"),
        "patterns")
