"""The numbered queries over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, language_id, near_dedup, piece_codec, quality_rules, source_divergence, source_mixing, substring_dedup, token_counts, token_files, url_filters, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Domain rules as (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host names whose pages make up the list of URLs that op3 filters by.
LISTED_HOSTS = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filters.host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_HOSTS)})\."))
    return url_filters.filter_urls(pages, listed.select(url_filters.canonical_of(F.col("url")).alias("canonical_url")), URL_RULES).drop("possible_hit")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).drop("posterior")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).drop("rep_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = decontamination.with_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.hit_summary(matched).select(F.col("__row.doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_at", "longest_item")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_with_offsets(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents")).drop("odds_rank", "inclusion")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_counts, op3_url_filters, op4_language_id, op5_html_extraction, op6_substring_dedup, op7_near_dedup, op8_decontamination, op9_piece_codec, op10_token_files,
        op11_source_mixing, op12_embedding_whitening, op13_source_divergence,
    )
}

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT *, row_number() OVER () AS nr FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
iw AS (
  SELECT item, nr, ip, k, array_to_string(w[ip:ip + k - 1], ' ') AS g
  FROM (SELECT item, nr, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS ip FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lengths)),
hits AS (SELECT doc_id, p, k, item, nr, ip FROM dw JOIN iw USING (k, g)),
words AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS at FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
runs AS (
  SELECT doc_id, item, min(p) - 1 AS place, count(*) + any_value(k) - 1 AS n
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, nr, p - ip ORDER BY p) AS island FROM hits) GROUP BY doc_id, item, nr, p - ip, island),
longest AS (SELECT doc_id, n AS longest_words, place AS longest_at, item AS longest_item FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place, item NULLS FIRST) = 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest_words, 0) AS BIGINT) AS longest_words, CAST(longest_at AS BIGINT) AS longest_at, longest_item
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

OP3_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS params
  FROM pages),
c AS (
  SELECT page_id, host, path, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM u),
listed AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_matches(host, '(^|[.])(ads-track|free-bets|cheap-pills|spam-farm|casino-win|adult-x)[.]')),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN listed.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, c.canonical_url
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed ON listed.canonical_url = c.canonical_url
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
r AS (
  SELECT doc_id, s, size, length(CASE WHEN size = 0 THEN '0' ELSE bin(size) END) AS stratum, CAST(floor(greatest(least(ln(u / (1 - u)), 20e0), -20e0) * 128) AS BIGINT) AS cell FROM d),
src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][(row_number() OVER (ORDER BY s = '', s) - 1) % 3 + 1] AS weight FROM r GROUP BY s),
share(round, unit) AS (
  SELECT 0, CAST(sum(n) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) FROM src
  UNION ALL
  SELECT round + 1, (SELECT CAST(sum(n) - 3 * coalesce(sum(n) FILTER (3 * n < unit * weight), 0) AS DOUBLE) / CAST(sum(weight) FILTER (3 * n >= unit * weight) AS DOUBLE) FROM src) FROM share
  WHERE round < (SELECT count(*) FROM src)),
goal AS (SELECT s, n, least(3e0 * n, max(unit) * weight) AS target FROM src, share GROUP BY s, n, weight),
g AS (SELECT *, coalesce(target / nullif(CAST(n AS DOUBLE), 0), 0e0) AS ratio FROM goal),
cells AS (SELECT s, stratum, cell, CAST(sum(size) AS DOUBLE) AS words FROM r GROUP BY s, stratum, cell),
strata AS (
  SELECT s, stratum, sum(words) AS words, list({'cell': cell, 'words': words, 'upto': upto} ORDER BY cell) AS cells, row_number() OVER (PARTITION BY s ORDER BY stratum DESC) AS k,
    (CAST('0x' || substr(md5(concat_ws(':', '0', 'border', s, CAST(stratum AS VARCHAR))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS coin
  FROM (SELECT *, sum(words) OVER (PARTITION BY s, stratum ORDER BY cell) AS upto FROM cells) GROUP BY s, stratum),
fold(s, k, chance, carry, remaining, stratum, last) AS (
  SELECT s, CAST(0 AS BIGINT), ratio - floor(ratio), 0e0, CAST(n AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM g
  UNION ALL
  SELECT s, k, chance, want - CASE WHEN over THEN edge.upto ELSE under END, remaining, stratum, cells[whole + CASE WHEN over THEN 1 ELSE 0 END].cell
  FROM (
    SELECT *, coalesce(CASE WHEN edge.upto - want <= chance * remaining AND want - under <= (1 - chance) * remaining THEN coin < part ELSE part >= 0.5 END, false) AS over
    FROM (
      SELECT *, cells[whole + 1] AS edge, CASE WHEN whole > 0 THEN cells[whole].upto ELSE 0e0 END AS under,
        (want - CASE WHEN whole > 0 THEN cells[whole].upto ELSE 0e0 END) / nullif(cells[whole + 1].words, 0) AS part
      FROM (
        SELECT f.s, t.k, chance, chance * words + carry AS want, remaining - words AS remaining, CAST(t.stratum AS BIGINT) AS stratum, cells, coin,
          len(list_filter(cells, lambda c: c.upto <= chance * words + carry)) AS whole
        FROM fold f JOIN strata t ON t.s = f.s AND t.k = f.k + 1)))),
taken AS (
  SELECT doc_id, size, n AS source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(floor(ratio) AS BIGINT) + CASE WHEN coalesce(cell <= last, false) THEN 1 ELSE 0 END END AS copies
  FROM r JOIN g USING (s) JOIN fold f ON f.s = r.s AND f.stratum = r.stratum)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM taken
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT nr, lang, source, term, count(*) AS c FROM (SELECT nr, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS lc FROM w GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, CAST(sum(c) AS HUGEINT) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p, 1 + (1000000000 * (lc + 5)) // (ln + 5 * v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS f FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL = {"op3_url_filters": OP3_SQL, "op8_decontamination": OP8_SQL, "op11_source_mixing": OP11_SQL, "op13_source_divergence": OP13_SQL}
