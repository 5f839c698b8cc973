"""Queries that look names, codes and words up in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mentions, staging, text_index
from ..sources import tables as t
from .common import query
from .news import _search_sql

_N = f"n AS ({t.NEWS_SQL})"
_NAMES = ("贵州茅台", "宁德时代", "东方", "中国平安", "比亚迪", "腾讯控股", "万科", "平安银行")
_PROBES = ("贵州茅台 获增持", "关注 宁德时代 与 中国平安", "东方 科技 集团", "比亚迪销量 000031 创新高", "平安银行 000011", "", "万科 腾讯控股有限公司")
#: News with Chinese names and codes in title, summary and body by their number; the whole text is there.
_TEXTS = f"""{_N}, x AS (SELECT news_id AS id, coalesce(title, '') || CASE WHEN news_id % 6 = 0 THEN ' 0000' || lpad(CAST(news_id % 50 AS VARCHAR), 2, '0') WHEN news_id % 11 = 0 THEN ' {_NAMES[3]}' ELSE '' END AS title,
  {list(_PROBES)}[news_id % {len(_PROBES)} + 1] AS summary, coalesce(summary, '') || CASE WHEN news_id % 7 = 0 THEN ' 0000' || lpad(CAST(news_id % 40 AS VARCHAR), 2, '0') ELSE '' END AS body FROM n),
d AS (SELECT item_id AS position, lpad(CAST(item_id AS VARCHAR), 6, '0') || '.sz' AS symbol, CASE WHEN item_id % 2 = 0 THEN 'cn' ELSE '' END AS market,
  CASE WHEN item_id % 3 = 0 THEN {list(_NAMES)}[item_id // 3 % {len(_NAMES)} + 1] ELSE regexp_extract(text, '^\\S+ \\S+ \\S+') END AS display_name FROM benchmark)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda k: F.concat(F.lit(" 0000"), F.lpad((F.col("news_id") % k).cast("string"), 2, "0"))
    title = F.concat(F.coalesce("title", F.lit("")), F.when(F.col("news_id") % 6 == 0, two(50)).when(F.col("news_id") % 11 == 0, " " + _NAMES[3]).otherwise(""))
    body = F.concat(F.coalesce("summary", F.lit("")), F.when(F.col("news_id") % 7 == 0, two(40)).otherwise(""))
    probe = F.element_at(F.array(*map(F.lit, _PROBES)), (F.col("news_id") % len(_PROBES) + 1).cast("int"))
    return t.news(spark, sf_dir).select(F.col("news_id").alias("id"), title.alias("title"), probe.alias("summary"), body.alias("body"))


def _stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chinese = F.element_at(F.array(*map(F.lit, _NAMES)), (F.expr("item_id div 3") % len(_NAMES) + 1).cast("int"))
    name = F.when(F.col("item_id") % 3 == 0, chinese).otherwise(F.regexp_extract("text", r"^\S+ \S+ \S+", 0))
    return t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), F.concat(F.lpad(F.col("item_id").cast("string"), 6, "0"), F.lit(".sz")).alias("symbol"), F.when(F.col("item_id") % 2 == 0, "cn").otherwise("").alias("market"), name.alias("display_name"))


@query(f"""WITH {_TEXTS},
r AS (SELECT upper(symbol) AS symbol, display_name AS term, 0 AS kind, -length(display_name) AS size, position FROM d WHERE length(display_name) >= 3 AND NOT list_contains({mentions.STOP_NAMES}, display_name)
  UNION ALL SELECT upper(symbol), left(symbol, 6), 1, 0, position FROM d),
h AS (SELECT id, r.*, CASE WHEN contains(title, term) THEN 1 WHEN contains(summary, term) THEN 2 WHEN contains(body, term) THEN 3 END AS place FROM x, r),
c AS (SELECT *, CASE kind WHEN 0 THEN [0.9, 0.7, 0.55][place] ELSE [0.95, 0.75, 0.6][place] END::DOUBLE AS confidence FROM h WHERE place IS NOT NULL)
SELECT id, symbol, 'cn' AS market, term AS display_name, confidence, ['title', 'summary', 'body'][place] AS place FROM c QUALIFY row_number() OVER (PARTITION BY id, symbol ORDER BY confidence DESC, kind, size, position) = 1""")
def security_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities named or given by code in title, summary or body (JN21)."""
    return mentions.security_mentions(_texts(spark, sf_dir), _stocks(spark, sf_dir))


@query(f"""WITH {_TEXTS}, y AS (SELECT id, lower(title || ' ' || summary) AS hay FROM x)
SELECT id, symbol, display_name FROM y JOIN d ON contains(hay, left(symbol, 6)) OR display_name <> '' AND contains(hay, lower(display_name)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) = 1""")
def watchlist_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first watched security that each item's title and summary hold (JN22)."""
    return mentions.watchlist_hits(_texts(spark, sf_dir), _stocks(spark, sf_dir))


@query(f"""WITH {_N} SELECT news_id, 'THAT' AS symbol, 0.6::DOUBLE AS confidence FROM n WHERE title ILIKE '%that%' OR summary ILIKE '%that%' OR title ILIKE '%thin ere%' OR summary ILIKE '%thin ere%' ORDER BY published_at DESC NULLS LAST, fetched_at DESC, news_id LIMIT 20""")
def keyword_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest news that hold a new symbol or its name (JN23); the limit is the feature."""
    return mentions.keyword_links(t.news(spark, sf_dir), "That", "Thin ere")


def _indexed(words: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = t.news(spark, sf_dir), f"{staging.new_path(spark, 'word-index')}"
    for batch in (0, 1):  # an index grows by batches
        text_index.add_batch(n.where(F.col("news_id") % 2 == batch), path, batch, ["title", "summary"], "news_id")
    return text_index.search_or_phrase(n, path, words, ["title", "summary"], "news_id").select("news_id")


@query(_search_sql("['that', 'thin']", "that thin"))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-terms search by an inverted index that is updated by batches (FLT06)."""
    return _indexed(["That", "thin"], spark, sf_dir)


@query(_search_sql("['eren', 'at']", "eren at"))
def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search that falls back to a phrase inside words where the index has no hit (FLT06, FLT07)."""
    return _indexed(["eren", "at"], spark, sf_dir)
