"""Domain tables as projections of the supplied tables, in Spark and as SQL text for oracles.

Every ``*_SQL`` constant is a SELECT that gives the same rows as the function of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One news item for each document: its first line, up to 500 characters, is the title, the rest the summary; times follow from the id."""
    first = F.substring_index("text", "\n", 1)
    minutes = F.col("doc_id") * 37 % 43200
    fetched = F.expr(f"timestamp_ntz'{EPOCH}'") + F.make_dt_interval(mins=minutes.cast("int"))
    published = F.when(F.col("doc_id") % 7 != 0, fetched - F.make_dt_interval(mins=(F.col("doc_id") % 90).cast("int")))
    score = (F.col("doc_id") * 53 % 201 - 100) / F.lit(100.0)
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("news_id"), F.col("source").alias("source_name"), F.substring(first, 1, 500).alias("title"),
        F.substring("text", F.when(F.length(first) > 500, 501).otherwise(F.length(first) + 2), F.lit(2147483647)).alias("summary"),
        F.when(F.col("lang") == "en", "us").when(F.col("lang") == "de", "hk").otherwise("cn").alias("market"), F.col("lang").alias("language"),
        published.alias("published_at"), fetched.alias("fetched_at"), F.coalesce(published, fetched).alias("effective_at"), score.alias("sentiment_score"),
        F.when(score >= 0.2, "positive").when(score <= -0.2, "negative").otherwise("neutral").alias("sentiment_label"),
    )


NEWS_SQL = rf"""
SELECT doc_id AS news_id, source AS source_name, substr(split_part(text, chr(10), 1), 1, 500) AS title,
  substr(text, CASE WHEN length(split_part(text, chr(10), 1)) > 500 THEN 501 ELSE length(split_part(text, chr(10), 1)) + 2 END) AS summary,
  CASE lang WHEN 'en' THEN 'us' WHEN 'de' THEN 'hk' ELSE 'cn' END AS market, lang AS language,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '{EPOCH}' + to_minutes(doc_id * 37 % 43200 - doc_id % 90) END AS published_at,
  TIMESTAMP '{EPOCH}' + to_minutes(doc_id * 37 % 43200) AS fetched_at,
  TIMESTAMP '{EPOCH}' + to_minutes(doc_id * 37 % 43200 - CASE WHEN doc_id % 7 <> 0 THEN doc_id % 90 ELSE 0 END) AS effective_at,
  (doc_id * 53 % 201 - 100) / 100.0::DOUBLE AS sentiment_score,
  CASE WHEN (doc_id * 53 % 201 - 100) >= 20 THEN 'positive' WHEN (doc_id * 53 % 201 - 100) <= -20 THEN 'negative' ELSE 'neutral' END AS sentiment_label
FROM documents
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symbols a news item mentions, from the click events."""
    e = read(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(
        F.col("event_id").alias("id"), F.expr("event_id div 5").alias("news_id"), F.concat(F.lit("S"), "user_id").alias("symbol"),
        F.element_at(F.array(*map(F.lit, ("us", "hk", "cn"))), (F.col("user_id") % 3 + 1).cast("int")).alias("market"), (F.col("value") % 1).alias("confidence"),
    )


MENTIONS_SQL = """
SELECT event_id AS id, event_id // 5 AS news_id, 'S' || user_id AS symbol,
  CASE user_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'cn' END AS market, value % 1 AS confidence
FROM events WHERE event_type = 'click'
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directional news with the symbol that it mentions, from the purchase and error events."""
    e = read(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    return e.select(
        F.col("event_id").alias("news_id"), F.concat(F.lit("S"), "user_id").alias("symbol"), F.col("ts").alias("published_at"),
        F.when(F.col("event_type") == "purchase", "positive").otherwise("negative").alias("label"),
        F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 101) / 100.0).alias("importance"),
        F.when(F.col("event_id") % 13 != 0, (F.col("event_id") * 7 % 201 - 100) / 100.0).alias("score"),
    )


SIGNALS_SQL = """
SELECT event_id AS news_id, 'S' || user_id AS symbol, ts AS published_at, CASE event_type WHEN 'purchase' THEN 'positive' ELSE 'negative' END AS label,
  CASE WHEN event_id % 11 <> 0 THEN (event_id % 101) / 100.0::DOUBLE END AS importance,
  CASE WHEN event_id % 13 <> 0 THEN (event_id * 7 % 201 - 100) / 100.0::DOUBLE END AS score
FROM events WHERE event_type IN ('purchase', 'error')
"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price snapshots, from the view and click events."""
    e = read(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("S"), "user_id").alias("symbol"), F.element_at(F.array(*map(F.lit, ("us", "hk", "cn"))), (F.col("user_id") % 3 + 1).cast("int")).alias("market"), F.col("value").alias("price"), F.col("ts").alias("fetched_at"))


QUOTES_SQL = """
SELECT event_id AS id, 'S' || user_id AS symbol, CASE user_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'cn' END AS market, value AS price, ts AS fetched_at
FROM events WHERE event_type IN ('view', 'click')
"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier: price is the extended price of a unit, in line order.

    The order (l_orderkey, l_linenumber) is one exact number, nulls first: other than a struct it lets Spark aggregate by hash, without sorting.
    """
    number = lambda c, least: F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(str(least)).cast("decimal(20,0)"))
    at = (number("l_orderkey", -(2**63) - 1) * F.lit(10**10).cast("decimal(11,0)") + number("l_linenumber", -(2**31) - 1)).cast("decimal(38,0)")
    line = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", at.alias("at"),
    )
    return line.groupBy("symbol", "trade_date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"), F.sum(F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("inflow"),
    )


BARS_SQL = """
SELECT 'P' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, sum(CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END * l_extendedprice * (1 - l_discount)) AS inflow
FROM lineitem GROUP BY 1, 2
"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of news items to topics: (topic_id, news_id)."""
    return news(spark, sf_dir).select((F.col("news_id") * 31 % 97).alias("topic_id"), "news_id")


TOPICS_SQL = "SELECT doc_id * 31 % 97 AS topic_id, doc_id AS news_id FROM documents"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: one for each customer, in the symbol of its number."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("S"), "c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 50 + 1).cast("double").alias("position_size"), F.when(F.col("c_custkey") % 4 != 0, F.abs("c_acctbal") / 100).alias("average_cost"))


HOLDINGS_SQL = """
SELECT 'S' || c_custkey AS symbol, CAST(CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 50 + 1 END AS DOUBLE) AS position_size,
  CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal) / 100 END AS average_cost
FROM customer
"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model token usage, from conversations: four characters are a token, one at least."""
    c = read(spark, sf_dir, "conversations")
    tokens = F.greatest(F.lit(1), F.expr("length(text) div 4")).cast("long")
    created = F.expr(f"timestamp_ntz'{EPOCH}'") + F.make_dt_interval(mins=((F.col("conv_id") * 61 + F.col("turn")) % 43200).cast("int"))
    return c.select(F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model_name"), F.col("role").alias("operation_type"), tokens.alias("prompt_tokens"), F.expr("length(text) % 50").cast("long").alias("completion_tokens"), created.alias("created_at"))


USAGE_SQL = f"""
SELECT 'model-' || conv_id % 3 AS model_name, role AS operation_type, CAST(greatest(1, length(text) // 4) AS BIGINT) AS prompt_tokens,
  CAST(length(text) % 50 AS BIGINT) AS completion_tokens, TIMESTAMP '{EPOCH}' + to_minutes((conv_id * 61 + turn) % 43200) AS created_at
FROM conversations
"""
