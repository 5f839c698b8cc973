"""Queries over late fields, pending rows, batch quotes, cool-downs and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..sources import tables as t
from .common import query, r

_N = f"n AS ({t.NEWS_SQL})"


@query(f"""WITH {_N}, u AS (SELECT news_id, min(came) AS late_at FROM (SELECT news_id, fetched_at - INTERVAL 3 HOUR AS came FROM n WHERE news_id % 2 = 0 UNION ALL SELECT news_id, fetched_at - INTERVAL 5 HOUR FROM n WHERE news_id % 6 = 0) GROUP BY 1)
SELECT news_id, coalesce(published_at, late_at) AS published_at, coalesce(published_at, late_at, fetched_at) AS effective_at,
  coalesce(published_at, late_at, fetched_at) <> coalesce(published_at, fetched_at) AS moved FROM n LEFT JOIN u USING (news_id)""")
def late_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication times that arrive later move the effective time (STR12)."""
    n = t.news(spark, sf_dir)
    late = lambda step, hours: n.where(F.col("news_id") % step == 0).select("news_id", (F.col("fetched_at") - F.make_dt_interval(hours=F.lit(hours))).alias("published_at"))
    return runs.filled_times(n, late(2, 3).union(late(6, 5)))


@query(f"""WITH {_N} SELECT news_id, CAST(row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC NULLS LAST, news_id DESC) AS INT) AS pos FROM n WHERE NOT (news_id % 3 <> 0)""")
def pending_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News without a signal, by source in the order in which they are taken (SRC43)."""
    n = t.news(spark, sf_dir).withColumn("signal_status", F.when(F.col("news_id") % 3 != 0, "done"))
    return runs.positions(n.where("signal_status IS NULL").select("news_id", "source_name", "published_at"), "source_name", "published_at", "news_id").select("news_id", "pos")


@query(f"""WITH b AS ({t.BARS_SQL}), k AS (SELECT *, row_number() OVER w AS pos, lead(close) OVER w AS previous_close FROM b WINDOW w AS (PARTITION BY symbol ORDER BY trade_date DESC))
SELECT symbol, trade_date AS day, close AS price, previous_close, {r('(close - previous_close) / previous_close * 100', 4)} AS change_percent FROM k WHERE pos = 1""", dates="day")
def frame_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from landed frames that hold a day's closes of a batch of symbols (SRC26)."""
    b = t.bars(spark, sf_dir).groupBy("trade_date", (F.substring("symbol", 2, 20).cast("long") % 40).alias("batch")).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("close"))
    quotes = runs.batch_quotes(b.select(F.to_json(F.struct(F.col("trade_date").alias("day"), "close")).alias("payload")))
    return quotes.withColumn("change_percent", F.floor(F.col("change_percent") * 1e4 + 0.500001) / 1e4)


@query(f"""WITH f AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1), c AS (SELECT user_id FROM f WHERE last > (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE)
SELECT page_id, length(html) > 600 AS oversize, CAST(least(length(html), 600) AS INT) AS n_read FROM pages WHERE page_id NOT IN (SELECT user_id FROM c)""")
def due_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose last failure is past its cool-down, cut to the size that is read (SRC23, SRC24); the cut is the feature."""
    events = t.read(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    failures = events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("failed_at"))
    pages = t.read(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), runs.truncated(F.col("html"), 600).alias("read"))
    due = runs.due_urls(pages, failures, now.scalar(), 60)
    return due.select("page_id", "read.oversize", F.length("read.content").alias("n_read"))


@query(f"""WITH {_N} SELECT CASE WHEN news_id % 9 <> 0 THEN news_id END AS sample_id, CASE WHEN news_id % 9 <> 0 AND news_id % 5 <> 0 THEN sentiment_label END AS label, CASE WHEN news_id % 9 <> 0 THEN title END AS title,
  CASE WHEN news_id % 9 = 0 THEN 'malformed' WHEN news_id % 5 = 0 THEN 'label' WHEN title IS NULL THEN 'title' END AS problem FROM n""")
def loaded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as JSON lines and loaded again, with what is wrong with them (SRC41, SRC42, SNK22)."""
    n = t.news(spark, sf_dir)
    line = F.to_json(F.struct(F.col("news_id").alias("sample_id"), F.when(F.col("news_id") % 5 != 0, F.col("sentiment_label")).alias("label"), "title"))
    return runs.parsed_samples(n.select(F.when(F.col("news_id") % 9 != 0, line).otherwise('{"sample_id": ').alias("line")), "sample_id long, label string, title string", ["sample_id", "label", "title"])


@query(f"""WITH {_N} SELECT news_id, '### ' || coalesce(title, '-') || chr(10) || chr(10) || '- source_name: ' || coalesce(source_name, '-') || chr(10) || '- sentiment_label: ' || CASE WHEN news_id % 4 <> 0 THEN sentiment_label ELSE '-' END AS section FROM n""")
def review_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue as Markdown sections (SNK23)."""
    n = t.news(spark, sf_dir).withColumn("sentiment_label", F.when(F.col("news_id") % 4 != 0, F.col("sentiment_label")))
    return n.select("news_id", runs.markdown_review(F.struct("title", "source_name", "sentiment_label"), "title", ["source_name", "sentiment_label"]).alias("section"))
