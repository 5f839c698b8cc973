"""Smaller queries: stored keys, reviews, job queues, page parts, movers, spellings and spoken times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, times
from ..functions.numbers import half_up
from ..operators import reviews
from ..sources import tables as t
from .common import query, r

_N = f"n AS ({t.NEWS_SQL})"
_NOW = "2024-01-15 06:30:00"


def _ntz(value: str) -> F.Column:
    return F.expr(f"timestamp_ntz'{value}'")


@query(f"WITH {_N} SELECT news_id, sentiment_label FROM n WHERE published_at >= TIMESTAMP '2024-01-10' AND sentiment_label IN ('positive', 'negative')")
def directional_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated news of a direction since a time (FLT11)."""
    return t.news(spark, sf_dir).where((F.col("published_at") >= _ntz("2024-01-10 00:00:00")) & F.col("sentiment_label").isin("positive", "negative")).select("news_id", "sentiment_label")


@query("""WITH p AS (SELECT conv_id * 1000 + turn AS post_id, conv_id % 3 = 0 AS stored, 'u' || conv_id % 40 AS url, CASE WHEN turn > 0 THEN 'x' || (conv_id * 7 + turn) % 300 END AS ext, md5(text) AS h FROM conversations),
s AS (SELECT * FROM p WHERE stored)
SELECT DISTINCT post_id, url IN (SELECT url FROM s) OR coalesce(ext IN (SELECT ext FROM s WHERE ext IS NOT NULL), false) OR coalesce(h IN (SELECT h FROM s WHERE h IS NOT NULL), false) AS known FROM p WHERE NOT stored""")
def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which posts are stored already, by any of three keys (FLT10)."""
    conv, turn = F.col("conv_id"), F.col("turn")
    p = t.read(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("post_id"), (conv % 3 == 0).alias("stored"), F.concat(F.lit("u"), conv % 40).alias("url"), F.when(turn > 0, F.concat(F.lit("x"), (conv * 7 + turn) % 300)).alias("ext"), F.md5("text").alias("h")
    )
    return reviews.stored_already(p.where("not stored"), p.where("stored"), "post_id", ["url", "ext", "h"])


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT day, dayofmonth(day) % 6 <> 0 AS is_open FROM d WHERE dayofmonth(day) <= 20)
SELECT day, coalesce(is_open, isodow(day) <= 5) AS is_trading FROM d LEFT JOIN c USING (day)""", dates="day")
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days by a calendar, else by the day of the week (FLT23)."""
    d = t.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    calendar = d.where(F.dayofmonth("day") <= 20).select("day", (F.dayofmonth("day") % 6 != 0).alias("is_open"))
    return d.join(calendar, "day", "left").select("day", F.coalesce("is_open", F.weekday("day") < 5).alias("is_trading"))


@query("""WITH j AS (SELECT event_id AS job_id, event_id % 8 AS attempt, CASE WHEN event_id % 5 <> 0 THEN ts + to_hours(event_id % 7) END AS retry_at FROM events WHERE event_type IN ('view', 'error'))
SELECT job_id, CAST([30, 120, 300, 900, 1800][greatest(1, least(attempt, 5))] AS INTEGER) AS delay FROM j WHERE retry_at IS NULL OR retry_at <= TIMESTAMP '2024-01-15' ORDER BY retry_at NULLS FIRST, job_id LIMIT 50""")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next jobs of a queue, with the delay before a further attempt (FLT32, STR21); the limit is the batch's size."""
    e = t.read(spark, sf_dir, "events").where("event_type IN ('view', 'error')")
    at = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int")))
    jobs = e.select(F.col("event_id").alias("job_id"), (F.col("event_id") % 8).alias("attempt"), at.alias("retry_at"))
    return reviews.due_jobs(jobs, _ntz("2024-01-15 00:00:00"), 50).select("job_id", reviews.retry_seconds(F.col("attempt")).alias("delay"))


@query("""WITH v AS (SELECT event_id % 300 AS doc_id, arg_max(CASE WHEN value > 50 THEN 1 ELSE 0 END, event_id) AS d FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(labels.doc_id, v.doc_id) AS doc_id, coalesce(d, quality) AS label, d IS NOT NULL AS reviewed, labels.doc_id IS NULL AS missing FROM labels FULL JOIN v ON labels.doc_id = v.doc_id""")
def reviewed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels overlaid by their latest reviews, and reviews without a label (JN28, JN29, SET11)."""
    v = t.read(spark, sf_dir, "events").where("event_type = 'view'").select((F.col("event_id") % 300).alias("doc_id"), "event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("decision"))
    return reviews.reviewed(t.read(spark, sf_dir, "labels"), v, "doc_id", "quality", "decision", "event_id")


@query(f"WITH b AS ({t.BARS_SQL}) SELECT symbol, trade_date, {r('inflow', 2)} AS inflow FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 60", dates="trade_date")
def fund_flow_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest 60 days of each symbol's flow (TOP19); the limit is the chart's length."""
    at = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    return t.bars(spark, sf_dir).withColumn("at", at).where("at <= 60").select("symbol", "trade_date", half_up(F.col("inflow"), 2).alias("inflow"))


@query(f"""WITH b AS ({t.BARS_SQL}), l AS (SELECT symbol, CASE WHEN volume % 5 <> 0 THEN volume END AS v FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 20)
SELECT symbol, {r('avg(v)', 4)} AS average_volume FROM l GROUP BY 1""")
def average_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the known volumes of each symbol's last 20 bars (FE04)."""
    at = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    last = t.bars(spark, sf_dir).select("symbol", F.when(F.col("volume") % 5 != 0, F.col("volume")).alias("v"), at.alias("at")).where("at <= 20")
    return last.groupBy("symbol").agg(half_up(F.avg("v"), 4).alias("average_volume"))


@query(f"""WITH {_N}, k AS (SELECT news_id, source_name, date_diff('day', DATE '2024-01-01', CAST(effective_at AS DATE)) // 7 AS week, abs(sentiment_score) AS score FROM n),
w AS (SELECT news_id, row_number() OVER (PARTITION BY source_name, week ORDER BY score DESC, news_id DESC) AS pos, count(*) OVER (PARTITION BY source_name, week) - 4 AS size FROM k),
c AS (SELECT *, greatest(10, CAST(ceil(size * 0.7::DOUBLE) AS BIGINT)) AS cut FROM w)
SELECT news_id, CASE WHEN pos = 1 THEN 'lead' WHEN pos <= 4 THEN 'supporting' WHEN size - cut >= 3 AND pos - 4 > cut THEN 'folded' ELSE 'stream' END AS part FROM c""")
def story_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead, supporting, stream and folded stories of each source's week (TOP21, TOP22)."""
    week = F.expr("date_diff(to_date(effective_at), date'2024-01-01') div 7")
    rows = t.news(spark, sf_dir).select("news_id", "source_name", week.alias("week"), F.abs("sentiment_score").alias("score"))
    return reviews.story_parts(rows, ["source_name", "week"], [F.col("score").desc(), F.col("news_id").desc()]).select("news_id", "part")


@query(f"""WITH u AS ({t.USAGE_SQL}), s AS (SELECT count(*) AS calls, sum(prompt_tokens) AS p, sum(prompt_tokens + completion_tokens) AS total FROM u)
SELECT calls, CASE WHEN total > 0 THEN {r('p / total * 100.0', 0)} ELSE 0 END AS prompt_percent, least(100, greatest(0, total / 20000.0::DOUBLE * 100)) AS budget_percent FROM s""")
def usage_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, share of prompts and share of the budget (FE16)."""
    s = t.usage(spark, sf_dir).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("p"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total"))
    share = F.when(F.col("total") > 0, half_up(F.col("p") / F.col("total") * 100.0, 0)).otherwise(F.lit(0.0))
    return s.select("calls", share.alias("prompt_percent"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("total") / F.lit(20000.0) * 100)).alias("budget_percent"))


_STATES = ("discovered", "validating", "watch", "qualified", "invalidated", "expired")
_EDGES = ", ".join(f"('{a}', '{b}')" for a, targets in reviews.TRANSITIONS.items() for b in targets)


@query(f"""WITH s AS (SELECT event_id, {list(_STATES)}[event_id % 6 + 1] AS state, {list(_STATES)}[event_id // 6 % 6 + 1] AS target, event_id % 4 <> 0 AS reasoned FROM events)
SELECT event_id, reasoned AND (state, target) IN (VALUES {_EDGES}) AS allowed FROM s""")
def candidate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which moves of candidates between states are allowed (CLS17)."""
    states, e = F.array(*map(F.lit, _STATES)), F.col("event_id")
    at = lambda x: F.element_at(states, (x % 6 + 1).cast("int"))
    return t.read(spark, sf_dir, "events").select("event_id", reviews.may_follow(at(e), at(F.floor(e / 6)), F.when(e % 4 != 0, F.col("event_type"))).alias("allowed"))


_TAGS = r"list_transform(regexp_extract_all(body, '\$([A-Za-z][A-Za-z0-9._-]{0,9})', 1), lambda x: upper(x))"


@query(rf"""WITH c AS (SELECT conv_id * 1000 + turn AS row_id, 'https://x.example/a/status/' || turn || '?s=1' AS url, text || '  $ab' || turn % 3 || ' $0700.HK $AB' || conv_id % 3 || '  $ZZ.HK' AS body FROM conversations), g AS (SELECT *, {_TAGS} AS tags FROM c)
SELECT DISTINCT row_id, regexp_extract(url, '/status/(\d+)', 1) AS post_id, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ',') AS symbols,
  CASE WHEN len(list_filter(tags, lambda x: ends_with(x, '.HK') OR starts_with(x, 'HK'))) > 0 THEN 'hk' ELSE 'us' END AS market, md5(lower(trim(regexp_replace(body, '\s+', ' ', 'g')))) AS content FROM g""")
def post_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, symbols, market and normalised content of posts (SC12, SC13, SC19, SET14)."""
    conv, turn = F.col("conv_id"), F.col("turn")
    url = F.concat(F.lit("https://x.example/a/status/"), turn, F.lit("?s=1"))
    body = F.concat("text", F.lit("  $ab"), turn % 3, F.lit(" $0700.HK $AB"), conv % 3, F.lit("  $ZZ.HK"))
    c = t.read(spark, sf_dir, "conversations").select((conv * 1000 + turn).alias("row_id"), url.alias("url"), body.alias("body"))
    tags = text.cashtags(F.col("body"))
    return c.select("row_id", text.post_id(F.col("url")).alias("post_id"), F.array_join(tags, ",").alias("symbols"), text.market_of_symbols(tags, F.lit(None).cast("string")).alias("market"), F.md5(text.plain_lower(F.col("body"))).alias("content")).distinct()


@query("""WITH s AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS c FROM part), e AS (SELECT *, CASE WHEN c[1] = '6' THEN 'SH' WHEN c[1] IN ('0', '3') THEN 'SZ' END AS x FROM s)
SELECT p_partkey, CASE WHEN x IS NULL THEN c ELSE c || ',' || c || '.' || x || ',' || x || c END AS spellings, lower(x) || c AS chart, CASE WHEN x = 'SH' THEN '1.' ELSE '0.' END || c AS prefixed FROM e""")
def symbol_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of security codes for several providers (SC15, SC17, SC18)."""
    s = t.read(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0").alias("c"))
    n = text.normal_symbol(F.col("c"), F.lit(None).cast("string"))
    spellings = F.array_join(text.symbol_spellings(F.col("c"), F.lit(None).cast("string")), ",")
    return s.select("p_partkey", spellings.alias("spellings"), text.chart_symbol(n["provider_symbol"]).alias("chart"), text.exchange_prefixed(n["symbol"]).alias("prefixed"))


@query(f"""WITH c AS (SELECT event_id, event_id % 24 AS h, event_id % 60 AS m, event_id % 5 AS kind FROM events), now AS (SELECT TIMESTAMP '{_NOW}' AS now)
SELECT event_id, CAST(epoch(CASE kind WHEN 0 THEN now - to_minutes(m) WHEN 1 THEN now::DATE - INTERVAL 1 DAY + to_hours(h - 8) + to_minutes(m)
  WHEN 2 THEN now::DATE + to_hours(h - 8) + to_minutes(m) - CASE WHEN h * 60 + m > 14 * 60 + 30 + 120 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
  WHEN 3 THEN make_timestamp(CASE WHEN h % 12 + 1 > 1 OR m % 28 + 1 > 16 OR (m % 28 + 1 = 16 AND h * 60 > 14 * 60 + 30) THEN 2023 ELSE 2024 END, h % 12 + 1, m % 28 + 1, 0, 0, 0) + to_hours(h - 8) END) AS BIGINT) AS at FROM c, now""")
def listed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, spoken, clock and yearless times, made of numbers and read again (DM02 to DM05)."""
    h, m, kind = F.col("event_id") % 24, F.col("event_id") % 60, F.col("event_id") % 5
    clock = F.format_string("%02d:%02d", h, m)
    raw = (
        F.when(kind == 0, F.concat(m, F.lit(" 分钟前"))).when(kind == 1, F.concat(F.lit("昨天 "), clock)).when(kind == 2, clock)
        .when(kind == 3, F.format_string("%02d-%02d %02d:00", h % 12 + 1, m % 28 + 1, h)).otherwise("soon")
    )
    now, market = F.lit(_NOW).cast("timestamp"), F.lit("cn")
    at = F.coalesce(times.spoken_time(raw, market, now), times.clock_time(raw, market, now))
    return t.read(spark, sf_dir, "events").select("event_id", F.unix_timestamp(at).alias("at"))


@query(f"""WITH {_N} SELECT news_id, coalesce(strftime(published_at, '%Y-%m-%dT%H'), 'unknown') AS bucket, greatest(1, least(90, CASE WHEN news_id % 3 <> 0 THEN news_id - 20 ELSE 30 END)) AS days,
  CAST(epoch(CASE WHEN (fetched_at + INTERVAL 8 HOUR)::TIME < TIME '07:30:00' THEN (fetched_at + INTERVAL 8 HOUR)::DATE + INTERVAL '7 hours 30 minutes' ELSE (fetched_at + INTERVAL 8 HOUR)::DATE + INTERVAL '31 hours 30 minutes' END - INTERVAL 8 HOUR) AS BIGINT) AS quiet_until FROM n""")
def time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour buckets, bounded day counts and ends of quiet hours (DM08, DM09, DM10)."""
    end = times.next_time_of_day(F.col("fetched_at").cast("timestamp"), 7, 30, "Asia/Shanghai")
    days = times.clamp_days(F.when(F.col("news_id") % 3 != 0, F.col("news_id") - 20))
    return t.news(spark, sf_dir).select("news_id", times.hour_bucket(F.col("published_at")).alias("bucket"), days.alias("days"), F.unix_timestamp(end).alias("quiet_until"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '名' || s_name || ' S' || s_suppkey || ' stock news,名' || s_name || ' 最新消息' ELSE s_name || ' S' || s_suppkey || ' stock news' || CASE WHEN s_nationkey % 3 > 0 THEN ',' || s_name || ' S' || s_suppkey || ' 股票 新闻' ELSE '' END END AS queries FROM supplier""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts for each security, by the script of its name and its market (SC29, SC30)."""
    key = F.col("s_suppkey")
    name = F.when(key % 2 == 0, F.concat(F.lit("名"), "s_name")).otherwise(F.col("s_name"))
    market = F.element_at(F.array(*map(F.lit, ("us", "hk", "cn"))), (F.col("s_nationkey") % 3 + 1).cast("int"))
    queries = text.search_queries(F.concat(F.lit("S"), key), name, market)
    return t.read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(queries, ",").alias("queries"))


@query(f"WITH b AS ({t.BARS_SQL}) SELECT trade_date, count(*) FILTER (close > open) AS advance, count(*) FILTER (close < open) AS decline, count(*) FILTER (close = open) AS flat FROM b GROUP BY 1", dates="trade_date")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that rose, fell or stayed on each day (AGG17)."""
    return reviews.breadth(t.bars(spark, sf_dir))


@query(f"""WITH {_N}, m AS ({t.MENTIONS_SQL}), g AS (SELECT symbol, sentiment_label, count(*) AS k, min(news_id) AS first FROM m JOIN n USING (news_id) GROUP BY 1, 2)
SELECT symbol, CAST(sum(k) OVER (PARTITION BY symbol) AS BIGINT) AS n, sentiment_label AS dominant FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC, first) = 1""")
def dominant_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common mood of each symbol's news (AGG57)."""
    m = t.mentions(spark, sf_dir).select("news_id", "symbol").join(t.news(spark, sf_dir).select("news_id", "sentiment_label"), "news_id")
    return reviews.most_common(m, ["symbol"], "sentiment_label", "news_id", "dominant")


@query("""WITH v AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'cn' END AS market, event_type FROM events WHERE abs(value - 50) > 40), g AS (SELECT market, event_type, count(*) AS k, min(event_id) AS first FROM v GROUP BY 1, 2)
SELECT market, CAST(sum(k) OVER (PARTITION BY market) AS BIGINT) AS n, event_type AS reason FROM g QUALIFY row_number() OVER (PARTITION BY market ORDER BY k DESC, first) = 1""")
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movers of each market and their most common reason (FE06, FE07)."""
    market = F.element_at(F.array(*map(F.lit, ("us", "hk", "cn"))), (F.col("user_id") % 3 + 1).cast("int"))
    return reviews.most_common(t.read(spark, sf_dir, "events").where("abs(value - 50) > 40").select("event_id", market.alias("market"), "event_type"), ["market"], "event_type", "event_id", "reason")
