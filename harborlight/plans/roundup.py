"""Further queries: dictionaries in texts, topic matching, reviews, batches, calendars, alerts, feeds of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import backoff_seconds, half_up
from ..functions.rules import any_term
from ..operators import desk, roundup, timeseries
from ..sources import tables as t
from .common import query, r

_N = f"n AS ({t.NEWS_SQL})"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT item_id AS name_id, {_WORDS}[1:2] AS nw FROM benchmark),
g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT DISTINCT doc_id, name_id FROM g JOIN k ON gram = array_to_string(nw, ' ') AND len(nw) = 2""")
def dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word names of a dictionary found as whole words in texts (SRC38, SRC39); `security_mentions` finds substrings."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    docs = t.read(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    names = t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name_id"), F.slice(words, 1, 2).alias("words"))
    return roundup.dictionary_hits(docs, names.where(F.size("words") == 2), 2)


_KEYS = "list_distinct(regexp_extract_all(lower(title), '[a-z]{4,}'))"


@query(f"""WITH {_N}, a AS (SELECT news_id AS item_id, {_KEYS} AS k FROM n WHERE news_id % 2 = 1), b AS (SELECT news_id AS topic_id, {_KEYS} AS k FROM n WHERE news_id % 2 = 0),
s AS (SELECT item_id, topic_id FROM (SELECT item_id, least(2, len(k)) AS need, unnest(k) AS word FROM a) JOIN (SELECT topic_id, unnest(k) AS word FROM b) USING (word) GROUP BY item_id, topic_id, need HAVING count(*) >= need)
SELECT item_id, min(topic_id) AS topic_id FROM a LEFT JOIN s USING (item_id) GROUP BY 1""")
def topic_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items matched to the lowest topic by shared keywords (SET03)."""
    k = t.news(spark, sf_dir).select("news_id", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), 1)).alias("keywords"))
    return roundup.match_topics(k.where("news_id % 2 = 1").withColumnRenamed("news_id", "item_id"), k.where("news_id % 2 = 0").withColumnRenamed("news_id", "topic_id"))


@query(f"""WITH {_N}, f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY news_id) = 1) SELECT news_id, source_name FROM f QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY news_id) <= 2""")
def capped_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drivers of each category, titles not repeated (WIN20, FE14)."""
    return roundup.capped(t.news(spark, sf_dir), "source_name", "title", [F.col("news_id")]).select("news_id", "source_name")


@query(f"""WITH {_N}, k AS (SELECT news_id, market, abs(sentiment_score) > 0.95 AS must FROM n), o AS (SELECT news_id, market FROM k WHERE NOT must QUALIFY row_number() OVER (PARTITION BY market ORDER BY sha256(news_id || ':42')) <= 5)
SELECT news_id, market FROM k WHERE must UNION ALL SELECT * FROM o""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory and spot-check samples (TOP16, FLT26); the spot check's size is a parameter."""
    return roundup.review_sample(t.news(spark, sf_dir), F.abs("sentiment_score") > 0.95, "market", 5, 42, "news_id").select("news_id", "market")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 12).alias("batch_id"), F.col("o_orderstatus").alias("label")).agg(half_up(F.avg((F.col("o_orderkey") % 97) / 97), 4).alias("f1"), F.count("*").alias("n")).select("batch_id", "label", "f1", "n", (F.col("batch_id") % 3).alias("dataset_hash"), (F.col("batch_id") * 100).alias("created_at"))


_RUNS = f"runs AS (SELECT o_custkey % 12 AS batch_id, o_orderstatus AS label, {r('avg((o_orderkey % 97) / 97)', 4)} AS f1, count(*) AS n, o_custkey % 12 % 3 AS dataset_hash, o_custkey % 12 * 100 AS created_at FROM orders GROUP BY ALL)"


@query(f"WITH {_RUNS}, b AS (SELECT batch_id, max(created_at) AS latest FROM runs GROUP BY 1 ORDER BY latest DESC, batch_id DESC LIMIT 3) SELECT batch_id, label, f1 FROM runs WHERE batch_id IN (SELECT batch_id FROM b)")
def recent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three latest evaluation batches (TOP17, TOP18, AGG43, FE21); the number is a parameter."""
    return roundup.recent_batches(_runs(spark, sf_dir), 3).select("batch_id", "label", "f1")


@query(f"WITH {_RUNS}, p AS (SELECT *, lag(f1) OVER (PARTITION BY dataset_hash, label ORDER BY created_at, batch_id) AS previous FROM runs) SELECT batch_id, label, f1, previous, {r('f1 - previous', 4)} AS delta FROM p")
def evaluation_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch against the one before it on the same data (AGG42)."""
    return roundup.regression(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, p AS (SELECT a.label, a.batch_id AS a, b.batch_id AS b, {r('b.f1 - a.f1', 4)} AS delta FROM runs a JOIN runs b ON a.label = b.label AND b.batch_id = a.batch_id + 1)
SELECT *, CASE WHEN delta > 0 THEN 'b' WHEN delta < 0 THEN 'a' ELSE 'tie' END AS winner FROM p""")
def ab_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A/B deltas and winner of neighbouring runs (AGG40)."""
    runs = _runs(spark, sf_dir)
    a, b = runs.select("label", F.col("batch_id").alias("a"), F.col("f1").alias("fa")), runs.select("label", (F.col("batch_id") - 1).alias("a"), F.col("batch_id").alias("b"), F.col("f1").alias("fb"))
    d = a.join(b, ["label", "a"]).select("label", "a", "b", half_up(F.col("fb") - F.col("fa"), 4).alias("delta"))
    return d.withColumn("winner", F.when(F.col("delta") > 0, "b").when(F.col("delta") < 0, "a").otherwise("tie"))


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 10) / 10.0::DOUBLE AS p0, (p_partkey % 7) / 7.0::DOUBLE AS r0, (p_partkey % 11) / 11.0::DOUBLE AS p1, (p_partkey % 5) / 5.0::DOUBLE AS r1 FROM part)
SELECT p_partkey, CASE WHEN r1 < 0.4 THEN 'reject_guardrail' WHEN (p1 > p0 AND r1 >= r0) OR (r1 > r0 AND p1 >= p0) THEN 'keep' ELSE 'reject_no_gain' END AS decision FROM x""")
def experiment_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep or reject a change by metrics before and after (AGG41)."""
    k = F.col("p_partkey")
    return t.read(spark, sf_dir, "part").select("p_partkey", roundup.experiment_decision(k % 10 / 10.0, k % 7 / 7.0, k % 11 / 11.0, k % 5 / 5.0, 0.4).alias("decision"))


@query("""SELECT o_custkey AS symbol, min(CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1997-01-01' THEN CAST(o_orderdate AS DATE) END) AS next_day,
  count(*) FILTER (CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AND date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) <= 90) AS n_within FROM orders GROUP BY 1""", dates="next_day")
def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next event of each symbol and events within 90 days (AGG53, FE12, FE13)."""
    o = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"))
    return roundup.calendar(o, F.lit("1997-01-01").cast("date"), 90)


@query(f"""WITH e AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, {r('list_reduce(v, lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE)', 4)} AS ema FROM e""")
def latency_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential average of each user's values in order (AGG55)."""
    return roundup.latency_ema(t.read(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("""WITH a AS (SELECT 'source' AS family, source AS name, 'warning' AS severity FROM documents GROUP BY source HAVING count(*) FILTER (n_chars < 300) > 5
  UNION ALL SELECT 'user', 'U' || user_id, 'critical' FROM events GROUP BY user_id HAVING max(value) > 99.5)
SELECT *, CASE (SELECT max(CASE severity WHEN 'critical' THEN 2 ELSE 1 END) FROM a) WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'ok' END AS overall FROM a""")
def health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of several families and the overall status (AGG46)."""
    made = lambda df, family, name, severity: df.select(F.lit(family).alias("family"), name.alias("name"), F.lit(severity).alias("severity"))
    s = t.read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") < 300).alias("n")).where("n > 5")
    u = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("m")).where("m > 99.5")
    return roundup.worst_alerts([made(s, "source", F.col("source"), "warning"), made(u, "user", F.concat(F.lit("U"), "user_id"), "critical")])


@query(f"""WITH {_N}, s AS (SELECT news_id, effective_at, sentiment_score AS score, (news_id % 100) / 10.0::DOUBLE AS importance, CASE WHEN effective_at >= TIMESTAMP '2024-01-30 12:00:00' AND (news_id % 100) / 10.0 >= 8.5 THEN 1 WHEN (news_id % 100) / 10.0 >= 8.5 THEN 3
  WHEN effective_at >= TIMESTAMP '2024-01-30 12:00:00' THEN 2 ELSE 4 END AS stage FROM n), k AS (SELECT * FROM s WHERE stage = (SELECT min(stage) FROM s))
(SELECT news_id, stage FROM k WHERE stage IN (1, 3) ORDER BY importance DESC, effective_at DESC, news_id DESC LIMIT 5) UNION ALL (SELECT news_id, stage FROM k WHERE stage IN (2, 4) ORDER BY abs(score) DESC, effective_at DESC, news_id DESC LIMIT 3)""")
def spotlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaking items in stages (FE09); the limits are the list's length."""
    rows = t.news(spark, sf_dir).select("news_id", "effective_at", F.col("sentiment_score").alias("score"), (F.col("news_id") % 100 / 10.0).alias("importance"))
    return roundup.spotlight(rows, F.col("effective_at") >= F.expr("timestamp_ntz'2024-01-30 12:00:00'"))


@query(f"""WITH q AS (SELECT * FROM ({t.QUOTES_SQL}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) = 1), c(symbol, kind, sort_order) AS (VALUES ('S1', 'index', 2), ('S2', 'index', 1), ('NONE', 'future', 3))
SELECT c.symbol, kind, sort_order, price, CASE WHEN price IS NULL THEN 'unavailable' ELSE 'ok' END AS status FROM c LEFT JOIN q USING (symbol)""")
def index_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured indexes with their latest quote or a placeholder (JN09, FE05)."""
    c = spark.createDataFrame([("S1", "index", 2), ("S2", "index", 1), ("NONE", "future", 3)], "symbol string, kind string, sort_order int")
    q = timeseries.latest(t.quotes(spark, sf_dir), "symbol", "fetched_at", "id").select("symbol", "price")
    return c.join(q, "symbol", "left").withColumn("status", F.when(F.col("price").isNull(), "unavailable").otherwise("ok"))


@query(f"""WITH {_N}, m AS ({t.MENTIONS_SQL}), l AS ({t.TOPICS_SQL}), w(symbol) AS (VALUES ('S1'), ('S2'))
SELECT DISTINCT m.symbol FROM m JOIN n USING (news_id) LEFT JOIN l USING (news_id) WHERE effective_at >= TIMESTAMP '2024-01-29' AND (sentiment_score > 0.8 OR topic_id = 3) UNION SELECT symbol FROM w""")
def hot_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of strong recent news or of a hot topic, and the watchlist (FLT19)."""
    m = t.mentions(spark, sf_dir).select("news_id", "symbol").join(t.news(spark, sf_dir).select("news_id", "effective_at", "sentiment_score"), "news_id").join(t.topics(spark, sf_dir), "news_id", "left")
    hot = m.where((F.col("effective_at") >= F.expr("timestamp_ntz'2024-01-29 00:00:00'")) & ((F.col("sentiment_score") > 0.8) | (F.col("topic_id") == 3))).select("symbol")
    return hot.union(spark.createDataFrame([("S1",), ("S2",)], "symbol string")).distinct()


@query(f"""WITH {_N} SELECT news_id FROM n WHERE contains(lower(title || ' ' || summary), 'thing') OR contains(lower(title || ' ' || summary), 'avec')""")
def keyword_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News that a keyword subscription wants (FLT24)."""
    return t.news(spark, sf_dir).where(any_term(F.lower(F.concat_ws(" ", "title", "summary")), ("thing", "avec"))).select("news_id")


@query("""WITH p AS (SELECT conv_id % 5 AS tag, turn, conv_id * 100 + turn AS id FROM conversations) SELECT tag, count(*) AS n, CAST(sum(turn) AS BIGINT) AS sources, max(turn) AS priority, array_to_string(list(id ORDER BY id DESC)[1:5], ',') AS newest FROM p GROUP BY 1""")
def macro_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of posts: size, sums, greatest priority, five newest ids (AGG27)."""
    p = t.read(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("tag"), "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.spark_partition_id().alias("part"))
    # Each task keeps its own five before the lists meet.
    part = p.groupBy("tag", "part").agg(F.count("*").alias("n"), F.sum("turn").alias("s"), F.max("turn").alias("priority"), F.slice(F.sort_array(F.collect_list("id"), False), 1, 5).alias("ids"))
    return part.groupBy("tag").agg(F.sum("n").alias("n"), F.sum("s").alias("sources"), F.max("priority").alias("priority"), F.array_join(F.slice(F.sort_array(F.flatten(F.collect_list("ids")), False), 1, 5).cast("array<string>"), ",").alias("newest"))


@query("SELECT source, CAST(300 * least(pow(2, count(*) FILTER (n_chars < 300) % 9), 16) AS DOUBLE) AS delay FROM documents GROUP BY 1")
def backoff_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-off of each source by its failures (DM33, STR07)."""
    s = t.read(spark, sf_dir, "documents").groupBy("source").agg((F.count_if(F.col("n_chars") < 300) % 9).alias("failures"))
    return s.select("source", backoff_seconds(F.lit(300.0), F.col("failures")).alias("delay"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN CASE WHEN abs(value - 50) / 8 >= 5 THEN 'critical' ELSE 'normal' END WHEN event_type = 'view' THEN 'normal' ELSE 'low' END AS severity FROM events""")
def alert_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of each alert (CLS23, DM27)."""
    kind = F.when(F.col("event_type") == "purchase", "watchlist_alert").when(F.col("event_type") == "view", "alert_digest").otherwise("other")
    return t.read(spark, sf_dir, "events").select("event_id", desk.severity(kind, (F.col("value") - 50) / 8).alias("severity"))


@query("""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR AS new FROM events), s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM e)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n FROM s GROUP BY 1, 2""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps of more than six hours."""
    from ..operators.asof import session_gaps

    return session_gaps(t.read(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600).groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


@query("SELECT conv_id * 1000 + turn AS post_id, row_number() OVER (ORDER BY CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, turn DESC, conv_id * 1000 + turn) <= 20 AS first_page FROM conversations WHERE contains(lower(text), 'a')")
def post_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search of posts, and which are on the first page by account tier (FLT08, TOP11, TOP12, JN24)."""
    p = t.read(spark, sf_dir, "conversations").where(F.col("text").ilike("%a%")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), (F.col("conv_id") % 3).alias("tier"), "turn")
    page = p.orderBy("tier", F.col("turn").desc(), "post_id").limit(20).select("post_id", F.lit(True).alias("on_page"))
    return p.join(page, "post_id", "left").select("post_id", F.coalesce("on_page", F.lit(False)).alias("first_page"))
