"""Queries over landed payloads: JSON lists, boards, facts, answers, detail pages, account files, and the portfolio of measured risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import backtest, staging
from ..sources import payloads, providers
from ..sources import tables as t
from .common import ORACLE_SQL, query, r


def _payload(df: DataFrame, by: str, rows: F.Column, wrap: str) -> DataFrame:
    """payload_id and content: the rows of each group as a JSON array in ``wrap``."""
    packed = df.groupBy(F.expr(by).alias("payload_id")).agg(F.to_json(F.array_sort(F.collect_list(rows))).alias("rows"))
    return packed.select("payload_id", F.concat(F.lit(wrap.split("?")[0]), "rows", F.lit(wrap.split("?")[1])).alias("content"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' T' || doc_id ELSE '' END AS title, trim(CASE WHEN doc_id % 4 = 0 THEN '【head ' || doc_id || '】' ELSE '' END || text) AS body FROM documents)
SELECT doc_id // 10 AS payload_id, doc_id AS id, coalesce(nullif(trim(title), ''), nullif(regexp_extract(body, '^【([^】]+)】', 1), ''), substr(body, 1, 60)) AS title, 'u' || doc_id AS url, sha256(body) AS body, 1704067200 + doc_id * 60 AS at, doc_id % 5 = 0 AS has_stock_refs FROM d""")
def telegraph_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telegraph payloads with bracketed titles, epoch times and stock references (SRC16, SRC18)."""
    body = F.concat(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("【head "), "doc_id", F.lit("】"))).otherwise(""), "text")
    stocks = F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit("sh600519").alias("StockID"), F.lit("n").alias("name")))).otherwise(F.expr("cast(array() as array<struct<StockID:string,name:string>>)"))
    item = F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" T"), "doc_id")).otherwise("").alias("title"), body.alias("content"), (1704067200 + F.col("doc_id") * 60).alias("ctime"), F.concat(F.lit("u"), "doc_id").alias("shareurl"), stocks.alias("stock_list"))
    found = payloads.parse_telegraph(_payload(t.read(spark, sf_dir, "documents"), "doc_id div 10", item, '{"data":{"roll_data":?}}'))
    return found.select("payload_id", "id", "title", "url", F.sha2("body", 256).alias("body"), F.unix_timestamp("published_at").alias("at"), "has_stock_refs")


@query("""SELECT conv_id AS payload_id, turn AS id, sha256(text) AS text, 1704067200 + conv_id * 61 + turn AS at FROM conversations WHERE conv_id % 7 <> 3""")
def live_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live feed and news interface payloads with epoch times; malformed ones give nothing (SRC15, SRC17)."""
    item = F.struct(F.col("turn").alias("id"), F.col("text").alias("content_text"), (1704067200 + F.col("conv_id") * 61 + F.col("turn")).alias("display_time"))
    landed = _payload(t.read(spark, sf_dir, "conversations"), "conv_id", item, '{"data":{"items":?}}')
    broken = F.when(F.col("payload_id") % 7 == 3, F.concat(F.lit("["), "content")).otherwise(F.col("content"))
    items = payloads.parse_json_items(landed.withColumn("content", broken), "data struct<items:array<struct<id:bigint,content_text:string,display_time:bigint>>>", "data.items")
    return items.select("payload_id", "id", F.sha2("content_text", 256).alias("text"), F.unix_timestamp(F.timestamp_seconds("display_time")).alias("at"))


@query("""SELECT s_nationkey AS payload_id, 'BK' || s_suppkey AS code, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey AS DOUBLE) / 4 END AS price, s_suppkey % 9 AS advance_count, s_suppkey % 4 AS decline_count, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 END AS flat_count
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY 'BK' || s_suppkey) AS rn FROM supplier WHERE s_suppkey % 11 <> 0) WHERE rn <= 100""")
def board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry boards of payloads whose list is an array or a map (SRC33); a payload's limit is a setting."""
    key = F.col("s_suppkey")
    board = F.struct(
        F.when(key % 11 != 0, F.concat(F.lit("BK"), key)).otherwise("").alias("f12"), F.col("s_name").alias("f14"), F.when(key % 5 != 0, (key / 4).cast("string")).otherwise("-").alias("f2"), (key % 9).cast("string").alias("f104"), (key % 4).cast("string").alias("f105"),
        F.when(key % 3 == 0, (key % 2).cast("string")).otherwise("-").alias("f106"),
    )
    packed = t.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("payload_id")).agg(F.array_sort(F.collect_list(board)).alias("b"))
    numbered = F.map_from_arrays(F.transform("b", lambda x, i: i.cast("string")), F.col("b"))
    content = F.concat(F.lit('{"data":{"diff":'), F.when(F.col("payload_id") % 2 == 0, F.to_json("b")).otherwise(F.to_json(numbered)), F.lit("}}"))
    return providers.parse_boards(packed.select("payload_id", content.alias("content"))).select("payload_id", "code", "name", "price", "advance_count", "decline_count", "flat_count")


@query("""WITH c AS (SELECT 'C' || c_custkey AS symbol, c_custkey AS k, CAST(c_custkey % 90 AS DOUBLE) / 8 AS eps, CAST(c_custkey % 40 - 20 AS DOUBLE) AS yoy FROM customer WHERE c_custkey % 13 <> 0)
SELECT symbol, '2024-0' || (k % 4 * 2 + 1) || '-15' AS period_end, 'eps' AS metric_key, eps AS value, '2024-0' || (k % 4 * 2 + 2) || '-20' AS available_at, 'D' || k AS document_id FROM c
UNION ALL SELECT symbol, '2024-0' || (k % 4 * 2 + 1) || '-15', 'net_profit_yoy', yoy / 100.0, '2024-0' || (k % 4 * 2 + 2) || '-20', 'D' || k FROM c WHERE k % 6 <> 0""")
def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial facts of provider payloads: percent as ratio, no row without a number or period (SRC32)."""
    key, day = F.col("c_custkey"), lambda add, d: F.concat(F.lit("2024-0"), key % 4 * 2 + add, F.lit(f"-{d} 00:00:00"))
    record = F.struct(
        F.when(key % 13 != 0, day(1, 15)).alias("REPORT_DATE"), day(2, 20).alias("NOTICE_DATE"), F.concat(F.lit("D"), key).alias("SECURITY_CODE"), ((key % 90) / 8).cast("string").alias("EPS"), F.when(key % 6 != 0, (key % 40 - 20).cast("string")).otherwise("-").alias("YOY")
    )
    landed = t.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("symbol"), F.concat(F.lit('{"result":{"data":'), F.to_json(F.array(record)), F.lit("}}")).alias("content"))
    found = providers.parse_facts(landed, {"eps": "EPS", "net_profit_yoy": "YOY"}, ("net_profit_yoy",))
    return found.withColumns({"period_end": F.col("period_end").cast("string"), "available_at": F.col("available_at").cast("string")})


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' END AS label, CASE conv_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS relevant, CASE WHEN conv_id % 4 <> 1 THEN CAST(turn AS DOUBLE) / 8 END AS score FROM conversations""")
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, optional booleans and safe numbers of answers with and without a code fence (SC31, SC32, SC33)."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    inner = F.to_json(F.struct(F.when(F.col("turn") % 3 != 2, pick(["keep", "drop", ""], F.col("turn"))).alias("label"), pick([" Yes", "1", "FALSE", "n", "maybe"], F.col("conv_id")).alias("relevant"), F.when(F.col("conv_id") % 4 == 1, "NaN").otherwise((F.col("turn") / 8).cast("string")).alias("score")))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), inner, F.lit("\n```\nend"))).otherwise(F.concat(F.lit("Answer: "), inner))
    parsed = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", payloads.fenced_json(answer, "label string, relevant string, score string").alias("j"))
    return parsed.select("conv_id", "turn", "j.label", text.optional_bool(F.col("j.relevant")).alias("relevant"), text.safe_double(F.col("j.score")).alias("score"))


@query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS x FROM pages)
SELECT page_id, sha256(x) AS digest, CASE WHEN length(x) = 0 THEN 'empty' WHEN contains(lower(x), 'captcha') OR contains(lower(x), 'eresti') THEN 'blocked' WHEN length(x) < 900 THEN 'too_short' END AS quality,
  array_to_string(list_filter(list_transform(string_split(x, ','), lambda w: trim(w)), lambda w: w <> '')[1:3], '|') AS keywords FROM p""")
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text, why one is no article, and comma-separated words (SC11, CLS22, SC23)."""
    p = t.read(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("x"))
    return p.select("page_id", F.sha2("x", 256).alias("digest"), rules.page_quality(F.col("x"), ("captcha", "eresti"), 900).alias("quality"), F.array_join(F.slice(text.keyword_list(F.col("x")), 1, 3), "|").alias("keywords"))


@query(f"""WITH cal AS ({ORACLE_SQL['sentiment_calibration']}), s AS ({t.SIGNALS_SQL})
SELECT news_id, cal.confidence FROM s JOIN cal ON cal.bucket = least(4, CAST(floor(abs(coalesce(score, 0)) * 5 + 1e-9) AS INT))""")
def calibrated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's confidence by the calibration table (DM22)."""
    s = t.signals(spark, sf_dir)
    table = backtest.calibration(backtest.score_buckets(backtest.outcomes(s, t.quotes(spark, sf_dir))))
    return backtest.calibrated(s, table).select("news_id", "confidence")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN 'Title ' || doc_id ELSE 'fallback' END AS title, CASE WHEN doc_id % 4 <> 1 THEN '2024-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS day, CASE WHEN doc_id % 3 <> 2 THEN sha256(trim(regexp_replace(translate(text, '"<>&/\', ''), '\s+', ' ', 'g'))) END AS body FROM documents""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, day and body of detail pages with escaped page data (SRC13)."""
    plain = F.translate("text", '"<>&/\\', "")
    head = F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit('x ArticleTitle\\",\\"props\\":{\\"date\\":\\"2024-03-'), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit('\\",\\"title\\":\\"Title '), "doc_id", F.lit('\\"}')))
    pushed = F.concat(F.lit('<script>self.__next_f.push([1,"\\u003cdiv style=\\"margin: 0; padding: 40px 20px;\\"\\u003e\\u003cp\\u003e'), plain, F.lit('\\u003c\\/p\\u003e\\u003c\\/div\\u003e"])</script>'))
    inline = F.concat(F.lit('\\u003cdiv style=\\"max-width: 768px; margin: auto\\"\\u003e'), plain, F.lit("\\u003c/div\\u003e"))
    body = F.when(F.col("doc_id") % 3 == 0, pushed).when(F.col("doc_id") % 3 == 1, inline).otherwise("")
    page = F.concat(F.coalesce(head, F.lit("")), F.coalesce(body, F.lit("")))
    d = t.read(spark, sf_dir, "documents").select("doc_id", payloads.detail_page(page, F.lit("fallback")).alias("p"))
    return d.select("doc_id", "p.title", F.date_format("p.published_at", "yyyy-MM-dd").alias("day"), F.sha2("p.content_text", 256).alias("body"))


@query("""SELECT lower(trim(' @C' || c_custkey)[2:]) AS handle, c_name AS display_name, CASE WHEN c_custkey % 3 = 0 THEN 'core' ELSE 'normal' END AS tier, CAST(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 100 ELSE 50 END AS INT) AS priority FROM customer WHERE c_custkey % 17 <> 0""")
def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of JSON account files, written and read again (SRC40)."""
    key = F.col("c_custkey")
    entry = F.struct(F.when(key % 17 != 0, F.concat(F.lit(" @C"), key)).alias("handle"), F.col("c_name").alias("display_name"), F.when(key % 3 == 0, "core").alias("tier"), F.when(key % 4 != 0, key % 100).alias("priority"))
    files = t.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("accounts"))).alias("value"))
    path = staging.new_path(spark, "accounts")
    files.select("value").write.text(path)
    return payloads.read_accounts(spark, path)


# The fold of `allocation` (plans/desk.py), for each portfolio in order of risk.
ORACLE_SQL["allocation"] = f"""WITH RECURSIVE vol AS ({ORACLE_SQL['volatility_20d']}),
raw AS (SELECT 'N' || s_nationkey AS portfolio, symbol, ['trend_flow', 'event_catalyst'][s_suppkey % 2 + 1] AS sleeve, 1 / greatest(vol, 1e-6) AS raw, row_number() OVER (PARTITION BY s_nationkey ORDER BY vol, symbol) AS rn FROM vol JOIN supplier ON symbol = 'P' || s_suppkey),
kept AS (SELECT *, sum(raw) OVER (PARTITION BY portfolio) AS total FROM raw WHERE rn <= 12),
fold(portfolio, rn, symbol, weight, reason, invested, trend, event) AS (
  SELECT DISTINCT portfolio, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 0e0, CAST(NULL AS VARCHAR), 0e0, 0e0, 0e0 FROM kept
  UNION ALL
  SELECT portfolio, rn, symbol, CASE WHEN reason IS NULL THEN w ELSE 0 END, reason, invested + CASE WHEN reason IS NULL THEN w ELSE 0 END,
    trend + CASE WHEN sleeve = 'trend_flow' AND reason IS NULL THEN w ELSE 0 END, event + CASE WHEN sleeve <> 'trend_flow' AND reason IS NULL THEN w ELSE 0 END
  FROM (
    SELECT *, CASE WHEN cash <= 0 THEN 'cash_floor' WHEN w <= 0 THEN 'sleeve_or_cash_cap' END AS reason
    FROM (
      SELECT f.portfolio, k.rn, k.symbol, k.sleeve, f.invested, f.trend, f.event, (1 - 0.1e0) - f.invested AS cash, least(0.08e0, (1 - 0.1e0) - f.invested, 0.5e0 - CASE WHEN k.sleeve = 'trend_flow' THEN f.trend ELSE f.event END, k.raw / k.total) AS w
      FROM fold f JOIN kept k ON k.portfolio = f.portfolio AND k.rn = f.rn + 1)))
SELECT portfolio, {r('greatest(0.1e0, 1 - max(invested) OVER (PARTITION BY portfolio))', 6)} AS cash, symbol, sleeve, {r('weight', 6)} AS weight, reason FROM fold JOIN (SELECT portfolio AS p, symbol AS s, sleeve FROM kept) ON p = portfolio AND s = symbol"""
