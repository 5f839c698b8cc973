"""Ingestion queries: payload parsing, relevance gate, deduplicated inserts, merges, retention, radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import half_up
from ..operators import news as news_ops
from ..operators import upsert
from ..sources import payloads
from ..sources import tables as t
from .common import query, r

_N = f"n AS ({t.NEWS_SQL})"


@query(r"""WITH d AS (SELECT doc_id, doc_id // 20 AS payload_id, CAST(doc_id % 20 AS INT) AS pos, trim(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z ]', '', 'g')) AS title FROM documents)
SELECT payload_id, pos, title, 'https://example.org/' || doc_id % 1000 AS url FROM d WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY payload_id, url ORDER BY pos) = 1""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS and Atom payloads made of the documents and parsed again (SRC05 to SRC08)."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 20").alias("payload_id"), F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "[^A-Za-z ]", "")).alias("title"))
    url = F.concat(F.lit("https://example.org/"), F.col("doc_id") % 1000)
    atom = F.col("payload_id") % 2 == 1
    item = F.when(atom, F.concat(F.lit("<entry><title>"), "title", F.lit('</title><link rel="self" href="x"/><link rel="alternate" href="'), url, F.lit('"/></entry>'))).otherwise(F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), url, F.lit("</link><description>a & b</description></item>")))
    made = d.groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda x: x["x"]), "").alias("body"))
    content = F.when(atom, F.concat(F.lit("<feed>"), "body", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), "body", F.lit("</channel></rss>")))
    return payloads.parse_feeds(made.select("payload_id", content.alias("content"))).select("payload_id", "pos", "title", "url")


@query(f"WITH b AS ({t.BARS_SQL}) SELECT symbol, trade_date, {r('open', 4)} AS open, {r('close', 4)} AS close, {r('high', 4)} AS high, {r('low', 4)} AS low, volume, {r('amount', 2)} AS amount FROM b", dates="trade_date")
def bar_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar lines in JSON payloads of a symbol and year, made of the bars and parsed again (SRC29, SRC30, SRC31)."""
    b = t.bars(spark, sf_dir)
    fixed = lambda c, k: half_up(F.col(c), k).cast("decimal(24,6)").cast("string")
    line = F.concat_ws(",", F.col("trade_date").cast("string"), fixed("open", 4), fixed("close", 4), fixed("high", 4), fixed("low", 4), F.col("volume").cast("decimal(24,2)").cast("string"), fixed("amount", 2))
    made = b.groupBy("symbol", F.year("trade_date").alias("y")).agg(F.to_json(F.struct(F.struct(F.collect_list(line).alias("klines")).alias("data"))).alias("content"))
    return payloads.parse_bar_lines(made).drop("turnover_rate")


@query("""SELECT 'S' || user_id AS symbol, event_id % 2 = 0 AS cn, floor(value * 100 + 0.500001) / 100 AS price, CAST(event_id AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 100 ELSE 1 END AS volume FROM events""")
def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote lines with fields between tildes (SRC27)."""
    cn = F.col("event_id") % 2 == 0
    price = half_up(F.col("value"), 2).cast("decimal(12,2)").cast("string")
    fields = [F.lit("0")] * 3 + [price, price, price, F.col("event_id").cast("string")] + [F.lit("")] * 24 + [F.lit("0.1"), F.lit("1.5"), price, price]
    e = t.read(spark, sf_dir, "events").select(F.concat(F.lit("S"), "user_id").alias("symbol"), F.when(cn, "cn").otherwise("hk").alias("market"), F.concat(F.lit('v_x="'), F.concat_ws("~", *fields), F.lit('";')).alias("content"))
    return payloads.parse_quote_text(e).select("symbol", (F.col("market") == "cn").alias("cn"), "price", "volume")


@query(r"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?s)<p\b[^>]*>(.*?)</p>', 1),
  lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) >= 25) AS ps FROM pages)
SELECT page_id, array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), chr(10) || chr(10)) AS body FROM p""")
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph bodies of the pages (SRC19, SRC22)."""
    return t.read(spark, sf_dir, "pages").select("page_id", payloads.body_paragraphs(F.col("html")).alias("body"))


_TERMS = rules.RelevanceTerms(strong=("thent", "oning"), weak=("ander", "thand"), phrases=("of the the",), acronyms=("st", "nd"), generic_tech=("that",), sectors={"core": (("inging", "onthe", "tion"), ("the",))}, noise=("quelle",))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.news(spark, sf_dir).withColumn("v", rules.relevance(F.col("title"), F.col("summary"), F.lit(None).cast("string"), _TERMS))
    return n.withColumn("g", rules.ingest_gate(F.col("source_name") == "src3", F.col("news_id") % 29 == 0, F.col("v")))


_GATE_SQL = f"""WITH {_N}, w AS (SELECT news_id, source_name, lower(title || ' ' || summary) AS txt, regexp_extract_all(lower(title || ' ' || summary), '[a-z0-9]+') AS ws FROM n),
v AS (SELECT *, list_has_any(ws, ['inging', 'onthe', 'tion']) AND contains(txt, 'the') AS sector FROM w),
k AS (SELECT *, CASE WHEN list_has_any(ws, ['thent', 'oning']) THEN 'market_signal_term' WHEN sector AND list_has_any(ws, ['ander', 'thand']) THEN 'sector_signal_term' WHEN contains(txt, 'of the the') THEN 'market_signal_phrase'
  WHEN list_has_any(ws, ['st', 'nd']) THEN 'macro_acronym' WHEN sector AND list_has_any(ws, ['orders', 'capacity', 'shipments', 'guidance']) THEN 'sector_signal' WHEN contains(txt, 'quelle') THEN 'chinese_noise' WHEN list_has_any(ws, ['that']) THEN 'generic_tech' END AS reason FROM v)
SELECT news_id, CASE WHEN source_name = 'src3' THEN 'official_source' WHEN news_id % 29 = 0 THEN 'structured_stock_refs' WHEN reason IS NULL OR reason IN ('chinese_noise', 'generic_tech') THEN 'no_market_signal:' || coalesce(reason, 'none')
  WHEN reason = 'sector_signal_term' THEN 'weak_signal:' || reason ELSE 'market_signal:' || reason END AS reason,
  source_name = 'src3' OR news_id % 29 = 0 OR coalesce(reason IN ('market_signal_term', 'market_signal_phrase', 'macro_acronym', 'sector_signal'), false) AS passed FROM k"""


@query(_GATE_SQL)
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance cascade and ingest gate, with terms of the invented languages (CLS07 to CLS11, FLT15)."""
    return _gate(spark, sf_dir).select("news_id", "g.reason", "g.passed")


@query(f"SELECT reason, passed, count(*) AS n FROM ({_GATE_SQL}) GROUP BY ALL")
def drop_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each gate reason let through or dropped (SNK04)."""
    return _gate(spark, sf_dir).groupBy("g.reason", "g.passed").agg(F.count("*").alias("n"))


#: Closing words of titles that make each rule of the cascade the first that fits, and some that make none.
_PROBES = (
    "shares of a bank", "shipment of ai servers", "dividend paid", "央行公开市场操作", "召回外交人员", "产品召回", "CPI up", "shipping on a new route", "空袭 油轮", "恢复 运河", "台湾 军售", "伊朗 军事行动 参议院 投票", "iphone supplier orders", "演唱会", "新概念 涨停",
    "laptop", "早报 要闻", "港股 走低", "nothing here", "美股 收跌", "halbleiter wafer export controls", "tencent gaming recovery",
)
_ROUNDUPS = ("", "美股 上涨", "a股")


def _probe_sql() -> str:
    terms = rules.RelevanceTerms()
    has = lambda col, words: f"regexp_matches({col}, '{'|'.join(words)}')"
    words = lambda some: "list_has_any(ws, [" + ", ".join(f"'{w}'" for w in some) + "])"
    sector = {name: f"(({words(anchors)}" + "".join(f" OR contains(txt, '{p}')" for p in terms.anchor_phrases.get(name, ())) + f") AND {has('txt', near)})" for name, (anchors, near) in terms.sectors.items()}
    pick = lambda some, key: f"[{', '.join(repr(x) for x in some)}][{key} % {len(some)} + 1]"
    return f"""WITH {_N}, k AS (SELECT news_id, title || ' ' || {pick(_PROBES, 'news_id')} AS title, {pick(_ROUNDUPS, 'news_id')} AS body FROM n),
x AS (SELECT news_id, title, title || ' ' || body AS raw, lower(title || ' ' || body) AS txt, regexp_extract_all(lower(title || ' ' || body), '[a-z0-9]+') AS ws, CASE WHEN {has('title', terms.digest_titles)} THEN lower(title) ELSE lower(title || ' ' || body) END AS alias FROM k),
s AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, test in sector.items())}], lambda z: z IS NOT NULL) AS tags FROM x),
v AS (SELECT news_id, array_to_string(tags, ',') AS sectors, CASE WHEN {words(terms.strong)} THEN 'market_signal_term' WHEN len(tags) > 0 AND {words(terms.weak)} THEN 'sector_signal_term' WHEN {has('txt', terms.phrases)} THEN 'market_signal_phrase'
  WHEN contains(alias, '美股') AND {has('alias', terms.us_context)} OR {has('alias', terms.broad)} OR {has('txt', [w for w in terms.chinese if w != '召回'])} OR contains(txt, '召回') AND NOT {has('txt', terms.recall_friends)} THEN 'chinese_market_phrase'
  WHEN {words(terms.acronyms)} THEN 'macro_acronym' WHEN {words(terms.shipping_routes)} AND {has('txt', terms.shipping_disruptions)} THEN 'shipping_disruption' WHEN {has('txt', terms.geo_actions)} AND {has('txt', terms.energy_carriers)} THEN 'geo_energy_shipping'
  WHEN {has('txt', terms.status_changes)} AND {has('txt', terms.status_carriers)} THEN 'shipping_status_change' WHEN {has('raw', terms.taiwan)} AND {has('raw', terms.arms)} THEN 'taiwan_arms_sale'
  WHEN {has('raw', terms.iran)} AND {has('raw', terms.military)} AND {has('raw', terms.war_powers)} THEN 'iran_war_powers' WHEN len(tags) > 0 AND ({words(terms.sector_triggers)} OR {has('txt', ('export controls', 'supply chain'))}) THEN 'sector_signal'
  WHEN {has('txt', terms.noise)} THEN 'chinese_noise' WHEN {has('raw', terms.concepts)} AND {has('raw', terms.moves)} THEN 'concept_mover' WHEN {words(terms.generic_tech)} THEN 'generic_tech' END AS reason FROM s)
SELECT news_id, reason, coalesce(reason NOT IN ('chinese_noise', 'generic_tech'), false) AS relevant, sectors FROM v"""


@query(_probe_sql())
def relevance_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole relevance cascade with its own terms, over titles that make each rule fire (CLS07 to CLS11)."""
    pick = lambda some: F.element_at(F.array(*map(F.lit, some)), (F.col("news_id") % len(some) + 1).cast("int"))
    rows = t.news(spark, sf_dir).select("news_id", F.concat_ws(" ", "title", pick(_PROBES)).alias("title"), pick(_ROUNDUPS).alias("body"))
    v = rows.select("news_id", rules.relevance(F.col("title"), F.lit(None).cast("string"), F.col("body")).alias("v"))
    return v.select("news_id", "v.reason", "v.relevant", F.array_join("v.sectors", ",").alias("sectors"))


_IN = "news_id % 3 = 0"


@query(f"""WITH {_N}, k AS (SELECT *, md5(title) AS h FROM n) SELECT min(news_id) AS news_id FROM k WHERE {_IN} AND h NOT IN (SELECT h FROM k WHERE NOT ({_IN})) GROUP BY h""")
def deduplicated_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items whose key is not stored yet, one for each key (SNK01, SNK07, SNK12, SNK28, SET10, SET12)."""
    rows = t.news(spark, sf_dir).select("news_id", F.md5("title").alias("h"))
    fresh = rows.where(_IN).groupBy("h").agg(F.min("news_id").alias("news_id"))
    return upsert.insert_ignore(rows.where(f"NOT ({_IN})"), fresh, ["h"]).select("news_id")


@query("""WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS k, 'new' || c_custkey AS name, 0.0::DOUBLE AS bal FROM customer WHERE c_custkey % 3 = 0)
SELECT k, coalesce(o.name, n.name) AS name, coalesce(o.bal, n.bal) AS bal FROM o FULL JOIN n USING (k)""")
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-level merge that only fills what is missing (SNK02, SNK05)."""
    c = t.read(spark, sf_dir, "customer")
    old = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("new"), "c_custkey").alias("name"), F.lit(0.0).alias("bal"))
    return upsert.fill_only(old, new, ["k"])


@query(f"""WITH b AS ({t.BARS_SQL}), nw AS (SELECT symbol, trade_date, close * 2 AS close FROM b WHERE year(trade_date) = 2000), od AS (SELECT symbol, trade_date, close FROM b WHERE year(trade_date) < 2001)
SELECT symbol, trade_date, {r('coalesce(nw.close, od.close)', 4)} AS close FROM od FULL JOIN nw USING (symbol, trade_date)""", dates="trade_date")
def bar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars upserted by symbol and day, the later write wins (SNK06, SNK09, SNK10, SNK11)."""
    b = t.bars(spark, sf_dir).select("symbol", "trade_date", "close")
    new = b.where("year(trade_date) = 2000").withColumn("close", F.col("close") * 2)
    return upsert.latest_wins(b.where("year(trade_date) < 2001"), new, ["symbol", "trade_date"]).withColumn("close", half_up(F.col("close"), 4))


@query(f"WITH q AS ({t.QUOTES_SQL}) SELECT fetched_at < TIMESTAMP '2024-01-11' AS expired, count(*) AS n, min(id) AS first_id FROM q GROUP BY 1")
def retention_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows past their retention, and the others (SNK16, SNK17, SNK18, FLT29)."""
    old, kept = upsert.split_expired(t.quotes(spark, sf_dir), "fetched_at", F.expr("timestamp_ntz'2024-01-11 00:00:00'"))
    return old.withColumn("expired", F.lit(True)).union(kept.withColumn("expired", F.lit(False))).groupBy("expired").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations")
    words = F.element_at(F.array(*map(F.lit, ("no news", "Tariff talk", "CPI day", "the FED speaks"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), (F.col("conv_id") % 7).alias("account_id"), F.element_at(F.array(*map(F.lit, ("core", "watch", "muted"))), (F.col("conv_id") % 3 + 1).cast("int")).alias("tier"),
        (F.col("turn") * 30).alias("priority"), words.alias("text"), F.when(F.col("turn") % 2 == 0, "S1").alias("symbol"),
    )


@query(f"""WITH p AS (SELECT conv_id * 1000 + turn AS post_id, conv_id % 7 AS account_id, CASE conv_id % 3 WHEN 0 THEN 40.0 WHEN 1 THEN 22.0 ELSE 0.0 END + least(greatest(turn * 30, 0), 100) * 0.2 AS w,
  CASE conv_id % 4 WHEN 1 THEN 'tariff' WHEN 2 THEN 'rate' WHEN 3 THEN 'fed' END AS tag, CASE conv_id % 4 WHEN 1 THEN 34.0 WHEN 2 THEN 24.0 WHEN 3 THEN 22.0 END AS rw, turn % 2 = 0 AS has FROM conversations)
SELECT 'account_post' AS signal_type, NULL AS tag, {r('w::DOUBLE + CASE WHEN has THEN 8 ELSE 0 END', 4)} AS priority_score, 0.62::DOUBLE AS confidence, post_id, 1::BIGINT AS source_count FROM p
UNION ALL SELECT 'macro_event', tag, {r('w::DOUBLE + rw + CASE WHEN has THEN 10 ELSE 0 END', 4)}, 0.82::DOUBLE, post_id, 1 FROM p WHERE tag IS NOT NULL
UNION ALL SELECT 'multi_account_resonance', tag, {r('max(rw)::DOUBLE + 60 + 4 * count(DISTINCT account_id)', 4)}, 0.9::DOUBLE, min(post_id), count(DISTINCT account_id) FROM p WHERE tag IS NOT NULL GROUP BY tag HAVING count(DISTINCT account_id) >= 2""")
def radar_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account, macro and resonance signals of posts (AGG28, CLS21, DM28)."""
    return rules.radar_signals(_posts(spark, sf_dir))


@query(f"""WITH {_N} SELECT news_id, CASE WHEN contains(source_name, '1') THEN 'D' ELSE 'C' END AS grade, 'discovered' AS state FROM n""")
def event_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence grades and proposed states (CLS14, CLS15, CLS16, CLS18)."""
    n = t.news(spark, sf_dir)
    name = F.when(F.contains("source_name", F.lit("1")), F.concat("source_name", F.lit(" weibo"))).otherwise(F.col("source_name"))
    g = n.select("news_id", rules.evidence_grade(name, F.lit("")).alias("grade"))
    return g.withColumn("state", rules.propose_state(F.col("grade"), F.lit(0.8), F.lit(0.8), F.lit(1.0), F.lit(0.7)))


@query(f"""WITH {_N}, c AS (SELECT news_id, CASE news_id % 5 WHEN 0 THEN 'policy_macro' WHEN 1 THEN 'company_action' WHEN 2 THEN 'supply_chain' WHEN 3 THEN 'price_action' ELSE 'other' END AS category, epoch(TIMESTAMP '2024-02-01' - effective_at) / 86400 AS age FROM n)
SELECT news_id, CASE WHEN category IN ('policy_macro', 'company_action') THEN CASE WHEN age <= 7 THEN 'act_now' ELSE 'watch_today' END WHEN category = 'supply_chain' THEN 'watch_today'
  WHEN category = 'price_action' THEN CASE WHEN age <= 3 THEN 'watch_today' ELSE 'know_only' END ELSE 'know_only' END AS action FROM c""")
def driver_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action levels by category and age (CLS19, CLS20, TOP13)."""
    category = F.element_at(F.array(*map(F.lit, ("policy_macro", "company_action", "supply_chain", "price_action", "other"))), (F.col("news_id") % 5 + 1).cast("int"))
    age = (F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("effective_at")) / 86400
    return t.news(spark, sf_dir).select("news_id", rules.driver_action(category, age).alias("action"))


@query("SELECT DISTINCT source, CASE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'fallback' END AS tier, false AS official FROM documents")
def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and official flag of each source without a registry entry (FLT16)."""
    s = t.read(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", news_ops.source_tier(F.col("source")).alias("tier"), news_ops.official(F.col("source")).alias("official"))


@query(r"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]+)">', 1))) AS INT) AS n_links, regexp_extract(html, '<a href="([^"]+)">', 1) AS first_url FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page (part of SRC09)."""
    p = t.read(spark, sf_dir, "pages").select("page_id", payloads.anchors(F.col("html")).alias("a"))
    return p.select("page_id", F.size("a").alias("n_links"), F.coalesce(F.get("a", F.lit(0))["url"], F.lit("")).alias("first_url"))
