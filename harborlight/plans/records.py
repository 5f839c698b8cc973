"""Queries over stored records: sources, better URLs, card merges, topics, proposals, reviews, page payloads, feed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import topics
from ..functions.numbers import limit_up_price
from ..operators import records
from ..sources import payloads
from ..sources import tables as t
from .common import query, r

_N = f"n AS ({t.NEWS_SQL})"
_STRINGS = "array<string>"


def _pick(values: list, key: str) -> Column:
    column = lambda v: F.lit(None).cast("string") if v is None else F.array(*map(F.lit, v)).cast(_STRINGS) if isinstance(v, list) else F.lit(v)
    return F.element_at(F.array(*map(column, values)), (F.expr(key) % len(values) + 1).cast("int"))


def _pick_sql(values: list, key: str) -> str:
    one = lambda v: "NULL" if v is None else f"CAST([{', '.join(map(repr, v))}] AS VARCHAR[])" if isinstance(v, list) else repr(v)
    return f"[{', '.join(map(one, values))}][{key} % {len(values)} + 1]"


def _map_sql(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in table.items())}}}"


_KEYWORDS = [["ai", "chips", "tencent"], ["market", "orders"], ["foo"], ["芯片", "Cloud", "芯片"], [], ["guidance", "oil"], ["fed", "rates", "oil", "energy"]]
_KEYS = ["oil-demand update", "general-market-update", "", "semiconductor"]
_HEADS = ["", "新闻 ", "", "", "", "The report of "]
_TAILS = [" raises guidance", " 收购", " iphone supplier orders", "", " tariff on wafer", " shares", " bond", " shortage"]
_ALIAS_SQL = _map_sql(topics.TOPIC_ALIASES)


@query(f"""WITH {_N}, k AS (SELECT news_id, trim({_pick_sql(_HEADS, 'news_id')} || CASE WHEN news_id % 8 = 0 THEN '' ELSE title END) AS title, {_pick_sql(_KEYS, 'news_id')} AS key, {_pick_sql(_KEYWORDS, 'news_id')} AS kw FROM n),
w AS (SELECT *, list_filter(list_concat(kw, regexp_split_to_array(replace(key, '-', ' '), '\\s+')), lambda x: x <> '') AS toks FROM k),
l AS (SELECT *, list_filter(list_transform(toks, lambda x: map_extract({_ALIAS_SQL}, lower(x))[1]), lambda x: x IS NOT NULL) AS al, list_filter(list_transform(toks, lambda x: coalesce(map_extract({_ALIAS_SQL}, lower(x))[1], CASE WHEN regexp_matches(x, '{topics.CJK}') THEN x END)), lambda x: x IS NOT NULL) AS named FROM w),
p AS (SELECT *, array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i)[1:3], '') AS parts FROM l)
SELECT news_id, CASE WHEN regexp_matches(title, '{topics.CJK}') THEN title WHEN parts <> '' THEN parts ELSE coalesce(nullif(title, ''), nullif(key, ''), '{topics.NO_TOPIC}') END AS name, al[1] AS alias FROM p""")
def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable topic names and the first alias (SC24, SC25)."""
    title = F.trim(F.concat(_pick(_HEADS, "news_id"), F.when(F.col("news_id") % 8 == 0, "").otherwise(F.col("title"))))
    k = t.news(spark, sf_dir).select("news_id", title.alias("title"), _pick(_KEYS, "news_id").alias("key"), _pick(_KEYWORDS, "news_id").alias("kw"))
    return k.select("news_id", topics.topic_name(F.col("key"), F.col("title"), F.col("kw")).alias("name"), topics.first_alias(F.col("key"), F.col("kw")).alias("alias"))


def _label_sql(table: dict[str, tuple[str, ...]]) -> str:
    return " ".join(f"WHEN regexp_matches(txt, '{'|'.join(words)}') THEN '{label}'" for label, words in table.items())


@query(f"""WITH {_N}, k AS (SELECT news_id, {_pick_sql(_HEADS, 'news_id')} || title || {_pick_sql(_TAILS, 'news_id')} AS title, CASE WHEN news_id % 4 = 0 THEN summary END AS summary, {_pick_sql(_KEYWORDS, 'news_id')} AS kw FROM n),
x AS (SELECT *, array_to_string(list_filter([title, summary, array_to_string(kw, ' ')], lambda z: z IS NOT NULL AND z <> ''), ' ') AS raw FROM k),
y AS (SELECT *, lower(raw) AS txt, list_concat(kw, list_filter(regexp_extract_all(split_part(raw, chr(10), 1), '[A-Za-z0-9一-鿿]+')[1:4], lambda z: lower(z) NOT IN ({', '.join(map(repr, topics.ARTICLES))})))[1] AS word FROM x)
SELECT news_id, CASE {' '.join(f"WHEN contains(txt, '{e}') THEN '{topics.TOPIC_ALIASES.get(e, e)}'" for e in topics.ENTITIES)} ELSE coalesce(map_extract({_ALIAS_SQL}, lower(word))[1], word, '{topics.NO_SUBJECT}') END
  || '：' || CASE {_label_sql(topics.EVENTS)} ELSE '{topics.NO_EVENT}' END || '，影响' || CASE {_label_sql(topics.IMPACTS)}
  ELSE coalesce(list_filter(list_transform(kw, lambda z: map_extract({_ALIAS_SQL}, lower(z))[1]), lambda z: z IS NOT NULL AND z NOT IN ({', '.join(map(repr, topics.UNSPECIFIC_ALIASES))}))[1] || '相关标的', '{topics.NO_IMPACT}') END AS takeaway FROM y""")
def takeaways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sentence takeaways of news items (SC27)."""
    n = t.news(spark, sf_dir)
    title = F.concat(_pick(_HEADS, "news_id"), "title", _pick(_TAILS, "news_id"))
    return n.select("news_id", topics.takeaway(title, F.when(F.col("news_id") % 4 == 0, F.col("summary")), _pick(_KEYWORDS, "news_id")).alias("takeaway"))


_RATINGS = ["Buy", " strong sell ", "观望", "bearish", "???", None, "增持", "unknown"]
_HORIZONS = ["30m", " 4H ", "1d", "0h", "h", None, "2w"]
_NUMBERS = ["12", "x", None, " 7 "]


@query(f"""WITH k AS (SELECT conv_id, turn, lower(trim(coalesce({_pick_sql(_RATINGS, 'conv_id')}, ''))) AS word, lower(trim({_pick_sql(_HORIZONS, '(conv_id + turn)')})) AS h, {_pick_sql(_NUMBERS, 'conv_id')} AS num FROM conversations),
p AS (SELECT *, TRY_CAST(regexp_extract(h, '^(\\d+)[mhd]$', 1) AS BIGINT) AS amount FROM k)
SELECT conv_id, turn, CASE WHEN word IN ({', '.join(map(repr, topics.RATINGS))}) THEN word ELSE coalesce(map_extract({_map_sql(topics.RATING_SYNONYMS)}, word)[1], 'neutral') END AS rating,
  CASE WHEN amount > 0 THEN amount * CASE right(h, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END AS horizon_seconds, TRY_CAST(trim(num) AS BIGINT) AS number,
  strftime(make_timestamp((1704067200 + conv_id * 61 + turn) * 1000000), '%Y-%m-%d %H:%M:%S') AS at,
  array_to_string(list_filter(['e' || turn, 'e' || conv_id % 3], lambda z: z NOT IN ('e0', 'e1')), ',') AS unknown_evidence FROM p""")
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, horizons, numbers, epoch times and claimed evidence of answers (CLS24, SC26, SC34, DM06, SET13)."""
    c = t.read(spark, sf_dir, "conversations")
    claimed = F.array(F.concat(F.lit("e"), "turn"), F.concat(F.lit("e"), F.col("conv_id") % 3))
    unknown = F.filter(claimed, lambda e: F.array_contains(records.unknown_evidence(claimed, F.array(F.lit("e0"), F.lit("e1"))), e))
    return c.select(
        "conv_id", "turn", topics.rating(_pick(_RATINGS, "conv_id")).alias("rating"), topics.horizon_seconds(_pick(_HORIZONS, "conv_id + turn")).alias("horizon_seconds"),
        F.trim(_pick(_NUMBERS, "conv_id")).try_cast("long").alias("number"), F.date_format(F.timestamp_seconds(1704067200 + F.col("conv_id") * 61 + F.col("turn")), "yyyy-MM-dd HH:mm:ss").alias("at"), F.array_join(unknown, ",").alias("unknown_evidence"),
    )


_NUMBER = "TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT)"


@query(f"""WITH s AS (SELECT DISTINCT source AS name, {_NUMBER} AS k FROM documents),
d AS (SELECT name, k, {_pick_sql(['rss', 'html', 'api', 'ftp'], 'k')} AS source_type, {_pick_sql(['the_news_api_json', 'feed'], 'k')} AS parser, {_pick_sql(['primary', None, 'secondary', 'other', 'fallback'], 'k')} AS tier, k % 6 * 10 AS priority, CASE WHEN k % 3 = 0 THEN NULL ELSE 600 END AS cadence, CASE WHEN k % 7 = 0 THEN NULL ELSE 'us' END AS market FROM s WHERE k % 9 <> 4
  UNION ALL SELECT name, k, 'rss', NULL, 'primary', NULL, CASE WHEN k = 8 THEN 0 ELSE 60 END, 'hk' FROM s WHERE k % 4 = 0),
f AS (SELECT name, source_type, parser, coalesce(tier, 'primary') AS tier, coalesce(priority, 100) AS priority, coalesce(cadence, 300) AS cadence_seconds, market FROM d WHERE k % 4 <> 0 OR market = 'hk')
SELECT *, CASE WHEN market IS NULL THEN 'markets' WHEN source_type NOT IN ('rss', 'html', 'api') THEN 'source_type' WHEN tier NOT IN ('primary', 'secondary', 'fallback') THEN 'tier' WHEN priority <= 0 THEN 'priority'
  WHEN cadence_seconds <= 0 THEN 'cadence_seconds' WHEN source_type = 'api' AND parser IS DISTINCT FROM 'the_news_api_json' THEN 'parser' END AS problem FROM f""")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default and own feed definitions merged, filled and validated (SRC01, SRC02)."""
    s = t.read(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int").alias("k")).distinct()
    k = F.col("k")
    defaults = s.where("k % 9 <> 4").select(
        "name", _pick(["rss", "html", "api", "ftp"], "k").alias("source_type"), _pick(["the_news_api_json", "feed"], "k").alias("parser"), _pick(["primary", None, "secondary", "other", "fallback"], "k").alias("tier"), (k % 6 * 10).alias("priority"),
        F.when(k % 3 != 0, 600).alias("cadence_seconds"), F.when(k % 7 == 0, F.array().cast(_STRINGS)).otherwise(F.array(F.lit("us"))).alias("markets"),
    )
    own = s.where("k % 4 = 0").select("name", F.lit("rss").alias("source_type"), F.lit(None).cast("string").alias("parser"), F.lit("primary").alias("tier"), F.lit(None).cast("int").alias("priority"), F.when(k == 8, 0).otherwise(60).alias("cadence_seconds"), F.array(F.lit("hk"), F.lit("us")).alias("markets"))
    return records.source_registry(defaults, own).drop("markets")


_TIERS = ["primary", "secondary", "fallback", None]
_HASH_SQL = "CASE WHEN doc_id % 10 = 0 THEN 'h' || doc_id WHEN doc_id % 6 = 0 THEN 'h' || (doc_id + 1) ELSE 'x' || doc_id % 500 END"
_RANK_SQL = "coalesce(list_position(['fallback', 'secondary', 'primary'], tier), 0) * 1000"


@query(f"""WITH s AS (SELECT doc_id AS id, 'u' || doc_id AS url, 'h' || doc_id AS url_hash, {_RANK_SQL} - doc_id % 3 AS rank FROM (SELECT *, {_pick_sql(_TIERS, 'doc_id')} AS tier FROM documents)),
i AS (SELECT doc_id AS id, 'v' || doc_id % 500 AS url, {_HASH_SQL} AS url_hash, {_RANK_SQL} - doc_id % 5 AS rank FROM (SELECT *, {_pick_sql(_TIERS, '(doc_id // 4)')} AS tier FROM documents WHERE doc_id % 2 = 0)
  UNION ALL SELECT doc_id, 'w' || doc_id, 'w' || doc_id, 2999 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'u' || doc_id, 'q', 3000 FROM documents WHERE doc_id % 7 = 0),
b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC, url) = 1),
w AS (SELECT b.id, b.url, b.url_hash, b.url_hash = s.url_hash AS same FROM b JOIN s USING (id) WHERE b.rank > s.rank AND b.url <> s.url),
g AS (SELECT id, url, url_hash FROM w WHERE same UNION ALL SELECT id, url, url_hash FROM (SELECT * FROM w WHERE NOT same QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id) = 1) WHERE url_hash NOT IN (SELECT url_hash FROM s))
SELECT s.id, coalesce(g.url, s.url) AS url, coalesce(g.url_hash, s.url_hash) AS url_hash, g.id IS NOT NULL AS promoted FROM s LEFT JOIN g USING (id)""")
def promoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of better sources taken over, unless another row has the hash (SNK03)."""
    d = t.read(spark, sf_dir, "documents").select("doc_id")
    name = lambda p, c="doc_id": F.concat(F.lit(p), F.expr(c))
    row = lambda df, url, h, rank: df.select(F.col("doc_id").alias("id"), url.alias("url"), h.alias("url_hash"), rank.alias("rank"))
    stored = row(d, name("u"), name("h"), records.source_rank(_pick(_TIERS, "doc_id"), (F.col("doc_id") % 3).cast("int")))
    incoming = row(d.where("doc_id % 2 = 0"), name("v", "doc_id % 500"), F.expr(_HASH_SQL), records.source_rank(_pick(_TIERS, "doc_id div 4"), (F.col("doc_id") % 5).cast("int")))
    incoming = incoming.union(row(d.where("doc_id % 3 = 0"), name("w"), name("w"), records.source_rank(F.lit("primary"), F.lit(1))))
    incoming = incoming.union(row(d.where("doc_id % 7 = 0"), name("u"), F.lit("q"), records.source_rank(F.lit("primary"), F.lit(0))))
    return records.promote_urls(stored, incoming)


@query(f"""WITH {_N}, m AS (SELECT news_id // 3 AS g, * FROM n UNION SELECT (news_id + 1) // 3, * FROM n),
c AS (SELECT g, max(abs(sentiment_score)) AS importance, max(effective_at) AS last_seen_at, list_sort(list_distinct(list('S' || news_id * 7 % 9))) AS symbols, CASE WHEN g % 5 <> 0 THEN 'S' || g % 7 END AS primary_symbol FROM m GROUP BY g),
u AS (SELECT DISTINCT g // 2 AS p, news_id, effective_at, source_name FROM m),
v AS (SELECT p, count(DISTINCT source_name) AS source_count, count(*) AS news_count, array_to_string(list(CAST(news_id AS VARCHAR) ORDER BY effective_at DESC, news_id DESC)[1:3], ',') AS news FROM u GROUP BY p),
j AS (SELECT a.g // 2 AS p, 'fused-' || a.g || '-' || b.g AS event_key, greatest(a.importance, b.importance) AS importance, greatest(a.last_seen_at, b.last_seen_at) AS last_seen_at, coalesce(a.primary_symbol, b.primary_symbol) AS primary_symbol, list_concat(a.symbols, b.symbols) AS symbols FROM c a JOIN c b ON a.g % 2 = 0 AND b.g = a.g + 1)
SELECT event_key, {r('importance', 4)} AS importance, last_seen_at, primary_symbol, array_to_string(list_filter(symbols, lambda x, i: list_position(symbols, x) = i)[1:5], ',') AS symbols, CAST(source_count AS INT) AS source_count, CAST(news_count AS INT) AS news_count, news FROM j JOIN v USING (p)""")
def merged_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event cards merged into one (SET04)."""
    n = t.news(spark, sf_dir).withColumn("g", F.explode(F.array_distinct(F.array(F.expr("news_id div 3"), F.expr("(news_id + 1) div 3")))))
    card = n.groupBy("g").agg(
        F.concat(F.col("g")).alias("event_key"), F.max(F.abs("sentiment_score")).alias("importance"), F.max("effective_at").alias("last_seen_at"), F.when(F.col("g") % 5 != 0, F.concat(F.lit("S"), F.col("g") % 7)).alias("primary_symbol"),
        F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("news_id") * 7 % 9))).alias("symbols"), F.array_sort(F.collect_list(F.struct("effective_at", F.col("news_id").alias("id"), F.col("source_name").alias("source")))).alias("news"),
    )
    side = lambda name, parity: card.where(f"g % 2 = {parity}").select(F.expr("g div 2").alias("p"), F.struct(*(c for c in card.columns if c != "g")).alias(name))
    merged = side("a", 0).join(side("b", 1), "p").select(F.inline(F.array(records.merged_card(F.col("a"), F.col("b")))))
    return merged.select("event_key", F.expr("floor(importance * 1e4 + 0.500001D) / 1e4").alias("importance"), "last_seen_at", "primary_symbol", F.array_join("symbols", ",").alias("symbols"), "source_count", "news_count", F.array_join(F.transform("news", lambda x: x["id"].cast("string")), ",").alias("news"))


@query(f"""WITH RECURSIVE b AS ({t.BARS_SQL}), last AS (SELECT symbol, arg_max(close, trade_date) AS close, arg_max(open, trade_date) AS open, arg_max(high, trade_date) AS high, arg_max(low, trade_date) AS low, arg_max(volume, trade_date) AS volume, max(trade_date) AS day FROM b GROUP BY symbol),
prev AS (SELECT symbol, arg_max(b.close, trade_date) AS previous FROM b JOIN last USING (symbol) WHERE trade_date < day GROUP BY symbol),
q AS (SELECT 'P' || s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 10 END AS snapshot, l.* EXCLUDE (symbol), coalesce(previous > 0 AND {r('open', 2)} >= {r('previous * 1.1::DOUBLE', 2)} AND (high = low AND low = open OR volume = 0), false) AS locked FROM supplier LEFT JOIN last l ON l.symbol = 'P' || s_suppkey LEFT JOIN prev p ON p.symbol = l.symbol),
z AS (SELECT symbol, CASE WHEN snapshot > 0 THEN snapshot WHEN NOT locked THEN close END AS price, CASE WHEN snapshot > 0 THEN NULL WHEN close IS NULL THEN 'no_market_data' WHEN locked THEN 'limit_up_unfilled' END AS reject FROM q),
i AS (SELECT c_custkey AS k, pos, 'P' || (c_custkey * 4 + pos) % 120 AS symbol, (pos + 1) * 0.1::DOUBLE AS weight FROM customer, range(4) t(pos)),
o AS (SELECT k, pos, i.symbol, weight, price, CASE WHEN z.symbol IS NULL THEN 'no_market_data' ELSE reject END AS reject FROM i LEFT JOIN z USING (symbol)),
s AS (SELECT c_custkey AS k, CAST(-1 AS BIGINT) AS pos, c_acctbal * 100 + 50000 AS cash, NULL::VARCHAR AS symbol, 0::BIGINT AS shares, NULL::DOUBLE AS price, NULL::VARCHAR AS reject_reason FROM customer
  UNION ALL SELECT k, pos, cash - CASE WHEN reason IS NULL THEN price * shares ELSE 0 END, symbol, CASE WHEN reason IS NULL THEN shares ELSE 0 END, CASE WHEN reason IS NULL THEN price END, reason
  FROM (SELECT *, coalesce(reject, CASE WHEN price IS NULL OR price <= 0 THEN 'no_market_data' WHEN shares < 100 THEN 'below_min_lot' END) AS reason
    FROM (SELECT s.k, o.pos, s.cash, o.symbol, o.price, o.reject, CAST(floor(s.cash * o.weight / o.price / 100) * 100 AS BIGINT) AS shares FROM s JOIN o ON o.k = s.k AND o.pos = s.pos + 1)))
SELECT k AS account, symbol, shares, {r('price', 4)} AS price, reject_reason FROM s WHERE pos >= 0""")
def proposal_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill prices and whole lots of proposals from the cash that is left (DM29, DM30)."""
    b = t.bars(spark, sf_dir)
    at = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    two = b.select("symbol", F.struct("open", "high", "low", "close", "volume").alias("bar"), F.lead("close").over(at).alias("previous"), F.row_number().over(at).alias("rank")).where("rank = 1")
    s = t.read(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("symbol"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") / 10).alias("snapshot"))
    fill = records.fill_price(F.col("snapshot"), F.col("bar"), F.col("previous"), limit_up_price(F.col("previous"), F.lit("main")))
    prices = s.join(two, "symbol", "left").select("symbol", F.inline(F.array(fill)))
    c = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), (F.col("c_acctbal") * 100 + 50000).alias("cash"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    items = c.withColumn("symbol", F.concat(F.lit("P"), (F.col("account") * 4 + F.col("pos")) % 120)).join(prices, "symbol", "left")
    item = F.struct("pos", "symbol", ((F.col("pos") + 1) * F.lit(0.1)).alias("weight"), "price", "reject_reason")
    orders = items.groupBy("account", "cash").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = orders.select("account", F.inline(records.proposal_fills(F.col("items"), F.col("cash"))))
    return out.select("account", "symbol", "shares", F.expr("floor(price * 1e4 + 0.500001D) / 1e4").alias("price"), "reject_reason")


@query("""WITH p AS (SELECT conv_id, '{"code_commit":"c1","items":[' || string_agg('{"deterministic_score":' || CAST((conv_id + turn * 25) % 400 / 100.0::DOUBLE AS VARCHAR) || ',"rank":' || turn || ',"sleeve":"' || role || '","symbol":"S' || turn || '"}', ',' ORDER BY role, turn) || '],"rule_version":"\\u89c4' || conv_id % 2 || '"}' AS payload FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id AS run_id, sha256(payload) AS result_hash FROM p) SELECT * FROM h WHERE result_hash NOT IN (SELECT result_hash FROM h WHERE run_id % 3 = 0)""")
def unexecuted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the hash of their result, without those whose hash the decision log has (SC22, SET15)."""
    c = t.read(spark, sf_dir, "conversations")
    item = F.struct(F.col("role").alias("sleeve"), F.col("turn").alias("rank"), F.concat(F.lit("S"), "turn").alias("symbol"), ((F.col("conv_id") + F.col("turn") * 25) % 400 / F.lit(100.0)).alias("deterministic_score"))
    runs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    hashed = runs.select(F.col("conv_id").alias("run_id"), records.result_hash(F.to_json(F.struct(F.concat(F.lit("规"), F.col("conv_id") % 2).alias("rule_version"), F.lit("c1").alias("code_commit"), "items"))).alias("result_hash"))
    return hashed.join(hashed.where("run_id % 3 = 0").select("result_hash"), "result_hash", "left_anti")


@query("""WITH q AS (SELECT 's' || doc_id AS sample_id, doc_id % 2 = 0 AS rel, CASE WHEN doc_id % 4 = 1 THEN 'ad' END AS noise FROM documents WHERE doc_id % 10 <> 9),
d AS (SELECT 's' || doc_id AS sample_id, CASE WHEN doc_id % 11 = 0 THEN 'model' ELSE 'human_corrected' END AS src, [NULL, true, NULL, false, false][doc_id % 5 + 1] AS said, CASE WHEN doc_id % 3 = 0 THEN 'chat' END AS said_noise FROM documents WHERE doc_id % 7 <> 0),
e AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE TRY_CAST(substr(sample_id, 2) AS BIGINT) % 13 = 0), g AS (SELECT sample_id, count(*) AS times, any_value(src) AS src, any_value(said) AS said, any_value(said_noise) AS said_noise FROM e GROUP BY 1),
j AS (SELECT sample_id, q.rel IS NOT NULL AS queued, times, src, coalesce(said, rel) AS rel, coalesce(said_noise, noise) AS noise FROM q FULL JOIN g USING (sample_id))
SELECT sample_id, rel AS market_relevant, CASE WHEN NOT rel THEN noise END AS noise_type, src AS label_source,
  CASE WHEN NOT queued THEN 'not_in_queue' WHEN times IS NULL THEN 'missing' WHEN times > 1 THEN 'duplicate' WHEN src <> 'human_corrected' THEN 'label_source' WHEN NOT rel AND noise IS NULL THEN 'noise_type' END AS problem FROM j""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions checked and joined to the review queue (SNK25)."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), "doc_id").alias("sample_id"))
    queue = d.where("doc_id % 10 <> 9").select("sample_id", (F.col("doc_id") % 2 == 0).alias("market_relevant"), F.when(F.col("doc_id") % 4 == 1, "ad").alias("noise_type"))
    made = d.where("doc_id % 7 <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1))))
    decisions = made.select(F.concat(F.lit(" "), "sample_id").alias("sample_id"), F.when(F.col("doc_id") % 11 == 0, "model").otherwise("human_corrected ").alias("review_label_source"), _pick(["", "Yes", None, "0", "false"], "doc_id").alias("review_market_relevant"), F.when(F.col("doc_id") % 3 == 0, "chat").otherwise(" ").alias("review_noise_type"))
    return records.apply_reviews(queue, decisions)


_HREFS = ["/a?x=1", "b.html", "https://other.example/z", "../up", "#here", "//cdn.example/c"]


@query(rf"""WITH k AS (SELECT page_id, {_pick_sql(_HREFS, 'page_id')} AS href, 'https://h' || page_id % 5 AS host FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN host || href WHEN 1 THEN host || '/d/e/' || href WHEN 2 THEN href WHEN 3 THEN host || '/d/up' WHEN 4 THEN host || '/d/e/f' || href ELSE 'https:' || href END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'Flash ' || page_id ELSE nullif(substr(trim('Page ' || page_id || ' ' || coalesce(regexp_extract(html, '<p>([^<]*)</p>', 1), ''), ' ' || chr(9) || chr(10)), 1, 60), '') END AS title,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'n' || page_id || ' "q" ]' END AS first_title, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 2 END AS n_news FROM k JOIN pages USING (page_id)""")
def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links, titles from bodies, streamed chunks and inline news of pages (SC10, SRC11, SRC12, SRC14, SRC18)."""
    p = t.read(spark, sf_dir, "pages")
    plain = F.concat(F.lit("Page "), "page_id", F.lit(" "), F.regexp_extract("html", "<p>([^<]*)</p>", 1))
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" 【 Flash "), "page_id", F.lit(" 】 text"))).otherwise(plain)
    title = F.concat(F.lit("n"), "page_id", F.lit(' "q" ]'))
    record = lambda i, zh, en: F.struct(F.lit(i).alias("id"), F.coalesce(zh).alias("title_zh"), F.lit(en).cast("string").alias("title_en"))
    news = F.concat(F.lit("["), F.concat_ws(", ", F.to_json(record("7", title, None)), F.lit("5"), F.to_json(record("7", F.lit("again"), None)), F.to_json(record("8", F.lit(None).cast("string"), "x"))), F.lit("]"))
    chunk = F.concat(F.lit('{"newsItems": '), news, F.lit(', "rest": [[]]}'))
    quoted = F.substring(F.to_json(F.array(chunk)), 2, F.length(F.to_json(F.array(chunk))) - 2)
    page = F.when(F.col("page_id") % 4 == 0, "<p></p>").otherwise(F.concat(F.lit("<script>self.__next_f.push([1,"), quoted, F.lit("])</script>")))
    found = payloads.inline_news(F.array_join(payloads.streamed_chunks(page), ""))
    base = F.concat(F.lit("https://h"), F.col("page_id") % 5, F.lit("/d/e/f"))
    rows = p.select("page_id", payloads.absolute_url(_pick(_HREFS, "page_id"), base).alias("url"), payloads.title_from_body(body).alias("title"), F.coalesce(found, F.array().cast("array<struct<url:string,title:string,summary:string,created:string>>")).alias("news"))
    return rows.select("page_id", "url", "title", F.get("news", F.lit(0))["title"].alias("first_title"), F.size("news").alias("n_news"))


@query(f"""WITH b AS ({t.BARS_SQL}), k AS (SELECT symbol, trade_date, close, CAST(substr(symbol, 2) AS INT) AS s, trade_date = max(trade_date) OVER (PARTITION BY symbol) AS newest FROM b)
SELECT symbol, trade_date, {r('CASE WHEN s % 5 = 0 OR s % 4 = 0 AND s % 3 <> 1 THEN close * 2 WHEN newest AND s % 4 = 0 THEN NULL ELSE close END', 4)} AS close, CASE WHEN s % 5 = 0 OR s % 4 = 0 AND s % 3 <> 1 THEN 'fallback' ELSE 'primary' END AS provider
FROM k WHERE NOT (s % 5 = 0 AND s % 3 = 1)""", dates="trade_date")
def bar_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by the first provider that has a complete last row (SRC28)."""
    b = t.bars(spark, sf_dir).select("symbol", "trade_date", "close", F.substring("symbol", 2, 20).cast("int").alias("s"))
    newest = F.max("trade_date").over(Window.partitionBy("symbol"))
    primary = b.where("s % 5 <> 0").select("symbol", "trade_date", F.when(~((F.col("s") % 4 == 0) & (F.col("trade_date") == newest)), F.col("close")).alias("close"))
    out = records.bar_history(primary, b.where("s % 3 <> 1").select("symbol", "trade_date", (F.col("close") * 2).alias("close")))
    return out.select("symbol", "trade_date", F.expr("floor(close * 1e4 + 0.500001D) / 1e4").alias("close"), "provider")


@query("""WITH o AS (SELECT 'P' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k FROM orders)
SELECT DISTINCT symbol, event_type, day FROM (SELECT symbol, 'earnings' AS event_type, day FROM o WHERE k % 2 = 0 UNION ALL SELECT symbol, 'earnings', day + 7 FROM o WHERE k % 2 = 0 UNION ALL SELECT symbol, 'ex_dividend', day FROM o WHERE k % 3 = 0 UNION ALL SELECT symbol, 'earnings', day FROM o WHERE k % 4 <> 1)""", dates="day")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earnings and dividend days of calendars and lists, each once (SRC34)."""
    o = t.read(spark, sf_dir, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"))
    calendars = o.select("symbol", F.when(F.col("k") % 2 == 0, F.array("day", F.date_add("day", 7))).alias("earnings"), F.when(F.col("k") % 3 == 0, F.array("day")).alias("ex_dividend"))
    return records.calendar_events(calendars, o.where("k % 4 <> 1").select("symbol", "day"))


@query(f"WITH {_N} SELECT market, sentiment_label, count(*) AS n, count(*) FILTER (WHERE effective_at >= TIMESTAMP '2024-01-15') AS n_fresh, count(*) FILTER (WHERE published_at IS NULL) AS n_undated FROM n GROUP BY ALL")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by market and label, with those no older than a limit or in the future (FE10, FLT18)."""
    fresh = F.col("effective_at") >= F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return t.news(spark, sf_dir).groupBy("market", "sentiment_label").agg(F.count("*").alias("n"), F.count_if(fresh).alias("n_fresh"), F.count_if(F.col("published_at").isNull()).alias("n_undated"))


@query(f"""WITH s AS ({t.SIGNALS_SQL}), e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, news_id DESC) AS pos FROM s)
SELECT news_id, symbol, CAST(pos AS INT) AS pos, news_id IN (SELECT news_id FROM s ORDER BY published_at DESC, news_id DESC LIMIT 40) AS on_radar FROM e""")
def symbol_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each symbol, newest first, and the 40 newest of all, which the radar lists (FE18, FE19)."""
    s = t.signals(spark, sf_dir)
    newest = [F.col("published_at").desc(), F.col("news_id").desc()]
    radar = s.orderBy(*newest).limit(40).select("news_id", F.lit(True).alias("listed"))
    ranked = s.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy(*newest)))
    return ranked.join(radar, "news_id", "left").select("news_id", "symbol", "pos", F.coalesce("listed", F.lit(False)).alias("on_radar"))


@query("SELECT role, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) <= 100")
def answer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 latest answers of each role (FE20)."""
    latest = Window.partitionBy("role").orderBy(F.col("conv_id").desc(), F.col("turn").desc())
    return t.read(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(latest)).where("pos <= 100").select("role", "conv_id", "turn")
