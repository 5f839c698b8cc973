"""Quant, portfolio, usage, evaluation and health queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.numbers import half_up
from ..functions.text import board_of, normal_symbol
from ..operators import desk, quant, timeseries
from ..sources import tables as t
from .common import query, r, seconds

_B = f"b AS ({t.BARS_SQL})"
_LAST20 = f"{_B}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM b)"


@query(f"""WITH {_LAST20}, a AS (SELECT symbol, count(*) AS n_bars, max(trade_date) AS last_date, median(CASE WHEN rn <= 20 THEN amount END) AS m FROM k GROUP BY 1), d AS (SELECT max(trade_date) AS market_date FROM b)
SELECT symbol, n_bars, last_date, {r('m', 2)} AS median_amount, n_bars >= 120 AND last_date = market_date AND m >= 10000 AS in_universe, date_diff('day', last_date, market_date) > 5 AS stale FROM a, d""", dates="last_date")
def quant_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe by bars, liquidity and staleness (AGG29, AGG36, FLT13)."""
    return quant.bar_universe(t.bars(spark, sf_dir), median_amount=1e4)


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.read(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("C"), "p_partkey").alias("symbol"), F.when(F.col("p_partkey") % 17 == 0, "halted").when(F.col("p_partkey") % 19 == 0, "delisted").otherwise("listed").alias("status"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("list_date"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("effective_from"),
        F.when(F.col("p_partkey") % 5 == 0, F.date_add(F.lit("2021-06-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))).alias("effective_to"), (F.col("p_retailprice") * 9e4 + F.col("p_partkey") % 200 * 1e5).alias("median_amount_20d"),
    )


@query("""SELECT symbol, status FROM (SELECT 'C' || p_partkey AS symbol, CASE WHEN p_partkey % 17 = 0 THEN 'halted' WHEN p_partkey % 19 = 0 THEN 'delisted' ELSE 'listed' END AS status,
  DATE '2020-01-01' + CAST(p_partkey % 1000 AS INT) AS list_date, CASE WHEN p_partkey % 5 = 0 THEN DATE '2021-06-01' + CAST(p_partkey % 300 AS INT) END AS effective_to, p_retailprice * 9e4 + p_partkey % 200 * 1e5 AS m FROM part)
WHERE list_date <= DATE '2022-01-01' AND (effective_to IS NULL OR effective_to >= DATE '2022-01-01') AND status NOT IN ('halted', 'delisted') AND date_diff('day', list_date, DATE '2022-01-01') >= 120 AND m >= 1e8""")
def tradable_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated, liquid and listed securities (FLT12, FLT13)."""
    return quant.tradable(_master(spark, sf_dir), F.lit("2022-01-01").cast("date")).select("symbol", "status")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.read(spark, sf_dir, "lineitem")
    return line.select(
        F.concat(F.lit("P"), "l_suppkey").alias("symbol"), F.element_at(F.array(*map(F.lit, ("net_profit_yoy", "revenue_yoy", "roe"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("metric_key"),
        F.last_day("l_shipdate").alias("period_end"), (F.col("l_discount") * 10 - F.col("l_tax") * 5).alias("value"), F.when(F.col("l_orderkey") % 10 != 0, F.date_add(F.last_day("l_shipdate"), 30)).alias("available_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision_no"),
    )


_FACTS_SQL = """SELECT 'P' || l_suppkey AS symbol, CASE l_linenumber % 3 WHEN 0 THEN 'net_profit_yoy' WHEN 1 THEN 'revenue_yoy' ELSE 'roe' END AS metric_key, last_day(l_shipdate) AS period_end,
  l_discount * 10 - l_tax * 5 AS value, CASE WHEN l_orderkey % 10 <> 0 THEN last_day(l_shipdate) + 30 END AS available_at, l_orderkey * 10 + l_linenumber AS revision_no FROM lineitem"""


@query(f"""WITH f AS ({_FACTS_SQL}) SELECT symbol, metric_key, period_end, {r('value', 6)} AS value, revision_no FROM f WHERE available_at <= DATE '2000-06-30'
QUALIFY row_number() OVER (PARTITION BY symbol, metric_key ORDER BY period_end DESC, revision_no DESC, available_at DESC) = 1""", dates="period_end")
def point_in_time_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as known at a cutoff (JN15, JN16, FLT14)."""
    return quant.known_fact(_facts(spark, sf_dir), F.lit("2000-06-30").cast("date")).select("symbol", "metric_key", "period_end", half_up(F.col("value"), 6).alias("value"), "revision_no")


_FIN = f"""f AS ({_FACTS_SQL}), s AS (SELECT * FROM f WHERE available_at IS NULL OR available_at <= DATE '2000-06-30'),
w AS (SELECT symbol, period_end, arg_max(value, revision_no) FILTER (metric_key = 'net_profit_yoy') AS net_profit_yoy, arg_max(value, revision_no) FILTER (metric_key = 'revenue_yoy') AS revenue_yoy,
  arg_max(value, revision_no) FILTER (metric_key = 'roe') AS roe FROM s GROUP BY 1, 2), z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1)"""
_CLAMP = "coalesce(greatest({1}, least({2}, {0})), 0)"


@query(f"""WITH {_FIN}, c AS (SELECT symbol, period_end, 0.4 * {_CLAMP.format('net_profit_yoy / 0.5', -1, 1)} + 0.3 * {_CLAMP.format('revenue_yoy / 0.5', -1, 1)} + 0.3 * {_CLAMP.format('roe / 20', 0, 1)} AS score FROM z)
SELECT symbol, period_end, {r('score', 6)} AS score, floor(score * 1e6 + 0.500001) / 1e6 >= 0.25 AS watch FROM c""", dates="period_end")
def fundamental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest financials and the fundamental sleeve (JN17, DM20)."""
    f = quant.latest_financials(_facts(spark, sf_dir), ["net_profit_yoy", "revenue_yoy", "roe"], F.lit("2000-06-30").cast("date"))
    s = f.withColumn("s", quant.score_fundamental(F.col("net_profit_yoy"), F.col("revenue_yoy"), F.col("roe")))
    return s.select("symbol", "period_end", half_up(F.col("s.score"), 6).alias("score")).withColumn("watch", F.col("score") >= 0.25)


_TREND = f"""{_LAST20}, a AS (SELECT symbol, avg(amount) AS adv, arg_max(inflow, trade_date) AS inflow FROM k WHERE rn <= 20 GROUP BY 1),
s AS (SELECT symbol, 0.6 * abs(greatest(-1, least(1, inflow / 50000))) + 0.4 * greatest(0, least(1, adv / 100000)) AS score, inflow > 50000 AND greatest(0, least(1, adv / 100000)) >= 0.3 AS qualified FROM a)"""


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    a = t.bars(spark, sf_dir).withColumn("rn", rn).where("rn <= 20").groupBy("symbol").agg(F.avg("amount").alias("adv"), F.max_by("inflow", "trade_date").alias("inflow"))
    return a.withColumn("s", quant.score_trend(F.col("inflow"), F.col("adv"), 5e4, 1e5)).select("symbol", F.lit("trend_flow").alias("sleeve"), "s.score", "s.qualify")


@query(f"WITH {_TREND} SELECT symbol, {r('score', 6)} AS score, qualified FROM s")
def trend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend sleeve (AGG30, DM19)."""
    return _trend(spark, sf_dir).select("symbol", half_up(F.col("score"), 6).alias("score"), F.col("qualify").alias("qualified"))


@query(f"WITH {_TREND} SELECT symbol, CAST(row_number() OVER (ORDER BY score DESC, symbol) AS INT) AS rank FROM s WHERE qualified")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of qualified candidates (WIN18)."""
    return quant.rank_candidates(_trend(spark, sf_dir)).select("symbol", "rank")


@query(f"""WITH m AS ({t.MENTIONS_SQL}), n AS ({t.NEWS_SQL}), a AS (SELECT symbol, count(*) AS k, max(effective_at) AS last_at FROM m JOIN n USING (news_id) GROUP BY 1),
c AS (SELECT symbol, greatest(0, least(1, 1 - date_diff('day', CAST(last_at AS DATE), DATE '2024-02-01') / 7)) AS novelty, least(1, k / 3) AS materiality FROM a)
SELECT symbol, {r('novelty * materiality * 0.8', 6)} AS score, novelty * materiality * 0.8 >= 0.4 AS qualified FROM c""")
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sleeve from mention counts and news age (AGG31, JN18, DM18)."""
    a = t.mentions(spark, sf_dir).select("symbol", "news_id").join(t.news(spark, sf_dir).select("news_id", "effective_at"), "news_id").groupBy("symbol").agg(F.count("*").alias("k"), F.max("effective_at").alias("last_at"))
    novelty = numbers.clamp(1 - F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("last_at")) / 7, 0, 1)
    s = a.withColumn("s", quant.score_event(novelty, F.least(F.lit(1.0), F.col("k") / 3), F.lit("B")))
    return s.select("symbol", half_up(F.col("s.score"), 6).alias("score"), F.col("s.qualify").alias("qualified"))


_RULE = {"logic": "or", "conditions": [{"factor": "main_inflow_1d", "op": ">", "value": 20000}, {"logic": "and", "conditions": [{"factor": "roe", "op": ">=", "value": 40}, {"factor": "revenue_yoy", "op": "<", "value": 900}]}]}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).withColumn("main_inflow_1d", F.col("inflow")).withColumn("roe", F.col("volume")).withColumn("revenue_yoy", F.when(F.col("volume") % 2 == 0, F.col("close")))


@query(f"WITH {_B} SELECT symbol, trade_date, coalesce(inflow > 20000, false) OR (coalesce(volume >= 40, false) AND coalesce(CASE WHEN volume % 2 = 0 THEN close END < 900, false)) AS go FROM b", dates="trade_date")
def rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule tree compiled to a column (FLT30, FLT31)."""
    return _features(spark, sf_dir).select("symbol", "trade_date", quant.compile_rule(_RULE).alias("go"))


@query(f"""WITH RECURSIVE {_B}, g AS (SELECT *, coalesce(inflow > 20000, false) OR (coalesce(volume >= 40, false) AND coalesce(CASE WHEN volume % 2 = 0 THEN close END < 900, false)) AS go,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, lead(open) OVER w AS o, lead(high) OVER w AS h, lead(low) OVER w AS lo, lead(volume) OVER w AS v FROM b WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
f AS (SELECT *, close > 0 AND floor(o * 100 + 0.500001) >= floor(close * 1.1 * 100 + 0.500001) AND ((h = lo AND lo = o) OR v = 0) AS locked FROM g WHERE n >= 60),
s AS (
  SELECT symbol, 0::BIGINT AS i, n, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS dd, NULL::DOUBLE AS entry, 0::BIGINT AS trades, 0::BIGINT AS unfilled FROM f WHERE i = 1
  UNION ALL
  SELECT symbol, f_i, n, e2, greatest(peak, e2), greatest(dd, (greatest(peak, e2) - e2) / greatest(peak, e2)), en2, trades + buy, unfilled + miss FROM (
    SELECT s.symbol, f.i AS f_i, s.n, s.peak, s.dd, s.trades, s.unfilled, CASE WHEN s.entry IS NOT NULL AND NOT f.go THEN s.equity * f.o / s.entry ELSE s.equity END AS e2,
      CASE WHEN s.entry IS NULL THEN CASE WHEN f.go AND NOT f.locked THEN f.o END WHEN f.go THEN s.entry END AS en2,
      CASE WHEN s.entry IS NULL AND f.go AND NOT f.locked THEN 1 ELSE 0 END AS buy, CASE WHEN s.entry IS NULL AND f.go AND f.locked THEN 1 ELSE 0 END AS miss
    FROM s JOIN f ON f.symbol = s.symbol AND f.i = s.i + 1 WHERE f.i < f.n)),
e AS (SELECT s.*, b2.close AS last_close FROM s JOIN f b2 ON b2.symbol = s.symbol AND b2.i = s.n WHERE s.i = s.n - 1)
SELECT symbol, {r('log10(CASE WHEN entry IS NOT NULL THEN equity * last_close / entry ELSE equity END)', 6)} AS log_return, {r('dd', 6)} AS max_drawdown, trades, unfilled FROM e""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward test of a rule (WIN15, FLT27, FLT28)."""
    found = quant.walk_forward(_features(spark, sf_dir), quant.compile_rule(_RULE))
    return found.select("symbol", half_up(F.log10(1 + F.col("net_return")), 6).alias("log_return"), half_up(F.col("max_drawdown"), 6).alias("max_drawdown"), "trades", "unfilled")


@query()
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio weights under caps (WIN16), one portfolio for each nation of the suppliers; held against a loop in the tests."""
    vol = timeseries.volatility(t.bars(spark, sf_dir))
    s = t.read(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("symbol"), F.concat(F.lit("N"), "s_nationkey").alias("portfolio"), F.element_at(F.array(*map(F.lit, ("trend_flow", "event_catalyst"))), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("sleeve"))
    return quant.allocate(vol.join(s, "symbol"))


@query(f"""WITH {_B}, x AS (SELECT symbol, arg_min(close, trade_date) AS s, arg_max(close, trade_date) AS e, max(trade_date) > min(trade_date) AS paid FROM b GROUP BY 1)
SELECT symbol, {r('CASE WHEN paid THEN e * 1.1 + 0.5 * 1.1 ELSE e END / nullif(s, 0) - 1', 6)} AS total_return FROM x""")
def total_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total return of each symbol over its own span, with a distribution on its last day (WIN17)."""
    bars = t.bars(spark, sf_dir)
    spans = bars.groupBy("symbol").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))
    actions = spans.select("symbol", "start", "end", F.col("end").alias("ex_date"), F.col("start").alias("available_at"), F.lit(0.5).alias("cash_ratio"), F.lit(0.1).alias("share_ratio"))
    return quant.total_return(bars.join(spans, "symbol"), actions, F.col("start"), F.col("end"), F.col("end"))


@query(f"WITH {_B} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, max(trade_date) AS last_date, {r('count(DISTINCT symbol) * 100.0 / 6141', 2)} AS coverage FROM b", dates="last_date")
def market_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, symbols and last date of the bars (AGG33, FE17)."""
    return t.bars(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.max("trade_date").alias("last_date"), half_up(F.count_distinct("symbol") * 100 / 6141, 2).alias("coverage"))


@query(f"WITH {_TREND} SELECT CASE WHEN qualified THEN 'qualified' ELSE 'watch' END AS state, count(*) AS n FROM s GROUP BY 1")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by state (AGG34, AGG35)."""
    return _trend(spark, sf_dir).groupBy(F.when(F.col("qualify"), "qualified").otherwise("watch").alias("state")).agg(F.count("*").alias("n"))


_POS = f"""h AS ({t.HOLDINGS_SQL}), q AS (SELECT * FROM ({t.QUOTES_SQL}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) = 1),
p0 AS (SELECT h.symbol, position_size, average_cost, {r('nullif(price, 0) * position_size', 4)} AS market_value, {r('average_cost * position_size', 4)} AS cost_basis FROM h LEFT JOIN q USING (symbol) WHERE position_size > 0),
p AS (SELECT *, {r('market_value - cost_basis', 4)} AS profit FROM p0), tot AS (SELECT sum(market_value) AS mv FROM p), w AS (SELECT p.*, coalesce(market_value, 0) / mv AS weight FROM p, tot)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.positions(t.holdings(spark, sf_dir), timeseries.latest(t.quotes(spark, sf_dir), "symbol", "fetched_at", "id"))


@query(f"WITH {_POS} SELECT symbol, market_value, cost_basis, profit, {r('weight', 6)} AS weight FROM w")
def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and weights (JN31, DM26, AGG20)."""
    return desk.weights(_positions(spark, sf_dir)).select("symbol", "market_value", "cost_basis", "profit", half_up(F.col("weight"), 6).alias("weight"))


@query(f"""WITH {_POS} SELECT count(*) AS n, {r('sum(market_value)', 4)} AS market_value, {r('sum(cost_basis)', 4)} AS cost_basis,
  {r('sum(market_value) FILTER (cost_basis IS NOT NULL) - sum(cost_basis) FILTER (market_value IS NOT NULL)', 4)} AS profit,
  {r('(sum(market_value) FILTER (cost_basis IS NOT NULL) - sum(cost_basis) FILTER (market_value IS NOT NULL)) * 100 / nullif(sum(cost_basis) FILTER (market_value IS NOT NULL), 0)', 4)} AS profit_percent FROM p""")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio totals (AGG19)."""
    return desk.portfolio_summary(_positions(spark, sf_dir))


@query(f"""WITH {_POS}, n AS ({t.NEWS_SQL}), m AS (SELECT DISTINCT news_id, symbol FROM ({t.MENTIONS_SQL})),
i AS (SELECT news_id, effective_at, {r('sum(sentiment_score * weight)', 6)} AS impact, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM m JOIN w USING (symbol) JOIN n USING (news_id) GROUP BY 1, 2)
SELECT news_id, impact, symbols FROM i WHERE impact <> 0 ORDER BY abs(impact) DESC, effective_at DESC, news_id DESC LIMIT 12""")
def portfolio_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by weighted impact (JN32, AGG21, TOP10); the limit is the list's length."""
    return desk.weighted_news(desk.weights(_positions(spark, sf_dir)), t.news(spark, sf_dir), t.mentions(spark, sf_dir))


_U = f"u AS ({t.USAGE_SQL}), pr(model_name, pp, cp) AS (VALUES ('model-0', 0.5::DOUBLE, 1.5::DOUBLE), ('model-1', 0.1::DOUBLE, NULL))"
_COST = "CASE WHEN pp IS NOT NULL OR cp IS NOT NULL THEN (prompt_tokens * coalesce(pp, 0) + completion_tokens * coalesce(cp, 0)) / 1000 END"


def _usage_sql(by: str) -> str:
    return f"WITH {_U} SELECT {by}, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, {r(f'sum({_COST})', 6)} AS cost FROM u LEFT JOIN pr USING (model_name) GROUP BY ALL"


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("model-0", 0.5, 1.5), ("model-1", 0.1, None)], "model_name string, prompt_price double, completion_price double")


@query(_usage_sql("model_name"))
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage and cost by model (AGG22, AGG26, DM25)."""
    return desk.usage_by(t.usage(spark, sf_dir), ["model_name"], _prices(spark))


@query(_usage_sql("operation_type"))
def usage_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage by operation (AGG23)."""
    return desk.usage_by(t.usage(spark, sf_dir), ["operation_type"], _prices(spark))


@query(_usage_sql("CAST(created_at AS DATE) AS day"), dates="day")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage by day (AGG24, AGG25)."""
    return desk.usage_by(t.usage(spark, sf_dir), [F.to_date("created_at").alias("day")], _prices(spark))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return t.read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("n_chars") > 400).alias("guess"), F.concat(F.lit("L"), F.col("quality") + F.col("toxic")).alias("gold"), F.concat(F.lit("L"), F.col("n_chars") % 3).alias("predicted"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 10 / 10.0).alias("importance"))


_GOLD = """g AS (SELECT doc_id, quality = 1 AS good, n_chars > 400 AS guess, 'L' || (quality + toxic) AS gold, 'L' || (n_chars % 3) AS predicted, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS importance FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {_GOLD}, c AS (SELECT count(*) FILTER (good AND guess) AS tp, count(*) FILTER (NOT good AND guess) AS fp, count(*) FILTER (NOT good AND NOT guess) AS tn, count(*) FILTER (good AND NOT guess) AS fn FROM g),
s AS (SELECT *, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 4)} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 4)} AS recall, {r('coalesce(tn / nullif(tn + fp, 0), 0)', 4)} AS noise_rejection FROM c)
SELECT *, recall >= 0.8 AS passes FROM s""")
def relevance_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary evaluation (AGG37, JN27)."""
    return desk.binary_evaluation(_gold(spark, sf_dir).select(F.col("good").alias("gold"), F.col("guess").alias("predicted")))


@query(f"""WITH {_GOLD}, l AS (SELECT gold AS label FROM g UNION SELECT predicted FROM g), c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND predicted = label) AS hits, count(*) FILTER (predicted = label) AS guessed FROM l, g GROUP BY 1),
s AS (SELECT label, support, coalesce(hits / nullif(guessed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS q FROM c)
SELECT label, support, {r('p', 4)} AS precision, {r('q', 4)} AS recall, {r('coalesce(2 * p * q / nullif(p + q, 0), 0)', 4)} AS f1 FROM s""")
def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each label (AGG38)."""
    return desk.label_scores(_gold(spark, sf_dir))


@query(f"WITH {_GOLD} SELECT gold, predicted, count(*) AS n FROM g WHERE gold <> predicted GROUP BY 1, 2 ORDER BY n DESC, gold, predicted LIMIT 3")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent confusions (AGG44); the limit is the report's length."""
    return desk.top_confusions(_gold(spark, sf_dir))


@query(f"WITH {_GOLD} SELECT {r('avg(CAST(gold = predicted AS INT))', 4)} AS accuracy, {r('sum(coalesce(importance, 1) * CAST(gold = predicted AS INT)) / sum(coalesce(importance, 1))', 4)} AS weighted_accuracy FROM g")
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance-weighted accuracy (AGG39)."""
    return desk.weighted_accuracy(_gold(spark, sf_dir))


_HEALTH = """SELECT source, count(*) AS fetches, count(*) FILTER (n_chars < 300) AS failures, max(doc_id) AS last_id FROM documents GROUP BY 1"""


@query(f"""WITH h AS ({_HEALTH}) SELECT source, {r('least(1, greatest(0, (fetches - failures) / fetches))', 4)} AS success_rate, CASE WHEN failures % 6 >= 4 THEN 'offline' WHEN failures % 6 >= 2 THEN 'degraded'
  WHEN last_id % 5 = 0 THEN 'offline' WHEN last_id % 700 > 600 THEN 'delayed' ELSE 'ok' END AS status FROM h""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source status ladder and success rate (AGG45, AGG47, AGG54)."""
    h = t.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("fetches"), F.count_if(F.col("n_chars") < 300).alias("failures"), F.max("doc_id").alias("last_id"))
    return h.select("source", desk.success_rate(F.col("fetches"), F.col("failures")).alias("success_rate"), desk.source_status(F.col("failures") % 6, F.when(F.col("last_id") % 5 != 0, F.col("last_id") % 700), F.lit(300)).alias("status"))


@query(f"""WITH n AS ({t.NEWS_SQL}), f AS (SELECT market, CASE TRY_CAST(regexp_extract(source_name, '([0-9]+)$', 1) AS INT) % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'fallback' END AS tier, epoch(TIMESTAMP '2024-01-31 00:00:00' - max(fetched_at)) AS age FROM n GROUP BY 1, 2)
SELECT market, CASE min(CASE WHEN age <= 3600 THEN CASE tier WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 ELSE 3 END END) WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'fallback' ELSE 'none' END AS mode FROM f GROUP BY 1""")
def market_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best live tier of each market (AGG48)."""
    from ..operators.news import source_tier

    age = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.max("fetched_at").cast("timestamp"))) / 1e6
    facts = t.news(spark, sf_dir).groupBy("market", source_tier(F.col("source_name")).alias("tier")).agg(age.alias("success_age"))
    return desk.market_mode(facts, 3600)


def _open_sql(unknown: str, markets: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{m}' THEN isodow(fetched_at) < 6 AND ({' OR '.join(f'minute BETWEEN {a - desk.MARGIN} AND {b + desk.MARGIN}' for a, b in desk.SESSIONS[m])})" for m in markets)
    return f"CASE market {cases} ELSE {unknown} END"


@query(f"WITH q AS (SELECT *, hour(fetched_at) * 60 + minute(fetched_at) AS minute FROM ({t.QUOTES_SQL})) SELECT market, count(*) FILTER ({_open_sql('true', ('cn', 'hk', 'us'))}) AS n_open, count(*) AS n FROM q GROUP BY 1")
def market_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes within trading sessions (FLT20, FLT21, FLT22)."""
    is_open = desk.market_open(F.col("market"), F.col("fetched_at"))
    return t.quotes(spark, sf_dir).groupBy("market").agg(F.count_if(is_open).alias("n_open"), F.count("*").alias("n"))


@query(f"""WITH q AS ({t.QUOTES_SQL}), o AS (SELECT *, price >= 90 AS over, coalesce(lag(price >= 90) OVER (PARTITION BY symbol ORDER BY fetched_at, id), false) AS before FROM q)
SELECT id, symbol, price, (hour(fetched_at + INTERVAL 8 HOUR) * 60 + minute(fetched_at)) >= 1320 OR (hour(fetched_at + INTERVAL 8 HOUR) * 60 + minute(fetched_at)) < 420 AS quiet FROM o WHERE over AND NOT before""")
def price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge-triggered alerts with quiet hours (WIN24, FLT25, STR13, STR19)."""
    return desk.edge_alerts(t.quotes(spark, sf_dir), 90.0).select("id", "symbol", "price", desk.quiet(F.col("fetched_at"), 1320, 420).alias("quiet"))


@query(f"""WITH n AS ({t.NEWS_SQL}), k AS (SELECT news_id, market, sentiment_label, row_number() OVER (PARTITION BY market, sentiment_label ORDER BY length(summary) DESC, news_id) AS rn FROM n)
SELECT news_id, market, sentiment_label FROM k ORDER BY rn, market, sentiment_label LIMIT 40""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin sample over market and label (WIN22, WIN23); the sample's size is a parameter."""
    news = t.news(spark, sf_dir)
    return desk.stratified(news, ["market", "sentiment_label"], [F.length("summary").desc(), F.col("news_id")], 40).select("news_id", "market", "sentiment_label")


_SEARCHES = ("c1", "c1.sz", "red widget", "hg11", "red", "h", "7", "dget", "g1", "12")


@query(f"""WITH s AS (SELECT 'C' || p_partkey || '.SZ' AS symbol, p_name AS name, left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) || p_partkey % 50 AS pinyin FROM part), q AS (SELECT unnest({list(_SEARCHES)}) AS q),
k AS (SELECT q, symbol, CASE WHEN split_part(lower(symbol), '.', 1) = q OR lower(symbol) = q THEN 100 WHEN NOT num AND lower(name) = q THEN 95 WHEN NOT num AND pinyin = q THEN 90 WHEN starts_with(lower(symbol), q) THEN 85
  WHEN NOT num AND starts_with(lower(name), q) THEN 80 WHEN NOT num AND starts_with(pinyin, q) THEN 75 WHEN contains(lower(symbol), q) THEN 65 WHEN NOT num AND contains(lower(name), q) THEN 60 WHEN NOT num AND contains(pinyin, q) THEN 55 END AS score
  FROM s, (SELECT q, regexp_full_match(q, '[0-9]+') AS num FROM q))
SELECT q AS query, symbol, CAST(score AS INT) AS score FROM k WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, symbol) <= 30""")
def security_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities found in nine tiers by code, name and pinyin, for several searches (TOP14, TOP15); the limit is the list's length."""
    part, word = t.read(spark, sf_dir, "part"), lambda i: F.substring(F.split_part("p_name", F.lit(" "), F.lit(i)), 1, 1)
    rows = part.select(F.concat(F.lit("C"), "p_partkey", F.lit(".SZ")).alias("symbol"), F.col("p_name").alias("name"), F.concat(word(1), word(2), F.col("p_partkey") % 50).alias("pinyin"))
    found = [desk.search_tiers(rows, q).select(F.lit(q).alias("query"), "symbol", "score") for q in _SEARCHES]
    return reduce(DataFrame.union, found)


@query(f"""WITH n AS ({t.NEWS_SQL}), m AS (SELECT DISTINCT news_id, symbol FROM ({t.MENTIONS_SQL})), c AS (SELECT symbol, count(*) FILTER (sentiment_label = 'positive') AS p, count(*) FILTER (sentiment_label = 'negative') AS g, count(*) AS k FROM n JOIN m USING (news_id) GROUP BY 1)
SELECT symbol, CASE WHEN k = 0 THEN 'unknown' WHEN p - g >= 3 THEN 'strong_bullish' WHEN p - g >= 1 THEN 'bullish' WHEN p - g <= -3 THEN 'strong_bearish' WHEN p - g <= -1 THEN 'bearish' ELSE 'neutral' END AS rating, {r('p / k', 4)} AS positive_ratio FROM c""")
def research_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating of each symbol from its news (AGG52, AGG50, FE08)."""
    m = t.mentions(spark, sf_dir).select("news_id", "symbol").distinct()
    c = t.news(spark, sf_dir).join(m, "news_id").groupBy("symbol").agg(F.count_if(F.col("sentiment_label") == "positive").alias("p"), F.count_if(F.col("sentiment_label") == "negative").alias("g"), F.count("*").alias("k"))
    return c.select("symbol", desk.rating(F.col("p"), F.col("g"), F.col("k"), F.lit(None).cast("double")).alias("rating"), half_up(F.col("p") / F.col("k"), 4).alias("positive_ratio"))


_SCORES = "CASE WHEN m <= -2 THEN -1.0 WHEN m >= 2 THEN 1.0 WHEN m < -0.5 THEN -1 + (m + 2) / 1.5 * 0.5 WHEN m <= 0.5 THEN m ELSE (m - 0.5) / 1.5 * 0.5 END"


@query(f"""WITH x AS (SELECT event_id, (value - 50) / 20 AS m, CASE WHEN event_id % 3 <> 0 THEN 10 + value / 4 END AS v, CASE WHEN event_id % 4 <> 0 THEN (user_id % 100) / 100.0::DOUBLE END AS a FROM events),
s AS (SELECT event_id, {_SCORES} AS ms, CASE WHEN v < 13 THEN 0.5 WHEN v < 20 THEN 0.5 - (v - 13) / 7 * 0.5 WHEN v < 30 THEN (v - 20) / 10 * -0.5 WHEN v >= 30 THEN -1.0 END AS vs, -0.5 + (greatest(0.3, least(0.7, a)) - 0.3) / 0.4 AS avs, a FROM x),
c AS (SELECT event_id, (0.6 * ms + coalesce(0.25 * vs, 0) + CASE WHEN a IS NULL THEN 0 ELSE 0.15 * avs END) / (0.6 + CASE WHEN vs IS NULL THEN 0 ELSE 0.25 END + CASE WHEN a IS NULL THEN 0 ELSE 0.15 END) AS score FROM s),
f AS (SELECT event_id, {r('score', 4)} AS score FROM c)
SELECT event_id, score, CASE WHEN score <= -0.6 THEN 'very_bearish' WHEN score <= -0.2 THEN 'bearish' WHEN score <= 0.2 THEN 'neutral' WHEN score <= 0.6 THEN 'bullish' ELSE 'very_bullish' END AS level FROM f""")
def composite_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of momentum, volatility and breadth with renormalised weights (AGG18, DM12 to DM16)."""
    x = t.read(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 20).alias("m"), F.when(F.col("event_id") % 3 != 0, 10 + F.col("value") / 4).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 100 / 100.0).alias("a"))
    vix, breadth = F.when(F.col("v").isNotNull(), numbers.volatility_score(F.col("v"))), F.when(F.col("a").isNotNull(), numbers.advance_score(F.col("a")))
    s = x.select("event_id", half_up(numbers.composite([(numbers.momentum_score(F.col("m")), 0.6), (vix, 0.25), (breadth, 0.15)]), 4).alias("score"))
    return s.withColumn("level", numbers.five_levels(F.col("score")))


@query(f"""SELECT event_type, count(*) AS n, {r('sum(value)', 4)} AS total, {seconds("date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR")} AS day_start FROM events GROUP BY event_type, day_start""")
def shanghai_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of Shanghai days (STR15, STR16, STR17)."""
    e = t.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 day", "1 day", "16 hours")).agg(F.count("*").alias("n"), half_up(F.sum("value"), 4).alias("total")).select("event_type", "n", "total", F.unix_timestamp("window.start").alias("day_start"))


@query("""WITH s AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM part)
SELECT p_partkey, code, CASE WHEN code[1] = '6' THEN 'cn' WHEN code[1] IN ('0', '3') THEN 'cn' ELSE 'us' END AS market, CASE WHEN code[1] = '6' THEN code || '.SS' WHEN code[1] IN ('0', '3') THEN code || '.SZ' ELSE code END AS provider_symbol,
  CASE WHEN regexp_matches(code, '^(688|689)') THEN 'star' WHEN regexp_matches(code, '^(300|301)') THEN 'chinext' WHEN regexp_matches(code, '^[48]') THEN 'bse' ELSE 'main' END AS board FROM s""")
def symbol_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol normalisation and boards (SC14, SC16, DM17)."""
    s = t.read(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0").alias("code"))
    n = s.withColumn("n", normal_symbol(F.col("code"), F.lit(None).cast("string")))
    return n.select("p_partkey", "code", "n.market", "n.provider_symbol", board_of(F.col("code")).alias("board"))


@query(f"""WITH m AS (SELECT news_id, symbol, max(confidence) AS c FROM ({t.MENTIONS_SQL}) GROUP BY 1, 2) SELECT news_id, symbol, c AS confidence FROM m""")
def mention_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions merged by greatest confidence (SNK08)."""
    return t.mentions(spark, sf_dir).groupBy("news_id", "symbol").agg(F.max("confidence").alias("confidence"))


@query(f"""WITH {_B}, c AS (SELECT DISTINCT trade_date FROM b), n AS (SELECT DISTINCT CAST(published_at AS DATE) AS day FROM ({t.SIGNALS_SQL})), s AS (SELECT day, trade_date FROM (SELECT day - 8400 AS day FROM n) ASOF LEFT JOIN c ON day >= trade_date)
SELECT day, trade_date FROM s""", dates="day trade_date")
def news_anchor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last trading day on or before each news day (JN13, JN14)."""
    from ..operators.asof import DAY, asof, micros

    days = t.signals(spark, sf_dir).select(F.date_sub(F.to_date("published_at"), 8400).alias("day")).distinct().withColumn("k", F.lit(1))
    calendar = t.bars(spark, sf_dir).select("trade_date").distinct().withColumn("k", F.lit(1)).withColumn("o", F.lit(0))
    found = asof(days, calendar, "k", micros("day"), micros("trade_date"), F.col("o"), ["trade_date"], "hit", bucket=365 * DAY)
    return found.select("day", "hit.trade_date")


