"""Market queries: backtest, latest quotes, bar series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import backtest, timeseries
from ..sources import tables as t
from .common import query, r, seconds

_OUTCOMES = f"""
s AS ({t.SIGNALS_SQL}), q AS ({t.QUOTES_SQL}), known AS (SELECT DISTINCT symbol FROM q),
b AS (SELECT s.*, q.price AS bp, q.fetched_at AS bt FROM s ASOF LEFT JOIN q ON s.symbol = q.symbol AND s.published_at >= q.fetched_at),
a AS (SELECT b.*, q.price AS fp FROM (SELECT *, published_at + INTERVAL 1 DAY AS due FROM b) b ASOF LEFT JOIN q ON b.symbol = q.symbol AND b.due <= q.fetched_at),
o AS (
  SELECT a.*, CASE WHEN known.symbol IS NULL THEN 'no_prices' WHEN bp IS NULL THEN 'no_baseline' WHEN published_at - bt > INTERVAL 1 DAY THEN 'stale'
      WHEN fp IS NULL OR bp = 0 THEN 'no_forward' END AS skip_reason
  FROM a LEFT JOIN known USING (symbol)),
outcome AS (
  SELECT *, CASE WHEN skip_reason IS NULL THEN fp / bp - 1 END AS ret,
    CASE WHEN skip_reason IS NULL THEN CASE label WHEN 'positive' THEN fp / bp - 1 > 0 ELSE fp / bp - 1 < 0 END END AS hit FROM o)
"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.outcomes(t.signals(spark, sf_dir), t.quotes(spark, sf_dir))


@query(f"WITH {_OUTCOMES} SELECT news_id, symbol, label, importance, score, bp AS base_price, fp AS forward_price, skip_reason, {r('ret', 6)} AS ret, hit FROM outcome")
def signal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward and forward as-of joins, with staleness bound (JN10, JN11, JN12)."""
    return _outcomes(spark, sf_dir).withColumn("ret", half_up(F.col("ret"), 6))


@query(f"""WITH {_OUTCOMES}, n AS (SELECT news_id, avg(CAST(hit AS INT)) AS rate FROM outcome WHERE ret IS NOT NULL GROUP BY 1)
SELECT count(*) AS total_signals, count(skip_reason) AS skipped, count(*) FILTER (skip_reason = 'stale') AS skipped_stale, count(ret) AS evaluated,
  {r('avg(CAST(hit AS INT))', 4)} AS hit_rate, {r('avg(ret)', 6)} AS avg_return, (SELECT {r('avg(rate)', 4)} FROM n) AS per_news_hit_rate, (SELECT count(*) FROM n) AS news_count FROM outcome""")
def signal_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest totals (AGG03, AGG08, AGG09)."""
    return backtest.summary(_outcomes(spark, sf_dir))


@query(f"""WITH {_OUTCOMES} SELECT label, count(*) AS n, count(*) FILTER (hit) AS hits, {r('avg(CAST(hit AS INT))', 4)} AS hit_rate, {r('avg(ret)', 6)} AS avg_return,
  {r('avg(ret - (SELECT avg(ret) FROM outcome))', 6)} AS avg_excess FROM outcome WHERE ret IS NOT NULL GROUP BY 1""")
def backtest_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction view and excess over the mean of all samples (AGG04, AGG07)."""
    return backtest.by_direction(_outcomes(spark, sf_dir))


@query(f"""WITH {_OUTCOMES}, f AS (SELECT CASE WHEN importance IS NULL THEN 'unknown' WHEN importance >= 0.66 THEN 'high' WHEN importance >= 0.33 THEN 'medium' ELSE 'low' END AS bucket,
  count(*) AS n, count(*) FILTER (hit) AS hits FROM outcome WHERE ret IS NOT NULL GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, {r('hits / nullif(n, 0)', 4)} AS hit_rate FROM (VALUES ('high'), ('medium'), ('low')) e(bucket) FULL JOIN f USING (bucket)""")
def backtest_by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance buckets, zero-filled (AGG05, DM23)."""
    return backtest.importance_buckets(_outcomes(spark, sf_dir))


_BUCKETS = f"""{_OUTCOMES}, f AS (SELECT least(4, CAST(floor(abs(coalesce(score, 0)) * 5 + 1e-9) AS INT)) AS bucket, count(*) AS n, count(*) FILTER (hit) AS hits FROM outcome WHERE ret IS NOT NULL GROUP BY 1),
buckets AS (SELECT bucket, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, {r('hits / nullif(n, 0)', 4)} AS hit_rate FROM (SELECT CAST(range AS INT) AS bucket FROM range(5)) LEFT JOIN f USING (bucket))"""


@query(f"WITH {_BUCKETS} SELECT * FROM buckets")
def backtest_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score buckets, zero-filled (AGG06, DM24)."""
    return backtest.score_buckets(_outcomes(spark, sf_dir))


@query(f"""WITH {_BUCKETS}, c AS (SELECT bucket, {r('bucket / 5.0', 1)} AS score_min, n, n < 30 OR hit_rate IS NULL AS low_sample,
  CASE WHEN n < 30 OR hit_rate IS NULL THEN {r('least(0.95, 0.35 + 0.5 * least(bucket / 5.0 + 0.1, 1.0))', 4)} ELSE hit_rate END AS confidence FROM buckets)
SELECT *, (SELECT min(score_min) FROM c WHERE NOT low_sample AND confidence >= 0.55) AS suggested_threshold FROM c""")
def sentiment_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration table (AGG10, DM21, SNK19)."""
    return backtest.calibration(backtest.score_buckets(_outcomes(spark, sf_dir)))


@query(f"SELECT symbol, market, id, price, {seconds('fetched_at')} AS at FROM ({t.QUOTES_SQL}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) = 1")
def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest quote of each symbol (JN07, TOP03, STR23)."""
    return timeseries.latest(t.quotes(spark, sf_dir), "symbol", "fetched_at", "id").select("symbol", "market", "id", "price", F.unix_timestamp("fetched_at").alias("at"))


@query(f"""SELECT symbol, arg_min(price, (fetched_at, id)) AS first_price, arg_max(price, (fetched_at, id)) AS last_price, max(price) AS high, min(price) AS low, count(*) AS n,
  CASE WHEN count(*) >= 2 THEN {r('(arg_max(price, (fetched_at, id)) - arg_min(price, (fetched_at, id))) * 100 / nullif(arg_min(price, (fetched_at, id)), 0)', 4)} END AS change_percent
FROM ({t.QUOTES_SQL}) GROUP BY 1""")
def price_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last price, high, low and change of each symbol (AGG13, AGG51)."""
    return timeseries.window_change(t.quotes(spark, sf_dir))


@query(t.BARS_SQL.replace("sum(CASE", "floor(sum(CASE").replace("(1 - l_discount)) AS inflow", "(1 - l_discount)) * 100 + 0.500001) / 100 AS inflow").replace("sum(l_extendedprice) AS amount", f"{r('sum(l_extendedprice)', 2)} AS amount"), dates="trade_date")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and fund flow by symbol and day (JN19, WIN05)."""
    return t.bars(spark, sf_dir).withColumn("amount", half_up(F.col("amount"), 2)).withColumn("inflow", half_up(F.col("inflow"), 2))


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(e: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {_frame(n)} = {n} THEN {r(e, 4)} END"


@query(f"WITH b AS ({t.BARS_SQL}) SELECT symbol, trade_date, " + ", ".join(f"{_full(f'avg(close) OVER {_frame(n)}', n)} AS ma{n}" for n in (5, 10, 20, 60)) + " FROM b", dates="trade_date")
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages, null until full (WIN01, WIN07)."""
    return timeseries.moving_averages(t.bars(spark, sf_dir))


def _bands(kind: str) -> str:
    mid, dev = f"avg(close) OVER {_frame(20)}", f"stddev_{kind}(close) OVER {_frame(20)}"
    return f"WITH b AS ({t.BARS_SQL}) SELECT symbol, trade_date, {_full(mid, 20)} AS mid, {_full(f'{mid} + 2 * {dev}', 20)} AS upper, {_full(f'{mid} - 2 * {dev}', 20)} AS lower FROM b"


@query(_bands("samp"), dates="trade_date")
def bollinger_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bollinger bands by sample deviation (WIN04)."""
    return timeseries.bollinger(t.bars(spark, sf_dir))


@query(_bands("pop"), dates="trade_date")
def bollinger_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bollinger bands by population deviation (WIN10)."""
    return timeseries.bollinger(t.bars(spark, sf_dir), sample=False)


@query(f"""WITH b AS ({t.BARS_SQL}), p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS previous_close FROM b)
SELECT symbol, trade_date, previous_close, {r('(close - previous_close) / nullif(previous_close, 0)', 6)} AS ret FROM p""", dates="trade_date")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous close and daily return (WIN12, WIN13, WIN14, SRC25)."""
    return timeseries.daily_returns(t.bars(spark, sf_dir))


@query(f"""WITH b AS ({t.BARS_SQL}), p AS (SELECT symbol, trade_date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS r FROM b),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 20)
SELECT symbol, {r('CASE WHEN count(r) >= 2 THEN stddev_pop(r) ELSE 1.0 END', 6)} AS vol FROM l GROUP BY 1""")
def volatility_20d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population volatility of the last 20 returns (AGG32)."""
    return timeseries.volatility(t.bars(spark, sf_dir))


@query(f"WITH b AS ({t.BARS_SQL}) SELECT symbol, trade_date, {r(f'avg(amount) OVER {_frame(20)}', 6)} AS adv FROM b", dates="trade_date")
def rolling_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling 20-bar mean amount (WIN11)."""
    return timeseries.rolling_amount(t.bars(spark, sf_dir))


@query(f"""WITH b AS ({t.BARS_SQL}), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 30)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS INT) AS pos, {r('close', 4)} AS close FROM l""")
def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 30 closes (WIN06)."""
    return timeseries.sparkline(t.bars(spark, sf_dir)).select("symbol", F.posexplode("closes").alias("pos", "close"))


@query(f"""WITH b AS ({t.BARS_SQL}), a AS (SELECT symbol, max(high) AS hi, min(low) AS lo, arg_max(close, trade_date) AS last FROM b GROUP BY 1)
SELECT symbol, CASE WHEN hi > lo THEN {r('least(1.0, greatest(0.0, (last - lo) / (hi - lo)))', 4)} END AS position FROM a""")
def range_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range position over the loaded bars (FE03)."""
    return timeseries.range_position(t.bars(spark, sf_dir))


@query(f"""WITH b AS ({t.BARS_SQL}), p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pc FROM b)
SELECT symbol, trade_date, {r('(high - low) * 100 / nullif(pc, 0)', 4)} AS amplitude, CASE WHEN high > low THEN {r('(close - low) / (high - low)', 4)} END AS session_position FROM p""", dates="trade_date")
def candle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude and session position (FE01, FE02)."""
    return timeseries.candle_stats(t.bars(spark, sf_dir))


@query(f"""WITH b AS ({t.BARS_SQL}), a AS (SELECT symbol, max(high) AS hi, min(low) AS lo FROM b GROUP BY 1)
SELECT symbol, CAST(ratio AS DOUBLE) AS ratio, {r('hi - (hi - lo) * CAST(ratio AS DOUBLE)', 4)} AS level FROM a, (VALUES (0.0), (0.236), (0.382), (0.5), (0.618), (0.786), (1.0)) v(ratio)""")
def retracement_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retracement levels (FE15)."""
    return timeseries.retracements(t.bars(spark, sf_dir))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i,
    min(low) OVER {_frame(9)} AS l9, max(high) OVER {_frame(9)} AS h9, close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS ch FROM ({t.BARS_SQL})),
v AS (SELECT *, CASE WHEN i >= 9 AND h9 > l9 THEN (close - l9) / (h9 - l9) * 100 ELSE 0.0 END AS rsv,
    CASE WHEN i = 15 THEN avg(greatest(ch, 0)) OVER w END AS up0, CASE WHEN i = 15 THEN avg(greatest(-ch, 0)) OVER w END AS down0
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
e AS (
  SELECT symbol, trade_date, i, close AS e12, close AS e26, 0.0::DOUBLE AS dea, rsv::DOUBLE AS k, rsv::DOUBLE AS d, NULL::DOUBLE AS up, NULL::DOUBLE AS down FROM v WHERE i = 1
  UNION ALL
  SELECT v.symbol, v.trade_date, v.i, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27,
    dea + ((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27) - dea) * 0.2, k + (rsv - k) / 3, d + (k + (rsv - k) / 3 - d) / 3,
    CASE WHEN v.i = 15 THEN up0 WHEN v.i > 15 THEN (up * 13 + greatest(ch, 0)) / 14 END, CASE WHEN v.i = 15 THEN down0 WHEN v.i > 15 THEN (down * 13 + greatest(-ch, 0)) / 14 END
  FROM e JOIN v ON v.symbol = e.symbol AND v.i = e.i + 1)
SELECT symbol, trade_date, {r('e12 - e26', 4)} AS dif, {r('dea', 4)} AS dea, {r('e12 - e26 - dea', 4)} AS hist, {r('k', 4)} AS k, {r('d', 4)} AS d, {r('3 * k - 2 * d', 4)} AS j,
  CASE WHEN i >= 15 THEN {r('CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END', 4)} END AS rsi FROM e""", dates="trade_date")
def oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD, KDJ, RSI and the EMA recurrences (WIN02, WIN03, WIN08, WIN09)."""
    return timeseries.oscillators(t.bars(spark, sf_dir))
