"""Bar series: averages, bands, oscillators, recurrences and ranges, each within a symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up


def in_order():
    """A symbol's bars by date."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def back(n: int):
    return in_order().rowsBetween(1 - n, 0)


def full(value: Column, n: int) -> Column:
    """The value, or null before n rows."""
    return F.when(F.count("*").over(back(n)) == n, value)


def moving_averages(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    return bars.select("symbol", "trade_date", *(half_up(full(F.avg("close").over(back(n)), n), 4).alias(f"ma{n}") for n in spans))


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0, sample: bool = True) -> DataFrame:
    """Middle, upper and lower band by sample (or population) deviation."""
    mid, dev = F.avg("close").over(back(n)), (F.stddev_samp if sample else F.stddev_pop)("close").over(back(n))
    return bars.select("symbol", "trade_date", *(half_up(full(x, n), 4).alias(name) for name, x in (("mid", mid), ("upper", mid + width * dev), ("lower", mid - width * dev))))


def daily_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(in_order())
    return bars.select("symbol", "trade_date", before.alias("previous_close"), half_up(F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0))), 6).alias("ret"))


def volatility(bars: DataFrame, n: int = 20, default: float = 1.0) -> DataFrame:
    """Population deviation of the last n daily returns of each symbol; ``default`` with fewer than two."""
    last = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    before = F.lag("close").over(in_order())
    r = bars.select("symbol", "trade_date", F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0))).alias("r"))
    return r.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n).groupBy("symbol").agg(half_up(F.when(F.count("r") >= 2, F.stddev_pop("r")).otherwise(default), 6).alias("vol"))


def rolling_amount(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean amount of the last n bars, partial frames allowed."""
    return bars.select("symbol", "trade_date", half_up(F.avg("amount").over(back(n)), 6).alias("adv"))


def sparkline(bars: DataFrame, n: int = 30) -> DataFrame:
    """The last n closes of each symbol in order, without nulls."""
    last = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    kept = bars.withColumn("rn", F.row_number().over(last)).where((F.col("rn") <= n) & F.col("close").isNotNull())
    return kept.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda x: half_up(x["close"], 4)).alias("closes"))


def range_position(bars: DataFrame) -> DataFrame:
    """Where the last close of each symbol lies between its lowest low and highest high; null if these are equal."""
    a = bars.groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "trade_date").alias("last"))
    return a.select("symbol", half_up(F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("last") - F.col("lo")) / (F.col("hi") - F.col("lo"))))), 4).alias("position"))


def candle_stats(bars: DataFrame) -> DataFrame:
    """Amplitude in percent of the previous close, and the close's place in the day's range."""
    before = F.lag("close").over(in_order())
    return bars.select(
        "symbol", "trade_date", half_up(F.try_divide((F.col("high") - F.col("low")) * 100, F.nullif(before, F.lit(0.0))), 4).alias("amplitude"),
        half_up(F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))), 4).alias("session_position"),
    )


def retracements(bars: DataFrame, ratios: tuple[float, ...] = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)) -> DataFrame:
    """Price levels between each symbol's highest high and lowest low."""
    a = bars.groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    return a.select("symbol", F.explode(F.array(*map(F.lit, ratios))).alias("ratio"), "hi", "lo").select("symbol", "ratio", half_up(F.col("hi") - (F.col("hi") - F.col("lo")) * F.col("ratio"), 4).alias("level"))


_OSCILLATORS = ("dif", "dea", "hist", "k", "d", "j", "rsi")


def oscillators(bars: DataFrame) -> DataFrame:
    """MACD (12, 26, 9; histogram not doubled), KDJ (9, thirds; RSV 0 in the first eight rows and flat ranges) and Wilder RSI 14.

    Recurrences need a symbol's bars in order.  A symbol's daily bars are held together: some thousands of
    rows in decades, whatever the number of symbols.  Symbols come one after the other in sorted Arrow batches.
    """
    kind = [("symbol", pa.string()), ("trade_date", pa.date32()), *((c, pa.float64()) for c in _OSCILLATORS)]
    rows = bars.select("symbol", "trade_date", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            """The result of whole symbols."""
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            high, low, close = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            edge = [*_starts(rows.column(0)), rows.num_rows]
            values = np.concatenate([_recurrences(high[i:j], low[i:j], close[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], axis=1)
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, values)], schema=pa.schema(kind))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not _same(held[-1].column(0)[-1], batch.column(0)[0]):
                yield done(held)
                held = []
            last = _starts(batch.column(0))[-1]
            if last:
                yield done([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(held)

    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", "trade_date")
    out = ordered.mapInArrow(run, "symbol string, trade_date date, " + ", ".join(f"{c} double" for c in _OSCILLATORS))
    return out.select("symbol", "trade_date", *(half_up(F.nanvl(c, F.lit(None).cast("double")), 4).alias(c) for c in _OSCILLATORS))


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _starts(symbols: pa.Array) -> list[int]:
    """Where each symbol begins in a sorted column; nulls are one symbol."""
    codes = symbols.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()


def _recurrences(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The oscillators of a symbol's bars in order, one row each."""
    n = len(close)
    if np.isnan(high).any() or np.isnan(low).any() or np.isnan(close).any():
        return _recurrences_with_gaps(pd.Series(high), pd.Series(low), pd.Series(close))
    rsv = np.zeros(n)
    if n >= 9:
        lowest, highest = np.lib.stride_tricks.sliding_window_view(low, 9).min(1), np.lib.stride_tricks.sliding_window_view(high, 9).max(1)
        rsv[8:] = np.divide(close[8:] - lowest, highest - lowest, out=np.zeros(n - 8), where=highest != lowest) * 100
    change = np.diff(close)
    gain, loss = np.maximum(change, 0.0).tolist(), np.maximum(-change, 0.0).tolist()
    prices, ranks = close.tolist(), rsv.tolist()
    fast = slow = prices[0]
    dea, k, d = 0.0, ranks[0], ranks[0]
    up = down = 0.0
    out = []
    for i, (price, rank) in enumerate(zip(prices, ranks, strict=True)):
        rsi = float("nan")
        if i:
            fast += (price - fast) * 2 / 13
            slow += (price - slow) * 2 / 27
            dea += (fast - slow - dea) * 0.2
            k += (rank - k) / 3
            d += (k - d) / 3
        if i >= 14:
            if i == 14:
                up, down = sum(gain[:14]) / 14, sum(loss[:14]) / 14
            else:
                up, down = (up * 13 + gain[i - 1]) / 14, (down * 13 + loss[i - 1]) / 14
            rsi = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        out.append((fast - slow, dea, fast - slow - dea, k, d, 3 * k - 2 * d, rsi))
    return np.array(out).T


def _recurrences_with_gaps(high: pd.Series, low: pd.Series, close: pd.Series) -> np.ndarray:
    """The same where values are missing: averages pass over them."""
    ema = lambda s, span: s.ewm(span=span, adjust=False).mean()
    dif = ema(close, 12) - ema(close, 26)
    dea = ema(dif, 9)
    lowest, highest = low.rolling(9).min(), high.rolling(9).max()
    rsv = ((close - lowest) / (highest - lowest).replace(0, np.nan) * 100).fillna(0.0)
    k = rsv.ewm(com=2, adjust=False).mean()
    d = k.ewm(com=2, adjust=False).mean()
    change = close.diff()
    gain, loss = change.clip(lower=0), -change.clip(upper=0)
    rsi = np.full(len(close), np.nan)
    if len(close) > 14:
        up, down = gain[1:15].mean(), loss[1:15].mean()
        for i in range(14, len(close)):
            if i > 14:
                up, down = (up * 13 + gain[i]) / 14, (down * 13 + loss[i]) / 14
            rsi[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    return np.array([dif, dea, dif - dea, k, d, 3 * k - 2 * d, rsi])


def latest(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``: one aggregation, combined within tasks first."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def window_change(quotes: DataFrame) -> DataFrame:
    """First, last, high, low and change in percent of each symbol's quotes; change needs two quotes."""
    a = quotes.groupBy("symbol").agg(
        F.min_by("price", F.struct("fetched_at", "id")).alias("first_price"), F.max_by("price", F.struct("fetched_at", "id")).alias("last_price"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n")
    )
    return a.withColumn("change_percent", half_up(F.when(F.col("n") >= 2, F.try_divide((F.col("last_price") - F.col("first_price")) * 100, F.nullif("first_price", F.lit(0.0)))), 4))
