"""Numeric column functions: rounding, interpolation, piecewise scores, costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounded to ``digits`` places, halves up; the same formula in any SQL dialect.

    A millionth of the last place is added, so that a half that sums in another order misses is still a half.
    """
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def lerp(x: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The line through (x0, y0) and (x1, y1) at x."""
    return F.lit(y0) + (x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def momentum_score(change: Column) -> Column:
    """Average index change in percent to -1 .. 1; it jumps at the ends."""
    return F.when(change <= -2, -1.0).when(change >= 2, 1.0).when(change < -0.5, lerp(change, -2, -1, -0.5, -0.5)).when(change <= 0.5, change).otherwise(lerp(change, 0.5, 0, 2, 0.5))


def volatility_score(vix: Column) -> Column:
    return F.when(vix < 13, 0.5).when(vix < 20, lerp(vix, 13, 0.5, 20, 0)).when(vix < 30, lerp(vix, 20, 0, 30, -0.5)).otherwise(-1.0)


def advance_score(ratio: Column) -> Column:
    return lerp(clamp(ratio, 0.3, 0.7), 0.3, -0.5, 0.7, 0.5)


def composite(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null; null if all are."""
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.try_divide(total, F.nullif(weight, F.lit(0.0)))


def five_levels(score: Column) -> Column:
    """Very negative .. very positive; upper bounds inclusive."""
    return F.when(score <= -0.6, "very_bearish").when(score <= -0.2, "bearish").when(score <= 0.2, "neutral").when(score <= 0.6, "bullish").otherwise("very_bullish")


def decayed(score: Column, hours: Column, rate: float = 0.03) -> Column:
    """Exponential decay by age; an unknown age leaves the score."""
    return F.when(hours.isNull(), score).otherwise(half_up(score * F.exp(-rate * F.greatest(F.lit(0.0), hours)), 4))


def importance_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x >= 0.66, "high").when(x >= 0.33, "medium").otherwise("low")


def score_bucket(x: Column) -> Column:
    """Fifth of |score|, 0 to 4; the last one is closed."""
    return F.least(F.lit(4), F.floor(F.abs(F.coalesce(x, F.lit(0.0))) * 5 + 1e-9)).cast("int")


def fallback_confidence(score: Column) -> Column:
    return F.least(F.lit(0.95), 0.35 + 0.5 * F.least(F.abs(score), F.lit(1.0)))


def token_cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Cost at prices for 1,000 tokens; null only if both prices are."""
    cost = (prompt * F.coalesce(prompt_price, F.lit(0.0)) + completion * F.coalesce(completion_price, F.lit(0.0))) / 1000
    return F.when(prompt_price.isNotNull() | completion_price.isNotNull(), cost)


def backoff_seconds(cadence: Column, failures: Column, most: int = 16) -> Column:
    return cadence * F.least(F.pow(F.lit(2.0), failures), F.lit(float(most)))


def price_limit(board: Column) -> Column:
    return F.when(board.isin("chinext", "star"), 0.2).when(board == "bse", 0.3).otherwise(0.1)


def limit_up_price(previous_close: Column, board: Column) -> Column:
    return half_up(previous_close * (1 + price_limit(board)), 2)


def ema_latency(previous: Column, latest: Column, alpha: float = 0.3) -> Column:
    return F.when(previous.isNull(), latest).otherwise(alpha * latest + (1 - alpha) * previous)
