"""Portfolio, usage, evaluation, health and alert roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, token_cost

# Trading hours in minutes of the UTC day, and the margin around them.
SESSIONS = {"cn": ((90, 210), (300, 420)), "hk": ((90, 240), (300, 480)), "us": ((810, 1260),), "kr": ((0, 390),), "jp": ((0, 360),), "eu": ((450, 990),)}
MARGIN = 15


def positions(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Value, cost and profit of each positive position; a price of 0 is missing. quotes: one row for each symbol."""
    price = F.nullif(F.col("price"), F.lit(0.0))
    rows = holdings.where("position_size > 0").join(quotes.select("symbol", "price"), "symbol", "left")
    rows = rows.withColumn("market_value", half_up(price * F.col("position_size"), 4)).withColumn("cost_basis", half_up(F.col("average_cost") * F.col("position_size"), 4))
    return rows.withColumn("profit", half_up(F.col("market_value") - F.col("cost_basis"), 4))


def weights(rows: DataFrame) -> DataFrame:
    """Each position's weight by market value, else cost, else size, else even: totals are one row."""
    total = rows.agg(F.sum("market_value").alias("mv"), F.sum("cost_basis").alias("cb"), F.sum("position_size").alias("ps"), F.count("*").alias("n"))
    w = F.when(F.col("mv") > 0, F.coalesce("market_value", F.lit(0.0)) / F.col("mv")).when(F.col("cb") > 0, F.coalesce("cost_basis", F.lit(0.0)) / F.col("cb")).when(F.col("ps") > 0, F.col("position_size") / F.col("ps")).otherwise(1 / F.col("n"))
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("weight", w).drop("mv", "cb", "ps", "n")


def portfolio_summary(rows: DataFrame) -> DataFrame:
    """Totals; profit in percent over positions with both value and cost."""
    both = F.col("market_value").isNotNull() & F.col("cost_basis").isNotNull()
    value, cost = F.sum(F.when(both, F.col("market_value"))), F.sum(F.when(both, F.col("cost_basis")))
    return rows.agg(
        F.count("*").alias("n"), half_up(F.sum("market_value"), 4).alias("market_value"), half_up(F.sum("cost_basis"), 4).alias("cost_basis"), half_up(value - cost, 4).alias("profit"), half_up(F.try_divide((value - cost) * 100, F.nullif(cost, F.lit(0.0))), 4).alias("profit_percent")
    )


def weighted_news(rows: DataFrame, news: DataFrame, mentions: DataFrame, k: int = 12) -> DataFrame:
    """The k news with the greatest impact: score times weight, summed over the symbols that it mentions."""
    hit = mentions.select("news_id", "symbol").distinct().join(rows.select("symbol", "weight"), "symbol").join(news.select("news_id", "sentiment_score", "effective_at"), "news_id")
    impact = hit.groupBy("news_id", "effective_at").agg(half_up(F.sum(F.col("sentiment_score") * F.col("weight")), 6).alias("impact"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))
    return impact.where("impact <> 0").orderBy(F.abs("impact").desc(), F.col("effective_at").desc(), F.col("news_id").desc()).limit(k).select("news_id", "impact", "symbols")


def usage_by(rows: DataFrame, by: list[Column | str], prices: DataFrame | None = None) -> DataFrame:
    """Calls, tokens and cost. prices: model_name, prompt_price, completion_price for 1,000 tokens, a row for each model."""
    cost = F.lit(None).cast("double")
    if prices is not None:
        rows = rows.join(prices, "model_name", "left")
        cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("prompt_price"), F.col("completion_price"))
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), half_up(F.sum(cost), 6).alias("cost"))


def binary_evaluation(rows: DataFrame, least_recall: float = 0.8) -> DataFrame:
    """Counts, precision, recall, noise rejection (0 on empty denominators) and guardrail of columns gold and predicted."""
    count = lambda g, p: F.count_if((F.col("gold") == g) & (F.col("predicted") == p))
    a = rows.agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(False, False).alias("tn"), count(True, False).alias("fn"))
    ratio = lambda x, y: half_up(F.coalesce(F.try_divide(F.col(x), F.nullif(F.col(x) + F.col(y), F.lit(0))), F.lit(0.0)), 4)
    return a.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("tn", "fp").alias("noise_rejection")).withColumn("passes", F.col("recall") >= least_recall)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def label_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label."""
    c = confusion(rows)
    gold, predicted = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits")), c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    full = gold.join(predicted, "label", "full").select("label", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "hits", "guessed")))
    p, q = F.coalesce(F.try_divide("hits", F.nullif("guessed", F.lit(0))), F.lit(0.0)), F.coalesce(F.try_divide("hits", F.nullif("support", F.lit(0))), F.lit(0.0))
    return full.select("label", "support", half_up(p, 4).alias("precision"), half_up(q, 4).alias("recall"), half_up(F.coalesce(F.try_divide(2 * p * q, F.nullif(p + q, F.lit(0.0))), F.lit(0.0)), 4).alias("f1"))


def top_confusions(rows: DataFrame, k: int = 3) -> DataFrame:
    return confusion(rows.where("gold <> predicted")).orderBy(F.col("n").desc(), "gold", "predicted").limit(k)


def weighted_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy, and accuracy weighted by importance (a missing weight is 1; null if all are missing)."""
    w, hit = F.coalesce("importance", F.lit(1.0)), (F.col("gold") == F.col("predicted")).cast("double")
    return rows.agg(half_up(F.avg(hit), 4).alias("accuracy"), half_up(F.when(F.count("importance") > 0, F.sum(w * hit) / F.sum(w)), 4).alias("weighted_accuracy"))


def source_status(failures: Column, success_age: Column, cadence: Column) -> Column:
    return F.when(failures >= 4, "offline").when(failures >= 2, "degraded").when(success_age.isNull(), "offline").when(success_age > 2 * cadence, "delayed").otherwise("ok")


def success_rate(fetches: Column, failures: Column) -> Column:
    return F.when(fetches > 0, half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (fetches - failures) / fetches)), 4))


def market_mode(rows: DataFrame, window_seconds: int) -> DataFrame:
    """The best tier of each market with a success within the window. rows: market, tier, success_age."""
    rank = F.when(F.col("tier") == "primary", 1).when(F.col("tier") == "secondary", 2).when(F.col("tier") == "fallback", 3)
    best = F.min_by("tier", F.when(F.col("success_age") <= window_seconds, rank))
    return rows.groupBy("market").agg(F.when(F.bool_or(F.coalesce(F.col("success_age") <= window_seconds, F.lit(False))), best).otherwise("none").alias("mode"))


def market_open(market: Column, ts: Column, unknown: bool = True, markets: tuple[str, ...] = ("cn", "hk", "us")) -> Column:
    """Weekday and within a session or its margin; ``unknown`` is the answer for other markets."""
    minute, low = F.hour(ts) * 60 + F.minute(ts), F.lower(F.coalesce(market, F.lit("")))
    out = F.lit(unknown)
    for name in markets:
        inside = F.lit(False)
        for start, end in SESSIONS[name]:
            inside = inside | minute.between(start - MARGIN, end + MARGIN)
        out = F.when(low == name, inside & (F.weekday(ts) < 5)).otherwise(out)
    return out


def quiet(ts: Column, start: int, end: int, zone: str = "Asia/Shanghai") -> Column:
    """Whether the local minute of the day lies in [start, end), which may cross midnight."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    m = F.hour(local) * 60 + F.minute(local)
    return (m >= start) & (m < end) if start <= end else (m >= start) | (m < end)


def edge_alerts(quotes: DataFrame, threshold: float) -> DataFrame:
    """Quotes at which a symbol's price goes over its threshold and was not over it before."""
    w = Window.partitionBy("symbol").orderBy("fetched_at", "id")
    over = F.col("price") >= threshold
    return quotes.withColumn("over", over).withColumn("before", F.coalesce(F.lag(over).over(w), F.lit(False))).where("over and not before").drop("over", "before")


def severity(event: Column, change: Column, critical: float = 5.0) -> Column:
    return F.when(event == "watchlist_alert", F.when(F.abs(change) >= critical, "critical").otherwise("normal")).when(event.isin("analysis_result", "alert_digest", "sentiment_divergence"), "normal").otherwise("low")


def rating(positives: Column, negatives: Column, total: Column, change: Column) -> Column:
    s = positives - negatives
    tilt = F.when(change >= 3, "bullish").when(change <= -3, "bearish").otherwise("neutral")
    return F.when(total == 0, "unknown").when(s >= 3, "strong_bullish").when(s >= 1, "bullish").when(s <= -3, "strong_bearish").when(s <= -1, "bearish").otherwise(tilt)


def stratified(rows: DataFrame, strata: list[str], order: list[Column], limit: int) -> DataFrame:
    """A round-robin sample over the strata; the limit is the sample's size."""
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    # No stratum gives more rows than the sample has: each task sorts its own heads before the shuffle.
    return rows.withColumn("rn", rn).where(F.col("rn") <= limit).orderBy("rn", *strata).limit(limit)


def search_score(rows: DataFrame, query: str) -> Column:
    """How well a security (symbol, name, pinyin) matches: nine tiers of equal, prefix and inside; null if not at all. Digits match codes alone."""
    q, s, n, p = query.strip().lower(), F.lower("symbol"), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("pinyin", F.lit("")))
    digits, words = F.substring_index(s, ".", 1), F.lit(not q.isdigit())
    tiers = [
        ((digits == q) | (s == q), 100), (words & (n == q), 95), (words & (p == q), 90), (digits.startswith(q) | s.startswith(q), 85), (words & n.startswith(q), 80), (words & p.startswith(q), 75),
        (F.contains(digits, F.lit(q)) | F.contains(s, F.lit(q)), 65), (words & F.contains(n, F.lit(q)), 60), (words & F.contains(p, F.lit(q)), 55),
    ]
    score = F.lit(None).cast("int")
    for match, tier in reversed(tiers):
        score = F.when(match, tier).otherwise(score)
    return score if q else F.lit(None).cast("int")


def search_tiers(rows: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The ``limit`` securities (symbol, name, and pinyin if there is one) that match best; of equal ones by symbol."""
    rows = rows if "pinyin" in rows.columns else rows.withColumn("pinyin", F.lit(""))
    return rows.withColumn("score", search_score(rows, query)).where("score is not null").orderBy(F.col("score").desc(), "symbol").limit(limit)
