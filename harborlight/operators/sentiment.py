"""Sentiment: lexicon classifier, daily timelines, divergence, market attribution, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fallback_confidence, half_up

# English terms and weights, which count once for each occurrence.
POSITIVE = {"beat": 0.7, "growth": 0.6, "improves": 0.5, "improved": 0.5, "boost": 0.7, "constructive": 0.4, "expands": 0.5, "higher": 0.4, "strong": 0.6}
NEGATIVE = {"weak": -0.7, "weakens": -0.8, "weaker": -0.7, "soft": -0.5, "softer": -0.5, "lower": -0.4, "risk": -0.5, "warning": -0.6, "pressure": -0.4}
# Chinese terms and weights, which count once for each text.
POSITIVE_ZH = {"利好": 0.7, "上涨": 0.6, "大涨": 0.8, "反弹": 0.5, "增长": 0.6, "超预期": 0.7, "强劲": 0.6, "突破": 0.6, "新高": 0.7, "盈利": 0.6, "提振": 0.6, "看好": 0.5, "机遇": 0.5, "乐观": 0.5, "回暖": 0.5, "走高": 0.5, "攀升": 0.5, "提升": 0.4, "加快": 0.4}
NEGATIVE_ZH = {"利空": -0.7, "下跌": -0.6, "大跌": -0.8, "暴跌": -0.9, "下滑": -0.5, "亏损": -0.7, "衰退": -0.7, "风险": -0.5, "警告": -0.6, "收紧": -0.5, "放缓": -0.4, "承压": -0.5, "疲软": -0.6, "下调": -0.5, "违约": -0.7, "制裁": -0.6, "处罚": -0.6, "崩盘": -0.9}
# Theme words, and words that are never keywords.
THEMES = "ai cloud revenue smartphone demand supply oil energy shipment shipments orders monetization platform 财报 营收 业绩 并购 收购 监管 上市 融资 芯片 半导体 人工智能 模型 新能源 产能 供应链 出货 订单 宏观 通胀 降息 加息 利率".split()
STOP_WORDS = "the and for with into from after ahead near term still points point market markets update latest news officials existing without next cycle remains remain focus keeps unchanged described mixed timing".split()


def classify(rows: DataFrame, text: Column) -> DataFrame:
    """Adds label, score (clamped, 4 places), confidence, keywords (first six) and topic_key.

    Tokens are the runs of Latin letters and digits that are no stop words, in order, then the Chinese terms
    that the text has, longest first.
    """
    sentiment = [*POSITIVE, *NEGATIVE, *POSITIVE_ZH, *NEGATIVE_ZH]
    weights = F.create_map(*(F.lit(x) for pair in {**POSITIVE, **NEGATIVE, **POSITIVE_ZH, **NEGATIVE_ZH}.items() for x in pair))
    latin = [w for w in sentiment if w.isascii()]
    chinese = sorted(dict.fromkeys([*POSITIVE_ZH, *NEGATIVE_ZH, *(w for w in THEMES if not w.isascii())]), key=len, reverse=True)
    low = F.lower(text)
    # Each step is a generator over one row, so that no later one computes it again.
    step = lambda df, name, value: df.select(*(F.col(c) for c in df.columns), F.inline(F.array(F.struct(value.alias(name)))))
    tokens = F.struct(
        F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1).alias("latin"),
        F.when(low.rlike("[一-鿿]"), F.filter(F.array(*map(F.lit, chinese)), lambda w: F.contains(low, w))).otherwise(F.array().cast("array<string>")).alias("chinese"),
    )
    out = step(rows, "tokens", tokens)
    words = F.filter("tokens.latin", lambda w: ((F.length(w) > 2) | (w == "ai")) & ~w.isin([*latin, *STOP_WORDS]))
    found = F.struct(F.filter("tokens.latin", lambda w: w.isin(latin)).alias("weighted"), F.array_distinct(words).alias("words"), F.col("tokens.chinese").alias("chinese"))
    out = step(out, "found", found).drop("tokens")
    mine = F.filter("found.chinese", lambda w: ~w.isin(sentiment) & (F.length(w) > 2))
    # Hundredths are summed, so that the order of the terms does not matter.
    raw = F.aggregate(F.concat("found.weighted", "found.chinese"), F.lit(0), lambda acc, w: acc + F.coalesce(F.round(F.try_element_at(weights, w) * 100), F.lit(0)).cast("int")) / 100.0
    out = step(out, "lexicon", F.struct(raw.alias("raw"), F.slice(F.array_distinct(F.concat("found.words", mine)), 1, 6).alias("keywords"))).drop("found")
    raw, keywords = F.col("lexicon.raw"), F.col("lexicon.keywords")
    rest = F.slice(keywords, 2, 5)
    themes = F.slice(F.filter(rest, lambda w: w.isin(THEMES)), 1, 2)
    topic = F.array_join(F.concat(F.slice(keywords, 1, 1), F.when(F.size(themes) > 0, themes).otherwise(F.slice(rest, 1, 2))), " ")
    return out.select(
        *(F.col(c) for c in rows.columns), F.when(raw >= 0.2, "positive").when(raw <= -0.2, "negative").otherwise("neutral").alias("label"),
        half_up(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), 4).alias("score"), half_up(fallback_confidence(raw), 4).alias("confidence"), keywords.alias("keywords"),
        F.when(F.size(keywords) == 0, "general-market-update").otherwise(topic).alias("topic_key"),
    )


def local_day(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def timeline(news: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mean score and labels of each symbol's news by local day; days without news are left out."""
    rows = news.join(mentions.select("news_id", "symbol").distinct(), "news_id").withColumn("day", local_day(F.col("effective_at")))
    counts = [F.count_if(F.col("sentiment_label") == x).alias(f"n_{x}") for x in ("positive", "neutral", "negative")]
    return rows.groupBy("symbol", "day").agg(half_up(F.avg("sentiment_score"), 4).alias("avg_score"), F.count("*").alias("n"), *counts)


def top_of_day(news: DataFrame, mentions: DataFrame, k: int = 3) -> DataFrame:
    """The k news of each symbol and local day with the strongest score."""
    rows = news.join(mentions.select("news_id", "symbol").distinct(), "news_id").withColumn("day", local_day(F.col("effective_at")))
    w = Window.partitionBy("symbol", "day").orderBy(F.abs("sentiment_score").desc(), F.col("news_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("symbol", "day", "rank", "news_id")


def divergence(news: DataFrame, mentions: DataFrame, changes: DataFrame, least: int = 3, mood: float = 0.4, move: float = 3.0) -> DataFrame:
    """Mood against price of each symbol; mood is null with fewer than ``least`` news."""
    m = news.join(mentions.select("news_id", "symbol").distinct(), "news_id").groupBy("symbol").agg(F.count("*").alias("news_count"), half_up(F.when(F.count("*") >= least, F.avg("sentiment_score")), 4).alias("mood"))
    both = m.join(changes.select("symbol", "change_percent"), "symbol", "left")
    status = F.when(F.col("mood").isNull() | F.col("change_percent").isNull(), "insufficient").when((F.col("mood") >= mood) & (F.col("change_percent") <= -move), "bearish_divergence").when((F.col("mood") <= -mood) & (F.col("change_percent") >= move), "bullish_divergence").otherwise("aligned")
    return both.withColumn("status", status)


def attributed(news: DataFrame, mentions: DataFrame, share: float = 0.6) -> DataFrame:
    """Each news item's market: that of most of its mentions if they are ``share`` of them (first seen wins ties), else its own."""
    counts = mentions.groupBy("news_id", F.col("market").alias("m")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    best = counts.groupBy("news_id").agg(F.max_by("m", F.struct("n", -F.col("first_id"))).alias("m"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return news.join(best, "news_id", "left").withColumn("attributed_market", F.when(F.col("n") >= share * F.col("total"), F.col("m")).otherwise(F.col("market"))).drop("m", "n", "total")


def by_market(news: DataFrame, markets: tuple[str, ...] = ("us", "hk", "cn", "jp", "kr"), least: int = 3) -> DataFrame:
    """Mean score of each market of the skeleton, with status."""
    found = news.groupBy(F.col("attributed_market").alias("market")).agg(F.avg("sentiment_score").alias("mean"), F.count("*").alias("n"))
    every = news.sparkSession.createDataFrame([(m,) for m in markets], "market string")
    full = every.join(found, "market", "left").withColumn("sample_count", F.coalesce("n", F.lit(0)))
    ok = F.col("sample_count") >= least
    return full.select("market", "sample_count", half_up(F.when(ok, F.col("mean")), 4).alias("score"), F.when(ok, "ok").otherwise("insufficient").alias("status"))
