"""Readable names of topics, structured takeaways, ratings and horizons, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns and synonyms that results must carry as they stand.
TOPIC_ALIASES = {
    "ai": "人工智能", "artificial": "人工智能", "intelligence": "人工智能", "chip": "芯片", "chips": "芯片", "semiconductor": "半导体", "semiconductors": "半导体",
    "earnings": "财报", "revenue": "营收", "guidance": "指引", "regulation": "监管", "regulatory": "监管", "policy": "政策", "tariff": "关税", "merger": "并购",
    "acquisition": "收购", "ipo": "上市", "fed": "美联储", "rate": "利率", "rates": "利率", "inflation": "通胀", "oil": "原油", "energy": "能源", "cloud": "云计算",
    "supply": "供应", "demand": "需求", "shipment": "出货", "shipments": "出货", "orders": "订单", "nvidia": "英伟达", "apple": "苹果", "tesla": "特斯拉",
    "tencent": "腾讯", "alibaba": "阿里巴巴",
}
EVENTS = {
    "上调业绩指引": ("guidance", "raises guidance", "lifts outlook", "上调指引", "上调业绩"),
    "发布财报": ("earnings", "results", "财报", "业绩", "营收"),
    "监管披露": ("filing", "8-k", "10-k", "sec", "监管", "披露", "公告"),
    "加息/利率表态": ("fed", "rates", "interest rate", "加息", "降息", "利率"),
    "关税/贸易政策": ("tariff", "export controls", "关税", "出口管制"),
    "并购重组": ("acquisition", "merger", "收购", "并购"),
    "供应扰动": ("supply", "shortage", "出货", "供应", "断供"),
    "需求变化": ("demand", "orders", "需求", "订单"),
}
NO_EVENT = "出现市场相关进展"
IMPACTS = {
    "AI算力链": ("ai", "gpu", "accelerator", "人工智能", "算力"),
    "半导体板块": ("chip", "semiconductor", "wafer", "芯片", "半导体"),
    "苹果供应链": ("apple", "iphone", "supplier", "苹果", "供应链"),
    "利率敏感资产": ("fed", "rates", "bond", "利率", "债市"),
    "相关上市公司": ("stock", "shares", "股价", "上市"),
}
NO_IMPACT, NO_SUBJECT, NO_TOPIC = "相关板块", "相关主体", "市场动态"
UNSPECIFIC_ALIASES = ("指引", "营收")
ENTITIES = ("nvidia", "apple", "tesla", "tencent", "alibaba", "fed", "sec", "英伟达", "苹果", "特斯拉", "腾讯", "阿里", "美联储")
ARTICLES = ("the", "a", "an", "on", "of", "and", "for")
RATINGS = ("strong_bullish", "bullish", "neutral", "bearish", "strong_bearish", "unknown")
RATING_SYNONYMS = {
    "positive": "bullish", "buy": "bullish", "bull": "bullish", "overweight": "bullish", "看多": "bullish", "偏多": "bullish", "增持": "bullish",
    "strong_buy": "strong_bullish", "strong buy": "strong_bullish", "negative": "bearish", "sell": "bearish", "bear": "bearish", "underweight": "bearish",
    "看空": "bearish", "偏空": "bearish", "减持": "bearish", "strong_sell": "strong_bearish", "strong sell": "strong_bearish", "hold": "neutral", "neutral": "neutral",
    "中性": "neutral", "观望": "neutral",
}

CJK = "[一-鿿]"
_STRINGS = "array<string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def alias(token: Column) -> Column:
    """The Chinese name of a word, null if it has none."""
    return _lookup(TOPIC_ALIASES, F.lower(F.trim(token)))


def _topic_tokens(topic_key: Column, keywords: Column) -> Column:
    words = F.concat(F.coalesce(keywords, F.array().cast(_STRINGS)), F.split(F.replace(F.coalesce(topic_key, F.lit("")), F.lit("-"), F.lit(" ")), r"\s+"))
    return F.filter(F.transform(words, F.trim), lambda w: w != "")


def topic_name(topic_key: Column, title: Column, keywords: Column) -> Column:
    """A title with Chinese stays; else up to three different aliases of keywords and key words; else title, key or a fixed name."""
    plain = F.trim(F.coalesce(title, F.lit("")))
    named = F.transform(_topic_tokens(topic_key, keywords), lambda w: F.coalesce(alias(w), F.when(w.rlike(CJK), w)))
    parts = F.array_join(F.slice(F.array_distinct(F.filter(named, lambda w: w.isNotNull())), 1, 3), "")
    return F.when(plain.rlike(CJK), plain).when(parts != "", parts).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.nullif(topic_key, F.lit("")), F.lit(NO_TOPIC)))


def first_alias(topic_key: Column, keywords: Column) -> Column:
    """The alias of the first keyword, or word of the key, that has one."""
    return F.get(F.filter(F.transform(_topic_tokens(topic_key, keywords), alias), lambda w: w.isNotNull()), F.lit(0))


def _first_label(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(text.rlike("|".join(words)), label) for label, words in table.items()))


def takeaway(title: Column, summary: Column, keywords: Column) -> Column:
    """Subject, event and impact of a news item in one sentence, from fixed patterns, keywords and the title."""
    keywords = F.coalesce(keywords, F.array().cast(_STRINGS))
    parts = F.filter(F.array(title, summary, F.array_join(keywords, " ")), lambda x: x.isNotNull() & (x != ""))
    raw = F.array_join(parts, " ")
    text = F.lower(raw)
    words = F.slice(F.regexp_extract_all(F.substring_index(raw, "\n", 1), F.lit("([A-Za-z0-9一-鿿]+)"), 1), 1, 4)
    candidates = F.concat(F.filter(keywords, lambda w: w != ""), F.filter(words, lambda w: ~F.lower(w).isin(*ARTICLES)))
    word = F.get(candidates, F.lit(0))
    subject = F.coalesce(*(F.when(F.contains(text, F.lit(e)), TOPIC_ALIASES.get(e, e)) for e in ENTITIES), alias(word), word, F.lit(NO_SUBJECT))
    linked = F.filter(F.transform(keywords, lambda w: _lookup(TOPIC_ALIASES, F.lower(w))), lambda w: w.isNotNull() & ~w.isin(*UNSPECIFIC_ALIASES))
    impact = F.coalesce(_first_label(text, IMPACTS), F.concat(F.get(linked, F.lit(0)), F.lit("相关标的")), F.lit(NO_IMPACT))
    return F.concat(subject, F.lit("："), F.coalesce(_first_label(text, EVENTS), F.lit(NO_EVENT)), F.lit("，影响"), impact)


def rating(value: Column) -> Column:
    """A rating as one of RATINGS; unknown words are neutral."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(raw.isin(*RATINGS), raw).otherwise(F.coalesce(_lookup(RATING_SYNONYMS, raw), F.lit("neutral")))


def horizon_seconds(value: Column) -> Column:
    """Seconds of a horizon such as 30m, 4h or 1d; null if it is none."""
    parts = F.lower(F.trim(value))
    amount = F.regexp_extract(parts, r"^(\d+)[mhd]$", 1).try_cast("long")
    unit = F.when(F.endswith(parts, F.lit("m")), 60).when(F.endswith(parts, F.lit("h")), 3600).otherwise(86400)
    return F.when(amount > 0, amount * unit)
