"""News feeds: pages, search, mentions, topics, event cards, editorial order, near-duplicate headlines."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import decayed, half_up
from ..functions.text import comparison_tokens, hamming, numeric_fingerprint, overlap, simhash64, title_tokens
from .staging import staged

# Event types by the first group that a text has a word of.
EVENT_PATTERNS = {
    "earnings": "earnings revenue guidance results profit 财报 营收 业绩 盈利 季度 年报 季报".split(),
    "macro": "inflation rate fed ecb cpi gdp jobs 宏观 通胀 降息 加息 利率 就业 非农".split(),
    "regulation": "sec regulator antitrust tariff approval filing policy 监管 反垄断 关税 审批 备案 政策 处罚 制裁 合规".split(),
    "product": "launch release model chip product platform 发布 新品 上线 芯片 产品 型号 旗舰".split(),
    "mna": "acquire merger deal acquisition stake buyout 收购 并购 合并 入股 注资 重组 要约".split(),
    "supply_chain": "supplier demand shipment shipments order orders capacity factory 供应链 产能 出货 订单 需求 交付 工厂 扩产".split(),
    "market_move": "rally selloff surge slump jump drop 大涨 大跌 暴涨 暴跌 飙升 跳水 异动 拉升 杀跌".split(),
}
# Words, and whole words, of a source name that mark an official source.
OFFICIAL_HINTS = ["ministry", "regulator", "exchange", "authority", "department", "edgar", "investor", "earnings", "federal reserve", "central bank", "港交所", "证监会", "公告", "财报", "上交所", "深交所"]
OFFICIAL_WORDS = ["ir", "sec", "fed", "boe", "sfc", "fda", "ecb", "csrc", "hkex", "8-k", "10-k", "10-q"]
# Weights of the editorial score.
WEIGHTS = {"topic": 0.4, "source": 0.25, "freshness": 0.2, "mention": 0.15, "official": 0.1}
# Weight of a source by its tier, and the greatest of them.
TIER_WEIGHTS = {"primary": 1.2, "secondary": 1.0, "fallback": 0.7}


def page(news: DataFrame, size: int, market: str | None = None, source: str | None = None, label: str | None = None, after: tuple | None = None) -> DataFrame:
    """A page of the feed, newest first, with one row more to show that there are others; ``after``: (time, id) of the last row seen."""
    for column, value in (("market", market), ("source_name", source), ("sentiment_label", label)):
        if value is not None:
            news = news.where(F.col(column) == value)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        news = news.where((F.col("effective_at") < at) | ((F.col("effective_at") == at) & (F.col("news_id") < last)))
    return news.orderBy(F.col("effective_at").desc(), F.col("news_id").desc()).limit(size + 1)


def search(news: DataFrame, terms: list[str]) -> DataFrame:
    """News with all terms as whole words; if there is none, those with the whole phrase in title or summary."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    words = F.split(text, r"[^\p{L}\p{N}]+")
    exact = news.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(words, t)))
    phrase = " ".join(terms)
    loose = news.where(F.contains(F.lower("title"), F.lit(phrase)) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lit(phrase)))
    found = exact.select(F.lit(1).alias("one")).limit(1)
    return exact.union(loose.join(F.broadcast(found), F.lit(True), "left_anti"))


def topic_stats(links: DataFrame, news: DataFrame) -> DataFrame:
    """Mean score, size, last seen and importance of each topic."""
    a = links.join(news.select("news_id", "sentiment_score", "effective_at"), "news_id").groupBy("topic_id").agg(half_up(F.avg("sentiment_score"), 4).alias("score"), F.max("effective_at").alias("last_seen_at"), F.count("*").alias("news_count"))
    return a.withColumn("importance", half_up(F.least(F.lit(1.0), 0.35 + 0.15 * F.col("news_count") + F.least(F.abs("score"), F.lit(0.4))), 4))


def topic_label(score: Column) -> Column:
    return F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")


def topic_symbols(links: DataFrame, mentions: DataFrame, k: int | None = 5) -> DataFrame:
    """How often each topic's news mention each symbol; the first k by (count desc, symbol)."""
    counts = links.join(mentions.select("news_id", "symbol"), "news_id").groupBy("topic_id", "symbol").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("n").desc(), "symbol")))
    return ranked.where(F.col("rank") <= k) if k else ranked


def topic_news(links: DataFrame, news: DataFrame, k: int = 3) -> DataFrame:
    """The newest k news of each topic."""
    w = Window.partitionBy("topic_id").orderBy(F.col("effective_at").desc(), F.col("fetched_at").desc(), F.col("news_id").desc())
    return links.join(news, "news_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_topic(links: DataFrame, stats: DataFrame) -> DataFrame:
    """The most important topic of each news item; the latest, then the greatest id, on ties."""
    return links.join(stats, "topic_id").groupBy("news_id").agg(F.max_by(F.struct("topic_id", "importance"), F.struct("importance", "last_seen_at", "topic_id")).alias("t")).select("news_id", "t.*")


def event_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("general")
    for name, words in reversed(EVENT_PATTERNS.items()):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def official(source: Column) -> Column:
    low = F.lower(source)
    return low.rlike("|".join(OFFICIAL_HINTS)) | low.rlike("(?<![a-z0-9])(" + "|".join(OFFICIAL_WORDS) + ")(?![a-z0-9])")


def source_tier(source: Column) -> Column:
    """Tier of a source by its number, for sources without a registry entry."""
    n = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int") % 3
    return F.when(n == 0, "primary").when(n == 1, "secondary").otherwise("fallback")


def event_cards(links: DataFrame, news: DataFrame, mentions: DataFrame, now: Column) -> DataFrame:
    """One card for each topic that qualifies: important, of several news, or about a symbol."""
    stats = topic_stats(links, news)
    heads = topic_news(links, news, 3).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "news_id", "title", "source_name"))).alias("items"))
    symbols = topic_symbols(links, mentions).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))) / 3.6e9
    cards = stats.join(heads, "topic_id").join(symbols, "topic_id", "left")
    cards = cards.where((F.col("importance") >= 0.55) | (F.col("news_count") >= 2) | (F.size(F.coalesce("symbols", F.array().cast("array<string>"))) > 0))
    return cards.select(
        "topic_id", F.col("items")[0]["title"].alias("event_title"), event_type(F.array_join(F.transform("items", lambda x: x["title"]), " ")).alias("event_type"), topic_label(F.col("score")).alias("sentiment_label"),
        decayed(F.col("importance"), hours).alias("importance"), "last_seen_at", "news_count", F.size(F.array_distinct(F.transform("items", lambda x: x["source_name"]))).alias("source_count"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"),
        F.transform("items", lambda x: x["news_id"]).alias("news_ids"),
    )


def _rarest(cards: DataFrame, values: str, kept: Column, mark: str) -> DataFrame:
    """topic_id, event_type and key: the ``kept`` rarest values of each card, by how many cards have them."""
    each = cards.select("topic_id", "event_type", kept.alias("kept"), F.explode(values).alias("value"))
    ranked = each.join(each.groupBy("value").agg(F.count("*").alias("n")), "value")
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("topic_id", "event_type").orderBy("n", "value")))
    return ranked.where("at <= kept").select("topic_id", "event_type", F.concat(F.lit(mark), "value").alias("key"))


def fusable(cards: DataFrame) -> DataFrame:
    """Pairs of cards (a < b) of one type that share a first symbol, two symbols, or half of their title words.

    Pairs come from equal keys, and common words and symbols are no keys where rarer ones must be shared too:
    cards with half of their words (two of their symbols) in common share one of the rarest half and one more
    of each card's words (one of all its symbols but the most common).
    """
    c = cards.where("event_type <> 'general'").select("topic_id", "event_type", "symbols", F.element_at(F.when(F.size("symbols") > 0, F.col("symbols")), 1).alias("first"), F.array_distinct(comparison_tokens(F.col("event_title"))).alias("words"))
    words = _rarest(c, "words", F.size("words") - F.ceil(F.size("words") / 2) + 1, "w:")
    both = _rarest(c.withColumn("symbols", F.array_distinct("symbols")), "symbols", F.size("symbols") - 1, "s:")
    first = c.where("first IS NOT NULL").select("topic_id", "event_type", F.concat(F.lit("f:"), "first").alias("key"))
    keys = words.union(both).union(first)
    near = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.event_type") == F.col("b.event_type")) & (F.col("a.topic_id") < F.col("b.topic_id")))
    near = near.select(F.col("a.topic_id").alias("a_id"), F.col("b.topic_id").alias("b_id"), F.col("a.event_type").alias("event_type")).distinct()
    side = lambda x: c.select(F.col("topic_id").alias(f"{x}_id"), "event_type", F.struct("symbols", "first", "words").alias(x))
    pairs = near.join(side("a"), ["a_id", "event_type"]).join(side("b"), ["b_id", "event_type"])
    alike = (F.coalesce(F.col("a.first") == F.col("b.first"), F.lit(False))) | (F.size(F.array_intersect("a.symbols", "b.symbols")) >= 2) | (overlap(F.col("a.words"), F.col("b.words")) >= 0.5)
    return pairs.where(alike).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "event_type").distinct()


def editorial(news: DataFrame, best: DataFrame, mentioned: DataFrame, now: Column) -> DataFrame:
    """News with editorial score: topic importance, source tier, freshness, mentions and official sources."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce("published_at", "fetched_at").cast("timestamp"))) / 3.6e9
    tier = source_tier(F.col("source_name"))
    weight = F.when(tier == "primary", TIER_WEIGHTS["primary"]).when(tier == "secondary", TIER_WEIGHTS["secondary"]).otherwise(TIER_WEIGHTS["fallback"])
    topics_with = mentioned.select("topic_id").distinct().withColumn("has", F.lit(True))
    rows = news.join(best.join(topics_with, "topic_id", "left"), "news_id", "left")
    score = (
        F.coalesce("importance", F.lit(0.0)) * WEIGHTS["topic"] + weight / 1.2 * WEIGHTS["source"] + decayed(F.lit(1.0), hours) * WEIGHTS["freshness"]
        + F.when(F.col("has"), WEIGHTS["mention"]).otherwise(0.0) + F.when(official(F.col("source_name")), WEIGHTS["official"]).otherwise(0.0)
    )
    return rows.select("news_id", "topic_id", half_up(score, 4).alias("editorial_score"))


def priority_order(news: DataFrame, now: Column) -> DataFrame:
    """Rank of each item: tier, official, age in hours, title, source."""
    tier = source_tier(F.col("source_name"))
    rank = F.when(tier == "primary", 3).when(tier == "secondary", 2).otherwise(1)
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("effective_at").cast("timestamp"))) / 3.6e9)
    return news.withColumn("tier_rank", rank).withColumn("official", official(F.col("source_name"))).withColumn("age", age).orderBy(F.col("tier_rank").desc(), F.col("official").desc(), "age", F.lower("title"), F.lower("source_name"), "news_id")


def _dealt(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: what Spark takes for the size of exploded rows and of well packed staged files is far
    below what they take in the driver's memory."""
    return side.hint("merge")


def _near_groups(groups: DataFrame, gray: int) -> DataFrame:
    """Pairs of groups (bucket, h and others) in one or neighbouring buckets whose hashes are at most ``gray`` bits apart, both
    ways and with themselves: the columns of each as a_.. and b_.., and distance.

    Candidates share two blocks of the SimHash: of ``gray`` + 2 blocks, hashes at most ``gray`` bits apart
    agree in two, so the join is on equal (time bucket, pair of blocks) keys of 16 bits and loses no pair.
    """
    blocks = gray + 2
    width = 64 // blocks + (64 % blocks > 0)
    block = lambda i: F.shiftrightunsigned("h", i * width).bitwiseAND((1 << width) - 1)
    keys = F.array(*(F.struct(F.lit(n).alias("n"), F.shiftleft(block(i), width).bitwiseOR(block(j)).alias("v")) for n, (i, j) in enumerate(combinations(range(blocks), 2))))
    keyed = groups.withColumn("block", F.explode(keys))
    right = keyed.withColumns({"near": F.col("bucket"), "bucket": F.explode(F.array("bucket", F.col("bucket") - 1))})
    a, b = keyed.alias("a"), _dealt(right.alias("b"))
    distance = hamming(F.col("a.h"), F.col("b.h"))
    alike = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.block") == F.col("b.block"))).where(distance <= gray)
    one = [F.col(f"a.{c}").alias(c) for c in groups.columns]
    other = [F.col(f"b.{'near' if c == 'bucket' else c}").alias(c) for c in groups.columns]
    alike = alike.select(F.struct(*one).alias("one"), F.struct(*other).alias("other"), distance.alias("distance")).distinct()
    # Groups of neighbouring buckets met with the earlier one first only; here they get their other order.
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    ways = F.when(F.col("one.bucket") == F.col("other.bucket"), F.array(way("one", "other"))).otherwise(F.array(way("one", "other"), way("other", "one")))
    both = alike.select(F.explode(ways).alias("w"), "distance")
    return both.select(*(F.col(f"w.{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in groups.columns), "distance")


def _hashed_titles(news: DataFrame, span: int) -> DataFrame:
    """news_id, numbers, time, time bucket and SimHash of the headlines of four tokens or more; written, as they are used several times."""
    t = F.unix_micros(F.col("effective_at").cast("timestamp"))
    rows = news.where(F.size(title_tokens(F.col("title"))) >= 4).select("news_id", numeric_fingerprint(F.col("title")).alias("numbers"), t.alias("t"), F.floor(t / span).alias("bucket"), simhash64(F.col("title")).alias("h"))
    return staged(rows, "title-hashes")


def near_titles(news: DataFrame, minutes: int = 60, duplicate: int = 3, gray: int = 6) -> DataFrame:
    """Pairs (a earlier id) of headlines at most ``minutes`` apart that look alike.

    Headlines of one hash and bucket are one group: only groups are dealt by keys and held against each other.  All
    pairs of copies are listed; ``near_title_links`` counts them instead.
    """
    span = minutes * 60_000_000
    rows = _hashed_titles(news, span)
    alike = _near_groups(rows.select("bucket", "h").distinct(), gray)
    side = lambda x: rows.select(F.col("bucket").alias(f"{x}_bucket"), F.col("h").alias(f"{x}_h"), F.col("news_id").alias(x), F.col("t").alias(f"{x}_t"), F.col("numbers").alias(f"{x}_numbers"))
    pairs = alike.join(_dealt(side("a")), ["a_bucket", "a_h"]).join(_dealt(side("b")), ["b_bucket", "b_h"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("a_t") - F.col("b_t")) <= span))
    return pairs.select("a", "b", "distance", (F.col("a_numbers") != F.col("b_numbers")).alias("contradict"), (F.col("distance") <= duplicate).alias("duplicate"))


def near_title_links(news: DataFrame, minutes: int = 60, duplicate: int = 3, gray: int = 6) -> DataFrame:
    """Each headline with its class (same hash and numbers; its least news_id), and for each class that it has links to, and
    its own in any case, n_links: the other headlines of that class at most ``minutes`` from it.

    No pair of headlines is formed.  Rows of one bucket are all within ``minutes`` of each other; of a neighbouring bucket
    those are whose place in the bucket is not past the headline's, which is a running count over both classes' times.
    """
    span = minutes * 60_000_000
    rows = _hashed_titles(news, span)
    classes = rows.groupBy("h", "numbers").agg(F.min("news_id").alias("class_id"))
    rows = staged(rows.join(_dealt(classes), ["h", "numbers"]).select("news_id", "class_id", "bucket", "t", "h", "numbers"), "title-classes")
    times = staged(rows.groupBy("bucket", "class_id", "t").agg(F.count("*").alias("n")), "title-times")
    alike = staged(_near_groups(rows.select("bucket", "class_id", "h").distinct(), gray).drop("a_h", "b_h"), "title-groups")
    side = lambda x: times.select(F.col("bucket").alias(f"{x}_bucket"), F.col("class_id").alias(f"{x}_class_id"), "t", "n")
    pair = ["a_bucket", "a_class_id", "b_bucket", "b_class_id"]
    here = alike.where("a_bucket = b_bucket").join(_dealt(side("b").groupBy("b_bucket", "b_class_id").agg(F.sum("n").alias("n"))), ["b_bucket", "b_class_id"]).join(_dealt(side("a").drop("n")), ["a_bucket", "a_class_id"])
    beside = alike.where("a_bucket <> b_bucket")
    place = ((F.col("b_bucket") - F.col("a_bucket")) * F.pmod("t", F.lit(span))).alias("place")
    asks = beside.join(_dealt(side("a")), ["a_bucket", "a_class_id"]).select(*pair, "distance", place, "t", F.lit(0).cast("long").alias("n"))
    has = beside.join(_dealt(side("b")), ["b_bucket", "b_class_id"]).select(*pair, "distance", place, F.lit(None).cast("long").alias("t"), "n")
    upto = Window.partitionBy(*pair).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asks.union(has).withColumn("n", F.sum("n").over(upto)).where("t is not null and n > 0")
    wanted = ["a_bucket", "a_class_id", "b_class_id", "distance", "t", "n"]
    links = here.select(*wanted).union(counted.select(*wanted)).groupBy(F.col("a_bucket").alias("bucket"), F.col("a_class_id").alias("class_id"), "t", F.col("b_class_id").alias("with_class"), "distance").agg(F.sum("n").alias("n"))
    numbers = rows.where("news_id = class_id").select("class_id", "numbers")
    others = links.where("class_id <> with_class").select("class_id", "with_class").distinct().join(_dealt(numbers.withColumnRenamed("numbers", "__own")), "class_id").join(_dealt(numbers.select(F.col("class_id").alias("with_class"), F.col("numbers").alias("__other"))), "with_class")
    contradict = others.select("class_id", "with_class", (F.col("__own") != F.col("__other")).alias("contradict"))
    links = links.join(_dealt(contradict), ["class_id", "with_class"], "left")
    out = rows.select("news_id", "class_id", "bucket", "t").join(_dealt(links), ["bucket", "class_id", "t"])
    own = (F.col("class_id") == F.col("with_class")).cast("long")
    return out.select("news_id", "class_id", "with_class", "distance", F.coalesce("contradict", F.lit(False)).alias("contradict"), (F.col("distance") <= duplicate).alias("duplicate"), (F.col("n") - own).alias("n_links"))
