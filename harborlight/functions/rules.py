"""Row-wise rule classifiers: market relevance, event types and grades, radar rules, driver categories."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relevance_terms as terms_of
from .numbers import half_up


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once for each row, however often ``make`` uses it."""
    return F.transform(F.array(value), make)[0]


_CJK = "一-鿿"


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{_CJK}]")


def any_term(text: Column, terms: Iterable[str], cjk: Column | None = None) -> Column:
    """Whether the text contains any of the terms; ``cjk``: whether it has any CJK character, where that is known."""
    terms = list(terms)
    wide = [t for t in terms if re.search(f"[{_CJK}]", t)] if cjk is not None or len(terms) > 16 else []
    out = F.lit(False)
    for t in terms:
        if t not in wide:
            out = out | F.contains(text, F.lit(t))
    if wide:
        out = out | ((cjk if cjk is not None else F.lit(True)) & text.rlike("|".join(map(re.escape, wide))))
    return out


def words_of(text: Column, terms: Iterable[str]) -> Column:
    """Which of the terms a lower-case text has as whole runs of Latin letters and digits, in order; other terms never fit."""
    heads: dict[str, list[str]] = {}
    for t in sorted({t for t in terms if re.fullmatch("[a-z0-9]+", t)}):
        heads.setdefault(t[0], []).append(t[1:])
    if not heads:
        return F.array().cast("array<string>")
    every = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in heads.items())
    return F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9])({every})(?![a-z0-9])"), 1)


def any_word(words: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    return F.arrays_overlap(words, F.array(*map(F.lit, terms))) if terms else F.lit(False)


_any_term = any_term


@dataclass(frozen=True)
class RelevanceTerms:
    """Term lists of the relevance cascade."""

    strong: tuple[str, ...] = terms_of.STRONG
    weak: tuple[str, ...] = terms_of.WEAK
    phrases: tuple[str, ...] = terms_of.PHRASES
    sector_triggers: tuple[str, ...] = terms_of.SECTOR_TRIGGERS
    chinese: tuple[str, ...] = terms_of.MONETARY + terms_of.MACRO + terms_of.REGULATORS + terms_of.TRADE + terms_of.CORPORATE + terms_of.COMMODITIES + terms_of.MARKET_MOVES
    recall_friends: tuple[str, ...] = terms_of.RECALL_FRIENDS
    broad: tuple[str, ...] = terms_of.BROAD
    us_context: tuple[str, ...] = terms_of.US_CONTEXT
    digest_titles: tuple[str, ...] = terms_of.DIGEST_TITLES
    acronyms: tuple[str, ...] = terms_of.ACRONYMS
    geo_actions: tuple[str, ...] = terms_of.GEO_ACTIONS
    energy_carriers: tuple[str, ...] = terms_of.CARRIERS
    status_changes: tuple[str, ...] = terms_of.STATUS_CHANGES
    status_carriers: tuple[str, ...] = terms_of.CARRIERS + terms_of.MORE_CARRIERS
    noise: tuple[str, ...] = terms_of.NOISE
    shipping_routes: tuple[str, ...] = terms_of.SHIPPING_ROUTES
    shipping_disruptions: tuple[str, ...] = terms_of.SHIPPING_DISRUPTIONS
    taiwan: tuple[str, ...] = terms_of.TAIWAN
    arms: tuple[str, ...] = terms_of.ARMS
    iran: tuple[str, ...] = terms_of.IRAN
    military: tuple[str, ...] = terms_of.MILITARY
    war_powers: tuple[str, ...] = terms_of.WAR_POWERS
    concepts: tuple[str, ...] = terms_of.CONCEPTS
    moves: tuple[str, ...] = terms_of.MOVES
    generic_tech: tuple[str, ...] = terms_of.GENERIC_TECH
    sectors: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=lambda: dict(terms_of.SECTORS))
    anchor_phrases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(terms_of.ANCHOR_PHRASES))


#: Reasons that do not pass the ingest gate alone.
WEAK_REASONS = ("concept_mover", "sector_signal_term")


def relevance(title: Column, summary: Column, body: Column, terms: RelevanceTerms = RelevanceTerms()) -> Column:  # noqa: B008
    """struct<relevant, reason, sectors>: the first rule of the ordered cascade that fits.

    Strong signals come first, then sector rules; noise rejects only what no strong signal has claimed.
    """
    raw = F.concat_ws(" ", title, summary, body)
    # All words that any rule asks for are found in one pass.
    every = [*terms.strong, *terms.weak, *terms.acronyms, *terms.shipping_routes, *terms.sector_triggers, *terms.generic_tech, *(w for anchors, _ in terms.sectors.values() for w in anchors)]
    texts = F.struct(title.alias("title"), raw.alias("raw"), F.lower(raw).alias("text"))
    found = lambda x: F.struct(x["title"].alias("title"), x["raw"].alias("raw"), x["text"].alias("text"), words_of(x["text"], every).alias("words"), has_cjk(x["text"]).alias("cjk"))
    return bound(bound(texts, found), lambda x: _cascade(x["title"], x["raw"], x["text"], x["words"], x["cjk"], terms))


def _cascade(title: Column, raw: Column, text: Column, words: Column, cjk: Column, terms: RelevanceTerms) -> Column:
    def any_term(of: Column, some: Iterable[str]) -> Column:
        return _any_term(of, some, cjk)

    def in_sector(name: str) -> Column:
        anchors, near = terms.sectors[name]
        return (any_word(words, anchors) | any_term(text, terms.anchor_phrases.get(name, ()))) & any_term(text, near)

    sector = F.lit(False)
    for name in terms.sectors:
        sector = sector | in_sector(name)
    alias_text = F.when(any_term(title, terms.digest_titles), F.lower(title)).otherwise(text)
    broad = (F.contains(alias_text, F.lit("美股")) & any_term(alias_text, terms.us_context)) | any_term(alias_text, terms.broad)
    chinese = broad | any_term(text, [t for t in terms.chinese if t != "召回"])
    if "召回" in terms.chinese:
        chinese = chinese | (F.contains(text, F.lit("召回")) & ~any_term(text, terms.recall_friends))
    steps = [
        (any_word(words, terms.strong), "market_signal_term"),
        (any_word(words, terms.weak) & sector, "sector_signal_term"),
        (any_term(text, terms.phrases), "market_signal_phrase"),
        (chinese, "chinese_market_phrase"),
        (any_word(words, terms.acronyms), "macro_acronym"),
        (any_word(words, terms.shipping_routes) & any_term(text, terms.shipping_disruptions), "shipping_disruption"),
        (any_term(text, terms.geo_actions) & any_term(text, terms.energy_carriers), "geo_energy_shipping"),
        (any_term(text, terms.status_changes) & any_term(text, terms.status_carriers), "shipping_status_change"),
        (any_term(raw, terms.taiwan) & any_term(raw, terms.arms), "taiwan_arms_sale"),
        (any_term(raw, terms.iran) & any_term(raw, terms.military) & any_term(raw, terms.war_powers), "iran_war_powers"),
        ((any_word(words, terms.sector_triggers) | any_term(text, ("export controls", "supply chain"))) & sector, "sector_signal"),
        (any_term(text, terms.noise), "chinese_noise"),
        (any_term(raw, terms.concepts) & any_term(raw, terms.moves), "concept_mover"),
        (any_word(words, terms.generic_tech), "generic_tech"),
    ]
    reason = F.lit(None).cast("string")
    for test, name in reversed(steps):
        reason = F.when(test, name).otherwise(reason)
    sectors = F.array_compact(F.array(*(F.when(in_sector(name), F.lit(name)) for name in terms.sectors)))
    relevant = lambda why: why.isNotNull() & ~F.coalesce(why.isin("chinese_noise", "generic_tech"), F.lit(False))
    return bound(F.struct(reason.alias("reason"), sectors.alias("sectors")), lambda y: F.struct(relevant(y["reason"]).alias("relevant"), y["reason"].alias("reason"), y["sectors"].alias("sectors")))


def ingest_gate(is_official: Column, has_stock_refs: Column, verdict: Column) -> Column:
    """struct<passed, reason>: official sources and items with stock references pass; weak reasons alone do not."""
    made = lambda passed, reason: F.struct(F.lit(passed).alias("passed"), reason.alias("reason"))
    judged = lambda v: (
        F.when(~v["relevant"], made(False, F.concat(F.lit("no_market_signal:"), F.coalesce(v["reason"], F.lit("none")))))
        .when(v["reason"].isin(*WEAK_REASONS), made(False, F.concat(F.lit("weak_signal:"), v["reason"])))
        .otherwise(made(True, F.concat(F.lit("market_signal:"), v["reason"])))
    )
    return F.when(is_official, made(True, F.lit("official_source"))).when(has_stock_refs, made(True, F.lit("structured_stock_refs"))).otherwise(bound(verdict, judged))


# Event types by the first keyword that a title has.
HARD_EVENTS = (
    ("年报", "periodic_report"), ("半年报", "periodic_report"), ("季报", "periodic_report"), ("业绩预告", "earnings_preview"), ("业绩快报", "earnings_flash"), ("回购", "buyback"), ("增持", "insider_increase"), ("减持", "insider_decrease"),
    ("问询函", "inquiry"), ("重组", "m_and_a"), ("并购", "m_and_a"), ("诉讼", "litigation"), ("扩产", "capacity"), ("股权激励", "incentive"), ("大额订单", "order"),
)
# Sources of each evidence grade, tried in this order.
GRADE_SOURCES = (
    ("A", ("巨潮", "cninfo", "sse.com", "szse.cn", "bse.cn", "上交所", "深交所", "北交所")),
    ("D", ("雪球", "微博", "weibo", "xueqiu", "twitter", "自媒体", "股吧")),
    ("B", ("公司公告", "ir", "人民政府", "行业协会")),
)
# Radar rules as (tag, keywords, weight); the first that fits counts.
RADAR_RULES = (
    ("tariff", ("tariff", "duties"), 34.0), ("export_control", ("export control", "export controls"), 28.0), ("rate", ("rate cut", "rates", "yield", "cpi", "inflation"), 24.0), ("fed", ("fed", "fomc", "powell"), 22.0),
)


def hard_event(title: Column, summary: Column) -> Column:
    text = F.concat_ws(" ", title, summary)
    out = F.lit("general")
    for word, kind in reversed(HARD_EVENTS):
        out = F.when(F.contains(text, F.lit(word)), kind).otherwise(out)
    return out


def evidence_grade(source: Column, url: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", source, url))
    out = F.lit("C")
    for grade, words in reversed(GRADE_SOURCES):
        out = F.when(any_term(blob, words), grade).otherwise(out)
    return out


def propose_state(grade: Column, novelty: Column, materiality: Column, quality: Column, gap: Column) -> Column:
    return F.when((grade != "D") & (novelty * materiality * quality * gap >= 0.45) & grade.isin("A", "B"), "validating").otherwise("discovered")


def radar_rule(text: Column) -> Column:
    """struct<tag, weight> of the first rule that fits, else null."""
    low = F.lower(text)
    out = F.lit(None)
    for tag, words, weight in reversed(RADAR_RULES):
        out = F.when(any_term(low, words), F.struct(F.lit(tag).alias("tag"), F.lit(weight).alias("weight"))).otherwise(out)
    return out


def account_weight(tier: Column, priority: Column) -> Column:
    bonus = F.when(tier == "core", 40.0).when(tier == "watch", 22.0).when(tier == "muted", 0.0).otherwise(10.0)
    return bonus + F.least(F.greatest(priority, F.lit(0)), F.lit(100)) * 0.2


def radar_signals(posts: DataFrame) -> DataFrame:
    """Signals of posts (post_id, account_id, tier, priority, text, symbol, posted_at): account, macro and resonance signals."""
    p = posts.withColumn("w", account_weight(F.col("tier"), F.col("priority"))).withColumn("rule", radar_rule(F.col("text")))
    has = F.col("symbol").isNotNull()
    common = [F.col("post_id"), F.lit(1).cast("long").alias("source_count")]
    account = p.select(F.lit("account_post").alias("signal_type"), F.lit(None).cast("string").alias("tag"), half_up(F.col("w") + F.when(has, 8.0).otherwise(0.0), 4).alias("priority_score"), F.lit(0.62).alias("confidence"), *common)
    matched = p.where("rule is not null")
    macro = matched.select(F.lit("macro_event").alias("signal_type"), "rule.tag", half_up(F.col("w") + F.col("rule.weight") + F.when(has, 10.0).otherwise(0.0), 4).alias("priority_score"), F.lit(0.82).alias("confidence"), *common)
    tags = matched.groupBy("rule.tag", "rule.weight").agg(F.count_distinct("account_id").alias("n"), F.min("post_id").alias("post_id")).where("n >= 2")
    resonance = tags.select(F.lit("multi_account_resonance").alias("signal_type"), "tag", half_up(F.col("weight") + 60 + 4 * F.col("n"), 4).alias("priority_score"), F.lit(0.9).alias("confidence"), "post_id", F.col("n").alias("source_count"))
    return account.unionByName(macro).unionByName(resonance)


def driver_action(category: Column, age_days: Column) -> Column:
    """How soon to act on a driver of a category."""
    return (
        F.when(category.isin("policy_macro", "company_action"), F.when(age_days <= 7, "act_now").otherwise("watch_today")).when(category == "supply_chain", "watch_today")
        .when(category == "price_action", F.when(age_days <= 3, "watch_today").otherwise("know_only")).otherwise("know_only")
    )


def page_quality(text: Column, blocked: tuple[str, ...] = ("access denied", "captcha", "enable javascript", "403 forbidden"), least: int = 200) -> Column:
    """Why an extracted text is no article; null if it may be one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) == 0, "empty").when(any_term(low, blocked), "blocked").when(F.length(low) < least, "too_short")
