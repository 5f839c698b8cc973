"""Queries whose result depends on the order of rows: the near-duplicate gate, new topics, fused event cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import comparison_tokens
from ..operators import news as news_ops
from ..operators import sequential
from ..sources import tables as t
from .common import query, r
from .news import _CARDS, _HASH, _TOK, _WORDS, now

_N = f"n AS ({t.NEWS_SQL})"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News as they come in, ten seconds apart, published up to half an hour before."""
    at = F.expr(f"timestamp_ntz'{t.EPOCH}'") + F.make_dt_interval(secs=(10 * F.col("news_id") - F.col("news_id") * 7919 % 1800).cast("decimal(18,6)"))
    return t.news(spark, sf_dir).select(F.col("news_id").alias("id"), "title", F.concat(F.lit("http://"), "source_name").alias("url"), at.alias("at"))


#: Items with the host and title as one key, and the hash of the title's tokens.
_ARRIVALS = f"""{_N}, a AS (SELECT news_id AS id, 10 * news_id - news_id * 7919 % 1800 AS at, {_TOK} AS tokens,
  source_name || '|' || nullif(trim(regexp_replace(lower(substr(title, 1, 500)), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '') AS signature FROM n),
bits AS (SELECT id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS w FROM (SELECT id, unnest({_HASH.format('tokens')}) AS h FROM a), (SELECT range::UBIGINT AS bit FROM range(64)) GROUP BY 1, 2),
hashes AS (SELECT id, bit_or(CASE WHEN w > 0 THEN (1::UBIGINT << bit) ELSE 0::UBIGINT END) AS h FROM bits GROUP BY 1),
x AS (SELECT a.*, len(tokens) AS k, coalesce(h, 0::UBIGINT) AS h FROM a LEFT JOIN hashes USING (id))"""
#: Keeps the rows of seq (rn, id, prior) one by one: those of which no prior row is kept.
_FOLD = """fold(rn, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT seq.rn, CASE WHEN len(list_intersect(kept, prior)) = 0 THEN list_append(kept, id) ELSE kept END FROM fold JOIN seq ON seq.rn = fold.rn + 1),
kept AS (SELECT unnest(arg_max(kept, rn)) AS id FROM fold)"""


@query(f"""WITH RECURSIVE {_ARRIVALS},
p AS (SELECT b.id, a.id AS a, coalesce(a.signature = b.signature, false) AS same FROM x a JOIN x b ON a.id < b.id AND abs(a.at - b.at) <= 3600 AND b.signature IS NOT NULL
  AND (coalesce(a.signature = b.signature, false) OR a.k >= 4 AND b.k >= 4 AND bit_count(xor(a.h, b.h)) <= 3)),
seq AS (SELECT row_number() OVER (ORDER BY id) AS rn, id, coalesce(prior, []) AS prior FROM x LEFT JOIN (SELECT id, list(a) AS prior FROM p GROUP BY id) USING (id)),
{_FOLD}, m AS (SELECT p.id, arg_min(a, (NOT same, a)) AS matched_id FROM p JOIN kept ON kept.id = p.a GROUP BY p.id)
SELECT id, kept.id IS NOT NULL AS kept, CASE WHEN kept.id IS NULL THEN matched_id END AS matched_id FROM x LEFT JOIN kept USING (id) LEFT JOIN m USING (id)""")
def gated_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals kept by the near-duplicate gate, or what they repeat: later ones match only what was kept (SET08, STR11, SNK01)."""
    return sequential.duplicate_gate(arrivals(spark, sf_dir))


_KEYWORDS = "list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z]{5,}')))[1:5]"


@query(f"""WITH RECURSIVE {_N}, x AS (SELECT news_id AS id, {_KEYWORDS} AS words, nullif(array_to_string({_KEYWORDS}[1:2], ' '), '') AS key FROM n),
p AS (SELECT b.id, a.id AS a, coalesce(a.key = b.key, false) AS same FROM x a JOIN x b ON a.id < b.id AND (coalesce(a.key = b.key, false) OR len(b.words) > 0 AND len(list_intersect(a.words, b.words)) >= least(2, len(b.words)))),
seq AS (SELECT row_number() OVER (ORDER BY id) AS rn, id, coalesce(prior, []) AS prior FROM x LEFT JOIN (SELECT id, list(a) AS prior FROM p GROUP BY id) USING (id)),
{_FOLD}, m AS (SELECT p.id, arg_min(a, (NOT same, a)) AS topic_id FROM p JOIN kept ON kept.id = p.a GROUP BY p.id)
SELECT x.id, CASE WHEN kept.id IS NULL THEN m.topic_id ELSE x.id END AS topic_id, kept.id IS NOT NULL AS created FROM x LEFT JOIN kept USING (id) LEFT JOIN m USING (id)""")
def created_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that items create or join, in order (SET03)."""
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{5,})"), 1))), 1, 5)
    rows = t.news(spark, sf_dir).select(F.col("news_id").alias("id"), words.alias("keywords"))
    return sequential.create_topics(rows.withColumn("topic_key", F.nullif(F.array_join(F.slice("keywords", 1, 2), " "), F.lit(""))))


_TYPES = ("earnings", "macro", "general", "product")


@query(f"""WITH RECURSIVE {_CARDS}, c AS (
  SELECT topic_id AS id, {list(_TYPES)}[topic_id % 4 + 1] AS et, symbols, symbols[1] AS prim, coalesce({_WORDS}, []) AS words, importance, row_number() OVER (PARTITION BY topic_id % 4 ORDER BY topic_id) AS k, count(*) OVER (PARTITION BY topic_id % 4) AS n FROM cards),
s(et, i, j, n, symbols, prim, words, done, hit) AS (
  SELECT et, k, k, n, symbols, prim, words, CAST([] AS BIGINT[]), false FROM c WHERE k = 1 AND et <> 'general'
  UNION ALL
  SELECT et, CASE WHEN turn THEN k ELSE i END, k, n, CASE WHEN turn THEN new WHEN hit THEN list_filter(symbols || new, lambda x, p: list_position(symbols || new, x) = p)[1:5] ELSE symbols END,
    CASE WHEN turn THEN newprim WHEN hit THEN coalesce(prim, newprim) ELSE prim END, CASE WHEN turn THEN newwords ELSE words END, CASE WHEN hit THEN list_append(done, k) ELSE done END, hit
  FROM (
    SELECT s.et, s.i, c.k, s.n, s.symbols, s.prim, s.words, s.done, c.symbols AS new, c.prim AS newprim, c.words AS newwords, s.j = s.n AS turn, s.j < s.n AND NOT list_contains(s.done, s.i) AND NOT list_contains(s.done, c.k) AND (
      coalesce(s.prim = c.prim, false) OR len(list_intersect(s.symbols, c.symbols)) >= 2 OR coalesce(len(list_intersect(s.words, c.words)) / nullif(len(list_distinct(s.words || c.words)), 0), 0) >= 0.5) AS hit
    FROM s JOIN c ON c.et = s.et AND c.k = CASE WHEN s.j < s.n THEN s.j ELSE s.i END + 1)),
h AS (SELECT et, i, j FROM s WHERE hit),
g AS (
  SELECT l.id AS leader, l.importance, l.symbols, list(m.id ORDER BY h.j) FILTER (m.id IS NOT NULL) AS ids, max(m.importance) AS most, flatten(list(m.symbols ORDER BY h.j) FILTER (m.id IS NOT NULL)) AS more
  FROM c l LEFT JOIN h ON h.et = l.et AND h.i = l.k LEFT JOIN c m ON m.et = h.et AND m.k = h.j
  WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.et = l.et AND x.j = l.k) GROUP BY l.id, l.importance, l.symbols)
SELECT leader, CAST(coalesce(len(ids), 0) + 1 AS INT) AS n_cards, repeat('fused-', coalesce(len(ids), 0)) || 'topic-' || leader || CASE WHEN len(ids) > 0 THEN '-' || array_to_string(list_transform(ids, lambda x: 'topic-' || x), '-') ELSE '' END AS event_key,
  {r('greatest(importance, coalesce(most, importance))', 4)} AS importance, array_to_string(list_filter(symbols || coalesce(more, []), lambda x, p: list_position(symbols || coalesce(more, []), x) = p)[1:5], ',') AS symbols FROM g""")
def fused_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event cards fused one after the other into earlier ones of their type (JN26, SET02, SET04)."""
    cards = news_ops.event_cards(t.topics(spark, sf_dir), t.news(spark, sf_dir), t.mentions(spark, sf_dir), now())
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("topic_id") % 4 + 1).cast("int"))
    cards = cards.select(
        F.col("topic_id").alias("id"), kind.alias("event_type"), F.get("symbols", F.lit(0)).alias("primary_symbol"), "symbols", F.array_distinct(comparison_tokens(F.col("event_title"))).alias("words"), "importance", "last_seen_at",
        F.transform("news_ids", lambda n: F.struct(F.col("last_seen_at").alias("effective_at"), n.alias("id"), n.cast("string").alias("source"))).alias("news"),
    )
    card = F.struct(F.concat(F.lit("topic-"), "id").alias("event_key"), "importance", "last_seen_at", "primary_symbol", "symbols", F.size("news").alias("source_count"), F.size("news").alias("news_count"), "news")
    leaders = sequential.fusion_leaders(cards)
    fused = sequential.fused_cards(cards, leaders, card).join(leaders.groupBy("leader").agg(F.count("*").cast("int").alias("n_cards")), "leader")
    return fused.select("leader", "n_cards", "card.event_key", F.expr("floor(card.importance * 1e4 + 0.500001D) / 1e4").alias("importance"), F.array_join("card.symbols", ",").alias("symbols"))
