"""Stored records: source registry, better URLs, merged cards, proposals and their fills, review decisions, backfill."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import half_up

# Fixed values.
SOURCE_TYPES = ("rss", "html", "api")
TIER_RANKS = {"primary": 3, "secondary": 2, "fallback": 1}
REVIEW_SOURCES = ("human_reviewed", "human_corrected")


def source_registry(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Feed definitions by name, those of ``own`` before the defaults, with missing fields filled.

    Both have name, source_type, parser, tier, priority, cadence_seconds and markets (array).  ``problem`` says what is
    wrong with a definition and is null for a sound one; no row is dropped.  Repeated names in one input must not occur.
    """
    merged = defaults.join(own.select("name"), "name", "left_anti").unionByName(own)
    filled = merged.select(
        "name", "source_type", "parser", F.coalesce("tier", F.lit("primary")).alias("tier"), F.coalesce("priority", F.lit(100)).alias("priority"),
        F.coalesce("cadence_seconds", F.lit(300)).alias("cadence_seconds"), "markets", F.get("markets", F.lit(0)).alias("market"),
    )
    problem = (
        F.when(F.coalesce(F.size("markets"), F.lit(0)) < 1, "markets")
        .when(~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)), "source_type")
        .when(~F.col("tier").isin(*TIER_RANKS), "tier")
        .when(F.col("priority") <= 0, "priority")
        .when(F.col("cadence_seconds") <= 0, "cadence_seconds")
        .when((F.col("source_type") == "api") & ~F.col("parser").eqNullSafe("the_news_api_json"), "parser")
    )
    return filled.withColumn("problem", problem)


def source_rank(tier: Column, priority: Column) -> Column:
    """Sorts sources: by tier, then by the lower priority number; sources without an entry come last."""
    ranks = F.coalesce(*(F.when(tier == name, rank) for name, rank in TIER_RANKS.items()), F.lit(0))
    return F.struct(ranks.alias("tier"), (-F.coalesce(priority, F.lit(0))).alias("priority"))


def promote_urls(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` (id, url, url_hash, rank) with the URL of the best incoming row (the same columns) that outranks it.

    A hash that another stored row has is not taken; of two rows that want one new hash, the lower id gets it.
    Incoming ties go to the lower URL.  ``promoted`` says whether the URL changed.
    """
    best = incoming.where("url <> ''").groupBy("id").agg(F.max("rank").alias("new_rank"), F.min_by(F.struct("url", "url_hash"), F.struct((-F.col("rank.tier")).alias("t"), (-F.col("rank.priority")).alias("p"), F.col("url"))).alias("new"))
    rows = stored.join(best, "id", "left")
    wants = rows.where((F.col("new_rank") > F.col("rank")) & ~F.col("new.url").eqNullSafe(F.col("url")))
    same = wants.where(F.col("new.url_hash").eqNullSafe(F.col("url_hash"))).select("id", "new")
    moves = wants.where(~F.col("new.url_hash").eqNullSafe(F.col("url_hash"))).groupBy(F.col("new.url_hash").alias("url_hash")).agg(F.min_by(F.struct("id", "new"), "id").alias("w"))
    free = moves.join(stored.select("url_hash"), "url_hash", "left_anti").select("w.id", "w.new")
    taken = same.unionByName(free).select("id", F.col("new").alias("taken"))
    return stored.join(taken, "id", "left").select("id", F.coalesce("taken.url", "url").alias("url"), F.coalesce("taken.url_hash", "url_hash").alias("url_hash"), F.col("taken").isNotNull().alias("promoted"))


def merged_card(first: Column, second: Column, most_news: int | None = 3, most_symbols: int = 5) -> Column:
    """Two cards as one: news of both by id, newest first; symbols in order; the greater importance and last time.

    Cards are structs of event_key, importance, last_seen_at, primary_symbol, symbols (array) and
    news (array of struct<effective_at, id, source>).
    """
    known = F.transform(first["news"], lambda n: n["id"])
    news = F.reverse(F.array_sort(F.concat(first["news"], F.filter(second["news"], lambda n: ~F.array_contains(known, n["id"])))))
    return F.struct(
        F.concat(F.lit("fused-"), first["event_key"], F.lit("-"), second["event_key"]).alias("event_key"), F.greatest(first["importance"], second["importance"]).alias("importance"),
        F.greatest(first["last_seen_at"], second["last_seen_at"]).alias("last_seen_at"), F.coalesce(F.nullif(first["primary_symbol"], F.lit("")), second["primary_symbol"]).alias("primary_symbol"),
        F.slice(F.array_distinct(F.concat(first["symbols"], second["symbols"])), 1, most_symbols).alias("symbols"),
        F.size(F.array_distinct(F.transform(news, lambda n: n["source"]))).alias("source_count"), F.size(news).alias("news_count"), (news if most_news is None else F.slice(news, 1, most_news)).alias("news"),
    )


def fill_price(snapshot: Column, bar: Column, previous_close: Column, limit_price: Column) -> Column:
    """Price and reason of a buy: a positive snapshot, else the last close unless its day was locked at the limit.

    ``bar`` is a struct of open, high, low, close and volume; the result is struct<price, reject_reason>.
    """
    close = F.when(bar["close"] != 0, bar["close"])
    locked = (half_up(bar["open"], 2) >= limit_price) & (previous_close > 0) & (((bar["high"] == bar["low"]) & (bar["low"] == bar["open"])) | (bar["volume"] == 0))
    shut = F.coalesce(locked, F.lit(False))
    price = F.when(snapshot > 0, snapshot).when(~shut, close)
    reason = F.when(~F.coalesce(snapshot > 0, F.lit(False)), F.when(close.isNull(), "no_market_data").when(shut, "limit_up_unfilled"))
    return F.struct(price.alias("price"), reason.alias("reject_reason"))


def proposal_fills(items: Column, cash: Column, lot: int = 100) -> Column:
    """Orders of one proposal in its order, each in whole lots of the cash that those before it left.

    ``items`` is an array of struct<symbol, weight, price, reject_reason>; the result is an array of
    struct<symbol, shares, price, reject_reason>.
    """
    start = F.struct(cash.cast("double").alias("cash"), F.array().cast("array<struct<symbol:string,shares:long,price:double,reject_reason:string>>").alias("orders"))

    def step(state: Column, item: Column) -> Column:
        price = item["price"].cast("double")
        shares = (F.floor(F.try_divide(F.try_divide(state["cash"] * item["weight"], price), F.lit(lot))) * lot).cast("long")
        reason = F.coalesce(item["reject_reason"], F.when(~F.coalesce(price > 0, F.lit(False)), "no_market_data"), F.when(shares < lot, "below_min_lot"))
        bought = F.when(reason.isNull(), shares).otherwise(F.lit(0).cast("long"))
        order = F.struct(item["symbol"].alias("symbol"), bought.alias("shares"), F.when(reason.isNull(), price).alias("price"), reason.alias("reject_reason"))
        return F.struct((state["cash"] - F.when(reason.isNull(), price * bought).otherwise(0.0)).alias("cash"), F.concat(state["orders"], F.array(order)).alias("orders"))

    return F.aggregate(items, start, step, lambda s: s["orders"])


@F.pandas_udf(T.StringType())
def result_hash(payload: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object in canonical form: keys sorted, no white space, ASCII only, Python's number format."""
    canon = lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return payload.map(lambda x: None if x is None else hashlib.sha256(canon(x).encode()).hexdigest())


def bar_history(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Bars of each symbol from one provider: the fallback's where the primary has none or no close on its last day.

    Both have symbol, trade_date and close; a fallback without rows of a symbol leaves the primary's.
    """
    last = primary.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("last_close"))
    sound = last.where(F.col("last_close").isNotNull() & ~F.isnan("last_close")).select("symbol")
    second = fallback.join(sound, "symbol", "left_anti")
    first = primary.join(second.select("symbol").distinct(), "symbol", "left_anti")
    return first.withColumn("provider", F.lit("primary")).unionByName(second.withColumn("provider", F.lit("fallback")))


def calendar_events(calendars: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (symbol, event_type, day) of calendars (symbol, earnings and ex_dividend as arrays) and listed earnings days (symbol, day)."""
    arrays = [calendars.select("symbol", F.lit(name).alias("event_type"), F.explode(name).alias("day")) for name in ("earnings", "ex_dividend")]
    return arrays[0].union(arrays[1]).union(listed.select("symbol", F.lit("earnings"), "day")).where("day IS NOT NULL").distinct()


def unknown_evidence(claimed: Column, known: Column) -> Column:
    """The claimed ids that are not known; an answer is sound if there is none."""
    return F.array_except(claimed, known)


def apply_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review decisions (text columns, as read from CSV) joined to the queue of samples.

    Every sample of the queue and every decision gives a row; ``problem`` is null for those that may be imported.
    ``queue`` has sample_id, market_relevant and noise_type; ``decisions`` has sample_id, review_label_source,
    review_market_relevant and review_noise_type.
    """
    flag = F.lower(F.trim("review_market_relevant"))
    d = decisions.select(F.trim("sample_id").alias("sample_id"), F.trim("review_label_source").alias("label_source"), F.when(flag.isin("true", "1", "yes", "y"), True).when(flag.isin("false", "0", "no", "n"), False).alias("said"), F.nullif(F.trim("review_noise_type"), F.lit("")).alias("said_noise"))
    d = d.groupBy("sample_id").agg(F.count("*").alias("times"), F.min(F.struct("label_source", "said", "said_noise")).alias("d"))
    rows = queue.withColumn("queued", F.lit(True)).join(d, "sample_id", "full")
    relevant = F.coalesce("d.said", "market_relevant")
    noise = F.coalesce("d.said_noise", "noise_type")
    problem = (
        F.when(F.col("queued").isNull(), "not_in_queue").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate")
        .when(~F.coalesce(F.col("d.label_source").isin(*REVIEW_SOURCES), F.lit(False)), "label_source").when(~relevant & noise.isNull(), "noise_type")
    )
    return rows.select("sample_id", relevant.alias("market_relevant"), F.when(~relevant, noise).alias("noise_type"), F.col("d.label_source").alias("label_source"), problem.alias("problem"))


def backfill(wanted: DataFrame, done_path: str, fetched: DataFrame, bars_path: str) -> None:
    """One resumable step of a backfill: bars of the wanted symbols that are not done are written, then marked as done.

    ``wanted`` has symbol; ``fetched`` has symbol and what a fetch gave.  A symbol without bars stays open.  Bars of a
    run that stopped before its mark are written again by the next: each symbol is a folder that is replaced whole.
    """
    spark = wanted.sparkSession
    schema = T.StructType([T.StructField("symbol", T.StringType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(schema).parquet(done_path) if there else spark.createDataFrame([], schema)
    todo = wanted.select("symbol").distinct().join(done, "symbol", "left_anti")
    fetched.join(todo, "symbol", "left_semi").repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(bars_path)
    written = spark.read.schema(fetched.schema).parquet(bars_path).select("symbol").distinct()
    written.join(todo, "symbol", "left_semi").write.mode("append").parquet(done_path)
