"""Signal backtest: news joined backward and forward to prices, hit rates, buckets and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fallback_confidence, half_up, importance_bucket, score_bucket
from .asof import asof, micros


def outcomes(signals: DataFrame, quotes: DataFrame, horizon_seconds: int = 86_400, max_age_seconds: int = 86_400) -> DataFrame:
    """One row for each signal: baseline and forward price, skip reason, return and hit.

    signals: news_id, symbol, published_at, label, importance, score; quotes: id, symbol, price, fetched_at.
    """
    known = quotes.groupBy("symbol").agg(F.count("*").alias("n_prices"))
    rows = asof(signals, quotes, "symbol", micros("published_at"), micros("fetched_at"), F.col("id"), ["price", "fetched_at"], "base")
    rows = asof(rows, quotes, "symbol", micros("published_at") + horizon_seconds * 1_000_000, micros("fetched_at"), F.col("id"), ["price"], "ahead", forward=True)
    rows = rows.join(known, "symbol", "left")
    age = micros("published_at") - micros("base.fetched_at")
    reason = (
        F.when(F.col("n_prices").isNull(), "no_prices").when(F.col("base").isNull(), "no_baseline").when(age > max_age_seconds * 1_000_000, "stale")
        .when(F.col("ahead").isNull() | (F.col("base.price") == 0), "no_forward")
    )
    rows = rows.withColumn("skip_reason", reason).withColumn("ret", F.when(reason.isNull(), F.try_divide("ahead.price", "base.price") - 1))
    hit = F.when(F.col("label") == "positive", F.col("ret") > 0).otherwise(F.col("ret") < 0)
    return rows.select("news_id", "symbol", "label", "importance", "score", F.col("base.price").alias("base_price"), F.col("ahead.price").alias("forward_price"), "skip_reason", "ret", hit.alias("hit"))


def summary(rows: DataFrame) -> DataFrame:
    """Totals, skips, hit rate and returns over all outcomes, and the two-level mean over news."""
    per_news = rows.where("ret is not null").groupBy("news_id").agg(F.avg(F.col("hit").cast("double")).alias("rate")).agg(half_up(F.avg("rate"), 4).alias("per_news_hit_rate"), F.count("*").alias("news_count"))
    total = rows.agg(
        F.count("*").alias("total_signals"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"), F.count_if(F.col("skip_reason") == "stale").alias("skipped_stale"),
        F.count("ret").alias("evaluated"), half_up(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"), half_up(F.avg("ret"), 6).alias("avg_return"),
    )
    return total.join(F.broadcast(per_news), F.lit(True))  # one row each


def by_direction(rows: DataFrame) -> DataFrame:
    """Sample count, hits, hit rate, mean return and mean excess over all samples, for each label."""
    mean = rows.where("ret is not null").agg(F.avg("ret").alias("mean"))
    return (
        rows.where("ret is not null").join(F.broadcast(mean), F.lit(True)).groupBy("label")
        .agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), half_up(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"), half_up(F.avg("ret"), 6).alias("avg_return"), half_up(F.avg(F.col("ret") - F.col("mean")), 6).alias("avg_excess"))
    )


def importance_buckets(rows: DataFrame) -> DataFrame:
    """Hit rates by importance; empty buckets are shown, but for unknown."""
    spark = rows.sparkSession
    found = rows.where("ret is not null").groupBy(importance_bucket(F.col("importance")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    every = spark.createDataFrame([("high",), ("medium",), ("low",)], "bucket string")
    full = every.join(found, "bucket", "full").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return full.withColumn("hit_rate", half_up(F.try_divide("hits", F.nullif("n", F.lit(0))), 4))


def score_buckets(rows: DataFrame) -> DataFrame:
    """Hit rates by fifth of |score|; empty buckets are shown."""
    found = rows.where("ret is not null").groupBy(score_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    every = rows.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return full.withColumn("hit_rate", half_up(F.try_divide("hits", F.nullif("n", F.lit(0))), 4))


def calibration(buckets: DataFrame, least: int = 30, target: float = 0.55) -> DataFrame:
    """Confidence of each score bucket: its hit rate, or the linear fallback for a small sample; and the suggested threshold."""
    low = F.col("bucket") / 5.0
    small = (F.col("n") < least) | F.col("hit_rate").isNull()
    rows = buckets.select("bucket", half_up(low, 1).alias("score_min"), "n", small.alias("low_sample"), F.when(small, half_up(fallback_confidence(low + 0.1), 4)).otherwise(F.col("hit_rate")).alias("confidence"))
    threshold = rows.agg(F.min(F.when(~F.col("low_sample") & (F.col("confidence") >= target), F.col("score_min"))).alias("suggested_threshold"))
    return rows.join(F.broadcast(threshold), F.lit(True))


def calibrated(scores: DataFrame, table: DataFrame) -> DataFrame:
    """``scores`` with the calibrated confidence of its |score| bucket; the table has five rows."""
    return scores.withColumn("bucket", score_bucket(F.col("score"))).join(F.broadcast(table.select("bucket", "confidence")), "bucket", "left").drop("bucket")
