"""Further joins and roll-ups: dictionaries in texts, topic matching, capped lists, batches, calendars, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up


def dictionary_hits(docs: DataFrame, names: DataFrame, most_words: int = 4) -> DataFrame:
    """Distinct (doc_id, name_id) where a name's words follow each other in a text.

    docs: doc_id, words; names: name_id, words (of one to ``most_words`` words).  Word runs of a text are
    joined to names by equality, so there is no pairwise containment test.
    """

    def runs_of(k: int) -> Column:
        starts = F.when(F.size("words") >= k, F.sequence(F.lit(1), F.size("words") - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("words", i, k), " "))

    runs = [runs_of(k) for k in range(1, most_words + 1)]
    grams = docs.where(F.size("words") > 0).select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))
    keys = names.where((F.size("words") > 0) & (F.size("words") <= most_words)).select("name_id", F.array_join("words", " ").alias("gram"))
    return grams.join(keys, "gram").select("doc_id", "name_id").distinct()


def match_topics(items: DataFrame, topics: DataFrame) -> DataFrame:
    """The lowest topic of each item that shares at least min(2, its number of keywords) keywords; null if none.

    items: item_id, keywords; topics: topic_id, keywords (arrays of distinct words).  Two words of an item are one key, and
    of a key's topics only the lowest is joined: no item meets all topics of a common word.
    """
    words = F.array_sort("keywords")
    pairs = F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size("keywords")), lambda b: F.concat(a, F.lit("\x1f"), b))))
    owned = topics.select("topic_id", F.explode(F.concat(words, pairs)).alias("key")).groupBy("key").agg(F.min("topic_id").alias("topic_id"))
    asked = items.select("item_id", F.explode(F.when(F.size("keywords") == 1, words).otherwise(pairs)).alias("key"))
    return items.select("item_id").join(asked.join(owned, "key").groupBy("item_id").agg(F.min("topic_id").alias("topic_id")), "item_id", "left")


def capped(rows: DataFrame, category: str, title: str, order: list[Column], cap: int = 2) -> DataFrame:
    """The first ``cap`` rows of each category, titles not repeated."""
    key = F.lower(F.trim(F.col(title)))
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1")
    return first.withColumn("__rn", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("__rn") <= cap).drop("__rn")


def review_sample(rows: DataFrame, must: Column, bucket: str, per_bucket: int, seed: int, key: str) -> DataFrame:
    """All rows that must be reviewed, and ``per_bucket`` others of each bucket in the order of a seeded hash."""
    rest = rows.where(~must).withColumn("__rn", F.row_number().over(Window.partitionBy(bucket).orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256))))
    return rows.where(must).withColumn("__rn", F.lit(0)).unionByName(rest.where(F.col("__rn") <= per_bucket)).drop("__rn")


def recent_batches(runs: DataFrame, n: int) -> DataFrame:
    """All rows of the n latest batches (batch_id, created_at)."""
    last = runs.groupBy("batch_id").agg(F.max("created_at").alias("at"))
    return runs.join(last.orderBy(F.col("at").desc(), F.col("batch_id").desc()).limit(n).select("batch_id"), "batch_id", "left_semi")


def regression(runs: DataFrame) -> DataFrame:
    """Each batch's F1 against the batch before it on the same data: batch_id, label, f1, previous, delta."""
    w = Window.partitionBy("dataset_hash", "label").orderBy("created_at", "batch_id")
    before = F.lag("f1").over(w)
    return runs.select("batch_id", "label", "f1", before.alias("previous"), half_up(F.col("f1") - before, 4).alias("delta"))


def experiment_decision(precision_before: Column, recall_before: Column, precision_after: Column, recall_after: Column, least_recall: float) -> Column:
    """Keep a change that holds the recall guardrail and betters precision or recall without loss of the other."""
    better = (precision_after > precision_before) & (recall_after >= recall_before) | (recall_after > recall_before) & (precision_after >= precision_before)
    return F.when(recall_after < least_recall, "reject_guardrail").when(better, "keep").otherwise("reject_no_gain")


def calendar(events: DataFrame, today: Column, days: int) -> DataFrame:
    """Next event of each symbol and its events within ``days``. events: symbol, day."""
    ahead = F.col("day") >= today
    return events.groupBy("symbol").agg(F.min(F.when(ahead, F.col("day"))).alias("next_day"), F.count_if(ahead & (F.date_diff("day", today) <= days)).alias("n_within"))


def latency_ema(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential average of each key's values in order; the first value starts it.

    The fold is over one key's values, so the keys' histories must be bounded, as retention makes them.
    """
    packed = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("a"))
    fold = F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), F.col("a")[0]["v"], lambda acc, x: acc * (1 - alpha) + x["v"] * alpha)
    return packed.select(key, half_up(fold, 4).alias("ema"))


def worst_alerts(families: list[DataFrame]) -> DataFrame:
    """Alerts (family, name, severity) of several families with the overall status: the worst severity, or ok."""
    alerts = families[0]
    for f in families[1:]:
        alerts = alerts.unionByName(f)
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = alerts.agg(F.max(rank).alias("r")).select(F.when(F.col("r") == 2, "critical").when(F.col("r") == 1, "degraded").otherwise("ok").alias("overall"))
    return alerts.join(F.broadcast(worst), F.lit(True))  # one row


def spotlight(rows: DataFrame, recent: Column, k_strong: int = 5, k_other: int = 3) -> DataFrame:
    """Breaking items: the recent ones, or all if none is; by importance if any is high, else by strength of mood.

    rows: news_id, importance, score, effective_at.
    """
    staged = rows.withColumn("stage", F.when(recent & (F.col("importance") >= 8.5), 1).when(F.col("importance") >= 8.5, 3).when(recent, 2).otherwise(4))
    best = staged.agg(F.min("stage").alias("best"))
    kept = staged.join(F.broadcast(best), F.lit(True)).where("stage = best")
    strong = kept.where(F.col("best").isin(1, 3)).orderBy(F.col("importance").desc(), F.col("effective_at").desc(), F.col("news_id").desc()).limit(k_strong)
    other = kept.where(F.col("best").isin(2, 4)).orderBy(F.abs("score").desc(), F.col("effective_at").desc(), F.col("news_id").desc()).limit(k_other)
    return strong.unionByName(other).select("news_id", "stage")
