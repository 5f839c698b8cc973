"""Keys already stored, reviewed labels, ranked streams, breadth and movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which state of a candidate may follow which.
TRANSITIONS = {
    "discovered": ("validating", "invalidated", "expired"),
    "validating": ("watch", "qualified", "invalidated", "expired"),
    "watch": ("qualified", "invalidated", "expired"),
    "qualified": ("invalidated", "expired"),
}
# Seconds before each further attempt.
RETRY_SECONDS = (30, 120, 300, 900, 1800)


def stored_already(rows: DataFrame, stored: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """id and known: whether any of a row's keys is a stored row's key of that name.  Null keys match nothing.

    One equi-join over all kinds of keys; the stored keys are made distinct first, so a hot key meets one row.
    """
    pair = lambda df: F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), df[k].cast("string").alias("value")) for k in keys)))
    have = stored.select(pair(stored).alias("k")).where("k.value is not null").distinct().select("k.*", F.lit(True).alias("found"))
    asked = rows.select(id_col, pair(rows).alias("k")).select(id_col, "k.*")
    return asked.join(have, ["kind", "value"], "left").groupBy(id_col).agg(F.coalesce(F.bool_or("found"), F.lit(False)).alias("known"))


def reviewed(candidates: DataFrame, reviews: DataFrame, id_col: str, label: str, decision: str, order: str) -> DataFrame:
    """Labels under their latest review: id, label, reviewed, and missing where a review has no candidate."""
    latest = reviews.groupBy(id_col).agg(F.max_by(decision, order).alias("__decision"))
    both = candidates.select(id_col, label, F.lit(True).alias("__has")).join(latest, id_col, "full")
    return both.select(id_col, F.coalesce("__decision", label).alias("label"), F.col("__decision").isNotNull().alias("reviewed"), F.col("__has").isNull().alias("missing"))


def may_follow(state: Column, target: Column, reason: Column) -> Column:
    """Whether a candidate may move to ``target``; every move needs a reason."""
    edges = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    return F.concat_ws(">", state, target).isin(edges) & (F.trim(F.coalesce(reason, F.lit(""))) != "")


def retry_seconds(attempt: Column) -> Column:
    """Seconds before the next attempt; the last value holds from there on."""
    at = F.greatest(F.lit(1), F.least(attempt, F.lit(len(RETRY_SECONDS)))).cast("int")
    return F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), at)


def due_jobs(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n jobs (job_id, retry_at) to try first: those without a retry time, then by retry time."""
    return jobs.where(F.col("retry_at").isNull() | (F.col("retry_at") <= now)).orderBy(F.col("retry_at").asc_nulls_first(), "job_id").limit(n)


def story_parts(rows: DataFrame, page: list[str], order: list[Column], supporting: int = 3, shown: float = 0.7, least_shown: int = 10, least_folded: int = 3) -> DataFrame:
    """Adds part to the rows of each page, in order: lead, supporting, stream, and the stream's folded tail.

    The tail beyond ``shown`` of the stream is folded, if ``least_shown`` rows are before it and
    ``least_folded`` in it.  A page is what one view loads, so its rows are few.
    """
    w = Window.partitionBy(*page)
    at = F.row_number().over(w.orderBy(*order))
    size = F.count("*").over(w) - 1 - supporting
    cut = F.greatest(F.lit(least_shown), F.ceil(size * F.lit(shown)))
    part = F.when(at == 1, "lead").when(at <= 1 + supporting, "supporting").when((size - cut >= least_folded) & (at - 1 - supporting > cut), "folded").otherwise("stream")
    return rows.withColumn("part", part)


def most_common(rows: DataFrame, by: list[str], value: str, seen: str, out: str) -> DataFrame:
    """Each group's size and most common value; of values equally common, the one seen first."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("k"), F.min(seen).alias("first"))
    return counted.groupBy(*by).agg(F.sum("k").alias("n"), F.max_by(value, F.struct("k", -F.col("first"))).alias(out))


def breadth(bars: DataFrame) -> DataFrame:
    """How many symbols rose, fell or stayed on each day."""
    return bars.groupBy("trade_date").agg(F.count_if(F.col("close") > F.col("open")).alias("advance"), F.count_if(F.col("close") < F.col("open")).alias("decline"), F.count_if(F.col("close") == F.col("open")).alias("flat"))
