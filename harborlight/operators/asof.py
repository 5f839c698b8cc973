"""As-of joins without range joins: one shuffle on (key, time bucket), and a carry over bucket summaries.

A key with very many rows is spread over its buckets.  What a bucket cannot answer itself is answered by
the nearest other bucket that has a row; the summaries are one row for each key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: str | Column) -> Column:
    """A timestamp as microseconds since the epoch."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, key: str, left_time: Column, right_time: Column, order: Column, take: list[str], out: str, forward: bool = False, bucket: int = DAY) -> DataFrame:
    """``left`` with struct ``out`` of the last row of ``right`` at or before left_time (first at or after, if forward).

    ``order`` breaks ties of time: the greatest wins (the least, if forward).  ``out`` is null if there is none.
    Rows with a null key or time get null.
    """
    sign = -1 if forward else 1
    lrows = left.select(F.col(key).alias("__k"), (left_time * sign).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__o"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__r"))
    right = right.where(F.col(key).isNotNull() & right_time.isNotNull())
    rrows = right.select(F.col(key).alias("__k"), (right_time * sign).alias("__t"), F.lit(0).alias("__side"), (order.cast("long") * sign).alias("__o"), F.lit(None).cast(lrows.schema["__left"].dataType).alias("__left"), F.struct(*take).alias("__r"))
    bucketed = lambda df: df.withColumn("__b", F.floor(F.col("__t") / bucket))
    rows, summary = bucketed(lrows.union(rrows)), bucketed(rrows)
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__side", F.col("__o").asc_nulls_last())
    found = rows.withColumn("__hit", F.last("__r", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("__side = 1")
    summary = summary.groupBy("__k", "__b").agg(F.max_by("__r", F.struct("__t", "__o")).alias("__r"))
    asked = bucketed(lrows).where("__k is not null and __t is not null").select("__k", "__b").distinct()
    both = asked.join(summary, ["__k", "__b"], "full")
    carry = both.withColumn("__carry", F.last("__r", True).over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__k", "__b", "__carry")
    joined = found.join(carry, ["__k", "__b"], "left")
    hit = F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__hit", "__carry"))
    return joined.select("__left.*", hit.alias(out))


def session_gaps(rows: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Rows with session_no: a new session starts after a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce((micros(time) - F.lag(micros(time)).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(w)).drop("__new")
