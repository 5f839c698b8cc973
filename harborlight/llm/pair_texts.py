"""Both texts of many pairs, by two joins that share one shuffle of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_texts(pairs: DataFrame, texts: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with columns left_text and right_text; ``texts`` has id and text, one row for each id.

    Both joins deal ``texts`` by its id, so Spark reuses the exchange.  Both sides of each join are plain
    shuffles: adaptive execution splits an id that very many pairs name.
    """
    named = lambda key, out: texts.select(F.col("id").alias(key), F.col("text").alias(out))
    return pairs.join(named(left, "left_text"), left).join(named(right, "right_text"), right)
