"""Connected components of an edge table, by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id in it) of every id that an edge (a, b) names.

    Labels start as ids.  In each round a label takes the least label among its neighbours, and then
    that label's own label, until a round changes nothing; star-like graphs take two or three rounds.
    Grouped minima combine within tasks first, so a hub does not gather its links in one task.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "id").select("id", F.least("component", "other").alias("via"), F.col("component").alias("was"))
        hop = labels.select(F.col("id").alias("via"), F.col("component").alias("hop"))
        after = materialize(lower.join(hop, "via").select("id", F.least("via", "hop").alias("component"), (F.least("via", "hop") < F.col("was")).alias("changed")), "labels")
        labels = after.select("id", "component")
        if after.where("changed").isEmpty():
            return labels
