"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``MOST`` times its own; what is over is shared
again by weight.  Every document gets the whole copies that its source's target holds for certain, the integer
part of target / source size, and one more with the fraction as its inclusion probability.  For that copy,
documents are ranked by their random odds divided by their inclusion odds, and the first are taken.

The sample has a fixed size in words.  A source's documents are split into strata of sizes within a factor of
two, from the longest down; each stratum takes ranks up to its share of the words, and what it takes too much
or too little changes the inclusion probability of the next one, whose documents are shorter.  So a source
misses its target by about one of its shortest documents, as far as it has short ones; where one document is longer than
the others can make good, by at most half of it.  Where the shorter
strata can make good either way, a coin with the right odds decides about the rank at the border, so that long
documents keep their probability; else the nearer border is taken.

All of it is DataFrame expressions.  Texts are read once; after that, only words, draw and stratum of a
document are.  The ranks of a stratum are summed into cells of 1 / ``CELLS`` of the log odds before the shuffle,
at most ``2 * WIDEST * CELLS + 1`` of them, so a hot source is no more to a task than any other.  The draw is a
hash of the id: a rerun takes the same documents.

Defined cases: a null text has no words; null sources are one source, after all others; documents without
words are not taken (0 words); rows that share an id share their draw, and repeated rows are taken or left
together; a corpus without words has targets of 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
CELLS, WIDEST = 128, 20


def uniform(*key: Column | str) -> Column:
    """A number between 0 and 1, from a hash of the key."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source_key (null sources: empty), size in words, stratum (binary digits of the size), draw and cell of its log odds."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_key"), size.alias("size"), uniform(F.lit(str(seed)), F.col(id_col).cast("string")).alias("draw"))
    log_odds = F.log(F.col("draw") / (1 - F.col("draw")))
    return rows.withColumns({"stratum": F.length(F.bin("size")), "cell": F.floor(F.greatest(F.least(log_odds, F.lit(WIDEST)), F.lit(-WIDEST)) * CELLS)})


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place, from 0 in code point order, null last: places within ranges, and the rows of the ranges before (a row for each range)."""
    last = F.col("source_key") == ""
    ranges = materialize(sources.repartitionByRange(last, "source_key").withColumn("range", F.spark_partition_id()), "mix-sources")
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranges.join(before, "range").select(*sources.columns, (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(last, "source_key")) - 1).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source_key, source_size and target of each source; ``sizes`` has source_key and source_size.

    The share of a unit of weight only grows as sources reach their limit: each round is an aggregate of one row.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(ranked(sizes).select("source_key", "source_size", weight.alias("weight")), "mix-weights")
    total, units = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    share = total / units
    while True:
        limit, wanted = F.col("source_size").cast("double") * most, F.lit(share) * F.col("weight")
        fixed, free = table.agg(F.sum(F.when(limit < wanted, F.col("source_size")).otherwise(0)), F.sum(F.when(limit < wanted, 0).otherwise(F.col("weight")))).first()
        grown = (total - most * fixed) / free if free else share
        if grown <= share:
            return table.select("source_key", "source_size", F.least(limit, wanted).alias("target"))
        share = grown


def cuts(cells: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """source_key, stratum, last cell taken (null: none) and inclusion probability, for every stratum of every source.

    ``cells`` has source_key, stratum, cell and words; a source is one row here, of a bounded number of cells.
    """
    upto = F.sum("words").over(Window.partitionBy("source_key", "stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    strata = cells.withColumn("upto", upto).groupBy("source_key", "stratum").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("cell", "words", "upto"))).alias("cells"))
    strata = strata.withColumn("coin", uniform(F.lit(str(seed)), F.lit("border"), "source_key", F.col("stratum").cast("string")))
    sources = strata.groupBy("source_key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("stratum", "words", "cells", "coin")))).alias("strata"), F.sum("words").cast("double").alias("words")).join(goals, "source_key")
    chance = F.col("chance")

    def step(state: Column, s: Column) -> Column:
        want = chance * s.words + state.carry
        whole = F.size(F.filter(s.cells, lambda c: c.upto <= want))
        under = F.when(whole > 0, F.get(s.cells, whole - 1).upto).otherwise(F.lit(0))
        border = F.get(s.cells, whole)
        part, left = F.try_divide(want - under, border.words.cast("double")), state.left - s.words
        either = (border.upto - want <= chance * left) & (want - under <= (1 - chance) * left)
        over = F.coalesce(F.when(either, s.coin < part).otherwise(part >= 0.5), F.lit(False))
        inclusion = F.greatest(F.least(F.coalesce(F.try_divide(want, s.words.cast("double")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        last = F.get(s.cells, whole + over.cast("int") - 1).cell
        return F.struct(
            (want - F.when(over, border.upto).otherwise(under)).alias("carry"), left.alias("left"), F.array_append(state.out, F.struct(s.stratum.alias("stratum"), last.alias("last"), inclusion.alias("inclusion"))).alias("out")
        )

    start = F.struct(F.lit(0.0).alias("carry"), F.col("words").alias("left"), F.expr("cast(array() as array<struct<stratum:int,last:bigint,inclusion:double>>)").alias("out"))
    return sources.select("source_key", F.inline(F.aggregate("strata", start, step, lambda state: state.out)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """id, size, source_size, target, taken (words), copies, inclusion (of the copy that is not certain) and odds_rank of every document."""
    rows = materialize(drawn(docs, id_col, text_col, source_col, seed), "mix-draws")
    cells = materialize(rows.groupBy("source_key", "stratum", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    goals = targets(cells.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, most)
    goals = materialize(goals.withColumn("certain", F.floor(ratio)).withColumn("chance", ratio - F.col("certain")), "mix-goals")
    borders = materialize(cuts(cells, goals, seed).join(goals, "source_key"), "mix-borders")
    extra = F.coalesce(F.col("cell") <= F.col("last"), F.lit(False)) & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("certain") + extra.cast("long")).otherwise(F.lit(0).cast("long"))
    odds = F.try_divide(F.col("draw") / (1 - F.col("draw")) * (1 - F.col("inclusion")), F.col("inclusion"))
    return rows.join(borders, ["source_key", "stratum"]).select(id_col, "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "inclusion", odds.alias("odds_rank"))
