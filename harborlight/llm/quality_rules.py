"""Quality rules with adaptive thresholds.

Every text gets exact word statistics.  A fixed base rule rejects texts of under ten words and texts
of which more than a fifth lies in repeated five-word windows.  For what is left, KLL quantile
sketches of each metric are built for each (lang, source) and merged upwards to each lang and to all
texts.  From each sketch come a lower and an upper quantile; a group's are drawn towards its language's, and
those towards all texts', as strongly as ``min_rows`` texts would.  The fence is the lower quantile plus
``1 + reach`` times the gap to the upper one, so a source whose texts are all of one make has a fence of its
own, however unusual.  Bad texts lift the upper quantile and not the lower one: the gap counts up to ``most_gap``
times that of the language's tighter groups (the lower quartile of their gaps), so that a source does not lift its own
fence while a quarter of its texts are good, and the sources of a language do not while a quarter of them are mostly good; and at least as a least spread, where most texts have one and the same value.  The fences are
then joined back to the texts, and a text beyond a fence is rejected.

Defined cases: a null text has no words and so fails the base rule; null lang or source form groups
of their own; repeated rows are judged one by one and all count; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLAIN, code_points, map_arrow, materialize, mix, row_slices, span_hash, span_numbers, split_words, text_bytes

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Metric:
    """A ratio of two statistics and the least spread that its fence allows for."""

    name: str
    over: str
    under: str
    least_spread: float


METRICS = (
    Metric("symbol_ratio", "n_symbols", "word_chars", 0.01),
    Metric("mean_word_chars", "word_chars", "n_words", 0.4),
    Metric("dup_line_ratio", "n_dup_lines", "n_lines", 0.1),
    Metric("repeat_ratio", "n_repeat_words", "n_words", 0.05),
)

#: The quantiles that make up a fence.
LOWER, UPPER = 0.25, 0.9


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of STATS for each text of a string column."""
    every, bounds = text_bytes(column)
    out = {name: np.zeros(len(bounds) - 1, np.int64) for name in STATS}
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    for first, last in row_slices(bounds):
        data, offsets, n = every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], last - first
        words = split_words(data, offsets, PLAIN)
        points, marks = code_points(data), np.concatenate([[0], np.cumsum(symbol[data])])
        count = lambda rows: np.bincount(rows, minlength=n)  # noqa: B023, E731
        out["n_words"][first:last] = count(words.row)
        out["word_chars"][first:last] = np.bincount(words.row, points[words.end] - points[words.start], n)
        out["n_symbols"][first:last] = np.diff(marks[offsets])

        newlines, full = np.flatnonzero(data == 10), np.flatnonzero(offsets[:-1] < offsets[1:])
        ends = np.concatenate([newlines, offsets[1:][full]])
        row = np.concatenate([np.searchsorted(offsets, newlines, "right") - 1, full])
        order = np.lexsort((ends, row))
        ends, row = ends[order], row[order]
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1] + 1
        fresh = np.ones(len(row), bool)
        fresh[1:] = row[1:] != row[:-1]
        starts[fresh] = offsets[row[fresh]]
        has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
        row, starts, ends = row[has_word], starts[has_word], ends[has_word]
        same = span_numbers(data, starts, ends, span_hash(data, starts, ends))
        out["n_lines"][first:last] = count(row)
        out["n_dup_lines"][first:last] = count(row) - count(row[np.unique(row * (len(row) + 1) + same, return_index=True)[1]])

        # Windows that may be repeats by hash are then held against each other by the numbers of their words.
        at, hashes = words.windows(5)
        _, inverse, times = np.unique(hashes ^ mix(words.row[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        if len(again):
            used = np.unique(again[:, None] + np.arange(5))
            number = np.zeros(len(words.row), np.int64)
            number[used] = span_numbers(data, words.start[used], words.end[used], words.hash[used])
            windows = np.column_stack([words.row[again], number[again[:, None] + np.arange(5)]])
            _, inverse, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
            again = again[times[inverse.ravel()] > 1]
        cover = np.zeros(len(words.row) + 6, np.int64)
        cover[again] += 1
        cover[again + 5] -= 1
        out["n_repeat_words"][first:last] = count(words.row[np.cumsum(cover)[: len(words.row)] > 0])
    return out


def with_stats(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """The statistics of each text, its group keys and verdict of the base rule; ``carried`` columns as struct __row."""
    inputs = docs.select(F.struct(*carried).alias("__row"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*inputs.schema.fields[:3], *(T.StructField(s, T.LongType()) for s in STATS)])

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_stats(batch.column(3))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[s]) for s in STATS)], ["__row", "lang", "source", *STATS])

    ratio = lambda m: F.coalesce(F.try_divide(F.col(m.over).cast("double"), F.col(m.under)), F.lit(0.0)).alias(m.name)
    return map_arrow(inputs, stats, schema).select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        *(ratio(m) for m in METRICS),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
    )


def fences(stats: DataFrame, min_rows: int = 200, reach: float = 2.5, most_gap: float = 2.0, sketch_k: int = 400) -> DataFrame:
    """lang_key, source_key and the fence of each metric, from mergeable sketches of the rows that pass the base rule."""
    sound = stats.where(~F.col("base_failed"))
    sketches = sound.groupBy("lang_key", "source_key").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(m.name, F.lit(sketch_k)).alias(m.name) for m in METRICS)
    )
    sketches = materialize(sketches, "quality-sketches")

    def merged(by: list[str], tag: str) -> DataFrame:
        return sketches.groupBy(*(by or [F.lit(0).alias("all_key")])).agg(
            F.sum("n").alias(f"n_{tag}"), *(F.kll_merge_agg_double(m.name, F.lit(sketch_k)).alias(f"{m.name}_{tag}") for m in METRICS)
        )

    groups = (
        sketches.withColumn("all_key", F.lit(0)).join(merged(["lang_key"], "lang"), "lang_key").join(merged([], "all"), "all_key")
    )

    def low_and_gap(sketch: str) -> F.Column:
        q = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(LOWER), F.lit(UPPER)))
        return F.array(q[0], q[1] - q[0])

    def drawn(own: F.Column, n: str, parent: F.Column) -> F.Column:
        return F.zip_with(own, parent, lambda x, y: (x * F.col(n) + y * min_rows) / (F.col(n) + min_rows))

    own = {m.name: low_and_gap(m.name) for m in METRICS}
    parent = {m.name: drawn(low_and_gap(f"{m.name}_lang"), "n_lang", low_and_gap(f"{m.name}_all")) for m in METRICS}
    ranges = groups.select(
        "lang_key", "source_key", "n", *(own[m.name][1].alias(f"{m.name}_gap") for m in METRICS), *(drawn(own[m.name], "n", parent[m.name]).alias(m.name) for m in METRICS),
        *(parent[m.name][1].alias(f"{m.name}_parent") for m in METRICS),
    )
    # The tight gap is one of groups, not of texts: large and dirty sources have one voice each.
    tight = ranges.where(F.col("n") >= min_rows).groupBy("lang_key").agg(*(F.percentile_approx(f"{m.name}_gap", 0.25, 1000).alias(f"{m.name}_tight") for m in METRICS))

    def fence(m: Metric) -> F.Column:
        most = F.lit(most_gap) * F.greatest(F.coalesce(f"{m.name}_tight", f"{m.name}_parent"), F.lit(m.least_spread))
        return (F.col(m.name)[0] + F.lit(1 + reach) * F.greatest(F.least(F.col(m.name)[1], most), F.lit(m.least_spread))).alias(f"{m.name}_fence")

    return ranges.join(tight, "lang_key", "left").select("lang_key", "source_key", *(fence(m) for m in METRICS))


def with_verdict(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds the fences and kept; there are few groups, and Spark broadcasts them only if their measured size allows it."""
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(m.name) <= F.col(f"{m.name}_fence"))
    return stats.join(limits, ["lang_key", "source_key"], "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_rows: int = 200, reach: float = 2.5) -> DataFrame:
    """id, lang, source, the statistics, base_failed, each ratio with its fence, and kept."""
    stats = materialize(with_stats(docs, text_col, [id_col]), "quality-stats")
    limits = materialize(fences(stats, min_rows, reach), "quality-fences")
    return with_verdict(stats, limits).select(f"__row.{id_col}", "*").drop("__row", "lang_key", "source_key")


def keep_good(docs: DataFrame, text_col: str = "text", min_rows: int = 200, reach: float = 2.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; one pass for the sketches, one to judge."""
    limits = materialize(fences(with_stats(docs, text_col, [text_col]).drop("__row"), min_rows, reach), "quality-fences")
    return with_verdict(with_stats(docs, text_col, docs.columns), limits).where("kept").select("__row.*")
