"""Source divergence audit: how far the term frequencies of each (lang, source) are from those of other sources.

Terms are runs of ASCII letters (lower-cased) and all code points above 127.  A language keeps the terms that
at least ``least_docs`` of its documents have.  A group gives each kept term the smoothed integer share
1 + floor(10^9 * (count + 5) / (N + 5 * V)).

Arrow batches count the terms of their texts per group, and Spark adds these up.  The kept counts are dealt
by (lang, block of terms, pair of tiles of groups); each such cell becomes a dense int64 matrix of at most
``TILE_GROUPS`` groups a side by about ``TILE_TERMS`` terms, and all pairs of its groups are compared by
broadcasting a row against the other tile.  The cells' partial sums are added up per pair of groups; each cell
also gives the most overrepresented terms of each of its groups, which are merged into one list per group.
Kept terms that no group of a cell has are not in its matrix: they add one and the same difference each.

What is shuffled is the table of distinct (group, term), for each pair of tiles.  A hot source or word is one
row of each batch.  Neither the driver nor a broadcast gets any of it.

Defined cases: null text, lang and source are empty strings; a group without terms has count 0 for all
kept terms; a language without kept terms has pairs of value 0 and no terms; a source that is alone in its
language has no pairs; repeated rows all count, also as documents; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_table, map_arrow, materialize, row_slices, span_numbers, split_words, text_bytes

#: Terms are runs of ASCII letters, lower-cased, and code points above 127.
TERMS = byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
TILE_GROUPS, TILE_TERMS = 256, 4096


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term (null in one row of each group), occurrences and documents, summed within Arrow batches."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = pa.StructArray.from_arrays(batch.columns[:2], ["lang", "source"])
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault((k["lang"], k["source"]), len(groups)) for k in key.to_pylist()])
        every, bounds = text_bytes(batch.column(2))
        owner, terms, uses, users = [np.arange(len(groups))], [None] * len(groups), [np.zeros(len(groups), np.int64)], [np.zeros(len(groups), np.int64)]
        for first, last in row_slices(bounds):
            data = TERMS[every[bounds[first] : bounds[last]]]
            words = split_words(data, bounds[first : last + 1] - bounds[first], TERMS)
            if not len(words.row):
                continue
            number = span_numbers(data, words.start, words.end, words.hash)
            _, one, times = np.unique(words.row * (number.max() + 1) + number, return_index=True, return_counts=True)  # a row for each text and term
            of, term = group[first + words.row[one]], number[one]
            _, place, back = np.unique(of * (number.max() + 1) + term, return_index=True, return_inverse=True)
            at = one[place]
            owner.append(of[place])
            terms += [data[a:b].tobytes().decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
            uses.append(np.bincount(back, times).astype(np.int64))
            users.append(np.bincount(back))
        names = list(groups)
        owner = np.concatenate(owner).tolist()
        return pa.RecordBatch.from_arrays([pa.array([names[g][0] for g in owner]), pa.array([names[g][1] for g in owner]), pa.array(terms, pa.string()), pa.array(np.concatenate(uses)), pa.array(np.concatenate(users))], ["lang", "source", "term", "uses", "docs"])

    return map_arrow(rows, run, "lang string, source string, term string, uses long, docs long").groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def shares(uses: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (uses + SMOOTH) / (total + SMOOTH * kept)), by long division in steps that stay within 64 bits."""
    over, rest = np.divmod((uses + SMOOTH) * 1000, total + SMOOTH * kept)
    for _ in range(2):
        more, rest = np.divmod(rest * 1000, total + SMOOTH * kept)
        over = over * 1000 + more
    return over + 1


def _ints(batch: pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().astype(np.int64)


def compare(counts: pa.Table, groups: pa.Table, top: int = TOP) -> Iterator[dict]:
    """Partial pair sums and top terms of one cell: ``counts`` has source, term, uses, lang_uses; ``groups`` all groups of its tiles."""
    name = groups.column("source").to_pylist()
    index = {s: i for i, s in enumerate(name)}
    total, tile = _ints(groups, "n"), _ints(groups, "tile")
    kept, block, lang_total, low, high = (int(groups.column(c)[0].as_py()) for c in ("v", "block_terms", "lang_n", "low", "high"))
    terms = counts.column("term").combine_chunks().dictionary_encode()
    columns = terms.indices.to_numpy()
    rows = np.array([index[s] for s in counts.column("source").to_pylist()], np.int64)
    uses = _ints(counts, "uses")
    matrix = np.zeros((len(name), len(terms.dictionary)), np.int64)
    matrix[rows, columns] = uses
    p = shares(matrix, total[:, None], kept)
    absent, none = block - matrix.shape[1], shares(np.zeros(1, np.int64), total, kept)
    right = np.flatnonzero(tile == high)
    for i in np.flatnonzero(tile == low).tolist():
        sums = np.abs(p[right] - p[i]).sum(1) + absent * np.abs(none[right] - none[i])
        for j, value in zip(right.tolist(), sums.tolist(), strict=True):
            if i != j:
                yield {"source": name[i], "part": "pair", "item": name[j], "value": value}
                if low != high:
                    yield {"source": name[j], "part": "pair", "item": name[i], "value": value}
    if low == high:
        text = terms.dictionary.to_pylist()
        bytewise = np.empty(len(text), np.int64)
        bytewise[sorted(range(len(text)), key=lambda k: text[k].encode())] = np.arange(len(text))
        value = p[rows, columns] - shares(_ints(counts, "lang_uses"), lang_total, kept)
        some = np.flatnonzero((uses > 0) & (value > 0))
        some = some[np.lexsort((bytewise[columns[some]], -value[some], rows[some]))]
        first = np.searchsorted(rows[some], rows[some])
        for k in some[np.arange(len(some)) - first < top].tolist():
            yield {"source": name[rows[k]], "part": "term", "item": text[columns[k]], "value": int(value[k])}


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair, term), item, value and rank."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("lang_uses")).where(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(kept, "kept-terms")
    cells = materialize(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    # A group's tile and a term's block are hashes: sizes are even without any numbering.
    sums = cells.groupBy("lang", "source").agg(F.sum("uses").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["n"])
    langs = groups.groupBy("lang").agg(F.count("*").alias("g"), F.sum("n").alias("lang_n")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    langs = materialize(langs.withColumns({"tiles": F.ceil(F.col("g") / TILE_GROUPS), "blocks": F.greatest(F.ceil(F.col("v") / TILE_TERMS), F.lit(1))}), "langs")
    tile, block = F.pmod(F.xxhash64("source"), "tiles").alias("tile"), F.pmod(F.xxhash64("term"), "blocks").alias("block")

    def paired(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of tiles that its own one is in."""
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return other.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")

    sizes = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(
        kept.join(langs, "lang").groupBy("lang", block).agg(F.count("*").alias("block_terms")), ["lang", "block"], "left"
    ).fillna(0, ["block_terms"]).drop("blocks")
    sides = paired(groups.join(langs, "lang").select("lang", "source", "n", "lang_n", "v", "tiles", tile)).join(sizes, "lang")
    left = paired(cells.join(langs.select("lang", "tiles", "blocks"), "lang").select("lang", "source", "term", "uses", "lang_uses", "tiles", tile, block)).drop("tiles", "tile")
    keys = ["lang", "block", "low", "high"]

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        out = list(compare(counts, groups, top)) if len(groups) else []
        found = pa.Table.from_pylist(out, pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))
        return found.add_column(0, "lang", pa.array([key[0].as_py()] * len(found), pa.string()))

    partial = left.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(run, "lang string, source string, part string, item string, value long")
    # A term is in one block, so that its sum is its own value; pairs are summed over the blocks.
    summed = materialize(partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = summed.where("part = 'pair'").withColumn("rank", rank)
    terms = summed.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.union(terms)
