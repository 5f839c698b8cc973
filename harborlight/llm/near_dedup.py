"""Near-duplicates by ProbMinHash signatures, banding and verification.

A text's shingles are its windows of five folded words (all its words if it has fewer), weighted by how
often they occur.  Its signature has ``BANDS * ROWS`` registers.  Each shingle is a Poisson process
with its weight as rate, whose points arrive in random registers; a register keeps the shingle that
arrived in it first.  A process stops as soon as its next point comes after the last register's first
arrival.  Registers of two texts agree with the probability Jaccard similarity of their shingles.

Texts that agree in all registers of a band share a bucket.  First each member is held against one
pivot, the member with most company over all its buckets; that settles most groups of copies.  Then
every bucket that still holds several classes is compared whole: the members outside its largest class
are dealt into chunks of bounded size, each chunk meets each chunk of the bucket in one task, and the
probability Jaccard similarity of all pairs of different classes is computed there from their shingle
sets.  Only links that join two classes leave the task, fewer than it has members, so no pairs are
listed; and every pair of texts that share a bucket and are alike ends in one class.

At similarity s two texts share a bucket with probability 1 - (1 - s ** 6) ** 32: over 0.9999 at 0.8.

Exact copies are grouped by the digest of their text first, and only one of them goes on.

Defined cases: a null text is a class of its own; texts without words are duplicates of exact copies
alone; repeated and null ids are allowed, rows are then told apart by number, and a class is named by
the least id in it, or null if it has none; an empty table gives no rows; other columns are ignored or
carried unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, Words, free_name, map_arrow, materialize, mix, row_slices, split_words, text_bytes
from .components import components
from .pair_texts import with_texts

SHINGLE, BANDS, ROWS = 5, 32, 6
REGISTERS = BANDS * ROWS
#: Shingles of one chunk of a bucket, and what rounding may take from a similarity.
CHUNK, SLACK = 200_000, 1e-9


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each shingle, in order of the texts."""
    at, hashes = words.windows(SHINGLE)
    row = words.row[at]
    counts = np.bincount(words.row, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.cumsum(counts) - counts
        whole = np.array([np.bitwise_xor.reduce(mix(words.hash[first[i] : first[i] + counts[i]] + np.arange(counts[i], dtype=np.uint64))) for i in short], np.uint64)
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, mix(whole)])
        order = np.argsort(row, kind="stable")
        row, hashes = row[order], hashes[order]
    return row, hashes


def weighted(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The registers of n texts (n x REGISTERS); 0 for texts without shingles."""
    first = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, np.uint64)
    time, step = np.zeros(len(row)), 0
    rate = weights / np.maximum(1, np.bincount(row, weights, n))[row]
    while len(row):
        step += 1
        draw = mix(hashes + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        slot = row * REGISTERS + (mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
        sooner = np.flatnonzero(time < first[slot])
        sooner = sooner[np.argsort(-time[sooner], kind="stable")]  # the soonest is written last
        first[slot[sooner]] = time[sooner]
        holder[slot[sooner]] = hashes[sooner]
        going = time < first.reshape(n, REGISTERS).max(1)[row]
        row, hashes, rate, time = row[going], hashes[going], rate[going], time[going]
    return holder.reshape(n, REGISTERS)


def band_keys(texts: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """The bucket keys of each text (none for a text without words), and how many distinct shingles it has."""
    every, bounds = text_bytes(texts)
    out: list[np.ndarray | None] = []
    sizes = np.zeros(len(texts), np.int64)
    for first, last in row_slices(bounds, 1 << 20):
        data, offsets, n = every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], last - first
        found = weighted(*shingles(split_words(data, offsets, FOLDED), n))
        registers = signatures(*found, n).reshape(n, BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + registers[:, :, r])
        sizes[first:last] = np.bincount(found[0], minlength=n)
        out += [keys[i].astype(np.int64) if sizes[first + i] else None for i in range(n)]
    return out, sizes


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (long), digest of the text, its bucket keys and number of shingles."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.col(text_col).cast("string"), 256)).alias("digest"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes = band_keys(batch.column(2))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64())), pa.array(sizes)], ["id", "digest", "keys", "size"])

    return map_arrow(rows, run, "id long, digest binary, keys array<long>, size long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, given as sorted hashes and their counts.

    For each common element the sum over all elements j of max(x_j / x_i, y_j / y_i) is a sum of the
    x_j whose ratio y_j / x_j is at most y_i / x_i, and of the other y_j: prefix sums in order of ratio.
    """
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below, above = only_x + np.cumsum(x), only_y + y.sum() - np.cumsum(y)
    return float((1.0 / (below / x + above / y)).sum())


def text_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and counts of each text."""
    every, bounds = text_bytes(texts)
    out = []
    for first, last in row_slices(bounds):
        data, offsets, n = every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], last - first
        row, hashes, weights = weighted(*shingles(split_words(data, offsets, FOLDED), n))
        edge = np.searchsorted(row, np.arange(n + 1))
        out += [(hashes[a:b], weights[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least the threshold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = text_sets(batch.column(2)), text_sets(batch.column(3))
        keep = pa.array([similarity(x, y) >= threshold - SLACK for x, y in zip(left, right, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return map_arrow(with_texts(pairs, texts, "a", "b").select("a", "b", "left_text", "right_text"), run, "a long, b long")


def with_pivots(members: DataFrame) -> DataFrame:
    """Members (key, id, company) with their bucket's most central member: key, id, pivot, pivot_company."""
    pivots = members.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("pivot"), F.col("company").alias("pivot_company")), F.struct("company", -F.col("id"))).alias("p"))
    return materialize(members.join(materialize(pivots.select("key", "p.*"), "pivots"), "key"), "bucket-pivots")


def with_sets(texts: DataFrame) -> DataFrame:
    """id, its sorted shingle hashes as 64-bit integers, and their counts as 32-bit integers, null if all are 1."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = text_sets(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype("<u8").tobytes() for h, _ in sets], pa.binary()), pa.array([w.astype("<u4").tobytes() if (w > 1).any() else None for _, w in sets], pa.binary())], ["id", "hashes", "counts"])

    return map_arrow(texts.select("id", "text"), run, "id long, hashes binary, counts binary")


def upper_bounds(mine: np.ndarray, at: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the similarity of one weighted set with many, and which of them are exact.

    ``mine`` are its counts by element; the others are joined: ``at`` and ``counts`` of all their
    elements, each from ``edges[i]`` on.  A common element of equal count w adds w over the sum of the
    greater counts of all elements; one of unequal counts adds at most the lesser of its two shares.
    """
    own = mine[at]
    total, theirs = mine.sum(), np.add.reduceat(counts, edges)
    equal = np.where(own == counts, counts, 0.0)
    bound = np.add.reduceat(equal, edges) / (total + theirs - np.add.reduceat(np.minimum(own, counts), edges))
    unequal = np.flatnonzero((own > 0) & (own != counts))
    of = np.searchsorted(edges, unequal, "right") - 1
    rest = np.bincount(of, np.minimum(own[unequal] / total, counts[unequal] / theirs[of]), len(edges))
    return bound + rest, rest == 0


def unit_links(ids: np.ndarray, classes: np.ndarray, outer: np.ndarray, left: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of a unit: its left members against its other ones.

    A pair of two outer members meets in two units, and counts in the one whose left member has the lesser id.
    """
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(x) or not len(y):
        return []
    classes = np.unique(classes, return_inverse=True)[1]
    every, number = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    ends = np.cumsum([len(h) for h, _ in sets])
    starts = ends - [len(h) for h, _ in sets]
    at = np.concatenate([number[starts[j] : ends[j]] for j in y])
    counts = np.concatenate([sets[j][1] for j in y]).astype(np.float64)
    edges = np.cumsum([0, *(len(sets[j][0]) for j in y[:-1])])
    mine, out = np.zeros(len(every)), []
    for i in x:
        open_ = (classes[y] != classes[i]) & (~outer[y] | (ids[y] > ids[i]))
        if not open_.any():
            continue
        mine[number[starts[i] : ends[i]]] = sets[i][1]
        bound, exact = upper_bounds(mine, at, counts, edges)
        mine[number[starts[i] : ends[i]]] = 0
        likely = np.flatnonzero(open_ & (bound >= threshold - SLACK))
        for j in likely[np.argsort(-bound[likely], kind="stable")]:
            k = y[j]
            if classes[k] != classes[i] and (exact[j] or similarity(sets[i], sets[k]) >= threshold - SLACK):
                out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
                classes[classes == classes[k]] = classes[i]
    return out


def bucket_links(members: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all classes of which two texts share a bucket and are alike."""
    named = materialize(members.select("key", "id", "size").join(labels, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component")), "bucket-classes")
    classes = named.groupBy("key", "component").agg(F.sum("size").alias("n"))
    buckets = classes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("most < all")
    mixed = materialize(named.join(materialize(buckets, "mixed-buckets"), "key"), "mixed-members")
    sets = materialize(with_sets(texts.join(mixed.select("id").distinct(), "id", "left_semi")), "shingle-sets")
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    mixed = mixed.join(sets, "id").withColumns({"outer": F.col("component") != F.col("main"), "lefts": chunks(F.col("all") - F.col("most")), "rights": chunks(F.col("all"))})

    def side(rows: DataFrame, left: bool, own: str, other: str) -> DataFrame:
        dealt = rows.select("*", F.pmod(F.xxhash64("id"), own).cast("int").alias("__own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("__other"))
        i, j = ("__own", "__other") if left else ("__other", "__own")
        return dealt.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.struct("id", "component", "outer", F.lit(left).alias("left"), "hashes", "counts").alias("m"))

    both = side(mixed.where("outer"), True, "lefts", "rights").union(side(mixed, False, "rights", "lefts"))
    units = both.groupBy("key", "i", "j").agg(F.collect_list("m").alias("unit")).select("unit")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        links = []
        for unit in batch.column(0):
            flat = unit.values
            ids, classes, outer, left = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            hashes = [np.frombuffer(h.as_buffer(), "<u8") for h in flat.field(4)]
            sets = [(h, np.frombuffer(n.as_buffer(), "<u4") if n.is_valid else np.ones(len(h), np.uint32)) for h, n in zip(hashes, flat.field(5), strict=True)]
            links += unit_links(ids, classes, outer, left, sets, threshold)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return map_arrow(units, run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (the least id of its class) and rep_id (of its exact copies)."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    if ids.where("id is null or n > 1").isEmpty():
        return _classes(docs, id_col, text_col, threshold)
    # Ids that do not tell rows apart: number the rows, written once so that the numbers are fixed.
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("own"), text_col, F.monotonically_increasing_id().alias("__row")), "numbered-rows")
    found = materialize(_classes(rows, "__row", text_col, threshold).join(rows.select("__row", "own"), "__row"), "numbered-classes")
    least = lambda key, out: found.groupBy(key).agg(F.min("own").alias(out))
    named = found.join(least("class_id", "class_own"), "class_id").join(least("rep_id", "rep_own"), "rep_id")
    return named.select(F.col("own").alias(id_col), F.col("class_own").alias("class_id"), F.col("rep_own").alias("rep_id"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """near_classes for ids that are unique and not null."""
    rows = materialize(with_keys(docs, id_col, text_col), "signatures")
    distinct = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    distinct = materialize(distinct, "distinct-texts")
    members = distinct.where("keys is not null").select("id", "size", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(materialize(sizes, "bucket-sizes"), "key"), "bucket-members")
    company = materialize(members.groupBy("id").agg(F.sum("n").alias("company")), "company")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = materialize(texts.join(company.select("id"), "id", "left_semi"), "candidate-texts")

    # First each member is held against the most central of its pivots: in a group of many copies that settles most.
    stars = with_pivots(members.drop("n").join(company, "id")).where("pivot <> id")
    pairs = stars.groupBy("id").agg(F.max_by("pivot", F.struct("pivot_company", -F.col("pivot"))).alias("pivot")).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = materialize(verified(materialize(pairs, "pivot-pairs"), texts, threshold), "links")
    more = materialize(bucket_links(members, components(links), texts, threshold), "links")
    labels = components(links.union(more))
    classes = distinct.select("digest", F.col("id").alias("rep_id")).join(labels.withColumnRenamed("id", "rep_id"), "rep_id", "left")
    joined = rows.drop("keys", "size").join(materialize(classes, "classes"), "digest", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("component", "rep_id", "id").alias("class_id"), F.coalesce("rep_id", "id").alias("rep_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the first row by id and text stays."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    if ids.where("id is null or n > 1").isEmpty():
        drop = _classes(docs, id_col, text_col, threshold).where(F.col(id_col) != F.col("class_id")).select(id_col)
        return docs.join(materialize(drop, "near-copies"), id_col, "left_anti").select(docs.columns)
    key = free_name(docs, "__row")
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-rows")
    found = _classes(rows, key, text_col, threshold)
    class_of = free_name(rows, "class_id")
    first = rows.join(found.select(key, F.col("class_id").alias(class_of)), key).groupBy(class_of).agg(F.min_by(key, F.struct(F.col(id_col).isNull(), id_col, text_col, key)).alias(key))
    return rows.join(materialize(first.select(key), "class-firsts"), key, "left_semi").select(docs.columns)
