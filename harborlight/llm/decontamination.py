"""Benchmark decontamination with suffix arrays of the training texts.

Each Arrow batch of documents is a shard.  Its words are numbered by the benchmark's vocabulary and split
into runs wherever two neighbours are not neighbours in any item, as no match goes across; runs shorter than
the shortest window cannot hold one and are left out.  The remaining suffixes are sorted into a suffix array by
prefix doubling.  Of the benchmark's suffixes, those with a word or pair of neighbours in their first window
that the shard lacks occur nowhere; all others are binary-searched in it at once, by arrays.  A suffix that
matches for a whole window gives, at every place where it occurs, the longest verbatim match.  A document keeps,
for each item, its longest match and as few others as have all words between them that the item hits, however often
a text repeats itself.  The benchmark lies in the shared folder in blocks of bounded size, which tasks read
one at a time; nothing of it passes through the driver.

A window is ``window`` consecutive words of an item; an item with fewer words, but some, is one window.

Defined cases: null texts and items have no words; an item without an id can hit words but is not
listed; repeated items count once; repeated documents are judged one by one; an empty benchmark
hits nothing and an empty table gives no rows; other columns are ignored or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLDED, bounded_batches, release_memory, shared_path, text_bytes

#: Text bytes of one benchmark block, on average, and of the documents that are held against a block at once if there are several.
BLOCK_BYTES = 32 << 20
SHARDS_BYTES = 64 << 20
_FOLD = FOLDED.tobytes()
#: Pairs of neighbouring words are looked up by as many bits of a hash: chance hits cost a search, and never a result.
PAIR_BITS = 22
#: Places handled at once.
CHUNK = 1 << 20
_MATCHES = "array<struct<item:string,item_word:int,doc_word:int,n_words:int>>"


def folded_words(text: bytes) -> list[bytes]:
    """ASCII-lower-cased runs of letters, digits and code points above 127."""
    return text.translate(_FOLD).split()


class TestSuffixes:
    """A benchmark block: its vocabulary, each item's word numbers as big-endian bytes, and all its windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item, text in items:
            words = folded_words((text or "").encode())
            if words:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append((item, np.array(numbers, ">u4").tobytes(), min(window, len(words))))
        self.shortest = min((need for _, _, need in self.items), default=0)
        # All windows as rows of word numbers, 0 beyond the words that must match; and each one's item and place.
        parts, where = [np.zeros((0, window), np.int64)], [np.zeros((0, 2), np.int64)]
        for n, (_, code, need) in enumerate(self.items):
            numbers = np.frombuffer(code, ">u4").astype(np.int64)
            rows = np.zeros((len(numbers) - need + 1, window), np.int64)
            rows[:, :need] = np.lib.stride_tricks.sliding_window_view(numbers, need)
            parts.append(rows)
            where.append(np.column_stack([np.full(len(rows), n), np.arange(len(rows))]))
        self.windows, self.where = np.concatenate(parts), np.concatenate(where)
        # All items' words, with a 0 after each; where each item begins; and the pairs of neighbours, by hash.
        self.words = np.concatenate([np.zeros(0, np.int64), *(np.append(np.frombuffer(code, ">u4").astype(np.int64), 0) for _, code, _ in self.items)])
        sizes = np.array([len(code) // 4 for _, code, _ in self.items], np.int64)
        self.sizes, self.needs = sizes, np.array([need for *_, need in self.items], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.pair = pair_hash(self.words)
        self.paired = pair_table(self.pair)

    def possible(self, x: np.ndarray) -> np.ndarray:
        """The windows all of whose words and pairs of neighbours the word numbers ``x`` may have."""
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[x] = True
        lacks = np.r_[0, np.cumsum(~there[self.words])]
        apart = np.r_[0, np.cumsum(~pair_table(pair_hash(x))[self.pair])] if len(self.pair) else np.zeros(1, np.int64)
        item, at = self.where.T
        first, need = self.begin[item] + at, self.needs[item]
        return np.flatnonzero((lacks[first + need] == lacks[first]) & (apart[first + need - 1] == apart[first]))


def pair_hash(x: np.ndarray) -> np.ndarray:
    """Of each two neighbours of ``x``, a number below 2 ** PAIR_BITS."""
    return ((x[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x[1:].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def pair_table(pairs: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << PAIR_BITS, bool)
    table[pairs] = True
    return table


def suffix_array(x: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """The positions ``at`` of ``x`` in order of what follows them up to the next 0, by prefix doubling."""
    rank, k = x.astype(np.int64), 1
    while k < longest:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        ahead[rank == 0] = 0
        _, rank = np.unique(rank * (len(x) + int(rank.max()) + 1) + ahead, return_inverse=True)
        rank[x == 0] = 0
        k *= 2
    return at[np.argsort(rank[at], kind="stable")]


def found_windows(x: np.ndarray, order: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place in the suffix array ``order`` of ``x`` of the suffixes that begin with each window."""
    width = windows.shape[1]
    padded = np.concatenate([x.astype(np.int64), np.zeros(width, np.int64)])

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order))
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) >> 1
            at, less, equal = order[middle], np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for j in range(width):
                have, want = padded[at + j], windows[open_, j]
                less |= equal & (want > 0) & (have < want)
                equal &= (want == 0) | (have == want)
            right = less | equal if after else less
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    return search(False), search(True)


def known_runs(x: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of ``x`` that can hold a match, with a 0 after each; the place in ``x`` of each word; and the words left in its run."""
    known = x > 0
    going = known[1:] & known[:-1] & tests.paired[pair_hash(x)] if len(x) > 1 else np.zeros(0, bool)
    first = np.flatnonzero(known & ~np.r_[False, going])
    size = np.flatnonzero(known & ~np.r_[going, False]) + 1 - first
    long = size >= tests.shortest
    first, size = first[long], size[long]
    ends = np.cumsum(size + 1)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - 1, size + 1)
    left = np.repeat(size, size + 1) - step
    place = np.repeat(first, size + 1) + step
    return np.where(left > 0, x[np.minimum(place, len(x) - 1)], 0), place, left


def matches_of(tests: TestSuffixes, y: np.ndarray, left: np.ndarray, order: np.ndarray, windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of item, item word, place in ``y`` and words of the matches that begin with ``windows`` and nowhere earlier."""
    item, at = tests.where[windows].T
    before = np.where(at > 0, tests.words[tests.begin[item] + at - 1], 0)
    # Windows that have the same places and the same word before them go on from the same places.
    _, one, alike = np.unique(np.column_stack([low, high, before]), axis=0, return_index=True, return_inverse=True)
    alike, previous = alike.ravel(), np.r_[0, y[:-1]]
    starts = []
    for g in one.tolist():
        places = order[low[g] : high[g]]
        starts.append(places if before[g] == 0 else places[previous[places] != before[g]])
    sizes, out = np.array([len(x) for x in starts], np.int64), [np.zeros((0, 4), np.int64)]
    per = sizes[alike]
    bounds = np.unique(np.r_[0, np.searchsorted(np.cumsum(per), np.arange(0, per.sum(), CHUNK)), len(per)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        place = np.concatenate([starts[g] for g in alike[a:b].tolist()])
        who, i = np.repeat(item[a:b], per[a:b]), np.repeat(at[a:b], per[a:b])
        n, most = tests.needs[who], np.minimum(tests.sizes[who] - i, left[place])
        origin = tests.begin[who] + i
        some = np.flatnonzero(n < most)
        while len(some):
            some = some[y[place[some] + n[some]] == tests.words[origin[some] + n[some]]]
            n[some] += 1
            some = some[n[some] < most[some]]
        out.append(np.column_stack([who, i, place, n]))
    return np.concatenate(out)


def covering(rows: np.ndarray) -> np.ndarray:
    """Which matches stay: of each (text, item), the longest one, and the fewest that have all words between them. Rows: text, item, text word, words."""
    order = np.lexsort((-rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
    stays = np.zeros(len(rows), bool)
    if not len(rows):
        return stays
    text, item, begin, size = rows[order].T
    edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)], strict=True):
        if b == a + 1:
            stays[order[a]] = True
            continue
        stays[order[a + int(np.argmax(size[a:b]))]] = True
        firsts = begin[a:b]
        reach = np.maximum.accumulate(firsts + size[a:b])
        best = np.flatnonzero(np.r_[True, reach[1:] > reach[:-1]])[np.cumsum(np.r_[True, reach[1:] > reach[:-1]]) - 1]  # up to each match, the one that reaches farthest
        k = 0
        while k < b - a:  # from the next word that is not covered on, the match that reaches farthest
            last = int(np.searchsorted(firsts, firsts[k], "right")) - 1
            while True:
                stays[order[a + best[last]]] = True
                end = reach[last]
                more = int(np.searchsorted(firsts, end, "right")) - 1  # begin within the covered words, or right behind them
                if reach[more] == end:
                    break
                last = more
            k = int(np.searchsorted(firsts, end, "right"))
    return stays


def shard_matches(texts: list[bytes], tests: TestSuffixes) -> tuple[list[int], list[list[tuple]]]:
    """For each text its number of words and its matches (item, item word, text word, words)."""
    get = tests.vocabulary.get
    numbers, sizes = [], []
    for text in texts:
        words = folded_words(text)
        sizes.append(len(words))
        numbers += map(get, words, repeat(0))
        numbers.append(0)
    found: list[list[tuple]] = [[] for _ in texts]
    y, origin, left = known_runs(np.array(numbers, np.int64), tests) if tests.items else (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero(left >= tests.shortest)
    if not len(at):
        return sizes, found
    windows = tests.possible(y)
    if not len(windows):
        return sizes, found
    order = suffix_array(y, at, int(left.max()) + 1)
    low, high = found_windows(y, order, tests.windows[windows])
    hit = low < high
    rows = matches_of(tests, y, left, order, windows[hit], low[hit], high[hit])
    doc_end = np.cumsum(np.array(sizes) + 1)
    place = origin[rows[:, 2]]
    text = np.searchsorted(doc_end, place, "right")
    word = place - np.r_[0, doc_end][text]
    stays = covering(np.column_stack([text, rows[:, 0], word, rows[:, 3]]))
    for doc, item, i, w, n in np.column_stack([text, rows[:, :2], word, rows[:, 3]])[stays].tolist():
        found[doc].append((tests.items[item][0], i, w, n))
    return sizes, found


def write_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[str, int]:
    """The folder and number of the benchmark's blocks, folders block=0 and so on; a block without items has none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    folder = shared_path(benchmark.sparkSession, "benchmark-blocks")
    if blocks:
        items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


_loaded: dict[tuple, TestSuffixes] = {}


def load_block(folder: str, block: int, window: int) -> TestSuffixes:
    """A block's suffixes; the last one read stays in memory."""
    key = folder, block, window
    if key not in _loaded:
        _loaded.clear()
        store, base = fs.FileSystem.from_uri(folder)
        files = store.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True))
        items = [r for f in files if f.path.endswith(".parquet") for r in pq.read_table(f.path, filesystem=store, partitioning=None).to_pylist()]
        _loaded[key] = TestSuffixes(sorted(((r["item"], r["text"]) for r in items), key=lambda r: (r[0] or "", r[1])), window)
    return _loaded[key]


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of some ``limit`` bytes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` as struct __row, with n_words and matches."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("n_words", T.LongType()), *T.StructType.fromDDL(f"matches {_MATCHES}").fields])
    kind = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
    folder, blocks = write_blocks(benchmark, item_col, item_text_col, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches, SHARDS_BYTES if blocks > 1 else 1):
            spans = [text_bytes(batch.column(1)) for batch in held]
            texts = [[data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for data, bounds in spans]
            sizes, found = [[] for _ in held], [[[] for _ in t] for t in texts]
            for block in range(max(1, blocks)):
                tests = load_block(folder, block, window) if blocks else TestSuffixes([], window)
                for i, some in enumerate(texts):
                    sizes[i], more = shard_matches(some, tests)
                    for old, new in zip(found[i], more, strict=True):
                        old += new
            for batch, n, matches in zip(held, sizes, found, strict=True):
                lists = [[dict(zip(("item", "item_word", "doc_word", "n_words"), m, strict=True)) for m in x] for x in matches]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lists, kind)], ["__row", "n_words", "matches"])
        release_memory()

    return rows.mapInArrow(search, schema)


def hit_summary(matched: DataFrame) -> DataFrame:
    """Adds n_hit (words inside matches), n_items, items_sha256, contaminated, and the longest match.

    The longest match is given by its words, its first word in the document and its item; of several the
    first in the document, then the first by item.
    """
    merged = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, m: F.struct(F.greatest(acc["end"], m["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(acc["end"], m["a"]))).alias("n")),
    )["n"]
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    first = F.array_sort(F.transform("matches", lambda m: F.struct((-m["n_words"]).alias("n"), m["doc_word"].alias("at"), m["item"].alias("item"))))
    longest = F.try_element_at(first, F.lit(1))
    return (
        matched.withColumn("n_hit", merged)
        .withColumn("n_items", F.size(items).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(items, ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .withColumn("longest_words", F.coalesce(-longest["n"], F.lit(0)).cast("long"))
        .withColumn("longest_at", longest["at"].cast("long"))
        .withColumn("longest_item", longest["item"])
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, unchanged."""
    return with_matches(docs, benchmark, text_col, window=window).where(F.size("matches") == 0).select("__row.*")
