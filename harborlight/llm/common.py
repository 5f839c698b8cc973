"""Shared helpers: bounded Arrow batches, shared storage, and vectorised word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handed to a Python worker at once, and text bytes that the vectorised code handles at once.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a run of very long texts cannot fill a worker.

    Spark reads the setting when a query runs, so it stays set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        folder = tempfile.mkdtemp(prefix="harborlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/harborlight/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps its workers, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)
        release_memory()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets into them; null has no bytes."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans longer than this are hashed in blocks of it.
_BLOCK = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position (and from the end) on, as little-endian integers; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.tobytes(), strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, mixed eight bytes at a time: spans of up to eight bytes and one length never collide.

    A hash only groups spans that are likely equal; where equality decides a result, ``equal_spans`` checks it.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _GOLDEN)
    some = np.flatnonzero(sizes <= _BLOCK)
    word, at, left = eights(data), starts[some], sizes[some]
    while len(some):
        part = np.minimum(left, 8)
        out[some] = mix(out[some] ^ (word[at] & _MASKS[part])) + _GOLDEN
        going = np.flatnonzero(left > 8)
        some, at, left = some[going], at[going] + 8, left[going] - 8
    long = np.flatnonzero(sizes > _BLOCK)
    if len(long):
        blocks = -(-sizes[long] // _BLOCK)
        first = np.cumsum(blocks) - blocks
        number = np.arange(blocks.sum()) - np.repeat(first, blocks)
        begin = np.repeat(starts[long], blocks) + number * _BLOCK
        parts = span_hash(data, begin, np.minimum(begin + _BLOCK, np.repeat(ends[long], blocks)))
        out[long] = mix(out[long] + np.add.reduceat(mix(parts ^ mix(number.astype(np.uint64) * _GOLDEN)), first))
    return out


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a[i] and from b[i] on are equal for sizes[i] bytes."""
    out = np.ones(len(sizes), bool)
    full = np.flatnonzero((sizes > 0) & (a != b))
    for some in np.array_split(full, max(1, int(sizes[full].sum()) // (4 * SLICE_BYTES))):
        if len(some):
            n = sizes[some]
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n)
            differ = data[np.repeat(a[some], n) + step] != data[np.repeat(b[some], n) + step]
            out[some] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return out


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each span; two spans have one number if and only if their bytes are equal."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    like = first[number]
    same = (sizes == sizes[like]) & equal_spans(data, starts, starts[like], np.minimum(sizes, sizes[like]))
    odd: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # one hash for two texts
        number[i] = len(first) + odd.setdefault(data[starts[i] : ends[i]].tobytes(), len(odd))
    return number


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Maps each byte to itself (A-Z to a-z if ``lower``), separators to a space."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 32
    return table


#: Words are runs of anything but ASCII white space.
PLAIN = byte_table(b" \t\n\x0b\x0c\r", lower=False)
#: Words are runs of ASCII letters (lower-cased), digits and all other code points above 127.
FOLDED = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


@dataclass
class Words:
    """Words of some texts, in order: text number, byte span in the joined texts, and hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of k words of one text."""
        n = len(self.row) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j : n + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        return first, mix(total[first])


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of the texts ``data[offsets[i]:offsets[i + 1]]``, without a Python object for each."""
    mapped = table[data]
    inside = mapped != 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    edge = offsets[:-1][full]
    opens[edge] = inside[edge]
    edge = offsets[1:][full] - 1
    closes[edge] = inside[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(row, start, end, span_hash(mapped, start, end))


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (n + 1 values)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
