"""Token ids as flat binary files.

Texts are dealt by ranges of their id, sorted, and encoded; each task writes one shard:

* ``.bin``: the token ids, unsigned little-endian integers, 16 bits if the vocabulary allows, else 32;
* ``.idx``: n + 1 unsigned 64-bit offsets of the documents in the ``.bin`` file, in tokens;
* ``.ids``: n signed 64-bit document ids (a null id is stored as the least value).

A shard's files carry the task attempt in their names and only a task that succeeds lists them in the
manifest, so a lost executor or a second attempt leaves nothing half-written in use.  A shard's base,
the tokens of all shards before it, is a prefix sum over the manifest, which has a row per shard.
Readers map the files into memory.

Defined cases: a null text is empty and gets the end id alone; rows that share an id follow each other
in order of a hash of their texts; a null id comes first; an empty table has no documents; other columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLAIN, bounded_batches, byte_table, materialize, row_slices, shared_path, split_words, text_bytes
from .piece_memo import Encoded, encode_spaced, joined
from .word_table import WordTable

NULL_ID = -(1 << 63)
_LOWER = byte_table(b"", lower=True)
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer that never joins text across ASCII white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.table = WordTable(self.ids)

    def ids(self, words: list[bytes]) -> Encoded:
        """Ids of each word."""
        words = [w.decode() for w in words]
        found = encode_spaced(self.library, words)
        return (found[0], found[2]) if found else joined([e.ids for e in self.library.encode_batch(words, add_special_tokens=False)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        """All ids of the texts ``data[offsets[i]:offsets[i + 1]]`` joined, and how many each text has."""
        # The tokenizer lower-cases: doing it first leaves fewer words to remember, but must not make special strings.
        lower = _LOWER[data]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
        for i in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
            lower[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
        words = split_words(lower, offsets, PLAIN)
        ids, counts = self.table(lower, words)
        return ids, np.bincount(words.row, counts, len(offsets) - 1).astype(np.int64)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new counts."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


#: Bytes of the source (as Spark's statistics give them) for one shard, and the most shards.
SHARD_BYTES, MOST_SHARDS = 128 << 20, 100_000
#: Text bytes encoded at once: larger than elsewhere, as each time the table of known words is merged.
ENCODE_BYTES = 2 << 20


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write the shards below ``folder``; returns their manifest with bases (shard, path, dtype, n_docs, n_tokens, base).

    Without ``shards`` there is one for every ``SHARD_BYTES`` of the source, and at least the session's number of
    shuffle partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # Spark's default for a source of unknown size is near the greatest long
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-known // SHARD_BYTES)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    # The hash lets a range end between rows of one id, should very many rows share it.
    rows = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        dtype = "<u2" if max(encode.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        ids, counts = [], []
        with store.open_output_stream(f"{path}.bin") as out:
            for batch in batches:
                ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                data, offsets = text_bytes(batch.column(1))
                for first, last in row_slices(offsets, ENCODE_BYTES):
                    tokens, n = with_end(*encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]), end_id)
                    out.write(tokens.astype(dtype).tobytes())
                    counts.append(n)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype("<u8")
        for name, values in (("idx", offsets), ("ids", ids.astype("<i8"))):
            with store.open_output_stream(f"{path}.{name}") as out:
                out.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "dtype": [dtype], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})

    manifest = materialize(rows.mapInArrow(write, "shard long, path string, dtype string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's integers: mapped into memory where the store is a mounted folder, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document, from the files that the manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for shard in (row for batch in batches for row in batch.to_pylist()):
            tokens, offsets, ids = (mapped(store, f"{shard['path']}.{x}", kind) for x, kind in (("bin", shard["dtype"]), ("idx", "<u8"), ("ids", "<i8")))
            offsets = offsets.astype(np.int64)
            for first in range(0, len(ids), 4096):
                some = offsets[first : first + 4097]
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(some[:-1], some[1:], strict=True)]
                doc = np.array(ids[first : first + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NULL_ID), pa.array(some[:-1] + shard["base"]), pa.array(np.diff(some)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(shards, "shard").mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = shared_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer_path, folder, id_col, text_col, end_id), folder, id_col)
