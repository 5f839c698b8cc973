"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks, with the end offset of every
token.  Two neighbouring encodings are spliced at the first boundary in their overlap that both have
and that is proven stable: a single space between two characters that are not white space.  The
byte-level pattern always starts a token at such a space whatever stands before it, so the tokens
beyond it do not depend on where a chunk began.  If an overlap has no such boundary, it is widened,
at last to the end of the text.  Shorter texts are one chunk.

Within a chunk, pieces between stable spaces are encoded by the library once and remembered in a
bounded memory; by the same argument the joined encodings are the encoding of the chunk.

Defined cases: a null text counts as empty, with no bytes and no tokens; special strings inside texts
are what the library makes of them by default; repeated rows are counted one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes
from .piece_memo import Encoded, PieceMemo, encode_spaced, joined

_ODD_SPACE = re.compile(r"\s | \s")
_STABLE = re.compile(r"(?<=\S)(?= \S)")
_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes a chunk to the end offsets, in characters, of its tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = PieceMemo(self.spaced, max_pieces=600_000)

    def raw(self, pieces: list[str]) -> Encoded:
        """Ends of the tokens of each piece."""
        return joined([[end for _, end in e.offsets] for e in self.library.encode_batch(pieces, add_special_tokens=False)])

    def spaced(self, words: list[str]) -> Encoded:
        """Ends of the tokens of each word with a space before it."""
        found = encode_spaced(self.library, words)
        return found[1:] if found else self.raw([" " + w for w in words])

    def __call__(self, text: str) -> np.ndarray:
        if _ODD_SPACE.search(text):
            pieces = _STABLE.split(text)
            ends, counts = self.raw(pieces)
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        else:
            first, *words = text.split(" ")
            ends, counts = self.raw([first])
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            if words:
                more, more_counts = self.memo(words)
                ends, counts, lengths = np.concatenate([ends, more]), np.concatenate([counts, more_counts]), np.r_[len(first), lengths]
            else:
                lengths = np.array([len(first)])
        return ends + np.repeat(np.cumsum(lengths) - lengths, counts)


def shared_boundary(text: str, left: np.ndarray, right: np.ndarray, start: int, stop: int) -> int | None:
    """The first stable position in (start, stop) at which tokens of both encodings end."""
    common = np.intersect1d(left[(left > start) & (left < stop)], right[(right > start) & (right < stop)])
    for at in common.tolist():
        if text[at] == " " and at + 1 < stop and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
    return None


def count_tokens(text: str, encode: Callable[[str], np.ndarray], chunk_chars: int, overlap_chars: int) -> int:
    """How many tokens the whole text has."""
    total, start, size, begin = 0, 0, len(text), -1  # tokens after ``begin`` are still to be counted; a chunk starts at ``start``
    if size <= chunk_chars:
        return len(encode(text))
    left = None
    while True:
        stop = min(size, start + chunk_chars + overlap_chars)
        if left is None:
            left = encode(text[start:stop]) + start
        overlap = overlap_chars
        while stop < size:
            after = start + chunk_chars
            right = encode(text[after : min(size, after + chunk_chars + overlap_chars)]) + after
            cut = shared_boundary(text, left, right, after, min(stop, after + chunk_chars))
            if cut is not None:
                break
            overlap *= 2
            stop = min(size, after + overlap)
            left = encode(text[start:stop]) + start
        if stop >= size:
            return total + int(np.count_nonzero(left > begin))
        total += int(np.count_nonzero((left > begin) & (left <= cut)))
        begin, start, left = cut, after, right


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_chars: int = 16_384, overlap_chars: int = 256) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, ChunkEncoder(tokenizer_path))
        column = batch.column(1)
        sizes = np.diff(text_bytes(column)[1])
        tokens = [count_tokens(x.as_py() or "", encode, chunk_chars, overlap_chars) for x in column]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    counted = map_arrow(docs.select(id_col, F.col(text_col).cast("string")), count, f"{id_col} {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
