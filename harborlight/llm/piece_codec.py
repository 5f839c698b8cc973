"""SentencePiece encoding and decoding that keeps source offsets.

Text is normalised as the model says: the compiled character map is searched for the longest prefix
at each position, and the origin of every normalised byte is recorded.  The library then encodes, and
each piece's span in the normalised text is projected through the recorded origins to a byte span of
the original text.

Where no piece of the model has a space mark after another character, a text is encoded word by word
with a bounded memory of words: merges cannot cross such a space, so the joined ids are those of the
whole text.  Texts with leading, trailing or repeated spaces or literal space marks, and models
without that property, are encoded whole.

Defined cases: a null text is encoded as an empty one, with no ids; repeated rows are encoded one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, row_slices, text_bytes
from .piece_memo import PieceMemo, joined

MARK = "▁"
_codecs: dict[str, PieceCodec] = {}


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings, and their replacements."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.blob = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes from ``at`` the longest entry covers, and its replacement."""
        found, node = None, 0
        unit = self.units[0]
        for i in range(at, len(text)):
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            node ^= text[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != text[i]:
                break
            if unit >> 8 & 1:
                leaf = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                found = i + 1 - at, self.blob[leaf : self.blob.index(b"\0", leaf)]
        return found

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The replaced text, and for each of its byte positions (and its end) the source position."""
        if not self.units:
            return text, np.arange(len(text) + 1)
        out, origin, at = bytearray(), [], 0
        while at < len(text):
            match = self.longest(text, at)
            if match is None:
                first = text[at]
                width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                match = width, text[at : at + width]
                origin.extend(range(at, at + width))
            else:
                origin.extend([at] * len(match[1]))
            out += match[1]
            at += match[0]
        return bytes(out), np.array([*origin, len(text)])


class PieceCodec:
    """Encodes with offsets, and decodes, by one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kinds = proto.ModelProto.SentencePiece
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.length = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces])
        self.unknown = self.library.unk_id()
        plain = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.by_word = self.prefix and not self.trim and not spec.precompiled_charsmap and model.trainer_spec.model_type == 2 and not any(MARK in p.lstrip(MARK) for p in plain)
        self.memo = PieceMemo(lambda words: joined(self.library.encode(words, num_threads=1)), max_pieces=150_000)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        words, kept, whole, out = [], [], [], [None] * len(texts)
        for i, text in enumerate(texts):
            if self.by_word and text and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
                kept.append((i, len(words)))
                words += text.split(" ")
            else:
                whole.append(i)
        ids, counts = self.memo(words) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        before = np.concatenate([[0], np.cumsum(counts)])
        for (i, first), (_, last) in zip(kept, [*kept[1:], (None, len(words))], strict=False):
            out[i] = ids[before[first] : before[last]]
        for i, found in zip(whole, self.library.encode([texts[i] for i in whole], num_threads=1), strict=True):
            out[i] = np.array(found, np.int32)
        return out

    def source(self, text: bytes) -> np.ndarray:
        """For each byte position of the normalised, space-marked text, and its end, the source position."""
        normal, origin = self.map.normalise(text)
        data = np.frombuffer(normal, np.uint8)
        keep = np.ones(len(data), bool)
        if self.trim:  # no spaces at the ends, and one for each run
            space = data == 32
            keep[1:] &= ~(space[1:] & space[:-1])
            inner = np.flatnonzero(~space)
            keep[: inner[0] if len(inner) else None] = False
            keep[inner[-1] + 1 if len(inner) else 0 :] = False
        widths = np.where(data == 32, 3, 1)[keep]
        at = np.repeat(origin[:-1][keep], widths)
        head = np.full(3, at[0] if len(at) else 0) if self.prefix and len(at) else at[:0]
        end = origin[np.flatnonzero(keep)[-1] + 1] if keep.any() else len(text)
        return np.concatenate([head, at, [end]])

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The original byte span of each piece."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        origin, lengths = self.source(text), self.length[ids]
        if (ids == self.unknown).any():  # an unknown piece has no length of its own
            pieces = self.library.encode(text.decode(), out_type=str)
            lengths = np.array([1 if self.is_byte[i] else len(p.encode()) for p, i in zip(pieces, ids, strict=True)])
        ends = np.cumsum(lengths)
        return origin[ends - lengths].astype(np.int32), origin[ends].astype(np.int32)


def encode_with_offsets(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, begins and ends (byte spans of the pieces in the text), and the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", "begins", "ends", "decoded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(model_path) or _codecs.setdefault(model_path, PieceCodec(model_path))
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for first, last in row_slices(bounds):  # each slice is a batch of its own: the ids and spans take more room than the text
                texts = [data[a:b].tobytes() for a, b in zip(bounds[first:last], bounds[first + 1 : last + 1], strict=True)]
                found = codec.encode([t.decode() for t in texts])
                spans = [codec.spans(t, x) for t, x in zip(texts, found, strict=True)]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (found, [x for x, _ in spans], [x for _, x in spans])]
                decoded = [codec.library.decode(x.tolist()) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists, pa.array(decoded, pa.string())], names)
        release_memory()

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(encode, f"{id_col} {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of encoded texts, spans_sha256 and the source bytes that the pieces cover.

    ``spans_sha256`` is of all first bytes joined by commas, a semicolon, and all ends likewise.
    """
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat_ws(";", joined("begins"), joined("ends")), 256).alias("spans_sha256"),
        # Pieces follow each other, and those of one character share its bytes.
        F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("begins", F.lit(1)), F.lit(0)).cast("long").alias("covered_bytes"),
    )
