"""Byte-level BPE as a sentencepiece model made straight from a rank file.

Each of the 256 bytes stands for one character, each vocabulary entry becomes
a piece scored by its negative rank, and the normaliser is the identity. The
best-scoring merge is then the merge of lowest rank, so sentencepiece makes
the merges of the rank file. Pre-tokens are encoded separately; decoding looks
the pieces up and maps characters back to bytes.

Null text counts as empty; an empty text has no ids. Ids outside the
vocabulary are an error in `decode`; a null list decodes to null.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .tokens import int_lists, slices, small_batches

#: A byte b is written as the character of this code point plus b.
BYTE_BASE = 0x4E00
#: Types of pieces and of models in a sentencepiece model file.
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Pre-tokens kept per worker before the memo starts anew; longer ones than LONGEST are never kept.
MEMO_PIECES, LONGEST = 250_000, 64
#: Bytes of text encoded at a time, and rows decoded at a time.
SLICE, STEP = 2 << 20, 500


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def to_chars(raw: bytes) -> str:
    return (np.frombuffer(raw, dtype=np.uint8).astype("<u2") + BYTE_BASE).tobytes().decode("utf-16-le")


def to_bytes(chars: str) -> bytes:
    return bytes([ord(c) - BYTE_BASE for c in chars])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def pieces_of(ranks: dict[bytes, int]) -> list[tuple[str, float]]:
    """(piece, score) of each id."""
    by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    return [(to_chars(token), -float(rank)) for token, rank in by_rank]


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes last."""
    pieces = [(piece, score, NORMAL) for piece, score in pieces_of(ranks)] + [("<unk>", 0.0, UNKNOWN)]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, score) + _field(3, kind)) for p, score, kind in pieces)
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class PieceCodec:
    """Encodes through a bounded memo of pre-tokens, and decodes; one per worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens; one that is itself an entry is one token, merges or not."""
        found, rest = {}, []
        for piece in pieces:
            if (whole := self.ranks.get(piece.encode("utf-8"))) is None:
                rest.append(piece)
            else:
                found[piece] = struct.pack("<i", whole)
        raw = [piece.encode("utf-8") for piece in rest]
        chars, at, shown = to_chars(b"".join(raw)), 0, []
        for r in raw:
            shown.append(chars[at : (at := at + len(r))])
        for piece, ids in zip(rest, self.model.encode(shown, out_type=int, num_threads=1) if rest else [], strict=True):
            found[piece] = struct.pack(f"<{len(ids)}i", *ids)
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        if len(self.known) > MEMO_PIECES:
            self.known.clear()
        split_up = [self.split(t) for t in texts]
        looked_up = [list(map(self.known.get, pieces)) for pieces in split_up]
        lacking = [i for i, ids in enumerate(looked_up) if None in ids]
        missing = {p for i in lacking for p, ids in zip(split_up[i], looked_up[i], strict=True) if ids is None}
        found = self.learn(missing)
        for i in lacking:
            looked_up[i] = [found[p] if ids is None else ids for p, ids in zip(split_up[i], looked_up[i], strict=True)]
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        return list(map(b"".join, looked_up))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> PieceCodec:
    return PieceCodec(path, pattern)


@lru_cache(maxsize=2)
def bytes_of_ids(path: str) -> list[bytes]:
    """What each id stands for: the inverse of the mapping from bytes to a piece's characters."""
    return [to_bytes(piece) for piece, _ in pieces_of(read_ranks(path))]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs but `text`, and the token ids of the whole text as an array of ints."""
    keep = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = codec(path, pattern).encode_batch
        for batch in slices(batches, text, SLICE):
            coded = int_lists(encode_batch([t or "" for t in batch.column(text).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), coded], names=[*keep, ids])

    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(text))
    schema = source.drop(text).schema.add(ids, ArrayType(IntegerType()))
    return source.transform(small_batches).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for in `out`."""
    keep = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of_ids(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                lists = [row.values for row in part.column(ids)]
                texts = [None if v is None else b"".join([table[i] for i in v.to_numpy(zero_copy_only=False).tolist()]) for v in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.binary())], names=[*keep, out])

    source = docs.select(*(F.col(f"`{c}`") for c in keep))
    return source.transform(small_batches).mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add(out, BinaryType()))
