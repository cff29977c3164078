"""Packing token pieces into sequences by minimum bin slack.

Every document is cut into pieces of at most `capacity` tokens. Which lengths
go together is decided on the histogram of piece lengths, which has at most
`capacity` rows however large the corpus is: each window takes the longest
length left, a subset-sum over a bitset of reachable totals finds the multiset
of remaining lengths that fills it closest to capacity, and the counts traced
back are used for as many windows as the histogram allows. Pieces then look
up their window by their number among the pieces of their length.

Null text counts as empty and is a piece of its end token. Repeated rows are
pieces of their own. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .ranking import numbered
from .store import Tables, materialise
from .tokens import encoder, int_lists, slices, small_batches


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to room from below.

    Bit s of `reached` is set if some multiset sums to s. Counts go in by powers
    of two, and the bitset before each such item is kept to trace back.
    """
    reached, trail = 1, []
    within = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0 and not reached >> room & 1:
            some = min(some, left)
            trail.append((length, some, reached))
            reached |= reached << length * some & within
            left -= some
            some *= 2
        if reached >> room & 1:
            break
    total, used = reached.bit_length() - 1, {}
    for length, some, before in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + some
            total -= length * some
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first piece, pieces, per window, first window, offset): which pieces of a length go where."""
    left = {length: n for length, n in histogram.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    rows, window = [], 0
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        chosen = fill({k: n for k, n in rest.items() if k <= capacity - longest}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, taken[length], n * times, n, window, offset))
            taken[length] += n * times
            left[length] -= n * times
            offset += length * n
            if not left[length]:
                del left[length]
        window += times
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens[, ids]) of each piece of each document."""
    source = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<i4")
        for batch in slices(batches, "__text"):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, found in enumerate(encode([t or "" for t in batch.column("__text").to_pylist()])):
                whole = np.concatenate([found, end]).tobytes()
                n = len(whole) // 4
                for at in range(0, n, capacity):
                    piece = whole[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if keep_ids:
                        ids.append(piece)
            columns = [batch.column(key).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays([*columns, *([int_lists(ids)] if keep_ids else [])], names=names)

    kind = source.schema[key].dataType.simpleString()
    return source.transform(small_batches).mapInArrow(run, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids)


def place_pieces(pieces: DataFrame, capacity: int, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset. `pieces` is read twice and should be a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_windows(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for length in histogram:
        by_length[length] = np.array([r[1:] for r in plan if r[0] == length], dtype=np.int64)
    ordered = numbered(pieces.withColumn("__tie", F.monotonically_increasing_id()), ["length"], [key, "start", "ids_crc32", "__tie"], Tables(pieces.sparkSession), "pieces", "__number", parts=parts)
    kept = pieces.columns
    names = [*kept, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("__number").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                these, rows = lengths == length, by_length[int(length)]
                row = rows[np.searchsorted(rows[:, 0], numbers[these], side="right") - 1]
                nth = numbers[these] - row[:, 0]
                sequence[these] = row[:, 3] + nth // row[:, 2]
                offset[these] = row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=names)

    return ordered.select(*(f"`{c}`" for c in kept), "__number").transform(small_batches).mapInArrow(run, pieces.schema.add("sequence_id", LongType()).add("offset", LongType()))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset, gapless within a sequence."""
    return place_pieces(materialise(cut_pieces(docs, tokenizer, capacity, end_id, key, text, keep_ids), "pieces"), capacity, key)


def sequences(packed: DataFrame, capacity: int, pad_id: int) -> DataFrame:
    """(sequence_id, ids) of packed pieces that kept their ids, each padded to capacity."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    joined = packed.groupBy("sequence_id").agg(ordered.alias("ids"))
    return joined.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))))
