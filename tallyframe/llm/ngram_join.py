"""Similarity join of documents on the Jaccard similarity of their word n-grams.

Texts that have the same set of n-grams are one set. Each set's n-grams are
ordered rarest first and only its prefix is joined: two sets at or above the
threshold share an n-gram of both prefixes. Candidates pass a length filter, a
positional filter (the n-grams before a shared one bound what two sets can
have in common) and a suffix filter (n-grams counted over cells of their
hash), and each pair is verified once, on whole sets.

Texts are read and hashed once: a word is a 64-bit BLAKE2 hash of its bytes, an
n-gram a mix of its words' hashes, a set's name a 128-bit digest. Each task
writes the n-grams of a set it has not met before, and all later steps read
that table.

Rarity comes from a sketch of fixed size that counts the n-grams of all
sets by hash; it decides only the order, so a collision costs time and
never a pair. A prefix n-gram that very many sets share is not expanded into
all its pairs: its sets are first compared with one pivot each, links are
contracted into components, and only pairs that still lie in different
components, and whose sizes are close enough, are compared with each other.
Links within a component can thus remain unlisted; components and the classes
of equal sets are exact.

Null and empty texts have no n-grams and are linked with nothing, not even
each other. A text of fewer than n words is one n-gram, its whole sequence.
Rows that repeat a key are separate rows; a null key is never a component's
name if any other key is there. An empty table gives an empty result, and
extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import BROADCAST_ROWS, Tables
from .tokens import slices, small_batches

#: Slots of the frequency sketch, and slots in one row of it while it is summed.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 12
#: Cells of the suffix filter, one byte each; a full cell is no evidence against a pair.
CELLS = 256
#: Sets in a tile when sets of one pivot are compared with each other.
TILE = 512
#: Set digests that a task remembers so as not to write a set twice, word hashes that a worker keeps, and the longest word it keeps.
REMEMBERED, WORDS_KEPT, LONGEST_KEPT = 100_000, 100_000, 64
#: Bytes of text hashed at once.
SLICE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD, _GRAM = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _WORD
    x = x ^ (x >> np.uint64(29))
    x = x * _GRAM
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least percent / 100 over n-grams of `words` words."""

    words: int = 5
    percent: int = 80

    def overlap(self, total):
        """Least intersection of two linked sets whose sizes sum to total."""
        return -(-self.percent * total // (100 + self.percent))

    def prefix(self, size):
        """Length of a set's prefix."""
        return size - -(-self.percent * size // 100) + 1

    def size_class(self, n: F.Column) -> F.Column:
        """Sets whose sizes pass the length filter are in one class or in adjacent ones."""
        width = max(math.log(100 / self.percent) * 1.0001, 1e-9)
        return F.floor(F.log(n.cast("double")) / width).cast("bigint")


class WordHashes(dict):
    """64-bit hashes of words, the recent ones kept."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One store per worker."""
    return WordHashes()


def gram_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all texts in order, first of each text and the end)."""
    split = [t.translate(_LOWER).split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    total = int(n_words.sum())
    word = np.fromiter(map(word_hashes().__getitem__, chain.from_iterable(split)), np.uint64, total)
    first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
    gram = np.zeros(total, np.uint64)
    for i in range(words):
        shifted = np.zeros(total, np.uint64)
        shifted[: max(0, total - i)] = word[i:]
        gram = (gram ^ shifted) * _WORD + np.uint64(i + 1)
        gram ^= gram >> np.uint64(31)
    gram = _mix(gram)
    sets = []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if 0 < b - a < words:  # the whole sequence, unlike any n-gram
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = (h ^ w) * _GRAM + np.uint64(7)
            sets.append(h)
        else:
            sets.append(np.unique(gram[a : max(a, b - words + 1)]))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two int64 per set, from sums of two independent mixes; zeros for empty sets."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for i, salt in enumerate((np.uint64(0x632BE59BD9B4E019), np.uint64(0xE220A8397B1DCDAF))):
            out[some, i] = _mix(np.add.reduceat(_mix(grams ^ salt), first[some]) + salt)
    return out.view(np.int64)


def _cells(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many n-grams of each set fall into each cell, a byte each."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.bincount(owner * CELLS + (grams >> np.uint64(50)).astype(np.int64) % CELLS, minlength=(len(first) - 1) * CELLS)
    return [c.tobytes() for c in np.minimum(255, counts).reshape(-1, CELLS).astype("u1")]


def read_sets(docs: DataFrame, rule: Threshold, key: str, text: str) -> DataFrame:
    """(key, n, d1, d2, cells, grams): size and digest of each row's set; its cell counts and n-grams where the task met it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "__text", SLICE):
            grams, first = gram_sets([(t or "").encode() for t in batch.column("__text").to_pylist()], rule.words)
            digest = _digests(grams, first)
            if len(seen) > REMEMBERED:
                seen.clear()
            new = np.zeros(len(first) - 1, bool)
            for d in np.flatnonzero(np.diff(first)).tolist():
                if (mark := digest[d].tobytes()) not in seen:
                    seen.add(mark)
                    new[d] = True
            cells = [c if fresh else None for c, fresh in zip(_cells(grams, first), new.tolist(), strict=True)]
            sizes = np.diff(first)
            ends = np.concatenate([[0], np.cumsum(np.where(new, sizes, 0))]).astype(np.int32)
            held = pa.array(grams[np.repeat(new, sizes)].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends), held, mask=pa.array(~new))
            columns = [pa.array(sizes), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), pa.array(cells, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), *columns], names=["key", "n", "d1", "d2", "cells", "grams"])

    source = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    return source.transform(small_batches).mapInArrow(run, f"key {source.schema['__key'].dataType.simpleString()}, n bigint, d1 bigint, d2 bigint, cells binary, grams array<bigint>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and where each list begins and the last one ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy().view(np.uint64), offsets - offsets[0]


def rarity(sets: DataFrame) -> np.ndarray:
    """How often n-grams of each slot occur in all sets, on a logarithmic scale of one byte a slot."""
    rows = SKETCH // SKETCH_ROW

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            slots, n = np.unique((_flat(batch.column("grams"))[0] >> np.uint64(20)).astype(np.uint32) & np.uint32(SKETCH - 1), return_counts=True)
            seen[slots] += n.astype(np.uint32)
        slots = np.flatnonzero(seen)
        some = np.split(slots, np.flatnonzero(np.diff(slots // SKETCH_ROW)) + 1) if len(slots) else []
        # a row that is mostly empty goes as its slots and their counts, others whole
        few = [2 * len(own) < SKETCH_ROW for own in some]
        places = [(own % SKETCH_ROW).astype("<u2").tobytes() if sparse else b"" for own, sparse in zip(some, few, strict=True)]
        row = [int(own[0]) // SKETCH_ROW for own in some]
        counts = [seen[own if sparse else slice(r * SKETCH_ROW, (r + 1) * SKETCH_ROW)].astype("<u4").tobytes() for r, own, sparse in zip(row, some, few, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["row", "slots", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "slots", "counts")), strict=True):
                if row not in total:
                    total[row] = np.zeros(SKETCH_ROW, np.int64)
                total[row][np.frombuffer(slots, "<u2") if slots else slice(None)] += np.frombuffer(counts, "<u4")
        scaled = [np.minimum(255, np.round(8 * np.log2(1 + t))).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array(scaled, pa.binary())], names=["row", "level"])

    parts = sets.select("grams").transform(small_batches).mapInArrow(count, "row int, slots binary, counts binary").repartition("row")
    levels = {r["row"]: bytes(r["level"]) for r in parts.transform(small_batches).mapInArrow(add, "row int, level binary").collect()}
    return np.frombuffer(b"".join(levels.get(i, bytes(SKETCH_ROW)) for i in range(rows)), np.uint8)


def prefix_entries(sets: DataFrame, rule: Threshold, level) -> DataFrame:
    """(gram, n, at, d1, d2): the prefix of each set, rarest first. level: broadcast of rarity()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(level.value, np.uint8)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                grams, first = _flat(batch.column("grams"))
                levels = rare[(grams >> np.uint64(20)).astype(np.int64) & SKETCH - 1]
                sizes = np.diff(first)
                kept = np.array([rule.prefix(int(n)) for n in sizes], np.int64)
                out = [grams[a:b][np.argsort(levels[a:b], kind="stable")[:k]] for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), kept.tolist(), strict=True)]
                owner = np.repeat(np.arange(len(sizes)), kept)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept)
                columns = [pa.array(np.concatenate(out).view(np.int64)), pa.array(sizes[owner].astype(np.int32)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(pa.array(owner)) for c in ("d1", "d2"))], names=["gram", "n", "at", "d1", "d2"])

    return sets.select("grams", "d1", "d2").transform(small_batches).mapInArrow(run, "gram bigint, n int, at int, d1 bigint, d2 bigint")


def shared_entries(entries: DataFrame, rule: Threshold) -> DataFrame:
    """(d1, d2, p1, p2, near): the sets of each n-gram in several prefixes, with a pivot: the one that holds it earliest.

    A set that holds a shared n-gram early has few n-grams of its own, so it is
    close to the others. near: whether set and pivot pass the length and the
    positional filter at some shared n-gram. Reads each n-gram's entries in
    that order as a stream, and holds one row back between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # last row of the batch before, whose successor is not known yet
        joined, pivot = False, np.zeros(5, np.int64)  # whether the held row follows another of its n-gram, and that one's pivot

        def settle(rows: np.ndarray, final: bool) -> pa.RecordBatch:
            nonlocal held, joined, pivot
            follows = np.concatenate([[joined], rows[1:, 0] == rows[:-1, 0]])
            lead = np.maximum.accumulate(np.where(follows, -1, np.arange(len(rows))))
            pivots = np.where((lead >= 0)[:, None], rows[lead], pivot)
            several = follows | np.concatenate([follows[1:], [False]])
            held, joined, pivot = (None, False, pivot) if final else (rows[-1:], bool(follows[-1]), pivots[-1])
            take = np.flatnonzero(several[: len(rows) if final else len(rows) - 1])
            own, led = rows[take], pivots[take]
            at, n, p_at, p_n = own[:, 1], own[:, 2], led[:, 1], led[:, 2]
            reach = np.minimum(at, p_at) + np.minimum(n - at, p_n - p_at)  # before, at and after the shared n-gram
            near = (100 * np.minimum(n, p_n) >= rule.percent * np.maximum(n, p_n)) & (reach >= rule.overlap(n + p_n))
            columns = np.unique(np.concatenate([own[:, 3:], led[:, 3:], near[:, None]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(4)), pa.array(columns[:, 4] == 1)], names=["d1", "d2", "p1", "p2", "near"])

        for batch in batches:
            if batch.num_rows:
                rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "at", "n", "d1", "d2")], axis=1)
                yield settle(rows if held is None else np.concatenate([held, rows]), False)
        if held is not None:
            yield settle(held, True)

    dealt = entries.repartition("gram").sortWithinPartitions("gram", "at", "n", "d1", "d2")
    listed = dealt.select("gram", "at", "n", "d1", "d2").transform(small_batches).mapInArrow(run, "d1 bigint, d2 bigint, p1 bigint, p2 bigint, near boolean")
    return listed.groupBy("d1", "d2", "p1", "p2").agg(F.max("near").alias("near"))


def _side(sets: DataFrame, columns: list[str], s: str) -> DataFrame:
    return sets.select(F.col("d1").alias(f"{s}1"), F.col("d2").alias(f"{s}2"), *(F.col(c).alias(f"{s}_{c}") for c in columns))


PAIRS = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"


def _cells_pass(rule: Threshold, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether pairs with these cells and sizes pass the length and the suffix filter."""
    near = 100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)
    full = np.maximum(a.max(axis=-1), b.max(axis=-1)) == 255
    return near & (full | (np.minimum(a, b).sum(axis=-1, dtype=np.int64) >= rule.overlap(n + m)))


def close_pairs(pairs: DataFrame, light: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a1, a2, b1, b2) that pass the length and the suffix filter. light: (d1, d2, n, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, CELLS) for c in ("a_cells", "b_cells"))
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("a_n", "b_n"))
                batch = batch.filter(pa.array(_cells_pass(rule, a, b, n, m)))
            yield batch.select(["a1", "a2", "b1", "b2"])

    joined = pairs.join(_side(light, ["n", "cells"], "b"), ["b1", "b2"]).join(_side(light, ["n", "cells"], "a"), ["a1", "a2"])
    return joined.select("a1", "a2", "b1", "b2", "a_n", "b_n", "a_cells", "b_cells").transform(small_batches).mapInArrow(run, PAIRS)


def verified(sets: DataFrame, pairs: DataFrame, rule: Threshold, tables: Tables, name: str) -> DataFrame:
    """The pairs that reach the threshold on whole sets, each looked at once. pairs: a written table."""
    ends = F.explode(F.array(F.struct(F.col("a1").alias("d1"), F.col("a2").alias("d2")), F.struct(F.col("b1").alias("d1"), F.col("b2").alias("d2"))))
    wanted = tables.write(pairs.select(ends.alias("d")).select("d.d1", "d.d2").distinct(), f"{name}_wanted")
    few = wanted.count() <= BROADCAST_ROWS
    chosen = sets.select("d1", "d2", "grams").join(F.broadcast(wanted) if few else wanted, ["d1", "d2"], "left_semi")
    whole = tables.write(chosen.groupBy("d1", "d2").agg(F.first("grams").alias("grams")), f"{name}_sets")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    heavy = pairs.join(_side(whole, ["grams"], "b"), ["b1", "b2"]).join(_side(whole, ["grams"], "a"), ["a1", "a2"])
    counted = heavy.select("a1", "a2", "b1", "b2", (F.size("a_grams") + F.size("b_grams")).alias("total"), common.alias("common"))
    links = tables.write(counted.where(100 * F.col("common") >= rule.percent * (F.col("total") - F.col("common"))).select("a1", "a2", "b1", "b2"), name)
    tables.drop(f"{name}_wanted", f"{name}_sets")
    return links


def crossing_pairs(members: DataFrame, light: DataFrame, rule: Threshold, tables: Tables) -> DataFrame:
    """(a1, a2, b1, b2): pairs of one pivot's sets that lie in different components and pass the filters.

    members: (p1, p2, d1, d2, c1, c2), without the pivots themselves, whose pairs
    are decided already. Only sets of one size class or of adjacent ones can be
    linked, so a pivot's sets meet per class (role 0) with those of the class
    above (role 1). A class is dealt over tiles of about TILE sets; each pair of
    tiles is one group, so no task holds a whole pivot, and pairs that the
    filters reject are never rows.
    """
    sized = tables.write(members.join(light.select("d1", "d2", "n"), ["d1", "d2"]).withColumn("class", rule.size_class(F.col("n"))), "sized")
    named = F.struct("c1", "c2")
    per_class = sized.groupBy("p1", "p2", "class").agg(F.count("*").alias("m"), F.min(named).alias("low"), F.max(named).alias("high"))
    above = per_class.select("p1", "p2", (F.col("class") - 1).alias("class"), F.col("m").alias("m1"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    apart = (F.col("low") != F.col("high")) | (F.col("m1") > 0) & ((F.col("low") != F.col("low1")) | (F.col("high") != F.col("high1")))
    tiles = lambda m: F.ceil(F.coalesce(m, F.lit(0)) / TILE).cast("int")
    groups = per_class.join(above, ["p1", "p2", "class"], "left").where(apart).select("p1", "p2", F.col("class").alias("k"), tiles(F.col("m")).alias("t0"), tiles(F.col("m1")).alias("t1"))
    own = sized.withColumn("k", F.col("class")).withColumn("role", F.lit(0)).join(groups, ["p1", "p2", "k"])
    below = sized.withColumn("k", F.col("class") - 1).withColumn("role", F.lit(1)).join(groups, ["p1", "p2", "k"])
    dealt = own.unionByName(below).drop("class", "n").join(light, ["d1", "d2"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("d1", "d2"), F.when(F.col("role") == 0, F.col("t0")).otherwise(F.col("t1"))).cast("int"))
    places = F.expr(
        """CASE WHEN role = 0 THEN concat(
             transform(sequence(tile, t0 - 1), j -> named_struct('i', tile, 'above', 0, 'j', j, 'side', 0)),
             transform(slice(sequence(0, tile), 1, tile), i -> named_struct('i', i, 'above', 0, 'j', tile, 'side', 1)),
             transform(slice(sequence(0, t1), 1, t1), j -> named_struct('i', tile, 'above', 1, 'j', j, 'side', 0)))
           ELSE transform(slice(sequence(0, t0), 1, t0), i -> named_struct('i', i, 'above', 1, 'j', tile, 'side', 1)) END"""
    )
    keyed = dealt.withColumn("at", F.explode(places)).select("p1", "p2", "k", "at.i", "at.above", "at.j", "at.side", "d1", "d2", "c1", "c2", "n", "cells")

    def compare(table: pa.Table) -> pa.Table:  # one group
        side, n = table.column("side").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), "u1").reshape(-1, CELLS)
        ids, comp = (np.stack([table.column(c).to_numpy() for c in names], axis=1) for names in (("d1", "d2"), ("c1", "c2")))
        own = table.column("above")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()  # a tile with itself
        left = np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        found = [np.zeros((0, 4), np.int64)]
        for x in left.tolist():
            y = right[right > x] if own else right
            y = y[(comp[y] != comp[x]).any(axis=1) & (100 * np.minimum(n[y], n[x]) >= rule.percent * np.maximum(n[y], n[x]))]
            if len(y):
                y = y[_cells_pass(rule, cells[y], cells[x], n[y], n[x])]
                found.append(np.concatenate([np.repeat(ids[x : x + 1], len(y), axis=0), ids[y]], axis=1))
        pairs = np.concatenate(found)
        return pa.table([np.ascontiguousarray(pairs[:, c]) for c in range(4)], names=["a1", "a2", "b1", "b2"])

    return keyed.groupBy("p1", "p2", "k", "i", "above", "j").applyInArrow(compare, PAIRS)


def set_links(sets: DataFrame, light: DataFrame, rule: Threshold, tables: Tables) -> DataFrame:
    """(d1, d2, c1, c2) of each linked set: its component, named by the smallest digest in it.

    sets: (d1, d2, grams), a set perhaps more than once. light: (d1, d2, n, cells) of every set.
    """
    level = sets.sparkSession.sparkContext.broadcast(rarity(sets).tobytes())
    shared = tables.write(shared_entries(prefix_entries(sets, rule, level), rule).where("d1 != p1 OR d2 != p2"), "shared")
    star = shared.where("near").select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("d1").alias("b1"), F.col("d2").alias("b2"))
    links = verified(sets, tables.write(close_pairs(star, light, rule), "close"), rule, tables, "links")
    labels = tables.write(_labels(links), "labels")
    members = shared.select("p1", "p2", "d1", "d2").join(labels, ["d1", "d2"], "left").withColumn("c1", F.coalesce("c1", "d1")).withColumn("c2", F.coalesce("c2", "d2"))
    apart = tables.write(crossing_pairs(members, light, rule, tables).distinct(), "apart")
    tables.drop("shared", "close", "sized")
    if not apart.isEmpty():
        rest = verified(sets, apart, rule, tables, "crossing_links")
        if not rest.isEmpty():
            labels = tables.write(_labels(links.unionByName(rest)), "all_labels")
    tables.drop("apart", "links")
    return labels


def _labels(links: DataFrame) -> DataFrame:
    edges = links.select(F.struct(F.col("a1").alias("d1"), F.col("a2").alias("d2")).alias("a"), F.struct(F.col("b1").alias("d1"), F.col("b2").alias("d2")).alias("b"))
    found = components(edges)
    return found.select("vertex.d1", "vertex.d2", F.col("component.d1").alias("c1"), F.col("component.d2").alias("c2"))


def near_duplicates(docs: DataFrame, rule: Threshold = Threshold(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key that links reach.

    The key may be a struct. Joins of rows with their sets leave a set that a
    large share of rows have to Spark's skew join.
    """
    tables = Tables(docs.sparkSession)
    read = tables.write(read_sets(docs, rule, key, text), "read")
    sets = read.where("grams IS NOT NULL")
    rows = tables.write(read.select("key", "n", "d1", "d2"), "rows")
    light = tables.write(sets.groupBy("d1", "d2").agg(F.first("n").alias("n"), F.first("cells").alias("cells")), "light")
    labels = set_links(sets.select("d1", "d2", "grams"), light, rule, tables)
    tables.drop("read", "light")
    named = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("low")).join(labels, ["d1", "d2"], "left")
    named = named.select("d1", "d2", "low", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"))
    least = named.groupBy("c1", "c2").agg(F.min("low").alias("least"))
    by_set = named.join(least, ["c1", "c2"]).select("d1", "d2", "least")
    joined = rows.where("n > 0").join(by_set, ["d1", "d2"]).select("key", "n", "least").unionByName(rows.where("n = 0").select("key", "n", F.col("key").alias("least")))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
