"""Exact duplicates through a cuckoo-filter index over text digests.

An index is a set of buckets, each a cuckoo filter in front of the bucket's
content: the full digests that are live, with their live count and largest
key. A digest that the filter has not seen is new. A hit is only a maybe and is
verified against the bucket's content, so false positives never merge texts.
When a filter overflows it is rebuilt at twice the size from the stored keys.
Deleting lowers a digest's live count and takes its fingerprint out of the
filter with the last live copy; an entry whose largest key may be gone is marked
stale, and refresh_keys() reads it anew.

Rows first pass through a small index of their own partition, so a text that
fills a third of the corpus reaches its bucket as one row per partition.

Texts are equal when their bytes are; null counts as the empty text. Of equal
texts the largest key stays. Rows that repeat a key and its text are reported
alike, and each counts in group_size. A null key is smaller than any other.
An empty table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import small_batches

#: Fingerprints in a slot group of the filter, and moves before it counts as full.
SLOTS, MOVES = 4, 200
#: Digests that a bucket should hold, and that a partition's own index holds before it is emptied.
BUCKET_DIGESTS, LOCAL_DIGESTS = 50_000, 200_000


class CuckooFilter:
    """A set of 16-bit fingerprints, each in one of two slot groups; 0 marks a free slot."""

    def __init__(self, groups: int):
        self.groups = groups  # a power of two
        self.cells = array("H", bytes(2 * SLOTS * groups))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "big") or 1
        first = int.from_bytes(digest[10:18], "big") & self.groups - 1
        return mark, first, self._other(first, mark)

    def _other(self, group: int, mark: int) -> int:
        return (group ^ mark * 0x5BD1E995) & self.groups - 1

    def _slot(self, group: int, mark: int) -> int:
        """Cell of the group that holds mark, or -1."""
        cells = self.cells
        for at in range(group * SLOTS, group * SLOTS + SLOTS):
            if cells[at] == mark:
                return at
        return -1

    def contains(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if the filter overflowed; it must then be rebuilt, as some fingerprint is without a place."""
        mark, a, b = self._places(digest)
        for group in (a, b):
            if (at := self._slot(group, 0)) >= 0:
                self.cells[at] = mark
                return True
        group = b
        for move in range(MOVES):
            at = group * SLOTS + move % SLOTS
            mark, self.cells[at] = self.cells[at], mark
            group = self._other(group, mark)
            if (free := self._slot(group, 0)) >= 0:
                self.cells[free] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for group in (a, b):
            if (at := self._slot(group, mark)) >= 0:
                self.cells[at] = 0
                return True
        return False


class DigestBucket:
    """A cuckoo filter before the live digests it stands for."""

    def __init__(self, groups: int = 64):
        self.filter = CuckooFilter(groups)
        self.content: dict[bytes, list] = {}

    def __len__(self) -> int:
        return len(self.content)

    def _verified(self, digest: bytes) -> list | None:
        return self.content.get(digest) if self.filter.contains(digest) else None

    def insert(self, digest: bytes, live: int, key, stale: bool = False) -> bool:
        """True if the digest is new to the bucket."""
        if (entry := self._verified(digest)) is not None:
            entry[0] += live
            entry[2] |= stale
            if entry[1] is None or key is not None and key >= entry[1]:
                entry[1] = key
            return False
        self.content[digest] = [live, key, stale]
        if not self.filter.insert(digest):
            self._grow()
        return True

    def _grow(self) -> None:
        groups = self.filter.groups
        while True:
            groups *= 2
            self.filter = CuckooFilter(groups)
            if all(map(self.filter.insert, self.content)):
                return

    def delete(self, digest: bytes, live: int = 1, key=None) -> bool:
        """Take out so many live copies, or all if there are fewer; True if any was there.

        The entry is stale from then on if its largest key may be among those taken out.
        """
        if (entry := self._verified(digest)) is None:
            return False
        entry[0] -= live
        entry[2] |= key is None or entry[1] is not None and key >= entry[1]
        if entry[0] <= 0:
            self.filter.delete(digest)
            del self.content[digest]
        return True

    def rows(self) -> tuple[list, ...]:
        return list(self.content), *([e[i] for e in self.content.values()] for i in range(3))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest): SHA-256 of each whole text, as bytes."""
    return docs.select(F.col(f"`{key}`").alias(key), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)).alias("digest"))


def _entry_schema(kind: str) -> str:
    return f"digest binary, live bigint, key {kind}, stale boolean"


def _batch(bucket: DigestBucket, key_type: pa.DataType, extra: tuple = ()) -> pa.RecordBatch:
    digests, live, keys, stale = bucket.rows()
    columns = [pa.array(digests, pa.binary()), pa.array(live, pa.int64()), pa.array(keys, key_type), pa.array(stale, pa.bool_())]
    names = ["digest", "live", "key", "stale"]
    for name, value in extra:
        columns.append(pa.array([value] * len(digests), pa.int32()))
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names=names)


def partial_entries(prints: DataFrame, key: str) -> DataFrame:
    """(digest, live, key) merged within each partition, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, key_type = DigestBucket(1024), None
        for batch in batches:
            key_type = batch.column(0).type
            for k, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bucket.insert(digest, 1, k)
            if len(bucket) > LOCAL_DIGESTS:
                yield _batch(bucket, key_type)
                bucket = DigestBucket(1024)
        if len(bucket):
            yield _batch(bucket, key_type)

    return prints.select(F.col(f"`{key}`"), "digest").transform(small_batches).mapInArrow(run, _entry_schema(prints.schema[key].dataType.simpleString()))


def _bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), F.lit(buckets)).cast("int").alias("bucket")


def bucket_count(docs: DataFrame, per_bucket: int = BUCKET_DIGESTS) -> int:
    """Buckets for a corpus, by its number of rows."""
    return max(16, -(-docs.count() // per_bucket))


def build_index(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, digest, live, key, stale): one row per distinct text, its live copies and their largest key."""
    entries = partial_entries(fingerprints(docs, key, text), key)
    return merge_entries(entries.withColumn("op", F.lit("+")), buckets)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index after inserting and then deleting rows. Deletes of digests that are not live change nothing.

    Of a digest, as many copies go as are deleted, or all. Where a deleted key may
    have been the largest, the entry is stale until refresh_keys().
    """
    held = index.select("digest", "live", "key", "stale", F.lit("+").alias("op"))
    new = partial_entries(fingerprints(inserts, key, text), key).withColumn("op", F.lit("+"))
    gone = partial_entries(fingerprints(deletes, key, text), key).withColumn("op", F.lit("-"))
    return merge_entries(held.unionByName(new).unionByName(gone), buckets)


def refresh_keys(index: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index with the largest keys of stale entries read anew from docs, the rows that are live."""
    stale = index.where("stale").select("digest")
    live = partial_entries(fingerprints(docs, key, text).join(stale, "digest", "left_semi").select(key, "digest"), key)
    best = live.groupBy("digest").agg(F.max("key").alias("__best"))
    return index.join(best, "digest", "left").withColumn("key", F.when(F.col("stale"), F.col("__best")).otherwise(F.col("key"))).withColumn("stale", F.lit(False)).drop("__best")


def merge_entries(entries: DataFrame, buckets: int) -> DataFrame:
    """Runs "+" and then "-" rows through the filter of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, key_type = None, DigestBucket(), None
        for batch in batches:
            key_type = batch.schema.field("key").type
            for b, digest, live, key, stale, op in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "live", "key", "stale", "op")), strict=True):
                if b != now:
                    if len(bucket):
                        yield _batch(bucket, key_type, (("bucket", now),))
                    now, bucket = b, DigestBucket()
                if op == "+":
                    bucket.insert(digest, live, key, stale)
                else:
                    bucket.delete(digest, live, key)
        if len(bucket):
            yield _batch(bucket, key_type, (("bucket", now),))

    kind = entries.schema["key"].dataType.simpleString()
    dealt = entries.select(_bucket_of(buckets), "digest", "live", "key", "stale", "op").repartition("bucket").sortWithinPartitions("bucket", "op")
    return dealt.transform(small_batches).mapInArrow(run, f"{_entry_schema(kind)}, bucket int")


def filter_table(index: DataFrame) -> DataFrame:
    """(bucket, groups, cells): each bucket's filter alone, to screen batches without reading content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, DigestBucket()
        out: list[tuple] = []
        for batch in batches:
            for b, digest in zip(batch.column("bucket").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if b != now:
                    if now is not None:
                        out.append((now, bucket.filter.groups, bucket.filter.cells.tobytes()))
                    now, bucket = b, DigestBucket()
                bucket.insert(digest, 1, None)
        if now is not None:
            out.append((now, bucket.filter.groups, bucket.filter.cells.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "groups", "cells"])

    return index.select("bucket", "digest").repartition("bucket").sortWithinPartitions("bucket").transform(small_batches).mapInArrow(run, "bucket int, groups bigint, cells binary")


def look_up(index: DataFrame, filters: DataFrame, docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, live): rows of docs whose text is live in the index; only filter hits are verified against content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, screen = None, None
        for batch in batches:
            keep = []
            for b, groups, cells, digest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "groups", "cells", "digest")), strict=True):
                if digest is None:  # the filter's own row comes first
                    now, screen = b, CuckooFilter(groups)
                    screen.cells = array("H", cells)
                keep.append(digest is not None and b == now and screen.contains(digest))
            hits = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([hits.column(key), hits.column("digest")], names=[key, "digest"])

    prints = fingerprints(docs, key, text).select(_bucket_of(buckets), "digest", key)
    both = filters.withColumn("digest", F.lit(None).cast("binary")).unionByName(prints, allowMissingColumns=True)
    hits = both.repartition("bucket").sortWithinPartitions("bucket", F.col("digest").asc_nulls_first()).transform(small_batches).mapInArrow(run, prints.select(key, "digest").schema)
    return hits.join(index.select("digest", "live"), "digest").select(key, "live")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, keep_id, group_size, kept and text_sha256."""
    index = build_index(docs, bucket_count(docs), key, text)
    return (
        fingerprints(docs, key, text)
        .join(index.select("digest", F.col("live").alias("group_size"), F.col("key").alias("keep_id")), "digest")
        .select(key, "keep_id", "group_size", F.col(f"`{key}`").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )
