"""A stored MinHash index of texts by user: insert, query, remove, versions.

A text's set is its lower-cased words between white space; its signature holds
the least of 128 hashes each. Sixteen bands of eight slots make two sets of
similarity .8 meet with probability .95. The index is two tables:

* `bands`: a row per entry and band, in folders by a hash of (user, band, value);
* `log`: a row per insertion (with the signature) or removal, in folders by a hash of (user, key).

Both only grow, so a failed or repeated write does no harm: the newest version of
an entry counts, and band rows of other versions are passed over. A query reads
the folders of its own buckets only, joins on the whole bucket, and compares
signatures. `compact` rewrites what is live.

Empty and null texts have no words; they are logged but never found and find
nothing. A null user is a user of its own; rows with a null key are left out.
Of rows that repeat (user, key) in one insertion the one with the largest text counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage_cut import written

SLOTS, BANDS = 128, 16
ROWS = SLOTS // BANDS
#: Two standard deviations of an estimate near .8: so much below the threshold an estimate may be and still count.
SLACK = 0.07


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed=7) for i in range(SLOTS)], np.uint64)[:, None]


def signature_of(text: str | None) -> list[int] | None:
    """The least of each of the 128 hashes over a text's words, as signed integers."""
    words = set((text or "").lower().split())
    if not words:
        return None
    held, least = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.full((SLOTS, 1), ~np.uint64(0))
    for at in range(0, len(held), 1024):  # bounded memory for long texts
        x = held[None, at : at + 1024] ^ _seeds()
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1, keepdims=True))
    return least[:, 0].view(np.int64).tolist()


def signature(text: Column) -> Column:
    """array<bigint> of 128 slots; null for a text without words."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signature_of(t) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run(text.cast("string"))


def bands(signed: Column) -> Column:
    """array of struct(band, value): a hash of each eight slots."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice(signed, b * ROWS + 1, ROWS)).alias("value")))


def estimate(a: Column, b: Column) -> Column:
    """The share of slots that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / SLOTS


class LshIndex:
    """An index in a folder that all executors share; `parts` folders for each table."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _read(self, table: str, key_type: str) -> DataFrame:
        kinds = {"bands": "user string, band int, value bigint, key {}, version bigint, part int", "log": "user string, key {}, version bigint, live boolean, signature array<bigint>, part int"}
        return self.spark.read.schema(kinds[table].format(key_type)).parquet(f"{self.folder}/{table}")

    def _key_type(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/log").schema["key"].dataType.simpleString()

    def _part(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def version(self) -> int:
        """The newest version, 0 before the first insertion."""
        try:
            return self.spark.read.parquet(f"{self.folder}/log").agg(F.max("version")).first()[0] or 0
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0
            raise

    def _signed(self, rows: DataFrame, user: str, key: str, text: str) -> DataFrame:
        kept = rows.select(F.col(user).cast("string").alias("user"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        return kept.select("user", "key", signature(F.col("text")).alias("signature"))

    def insert(self, rows: DataFrame, user: str, key: str, text: str) -> int:
        """Adds or replaces entries; returns their version. Band rows are written first: without the log they are not read."""
        version = self.version() + 1
        one = rows.where(F.col(key).isNotNull()).groupBy(F.col(user).cast("string").alias("user"), F.col(key).alias("key")).agg(F.max(F.col(text).cast("string")).alias("text"))
        signed = written(self._signed(one, "user", "key", "text").withColumn("version", F.lit(version).cast("bigint")), "signed")
        own = signed.where("signature IS NOT NULL").select("user", F.explode(bands(F.col("signature"))).alias("b"), "key", "version").select("user", "b.*", "key", "version")
        self._append(own.withColumn("part", self._part("user", "band", "value")), "bands")
        self._append(signed.select("user", "key", "version", F.lit(True).alias("live"), "signature").withColumn("part", self._part("user", "key")), "log")
        return version

    def remove(self, rows: DataFrame, user: str, key: str) -> int:
        """Marks entries as gone from a new version on."""
        version = self.version() + 1
        gone = rows.where(F.col(key).isNotNull()).select(F.col(user).cast("string").alias("user"), F.col(key).alias("key")).distinct()
        marks = gone.select("user", "key", F.lit(version).cast("bigint").alias("version"), F.lit(False).alias("live"), F.lit(None).cast("array<bigint>").alias("signature"))
        self._append(marks.withColumn("part", self._part("user", "key")), "log")
        return version

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.folder}/{table}")

    def entries(self, version: int | None = None) -> DataFrame:
        """(user, key, version, signature) of what is live, now or at an earlier version."""
        log = self._read("log", self._key_type())
        log = log if version is None else log.where(F.col("version") <= version)
        newest = log.groupBy("user", "key").agg(F.max_by(F.struct("version", "live", "signature"), "version").alias("at"))
        return newest.where("at.live").select("user", "key", "at.version", "at.signature")

    def query(self, rows: DataFrame, user: str, key: str, text: str, least: float = 0.8, version: int | None = None, but_itself: bool = True) -> DataFrame:
        """(user, query, key, similarity) of the live entries of each row's user whose estimated similarity is `least` or more, or below it by SLACK at most."""
        asked = written(self._signed(rows, user, key, text).where("signature IS NOT NULL").withColumnRenamed("key", "query"), "asked")
        own = asked.select("user", "query", F.explode(bands(F.col("signature"))).alias("b")).select("user", "query", "b.*").withColumn("part", self._part("user", "band", "value"))
        touched = [r["part"] for r in own.select("part").distinct().collect()]  # at most self.parts
        held = self._read("bands", self._key_type()).where(F.col("part").isin(touched) if touched else F.lit(False))
        held = held if version is None else held.where(F.col("version") <= version)
        bucket = own["user"].eqNullSafe(held["user"]) & (own["part"] == held["part"]) & (own["band"] == held["band"]) & (own["value"] == held["value"])
        met = own.join(held, bucket).select(own["user"], "query", held["key"], held["version"])
        met = (met.where(~F.col("query").eqNullSafe(F.col("key"))) if but_itself else met).distinct()
        live = self.entries(version).withColumnRenamed("signature", "held")
        found = met.alias("m").join(live.alias("l"), F.col("m.user").eqNullSafe(F.col("l.user")) & (F.col("m.key") == F.col("l.key")) & (F.col("m.version") == F.col("l.version")))
        found = found.select("m.user", "m.query", "m.key", "held").alias("f").join(asked.alias("a"), F.col("f.user").eqNullSafe(F.col("a.user")) & F.col("f.query").eqNullSafe(F.col("a.query")))
        return found.select("f.user", "f.query", "f.key", estimate(F.col("held"), F.col("signature")).alias("similarity")).where(F.col("similarity") >= least - SLACK)

    def stats(self, version: int | None = None) -> DataFrame:
        """(user, n_entries) of live entries."""
        return self.entries(version).groupBy("user").agg(F.count("*").alias("n_entries"))

    def compact(self, folder: str) -> LshIndex:
        """A copy that holds only what is live, as its version 1."""
        other = LshIndex(self.spark, folder, self.parts)
        live = written(self.entries().withColumn("version", F.lit(1).cast("bigint")), "live")
        own = live.where("signature IS NOT NULL").select("user", F.explode(bands(F.col("signature"))).alias("b"), "key", "version").select("user", "b.*", "key", "version")
        other._append(own.withColumn("part", self._part("user", "band", "value")), "bands")
        other._append(live.select("user", "key", "version", F.lit(True).alias("live"), "signature").withColumn("part", self._part("user", "key")), "log")
        return other


def similar_pairs(rows: DataFrame, group: list[str], key: str, text: str, least: float) -> DataFrame:
    """Pairs (group columns, first, second, similarity) of rows of a group, first < second, that agree in a band and in `least` of the slots.

    Rows whose words are the same are one set: each is paired with the set's first row, and sets with each other by their first rows.
    """
    # a text is signed once, however many rows repeat it
    given = rows.select(*group, F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    once = given.groupBy(*group, "text").agg(F.min("key").alias("key"))
    texts = written(once.withColumn("signature", signature(F.col("text"))).where("signature IS NOT NULL").withColumn("print", F.xxhash64("signature")), "texts")
    firsts = written(texts.groupBy(*group, "print").agg(F.min_by(F.struct("key", "signature"), "key").alias("at")).select(*group, "print", "at.*"), "firsts")
    sets = given.join(texts.select(*group, "text", "print"), [*group, "text"])
    on = [*group, "print"]
    same = sets.select(*on, "key").join(firsts.select(*on, F.col("key").alias("first")), on).where("first < key").select(*group, "first", F.col("key").alias("second"), F.lit(1.0).alias("similarity"))
    own = firsts.select(*group, "key", F.explode(bands(F.col("signature"))).alias("b")).select(*group, "key", "b.*")
    met = own.withColumnRenamed("key", "first").join(own.withColumnRenamed("key", "second"), [*group, "band", "value"]).where("first < second").select(*group, "first", "second").distinct()
    both = met.join(firsts.select(*group, F.col("key").alias("first"), F.col("signature").alias("x")), [*group, "first"]).join(firsts.select(*group, F.col("key").alias("second"), F.col("signature").alias("y")), [*group, "second"])
    return same.unionByName(both.select(*group, "first", "second", estimate(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least))


def dropped_by_first(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """(key) of the rows that go when each row, in order, goes if it is paired with an earlier one that stays.

    In each round the rows without an undecided earlier partner are decided at
    once; a row goes as soon as one partner stays. Rounds are as many as the
    longest chain of pairs, and only pairs between undecided rows are kept.
    """
    open_pairs, out = written(pairs.select(F.col(first).alias("a"), F.col(second).alias("b")), "pairs"), None
    while not open_pairs.isEmpty():
        later = open_pairs.select("b").distinct()
        stay = open_pairs.select("a").distinct().join(later, F.col("a") == F.col("b"), "left_anti")
        go = written(open_pairs.join(stay, "a", "left_semi").select("b").distinct(), "go")
        out = go if out is None else out.unionByName(go)
        left = open_pairs.join(go, open_pairs["a"] == go["b"], "left_anti")
        open_pairs = written(left.join(go, "b", "left_anti"), "pairs")
    return (out if out is not None else open_pairs.select("b")).select(F.col("b").alias("key"))
