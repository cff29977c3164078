"""Duplicate files and rows, content fingerprints, delta merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import tokens
from .lineage_cut import written


def newest_of_equal(df: DataFrame, keys: list[str], order: list[Column], n: int = 10) -> DataFrame:
    """Rows that share their keys with another, the newest n of each group."""
    group = Window.partitionBy(*keys)
    return df.select("*", F.count("*").over(group).alias("copies"), F.row_number().over(group.orderBy(*order)).alias("nth")).where((F.col("copies") > 1) & (F.col("nth") <= n))


def first_of_equal(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def content_fingerprint(text: Column) -> Column:
    """Equal for texts of the same words in any order."""
    return F.sha2(F.array_join(tokens(text), " "), 256)


def delta(existing: DataFrame, new: DataFrame, sheet: str, row_hash: str) -> DataFrame:
    """Per sheet: rows only in new, only in existing, in both; similarity; what to do.

    One full join on (sheet, hash) of distinct hashes gives all three counts.
    """
    keys = [sheet, row_hash]
    joined = existing.select(*keys).distinct().withColumn("a", F.lit(1)).join(new.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    counts = joined.groupBy(sheet).agg(F.count_if(F.col("a").isNull()).alias("new_rows"), F.count_if(F.col("b").isNull()).alias("removed_rows"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common_rows"))
    similarity = F.col("common_rows") / (F.col("common_rows") + F.col("removed_rows") + F.col("new_rows"))
    advice = F.when((F.col("new_rows") == 0), "skip").when(F.col("common_rows") == 0, "append").when(similarity > 0.5, "merge_intelligent").otherwise("merge_new_only")
    return counts.select("*", F.round(similarity, 6).alias("similarity"), advice.alias("recommendation"))


def rows_to_append(existing: DataFrame, new: DataFrame, row_hash: str) -> DataFrame:
    return new.join(existing.select(row_hash), row_hash, "left_anti")


def sheet_overlap(a: DataFrame, b: DataFrame, sheet: str, row_hash: str) -> DataFrame:
    """Whether each sheet's set of row hashes is the same on both sides.

    Compared by count and sums of hashes, which are combined before the shuffle; no set is collected.
    """

    def prints(df: DataFrame, s: str) -> DataFrame:
        held = df.select(sheet, row_hash).distinct()
        return held.groupBy(sheet).agg(F.count("*").alias(f"{s}n"), F.sum(F.xxhash64(row_hash).cast("decimal(38,0)")).alias(f"{s}x"), F.sum(F.hash(row_hash).cast("bigint")).alias(f"{s}h"))

    same = F.col("an").eqNullSafe(F.col("bn")) & F.col("ax").eqNullSafe(F.col("bx")) & F.col("ah").eqNullSafe(F.col("bh"))
    return prints(a, "a").join(prints(b, "b"), sheet, "full").select(sheet, same.alias("identical"), F.coalesce("an", F.lit(0)).alias("rows_a"), F.coalesce("bn", F.lit(0)).alias("rows_b"))


def first_alike(rows: DataFrame, group: list[str], key: str, text: str, least: float) -> DataFrame:
    """(group columns, key, first, similarity): for each row the earlier row of its group whose words are most like its own, by `least` or more; of equally like ones the first.

    Similarity is that of the sets of lower-cased words between white space, 1
    for equal sets; texts without words are like none. Every pair of sets is
    found, by the rarest words of each. Words of one set only are shared with no
    other, so sets of the same size and the same other words are one kind, and
    kinds are compared, not sets. Of a kind only the first set counts, as an
    earlier row.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")))
    held = rows.select(*group, F.col(key).alias("key"), words.alias("words")).where(F.size("words") > 0)
    sets = written(held.groupBy(*group, "words").agg(F.min("key").alias("first")), "sets")
    same = held.join(sets, [*group, "words"]).where("first < key").select(*group, "key", "first", F.lit(1.0).alias("similarity"))
    each = sets.select(*group, "first", F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = written(each.groupBy(*group, "word").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = each.join(counts, [*group, "word"]).groupBy(*group, "first", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("shared"))
    kept = written(shared.where(F.size("shared") >= F.ceil(F.col("size") * least)), "shared")  # fewer cannot be alike enough
    kinds = kept.groupBy(*group, "size", "shared").agg(F.min("first").alias("kind"), F.count("*").alias("sets"))
    kinds = written(kinds, "kinds")
    # of a set's rarest words, those of its own come first
    most = F.col("size") - F.ceil(F.col("size") * least) + 1 - (F.col("size") - F.size("shared"))
    rare = kinds.select(*group, "kind", "size", F.explode(F.slice("shared", F.lit(1), most.cast("int"))).alias("w")).select(*group, "kind", "size", F.col("w.word").alias("word"))
    a, b = rare.withColumnsRenamed({"kind": "ours", "size": "n"}), rare.withColumnsRenamed({"kind": "theirs", "size": "m"})
    met = a.join(b, [*group, "word"]).where((F.col("ours") != F.col("theirs")) & (F.least("n", "m") >= least * F.greatest("n", "m"))).select(*group, "ours", "theirs").distinct()
    ours = kinds.select(*group, F.col("kind").alias("ours"), F.col("size").alias("n"), F.col("shared").alias("x"))
    theirs = kinds.select(*group, F.col("kind").alias("theirs"), F.col("size").alias("m"), F.col("shared").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    pairs = met.join(ours, [*group, "ours"]).join(theirs, [*group, "theirs"]).withColumn("similarity", both / (F.col("n") + F.col("m") - both))
    within = kinds.where("sets > 1").select(*group, F.col("kind").alias("ours"), F.col("kind").alias("theirs"), (F.size("shared") / (2 * F.col("size") - F.size("shared"))).alias("similarity"))
    alike = written(pairs.select(*group, "ours", "theirs", "similarity").unionByName(within).where(F.col("similarity") >= least), "alike")
    member = kept.join(kinds.select(*group, "size", "shared", F.col("kind").alias("ours")), [*group, "size", "shared"]).select(*group, F.col("first").alias("key"), "ours")
    earlier = member.join(alike, [*group, "ours"]).where(F.col("theirs") < F.col("key"))
    best = earlier.groupBy(*group, "key").agg(F.min_by(F.struct("theirs", "similarity"), F.struct(-F.col("similarity"), "theirs")).alias("b"))
    return same.unionByName(best.select(*group, "key", F.col("b.theirs").alias("first"), "b.similarity"))
