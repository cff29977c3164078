"""Documents that hold passages of a benchmark: a set join of word windows, prefix-filtered by the rarest word.

An item's windows are its stretches of ten words (an item of fewer words is one
window). A document contains a window only if it contains each of its words, so
one word is a sufficient prefix, and the best one is the word that documents
hold least often, counted over all documents. Windows whose rarest word no
document has are dropped at once. Places of prefix words in documents are
joined with the windows that they stand for; the word's place in the window and
the window's length bound where the window can lie, and each place that is left
is verified, word by word, on the stretch of the window's size.

Everything is column arithmetic. Where the windows are small (checked in bytes)
they are broadcast and documents stay in place; otherwise documents' words are
written once and joined by shuffles, with the same result.

Words are stretches of letters, digits and non-ASCII characters, A-Z lower-cased.
Null and empty texts have no words. Rows that repeat a key are separate rows;
a null item id marks words but is not listed; items that repeat an id count once.
Empty tables give an empty result, or one without hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Tables

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of words up to which windows and their vocabulary are broadcast.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Distinct windows, each with the sorted ids of the items that have it."""
    own = items.select(items[key].alias("item"), words(items[text]).alias("words")).where(F.size("words") > 0)
    several = F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i: F.slice("words", i, size))
    each = own.select("item", F.explode(F.when(F.size("words") > size, several).otherwise(F.array("words"))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("id", F.monotonically_increasing_id())


def _small(table: DataFrame, strings: Column, limit: int) -> bool:
    """Whether the strings of a table, and 64 bytes for each row and string, stay below a limit."""
    total = table.agg(F.sum(F.aggregate(strings, F.lit(64).cast("bigint"), lambda n, s: n + F.octet_length(s.cast("string")) + 64))).first()[0]
    return (total or 0) <= limit


def prefixes(found: DataFrame, texts: DataFrame, tables: Tables, limit: int) -> DataFrame:
    """Windows with `token`, the word that documents hold least often, and `offset`, its first place in the window."""
    own = found.select("id", F.posexplode("window").alias("place", "word"))
    vocabulary = tables.write(own.select("word").distinct(), "vocabulary")
    held = texts.select(F.explode("words").alias("word"))
    if _small(vocabulary, F.array("word"), limit):
        held = held.join(F.broadcast(vocabulary), "word")
    counts = tables.write(held.groupBy("word").agg(F.count("*").alias("held")).join(vocabulary, "word"), "counts")
    rarest = own.join(counts, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "word", "place")).alias("rarest"))
    return found.join(rarest.where("rarest.held > 0"), "id").select("id", "window", "items", F.size("window").alias("length"), F.col("rarest.word").alias("token"), F.col("rarest.place").alias("offset"))


def _holds(at: Column) -> Column:
    """Whether the window lies around the place of its token, within the document and word by word."""
    start = at - F.col("offset")
    return F.when((start >= 0) & (start + F.col("length") <= F.size("words")), F.slice("words", start + 1, F.col("length")) == F.col("window")).otherwise(False)


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: the key, n_words, spans (start and end, in words, of all window occurrences, sorted) and items (ids whose windows occur)."""
    tables = Tables(docs.sparkSession)
    texts = docs.select(docs[key].alias("key"), words(docs[text]).alias("words"))
    found = tables.write(windows(items, item_key, item_text, size), "windows")
    found = tables.write(prefixes(found, texts, tables, limit), "prefixes")
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    place = F.when(F.col("id").isNotNull(), F.struct((F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("length")).alias("end")))
    total = [F.collect_set("place").alias("spans"), F.collect_set("items").alias("lists")]
    if _small(found, F.concat("window", F.col("items").cast("array<string>")), limit):
        tokens = [r["token"] for r in found.select("token").distinct().collect()]
        at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(tokens), i))) if tokens else F.array().cast("array<int>")
        places = rows.select("row", "key", "words", F.explode_outer(at).alias("at"))
        word = F.when(F.col("at").isNotNull(), F.col("words")[F.col("at")])
        hits = places.join(F.broadcast(found), (word == F.col("token")) & _holds(F.col("at")), "left")
        done = hits.select("row", "key", F.size("words").alias("n_words"), place.alias("place"), "items").groupBy("row", "key", "n_words").agg(*total)
    else:
        rows = tables.write(rows, "rows")
        fits = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("length") <= F.col("n_words"))
        places = rows.select("row", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "token"))
        candidates = places.join(found.select("id", "token", "offset", "length"), "token").where(fits).select("row", "id", "at")
        hits = candidates.join(rows.select("row", "words"), "row").join(found, "id").where(_holds(F.col("at"))).select("row", place.alias("place"), "items")
        done = rows.select("row", "key", F.size("words").alias("n_words")).join(hits.groupBy("row").agg(*total), "row", "left")
    none = F.array()
    return done.select(
        F.col("key").alias(key),
        "n_words",
        F.array_sort(F.coalesce("spans", none)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.coalesce("lists", none)))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("until"))

    def add(state: Column, span: Column) -> Column:
        n = state["n"] + F.greatest(span["end"] - F.greatest(span["start"], state["until"]), F.lit(0))
        return F.struct(n.cast("bigint").alias("n"), F.greatest(span["end"], state["until"]).alias("until"))

    return F.aggregate(spans, start, add, lambda state: state["n"])
