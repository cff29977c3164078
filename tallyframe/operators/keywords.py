"""Keyword automata over texts, and what they tell: the platform or the document type of a row.

A catalogue's words are compiled to one Aho-Corasick automaton per worker, which
reads each text once and reports every occurrence, overlapping ones and words
within words too. A word that two labels list belongs to the later one. What
the hits amount to is column arithmetic.

Null and empty texts have no hits. A catalogue is configuration, at most
`MOST_WORDS` words; a longer one is refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogs import Label

MOST_WORDS = 200_000
#: Texts whose hits are Python objects at the same time.
TEXTS = 64
#: Rows of a batch of totals.
BATCH = 10_000
HITS = "array<struct<label:string,word:string,hits:int,first:int>>"
_HIT = pa.struct([("label", pa.string()), ("word", pa.string()), ("hits", pa.int32()), ("first", pa.int32())])


@lru_cache(maxsize=8)
def automaton(words: tuple[tuple[str, str], ...]):
    """The automaton of (word, label) pairs, once per worker."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, label in words:
        made.add_word(word, (word, label))
    made.make_automaton()
    return made


def owners(labels: Iterable[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """(word, label) of lower-cased words, empty ones left out; of a word that several labels list the last one."""
    owned = {word.lower(): label for label, word in labels if word}
    if len(owned) > MOST_WORDS:
        raise ValueError(f"a catalogue of more than {MOST_WORDS} words")
    return tuple(owned.items())


def found_words(text: str, words: tuple[tuple[str, str], ...]) -> list[dict]:
    """Each word that occurs: its label, number of occurrences and the end of the first, by that end, longer words first."""
    if not text or not words:
        return []
    found: dict[str, dict] = {}
    for end, (word, label) in automaton(words).iter(text.lower()):
        if (hit := found.get(word)) is None:
            found[word] = {"label": label, "word": word, "hits": 1, "first": end}
        else:
            hit["hits"] += 1
    return list(found.values())


def keyword_hits(text: Column, labels: Iterable[tuple[str, str]]) -> Column:
    """array of struct(label, word, hits, first) of the words of (label, word) pairs in a text, in the order of first sight."""
    words = owners(labels)

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        # as Arrow after every few texts: hits of long texts as Python objects take several times the memory
        parts = [pa.array([found_words(t, words) for t in texts[at : at + TEXTS].to_pylist()], pa.list_(_HIT)) for at in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_HIT))

    return hits(text.cast("string"))


def word_totals(texts: DataFrame, text: str, labels: Iterable[tuple[str, str]]) -> DataFrame:
    """(label, word, n_docs, hits): the texts that hold each word, and its occurrences. A task holds two counts for each word, whatever its texts."""
    words = owners(labels)

    def run(batches):
        n_docs, hits = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid and words:
                    here = Counter(pair for _, pair in automaton(words).iter(t.as_py().lower()))
                    hits.update(here)
                    n_docs.update(here.keys())
        found = list(hits)
        for at in range(0, len(found), BATCH):
            some = found[at : at + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in some], pa.string()), pa.array([x[0] for x in some], pa.string()), pa.array([n_docs[x] for x in some], pa.int64()), pa.array([hits[x] for x in some], pa.int64())], names=["label", "word", "n_docs", "hits"])

    each = texts.select(F.col(text).cast("string")).mapInArrow(run, "label string, word string, n_docs bigint, hits bigint")
    return each.groupBy("label", "word").agg(F.sum("n_docs").alias("n_docs"), F.sum("hits").alias("hits"))


def label_hits(hits: Column) -> Column:
    """array of struct(label, hits) in the order of first sight; `hits` must be a column that is made already."""
    labels = F.array_distinct(F.transform(hits, lambda h: h["label"]))
    count = lambda label: F.aggregate(F.filter(hits, lambda h: h["label"] == label), F.lit(0), lambda n, h: n + h["hits"])
    return F.transform(labels, lambda label: F.struct(label.alias("label"), count(label).alias("hits")))


def best_hit(counted: Column) -> Column:
    """The entry with most hits, the first of equal ones; null if there is none."""
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("hits"))
    best = F.aggregate(counted, none, lambda best, h: F.when(h["hits"] > best["hits"], h).otherwise(best))
    return F.when(F.size(counted) > 0, best)


def _table(labels: list[Label], value) -> Column:
    return F.create_map(*(x for label in labels for x in (F.lit(label.id), value(label))))


def detect_platform(df: DataFrame, text: Column, fields: Column, labels: list[Label]) -> DataFrame:
    """df with struct `platform`: name, confidence, method, indicators and category, told from a row's text and its field names.

    Confidence: one less the entropy of the hits over the labels, divided by the
    number of labels; a tenth for each hit of the best one, at most .95 in all; a
    tenth for each of its field patterns in a field name; times its weight, at
    most 1. Without hits: unknown, 0.1.
    """
    hit, counts = "__hits", "__counts"
    while hit in df.columns or counts in df.columns:
        hit, counts = f"_{hit}", f"_{counts}"
    held = df.withColumn(hit, keyword_hits(text, [(label.id, w) for label in labels for w in label.words])).withColumn(counts, label_hits(F.col(hit)))
    counted = F.col(counts)
    total = F.aggregate(counted, F.lit(0), lambda n, h: n + h["hits"])
    share = lambda h: h["hits"].cast("double") / total
    entropy = F.aggregate(counted, F.lit(0.0), lambda e, h: e - share(h) * F.log2(share(h)))
    best = best_hit(counted)
    base = F.least(1 - entropy / F.greatest(F.size(counted), F.lit(1)) + best["hits"] * 0.1, F.lit(0.95))
    patterns = _table(labels, lambda label: F.array(*map(F.lit, label.field_patterns)))[best["label"]]
    names = F.transform(F.coalesce(fields, F.array().cast("array<string>")), F.lower)
    matched = F.size(F.filter(patterns, lambda p: F.exists(names, lambda n: n.contains(p))))
    confidence = F.least((base + matched * 0.1) * _table(labels, lambda label: F.lit(label.boost))[best["label"]], F.lit(1.0))
    known = F.struct(
        _table(labels, lambda label: F.lit(label.name))[best["label"]].alias("name"),
        confidence.alias("confidence"),
        F.lit("pattern_ahocorasick").alias("method"),
        F.array_sort(F.transform(hit, lambda h: h["word"])).alias("indicators"),
        _table(labels, lambda label: F.lit(label.category))[best["label"]].alias("category"),
    )
    unknown = F.struct(F.lit("unknown").alias("name"), F.lit(0.1).alias("confidence"), F.lit("fallback").alias("method"), F.array().cast("array<string>").alias("indicators"), F.lit("unknown").alias("category"))
    return held.withColumn("platform", F.when(F.size(counted) > 0, known).otherwise(unknown)).drop(hit, counts)


def combine(first: Column, second: Column) -> Column:
    """Two results (struct name, confidence, method, indicators, category) as one: the first one's name, .7 and .3 of the confidences, all indicators."""
    return F.struct(
        first["name"].alias("name"),
        (first["confidence"] * 0.7 + second["confidence"] * 0.3).alias("confidence"),
        F.lit("combined").alias("method"),
        F.array_sort(F.array_union(first["indicators"], second["indicators"])).alias("indicators"),
        first["category"].alias("category"),
        first["confidence"].alias("first_confidence"),
        second["confidence"].alias("second_confidence"),
    )


#: Terms of a text: stretches of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def fit_profiles(profiles: DataFrame) -> DataFrame:
    """A TF-IDF model of (label, text) rows: term, idf, label, weight.

    idf is ln((1 + n) / (1 + df)) + 1 over the n profiles; a label's weights are
    its counts times idf, scaled to length 1. The model is a table: write it, and
    read it where it is applied.
    """
    counts = profiles.select("label", F.explode(terms(F.col("text"))).alias("term")).groupBy("label", "term").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).join(profiles.agg(F.count("*").alias("n"))).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    length = raw.groupBy("label").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, "label").select("term", "idf", "label", (F.col("raw") / F.col("length")).alias("weight"))


def profile_cosines(docs: DataFrame, key: str, text: Column, model: DataFrame) -> DataFrame:
    """(key, label, cosine) of each document and each label that it shares a term with. `key` must tell rows apart.

    Documents' terms are counted once per document; only those of the model meet it, so a label's rows stay few.
    """
    idf = model.select("term", "idf").distinct()
    held = docs.select(F.col(key).alias("key"), F.explode(terms(text)).alias("term")).join(idf, "term")
    weighed = held.groupBy("key", "term").agg((F.count("*") * F.first("idf")).alias("raw"))
    length = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    dot = weighed.join(model.select("term", "label", "weight"), "term").groupBy("key", "label").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    return dot.join(length, "key").select(F.col("key").alias(key), "label", (F.col("dot") / F.col("length")).alias("cosine"))


def classify_documents(docs: DataFrame, key: str, text: Column, labels: list[Label], model: DataFrame) -> DataFrame:
    """(key, document_type, confidence, category, n_words) of every document; type unknown, 0.1 where no word of the catalogue occurs.

    The type is the profile of the largest cosine (earlier labels first, the first
    one if no term is shared); .6 of it and .06 for each hit of that type's words,
    at most 1, is the confidence.
    """
    place, known = _table(labels, lambda label: F.lit([x.id for x in labels].index(label.id))), {label.id: label for label in labels}
    rows = docs.select(F.col(key).alias("key"), text.alias("text"))
    cosines = profile_cosines(rows, "key", F.col("text"), model)
    best = cosines.groupBy("key").agg(F.max_by(F.struct("label", "cosine"), F.struct(F.round("cosine", 12), -place[F.col("label")])).alias("best"))
    hits = rows.select("key", keyword_hits(F.col("text"), [(label.id, w) for label in labels for w in label.words]).alias("found")).select("key", label_hits(F.col("found")).alias("hits"))
    joined = hits.join(best, "key", "left").withColumn("type_id", F.coalesce(F.col("best.label"), F.lit(labels[0].id)))
    own = F.aggregate(F.filter("hits", lambda h: h["label"] == F.col("type_id")), F.lit(0), lambda n, h: n + h["hits"])
    score = F.least(F.coalesce(F.col("best.cosine"), F.lit(0.0)) * 0.6 + own * 0.15 * 0.4, F.lit(1.0))
    some = F.size("hits") > 0
    return joined.select(
        F.col("key").alias(key),
        F.when(some, _table(labels, lambda label: F.lit(known[label.id].name))[F.col("type_id")]).otherwise("unknown").alias("document_type"),
        F.when(some, score).otherwise(0.1).alias("confidence"),
        F.when(some, _table(labels, lambda label: F.lit(known[label.id].category))[F.col("type_id")]).otherwise("unknown").alias("category"),
        F.aggregate("hits", F.lit(0), lambda n, h: n + h["hits"]).alias("n_words"),
    )
