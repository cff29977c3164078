"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; its result is written as Parquet and read again by the next. All but the
last return the columns of documents. doc_id names a document: rows that
repeat an id with another text are kept or dropped by the rules of each stage
alone, and rows that repeat both id and text are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, ngram_join, packing, pii, quality_mil
from tallyframe.llm.queries import SURROGATE_KEY
from tallyframe.llm.store import materialise, without

#: Documents with a lower score are rejected.
QUALITY_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage-attention classifier does not reject; it learns from four folds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_mil.held_out())
    scored = quality_mil.score(docs, quality_mil.train(docs, labels), out="__score")
    return scored.where(F.col("__score") >= QUALITY_SCORE).select(*docs.columns)


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id; null counts as the empty text.

    Rows that repeat an id and its text are one document. Only ids and digests are shuffled, but for such rows.
    """
    found = materialise(exact_dedup.duplicates(docs).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"), "copies")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (_sha() == F.col("__sha"))
    repeated = materialise(found.where("kept").groupBy("__id", "__sha").count().where("count > 1").drop("count"), "repeated")
    gone = materialise(found.where("NOT kept").drop("kept").unionByName(repeated).distinct(), "gone")
    once = docs.join(repeated, same, "left_semi").withColumn("__sha", _sha()).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
    return without(docs, gone, same).unionByName(once)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar sets of five-word n-grams, the document with the smallest doc_id; null is larger than any.

    Documents that share an id are told apart by their texts.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _sha().alias("sha"))
    groups = ngram_join.near_duplicates(docs.select(row.alias("row"), "text"), ngram_join.Threshold(words=5, percent=80), key="row")
    gone = materialise(groups.where("component_id != row").select(F.col("row.doc_id").alias("__id"), F.col("row.sha").alias("__sha")), "near")
    return without(docs, gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (_sha() == F.col("__sha")))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    replaced = pii.pseudonymise(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else replaced


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("PII", surrogates),
    ("packing", pack),
]
#: SQL cannot express the classifier, the surrogates or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
