"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, exact_dedup, license_scan, merkle, ngram_join, packing, periodic, pii, quality_mil, sharding, token_counts

Query = Callable[[SparkSession, str], DataFrame]

#: Key of the surrogates in these queries; a real corpus needs a secret one.
SURROGATE_KEY = b"tallyframe example key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), quality_mil.held_out()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = quality_mil.score(docs.select("doc_id", "text"), quality_mil.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op4_anisotropic_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k=20)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY, report=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.suffix_sums(histogram)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), shards=24)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    starts, base = F.col("base.word"), F.col("base.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("notices.label"))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("notices.coverage"), F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), ngram_join.Threshold(words=3, percent=90))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", decontamination.UPPER, decontamination.UPPER.lower())
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(*map(F.col, fields[:-1]), lowered))
    found = merkle.manifest(docs, fields, carry={"tampered": tampered})
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = F.array_join(F.transform("proof", lambda run: F.concat(run["left"], run["right"])), "")
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.occurrences(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        decontamination.covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, of which a tenth, by the CRC of the id, is made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    docs = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    docs = docs.withColumn("a", (F.col("g") % F.col("n")).cast("int")).withColumn("left", F.col("n") - F.col("a"))
    docs = docs.withColumn("p", F.expr("cast(1 + left div (3 + g % 8) AS int)"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.expr("cast((left + p - 1) div p AS int)"))), 1, F.col("left"))
    periodic = F.array_join(F.concat(F.slice("words", 1, F.col("a")), repeated), " ")
    return docs.select("doc_id", F.when(F.col("n").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(with_periods(documents(spark, sf_dir)))
    none = F.struct(*(F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period")))
    greater = lambda best, run: F.when(best["start"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    listed = F.transform("runs", lambda run: F.concat(run["start"].cast("string"), F.lit(","), run["length"].cast("string"), F.lit(","), run["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", F.aggregate("runs", none, greater))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_mil": op2_quality_mil,
    "op3_packing": op3_packing,
    "op4_anisotropic_mips": op4_anisotropic_mips,
    "op5_surrogates": op5_surrogates,
    "op6_token_counts": op6_token_counts,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_jump_shards": op8_jump_shards,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_join": op10_ngram_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_decontamination": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS g
                    FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT l FROM windows),
        places AS (SELECT r, k, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, lengths WHERE len(w) >= l)),
        hits AS (SELECT DISTINCT r, k, places.l, item_id FROM places JOIN windows ON places.l = windows.l AND places.g = windows.g),
        covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(k, k + l)) AS place FROM hits) GROUP BY r),
        listed AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
        SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(covered.n, 0) AS BIGINT) AS n_hit, cast(coalesce(listed.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)""",
}
