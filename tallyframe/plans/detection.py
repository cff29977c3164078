"""Queries over keyword automata, document models, edit distances and identifiers, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, edits, fields
from ..functions.catalogs import DOCUMENT_TYPES, PLATFORMS, Label
from ..operators import duplicates, entities, entity_store, keywords, lsh_index, platform_ids, row_pipeline
from ..operators.lineage_cut import own_folder, written
from ..sources.adapters import RELATIONSHIPS_SQL, ledger_events, relationships, table
from ..sources.records import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, row)) + ')' for row in rows)})"


def _pairs(labels: list[Label]) -> list[tuple[str, str]]:
    return [(label.id, w) for label in labels for w in label.words]


def _catalog_sql(labels: list[Label]) -> str:
    """The catalogue as tables: words with the label that owns them, labels in order, field patterns."""
    return ", ".join([
        _values("words", "word, label", [*keywords.owners(_pairs(labels))]),
        _values("labels", "label, place, name, category, boost", [(x.id, i, x.name, x.category, x.boost) for i, x in enumerate(labels)]),
        _values("patterns", "label, pattern", [(x.id, p) for x in labels for p in x.field_patterns]),
    ])


# Occurrences by replacement: equal to overlapping ones for words that do not overlap themselves in the text.
_COUNTED = "hits AS (SELECT key, label, word, (length(t) - length(replace(t, word, ''))) // length(word) AS n, strpos(t, word) + length(word) - 2 AS first FROM texts JOIN words ON contains(t, word))"

_ALL_WORDS = _pairs(PLATFORMS) + _pairs(DOCUMENT_TYPES)


@_query("keyword_hits", f"""WITH {_values("words", "word, label", [*keywords.owners(_ALL_WORDS)])}, texts AS (SELECT doc_id AS key, lower(text) AS t FROM documents), {_COUNTED}
 SELECT label, word, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS hits, CAST(min(first) AS INT) AS first FROM hits GROUP BY 1, 2""")
def keyword_hits(spark, sf_dir):
    """All platform and document words within all whole texts: documents and occurrences of each, and the earliest end of one."""
    found = table(spark, sf_dir, "documents").select(F.explode(keywords.keyword_hits(F.col("text"), _ALL_WORDS)).alias("h")).select("h.*")
    return found.groupBy("label", "word").agg(F.count("*").alias("n_docs"), F.sum("hits").alias("hits"), F.min("first").alias("first"))


@_query("benchmark_word_hits")
def benchmark_word_hits(spark, sf_dir):
    """Every word of the benchmark, wherever it stands within the whole texts of documents: documents and occurrences, overlapping ones too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(keywords.terms(F.col("text"))).alias("w")).distinct()
    listed = [("benchmark", r["w"]) for r in words.limit(keywords.MOST_WORDS + 1).collect()]  # a longer list is refused
    return keywords.word_totals(table(spark, sf_dir, "documents"), "text", listed).select("word", "n_docs", "hits")


_SHARES = """n AS (SELECT key, label, sum(n) AS n, min(first * 1000 - length(word)) AS seen FROM hits GROUP BY 1, 2),
 best AS (SELECT key, arg_min(label, (-n, seen)) AS label, max(n) AS n, sum(n) AS total, count(*) AS k FROM n GROUP BY 1),
 entropy AS (SELECT key, -sum(n.n / total * log2(n.n / total)) AS h FROM n JOIN best USING (key) GROUP BY 1)"""


@_query("platform_detection", f"""WITH {ctes("payloads")}, {_catalog_sql(PLATFORMS)}, texts AS (SELECT id AS key, lower(memo) AS t FROM payloads), {_COUNTED}, {_SHARES},
 fields AS (SELECT id AS key, count(DISTINCT pattern) AS m FROM (SELECT id, unnest(string_split(lower(field_names), ',')) AS f FROM payloads) JOIN best ON id = key JOIN patterns ON best.label = patterns.label AND contains(f, pattern) GROUP BY 1),
 listed AS (SELECT key, string_agg(word, ',' ORDER BY word) AS indicators FROM hits GROUP BY 1)
 SELECT id, coalesce(name, 'unknown') AS platform, coalesce(category, 'unknown') AS category, CASE WHEN best.label IS NULL THEN 'fallback' ELSE 'pattern_ahocorasick' END AS method, coalesce(indicators, '') AS indicators,
  round(CASE WHEN best.label IS NULL THEN 0.1 ELSE least((least(1 - h / k + best.n * 0.1, 0.95) + coalesce(m, 0) * 0.1) * boost, 1) END, 9) AS confidence
 FROM payloads LEFT JOIN best ON id = best.key LEFT JOIN entropy ON id = entropy.key LEFT JOIN labels ON best.label = labels.label LEFT JOIN fields ON id = fields.key LEFT JOIN listed ON id = listed.key""")
def platform_detection(spark, sf_dir):
    """The platform of every payload."""
    found = keywords.detect_platform(view(spark, sf_dir, "payloads"), F.col("memo"), F.split("field_names", ","), PLATFORMS)
    p = F.col("platform")
    return found.select("id", p["name"].alias("platform"), p["category"].alias("category"), p["method"].alias("method"), F.array_join(p["indicators"], ",").alias("indicators"), F.round(p["confidence"], 9).alias("confidence"))


@_query("platform_combined", f"""WITH d AS ({SQL["platform_detection"].replace("round(", "(").replace(", 9) AS", ") AS")}), t AS (SELECT d.*, user_id FROM d JOIN (SELECT o_orderkey AS id, o_custkey % 25 AS user_id FROM orders) USING (id))
 SELECT id, CASE WHEN user_id % 2 = 0 THEN 'Stripe' ELSE 'unknown' END AS platform, round(CASE WHEN user_id % 2 = 0 THEN 0.8 ELSE 0.1 END * 0.7 + confidence * 0.3, 9) AS confidence,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN user_id % 2 = 0 THEN ['user setting'] ELSE [] END, CASE WHEN indicators = '' THEN [] ELSE string_split(indicators, ',') END))), ',') AS indicators FROM t""")
def platform_combined(spark, sf_dir):
    """What a user's setting says of each payload's platform, blended with what the words say."""
    found = keywords.detect_platform(view(spark, sf_dir, "payloads"), F.col("memo"), F.split("field_names", ","), PLATFORMS)
    own = F.col("user_id") % 2 == 0
    told = F.struct(F.when(own, "Stripe").otherwise("unknown").alias("name"), F.when(own, 0.8).otherwise(0.1).alias("confidence"), F.when(own, F.array(F.lit("user setting"))).otherwise(F.array().cast("array<string>")).alias("indicators"), F.lit("payment_gateway").alias("category"))
    both = keywords.combine(told, F.col("platform"))
    return found.select("id", both.alias("b")).select("id", F.col("b.name").alias("platform"), F.round("b.confidence", 9).alias("confidence"), F.array_join("b.indicators", ",").alias("indicators"))


def document_model(spark: SparkSession) -> DataFrame:
    """The TF-IDF model of the document types, fitted on their words and field patterns."""
    return keywords.fit_profiles(spark.createDataFrame([(x.id, " ".join([*x.words, *x.field_patterns])) for x in DOCUMENT_TYPES], "label string, text string"))


_MODEL_SQL = rf"""profiles AS (SELECT label, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM (VALUES {', '.join(f"('{x.id}', {_quoted(' '.join([*x.words, *x.field_patterns]))})" for x in DOCUMENT_TYPES)}) p(label, text)),
 tf AS (SELECT label, term, count(*) AS tf FROM profiles GROUP BY 1, 2), idf AS (SELECT term, ln((1 + {len(DOCUMENT_TYPES)}) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 raw AS (SELECT label, term, idf, tf * idf AS w FROM tf JOIN idf USING (term)), model AS (SELECT label, term, idf, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS weight FROM raw)"""


def _classified_sql(source: str) -> str:
    return rf"""{_catalog_sql(DOCUMENT_TYPES)}, texts AS ({source}), {_COUNTED}, n AS (SELECT key, label, sum(n) AS n FROM hits GROUP BY 1, 2), {_MODEL_SQL},
 t AS (SELECT key, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM texts), own AS (SELECT key, term, count(*) * any_value(idf) AS w FROM t JOIN idf USING (term) GROUP BY 1, 2),
 size AS (SELECT key, sqrt(sum(w * w)) AS length FROM own GROUP BY 1), cosine AS (SELECT key, label, sum(w * weight) / any_value(length) AS c FROM own JOIN model USING (term) JOIN size USING (key) GROUP BY 1, 2),
 best AS (SELECT key, arg_min(label, (-round(c, 12), place)) AS label, arg_min(c, (-round(c, 12), place)) AS c FROM cosine JOIN labels USING (label) GROUP BY 1), words_of AS (SELECT key, sum(n) AS n FROM n GROUP BY 1)
 SELECT texts.key, CASE WHEN w.n IS NULL THEN 'unknown' ELSE name END AS document_type, CASE WHEN w.n IS NULL THEN 'unknown' ELSE category END AS category, CAST(coalesce(w.n, 0) AS INT) AS n_words,
  round(CASE WHEN w.n IS NULL THEN 0.1 ELSE least(coalesce(c, 0) * 0.6 + coalesce(n.n, 0) * 0.06, 1) END, 9) AS confidence
 FROM texts LEFT JOIN best USING (key) LEFT JOIN words_of w USING (key) LEFT JOIN labels ON labels.label = coalesce(best.label, '{DOCUMENT_TYPES[0].id}') LEFT JOIN n ON n.key = texts.key AND n.label = labels.label"""


def _classified(df: DataFrame, key: str, text: str) -> DataFrame:
    found = keywords.classify_documents(df, key, F.col(text), DOCUMENT_TYPES, document_model(df.sparkSession))
    return found.withColumnRenamed(key, "key").withColumn("confidence", F.round("confidence", 9))


@_query("payload_document_types", f"WITH {ctes('payloads')}, {_classified_sql('SELECT id AS key, lower(memo) AS t FROM payloads')}")
def payload_document_types(spark, sf_dir):
    return _classified(view(spark, sf_dir, "payloads"), "id", "memo")


@_query("text_document_types", f"WITH {_classified_sql('SELECT doc_id AS key, lower(text) AS t FROM documents')}")
def text_document_types(spark, sf_dir):
    """Document types of all whole texts."""
    return _classified(table(spark, sf_dir, "documents"), "doc_id", "text")


# The longest common subsequence of two short strings, by rows of the plain table: each value is the running maximum of what ends there.
_VENDOR_SQL = f"""WITH RECURSIVE {ctes("records")}, names AS (SELECT DISTINCT vendor_raw AS raw, ({{clean}}) AS clean FROM records),
 sorted AS (SELECT raw, clean, array_to_string(list_sort(string_split(lower(raw), ' ')), ' ') AS a, array_to_string(list_sort(string_split(lower(clean), ' ')), ' ') AS b FROM names),
 lcs(raw, i, r) AS (SELECT raw, 0, [0 FOR k IN range(0, length(b) + 1)] FROM sorted
  UNION ALL SELECT raw, i + 1, [0] || [list_max(t[1:k]) FOR k IN range(1, length(b) + 1)] FROM (SELECT s.raw, i, b, [greatest(r[k + 1], r[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END) FOR k IN range(1, length(b) + 1)] AS t FROM lcs JOIN sorted s USING (raw) WHERE i < length(a))),
 whole AS (SELECT raw, r[len(r)] AS common FROM lcs JOIN sorted USING (raw) WHERE i = length(a))
 SELECT event_id, vendor_raw, clean AS vendor_standard, round(least(0.95, 0.7 + 0.25 * 2 * common / (length(a) + length(b))), 9) AS confidence FROM records JOIN sorted ON vendor_raw = raw JOIN whole USING (raw)""".replace(
    "{clean}", "trim(regexp_replace(CASE WHEN ends_with(lower(vendor_raw), ' inc.') THEN left(vendor_raw, length(vendor_raw) - 5) ELSE vendor_raw END, '[^A-Za-z0-9 ]', ' ', 'g'))"
)


@_query("vendor_standards", _VENDOR_SQL)
def vendor_standards(spark, sf_dir):
    """The standard name of each event's vendor, with a confidence from the edit ratio of raw and cleaned names; each distinct name is compared once."""
    rows = view(spark, sf_dir, "records").select("event_id", "vendor_raw")
    names = rows.select("vendor_raw").distinct().withColumn("s", cleaning.standard_vendor(F.col("vendor_raw")))
    return rows.join(names, "vendor_raw").select("event_id", "vendor_raw", "s.vendor_standard", F.round("s.confidence", 9).alias("confidence"))


@_query("relationship_id_scores")
def relationship_id_scores(spark, sf_dir):
    """How alike the identifiers of both ends of each relationship are: 1 if they share one, else the best partial ratio."""
    own = view(spark, sf_dir, "records").select("event_id", F.array_compact(F.array("platform_id", F.concat(F.lit("INV-"), F.col("event_id").cast("string")), "employee")).alias("ids"))
    links = relationships(ledger_events(spark, sf_dir)).select("relationship_id", "source_event_id", "target_event_id")
    both = links.join(own.toDF("source_event_id", "ours"), "source_event_id").join(own.toDF("target_event_id", "theirs"), "target_event_id")
    return both.select("relationship_id", F.round(edits.id_score(F.col("ours"), F.col("theirs")), 9).alias("id_score"))


def _file_index(spark, sf_dir) -> tuple[lsh_index.LshIndex, DataFrame]:
    """All documents as files of the users named by their languages, indexed in a folder of its own."""
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("user"), "doc_id", "text", F.concat_ws(" ", "source", F.lit("part"), (F.col("doc_id") % 7).cast("string")).alias("file_name"))
    index = lsh_index.LshIndex(spark, own_folder(spark, "lsh-index"))
    index.insert(files, "user", "doc_id", "text")
    return index, files


@_query("stored_lsh_matches")
def stored_lsh_matches(spark, sf_dir):
    """Every hundredth document against a stored index of all: entries of the same user that are alike by .8 or more."""
    index, files = _file_index(spark, sf_dir)
    found = index.query(files.where("doc_id % 100 = 0"), "user", "doc_id", "text")
    return found.select("user", F.col("query").alias("doc_id"), F.col("key").alias("other"), F.round("similarity", 6).alias("similarity"))


@_query("near_duplicate_files")
def near_duplicate_files(spark, sf_dir):
    """The best match of every hundredth file, and a confidence of .7 and up to .3 for the likeness of the file names."""
    index, files = _file_index(spark, sf_dir)
    found = index.query(files.where("doc_id % 100 = 0"), "user", "doc_id", "text")
    best = found.groupBy("user", "query").agg(F.min_by(F.struct("key", "similarity"), F.struct(-F.col("similarity"), "key")).alias("b")).select("user", F.col("query").alias("doc_id"), F.col("b.key").alias("other"), "b.similarity")
    named = best.join(files.select("doc_id", "file_name"), "doc_id").join(files.select(F.col("doc_id").alias("other"), F.col("file_name").alias("other_name")), "other")
    return named.select("doc_id", "other", F.round("similarity", 6).alias("similarity"), F.round(0.7 + 0.3 * edits.token_set_ratio(F.col("file_name"), F.col("other_name")) / 100, 9).alias("confidence"))


@_query("near_duplicate_rows")
def near_duplicate_rows(spark, sf_dir):
    """Events whose payload is that of an earlier event of their user, word for word or by .85 of its words: the first such event, and how they agree."""
    rows = view(spark, sf_dir, "payloads").where("memo <> ''").select("user_id", "id", "memo")
    firsts = rows.groupBy("user_id", F.sha2("memo", 256).alias("hash")).agg(F.min("id").alias("first"))
    exact = rows.withColumn("hash", F.sha2("memo", 256)).join(firsts, ["user_id", "hash"]).where("first < id").select("user_id", "id", F.col("first").alias("duplicate_of"), F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    near = duplicates.first_alike(rows, ["user_id"], "id", "memo", 0.85)
    best = near.select("user_id", F.col("key").alias("id"), F.struct("first", "similarity").alias("b"))
    other = best.join(exact, ["user_id", "id"], "left_anti").select("user_id", "id", F.col("b.first").alias("duplicate_of"), F.lit("near").alias("kind"), F.col("b.similarity").alias("similarity"))
    return exact.unionByName(other).withColumn("similarity", F.round("similarity", 6))


@_query("unique_relationships", f"""WITH {RELATIONSHIPS_SQL.strip()}, {ctes("linked")} SELECT relationship_id, relationship_type, semantic_description FROM linked
 QUALIFY row_number() OVER (PARTITION BY relationship_type, semantic_description ORDER BY relationship_id) = 1""")
def unique_relationships(spark, sf_dir):
    """Relationships without those that repeat an earlier one's ends and type, or .85 of the words of its type and description."""
    links = view(spark, sf_dir, "linked")
    ends = links.groupBy("source_event_id", "target_event_id", "relationship_type").agg(F.min_by(F.struct("relationship_id", "semantic_description"), "relationship_id").alias("earliest")).select("relationship_type", "earliest.*")
    # rows of equal texts go with the first of them, whether it stays or not
    once = written(ends.groupBy("relationship_type", "semantic_description").agg(F.min("relationship_id").alias("relationship_id")), "once")
    told = once.withColumn("told", F.concat_ws(" ", "relationship_type", "semantic_description")).withColumn("all", F.lit(0))
    gone = lsh_index.dropped_by_first(lsh_index.similar_pairs(told, ["all"], "relationship_id", "told", 0.85))
    return once.join(gone, F.col("relationship_id") == F.col("key"), "left_anti").select("relationship_id", "relationship_type", "semantic_description")


@_query("phonetic_part_matches")
def phonetic_part_matches(spark, sf_dir):
    """For each part name, spelt otherwise, the names of its brand that sound alike, by which code; the ten best of each."""
    names = entities.with_phonetic_codes(table(spark, sf_dir, "part").select("p_brand", "p_name").distinct(), "p_name")
    asked = names.select("p_brand", F.regexp_replace(F.regexp_replace("p_name", "ll", "l"), "i", "y").alias("asked"))
    return entities.phonetic_matches(asked, "asked", names, "p_name", ["p_brand"]).select("p_brand", "asked", "p_name", "match_method")


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_rows").withColumn("row", F.from_json("row_text", "map<string,string>"))


def _first_fit(value: str, rules: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, {_quoted('(?i)' + pattern)}) THEN {out}" for pattern, out in rules) + f" ELSE {other} END"


_FIELDS_SQL = f"""raw AS (SELECT id, row_text, unnest(json_keys(row_text)) AS name FROM raw_rows), held AS (SELECT id, name, json_extract_string(row_text, '$."' || name || '"') AS value FROM raw),
 told AS (SELECT id, name, {_first_fit("trim(value)", [(p, _quoted(n)) for n, p, _ in fields.FORMATS])} AS format, {_first_fit("trim(value)", [(p, str(c)) for _, p, c in fields.FORMATS], "0")} AS by_format,
  {_first_fit("name", [("|".join(p.split()), _quoted(t)) for _, t, _, p in fields.MEANINGS], "'unknown'")} AS type, {_first_fit("name", [("|".join(p.split()), _quoted(c)) for c, _, _, p in fields.MEANINGS])} AS category,
  {_first_fit("name", [("|".join(p.split()), str(c)) for _, _, c, p in fields.MEANINGS], "0")} AS by_name FROM held WHERE value IS NOT NULL),
 analysed AS (SELECT id, name, type, category, format, CAST(least(1, by_format + by_name) AS DOUBLE) AS confidence FROM told)"""


@_query("field_meanings", f"WITH {ctes('raw_rows')}, {_FIELDS_SQL} SELECT id, name, type, category, format, round(confidence, 9) AS confidence FROM analysed")
def field_meanings(spark, sf_dir):
    """Type, category, format and confidence of every field of every raw row."""
    found = _raw_rows(spark, sf_dir).select("id", F.explode(fields.detected_fields(F.col("row"))).alias("f"))
    return found.select("id", "f.name", "f.type", "f.category", "f.format", F.round("f.confidence", 9).alias("confidence"))


@_query("format_detection", f"WITH {ctes('raw_rows')}, {_FIELDS_SQL} SELECT name, coalesce(format, 'none') AS format, count(*) AS n FROM analysed GROUP BY 1, 2")
def format_detection(spark, sf_dir):
    """How often the values of each field name have which format, over all raw rows."""
    found = _raw_rows(spark, sf_dir).select(F.explode("row").alias("name", "value")).where("value IS NOT NULL")
    return found.groupBy("name", F.coalesce(fields.format_of(F.col("value"))["format"], F.lit("none")).alias("format")).agg(F.count("*").alias("n"))


@_query("field_suggestions", f"""WITH {ctes('raw_rows')}, {_FIELDS_SQL} SELECT id, CAST(count(*) AS INT) AS total_fields, CAST(count(*) FILTER (type <> 'unknown') AS INT) AS recognised_fields, round(avg(confidence), 9) AS confidence_score,
 coalesce(string_agg(name, ',' ORDER BY name) FILTER (confidence < 0.5), '') AS low_confidence, coalesce(string_agg(name, ',' ORDER BY name) FILTER (type = 'unknown'), '') AS unknown FROM analysed GROUP BY id""")
def field_suggestions(spark, sf_dir):
    """What to review in each raw row."""
    analysed = _raw_rows(spark, sf_dir).select("id", fields.detected_fields(F.col("row")).alias("fields"))
    found = analysed.select("id", fields.field_suggestions(F.col("fields")).alias("s"))
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return found.select("id", "s.total_fields", "s.recognised_fields", F.round("s.confidence_score", 9).alias("confidence_score"), names(F.col("s.low_confidence")).alias("low_confidence"), names(F.col("s.unknown")).alias("unknown"))


def _enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_pipeline.enriched_rows(_raw_rows(spark, sf_dir), "row", view(spark, sf_dir, "dated_rates"), date(2024, 1, 1))


# Written from what the rows hold, not from the rules that find it.
_ENRICHED_SQL = f"""WITH {ctes("raw_rows", "dated_rates")}, core AS (SELECT id, o_orderkey % 3 AS kind, CASE o_orderkey % 3 WHEN 2 THEN CAST(-o_custkey AS DOUBLE) ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) END AS amount,
  CASE o_orderkey % 3 WHEN 0 THEN 'Customer ' || o_custkey || ' Inc.' WHEN 1 THEN 'Customer ' || o_custkey ELSE '' END AS vendor_raw, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'Customer ' || o_custkey END AS vendor_standard,
  CASE o_orderkey % 3 WHEN 2 THEN DATE '2024-01-01' ELSE CAST(o_orderdate AS DATE) END AS date, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE '' END AS description, ['EUR', 'GBP', 'USD'][o_orderkey % 3 + 1] AS currency, CASE o_orderkey % 3 WHEN 2 THEN 0.6 ELSE 0.9 END AS confidence
  FROM raw_rows JOIN orders ON id = o_orderkey), rated AS (SELECT core.*, CASE WHEN core.currency = 'USD' THEN 1.0 ELSE rate END AS exchange_rate FROM core ASOF LEFT JOIN dated_rates r ON core.currency = r.currency AND core.date >= r.day)
 SELECT id, amount, vendor_raw, vendor_standard, date, description, currency, CAST(confidence AS DOUBLE) AS confidence, exchange_rate, round(amount * exchange_rate, 4) AS amount_usd,
  round(CASE kind WHEN 2 THEN 0 WHEN 1 THEN 0.95 ELSE least(0.95, 0.7 + 0.25 * 2 * (length(vendor_raw) - 5) / (2 * length(vendor_raw) - 5)) END, 9) AS vendor_confidence,
  concat_ws(',', CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN exchange_rate IS NULL THEN 'no_exchange_rate' END, CASE WHEN length(vendor_raw) < 2 THEN 'vendor_too_short' END) AS issues FROM rated"""


@_query("enriched_rows", _ENRICHED_SQL)
def enriched_rows(spark, sf_dir):
    """Raw rows of three kinds of files, through the whole chain: fields, values, vendors, dated rates, issues."""
    core = F.col("core")
    return _enriched_rows(spark, sf_dir).select(
        "id", core["amount"].alias("amount"), core["vendor_name"].alias("vendor_raw"), "vendor_standard", core["date"].alias("date"), core["description"].alias("description"), core["currency"].alias("currency"), F.round(core["confidence"], 9).alias("confidence"),
        "exchange_rate", F.round("amount_usd", 4).alias("amount_usd"), F.round("vendor_confidence", 9).alias("vendor_confidence"), F.array_join("issues", ",").alias("issues"),
    )


@_query("event_records", f"""WITH e AS ({_ENRICHED_SQL}) SELECT id, file_id AS file, amount AS amount_original, currency, amount_usd, sha256(file_id || '||' || id || '||' || array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(row_text), '[\\s,;]+'), lambda x: length(x) > 1))), ' ')) AS hash, issues <> '' AS requires_review
 FROM e JOIN (WITH {ctes("raw_rows")} FROM raw_rows) USING (id)""")
def event_records(spark, sf_dir):
    """The events that raw rows become, with where they come from and a hash of the whole row."""
    found = row_pipeline.event_records(_enriched_rows(spark, sf_dir), "file_id", "id", ["row_text"])
    return found.select("id", "provenance.file", "payload.amount_original", "payload.currency", F.round("payload.amount_usd", 4).alias("amount_usd"), "provenance.hash", "requires_review")


@_query("learned_field_mappings", f"""WITH {ctes('raw_rows')}, {_FIELDS_SQL}, learned AS (SELECT file_id AS user_id, name, type, max(confidence) AS confidence, count(*) AS seen FROM analysed JOIN raw_rows USING (id) WHERE type <> 'unknown' GROUP BY 1, 2, 3 HAVING max(confidence) >= 0.5)
 SELECT user_id, type AS target_field, arg_max(name, (confidence, seen, name)) AS source_column FROM learned GROUP BY 1, 2""")
def learned_field_mappings(spark, sf_dir):
    """The column that stands best for each meaning in each user's files, learned from all their rows."""
    rows = _raw_rows(spark, sf_dir).withColumnRenamed("file_id", "user_id").transform(row_pipeline.with_core_fields, "row", date(2024, 1, 1))
    return row_pipeline.best_mappings(row_pipeline.learned_mappings(rows, "user_id"), "user_id")


@_query("mapped_rows", f"""WITH {ctes('raw_rows')}, {_FIELDS_SQL}, learned AS (SELECT file_id, name, type, max(confidence) AS confidence, count(*) AS seen FROM analysed JOIN raw_rows USING (id) WHERE type <> 'unknown' GROUP BY 1, 2, 3 HAVING max(confidence) >= 0.5),
 best AS (SELECT file_id, type, arg_max(name, (confidence, seen, name)) AS name FROM learned GROUP BY 1, 2), named AS (SELECT h.id, coalesce(b.type, h.name) AS name, arg_min(coalesce(value, chr(0)), h.name) AS value FROM held h JOIN raw_rows r USING (id) LEFT JOIN best b ON b.file_id = r.file_id AND b.name = h.name GROUP BY 1, 2)
 SELECT id, string_agg(name || '=' || replace(value, chr(0), ''), '|' ORDER BY name) AS mapped FROM named GROUP BY 1""")
def mapped_rows(spark, sf_dir):
    """Raw rows under the standard names that their users' files teach."""
    rows = _raw_rows(spark, sf_dir)
    learned = row_pipeline.best_mappings(row_pipeline.learned_mappings(rows.transform(row_pipeline.with_core_fields, "row", date(2024, 1, 1)), "file_id"), "file_id")
    found = row_pipeline.mapped_fields(rows, "row", "file_id", learned, "id")
    return found.select("id", F.array_join(F.transform(F.map_entries("mapped"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|").alias("mapped"))


# Written from what the rows hold; made-up ids are compared by their platform only.
@_query("platform_ids_of_rows", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'charge_id=abc' || o_orderkey WHEN 1 THEN 'invoice_id=' || (o_orderkey + 1000) WHEN 2 THEN 'invoice_id=2024' WHEN 3 THEN 'employee_id=77a' || o_orderkey || ',timesheet_id=9zz'
  WHEN 4 THEN 'platform_generated_id=razorpay' ELSE '' END AS ids, CAST([0.9, 0.7, 0.9, 0.6, 0.1, 0.0][o_orderkey % 6 + 1] AS DOUBLE) AS confidence FROM orders""")
def platform_ids_of_rows(spark, sf_dir):
    """The identifiers of each row's platform."""
    rows = view(spark, sf_dir, "id_rows").withColumn("row", F.from_json("row_text", "map<string,string>"))
    found = platform_ids.with_platform_ids(rows, "row", "platform")
    shown = F.transform(F.map_entries("platform_ids.ids"), lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"] == "platform_generated_id", F.split_part(e["value"]["id"], F.lit("_"), F.lit(1))).otherwise(e["value"]["id"])))
    return found.select("id", F.array_join(F.array_sort(shown), ",").alias("ids"), F.round("platform_ids.confidence", 9).alias("confidence"))


@_query("checked_platform_ids", r"""SELECT o_orderkey AS id, o_orderkey % 3 = 0 AND o_orderkey < 100000000 OR o_orderkey % 3 = 1 AS is_valid, CASE o_orderkey % 3 WHEN 1 THEN 'ID contains test/sample indicators' ELSE '' END AS warnings, CASE o_orderkey % 3 WHEN 1 THEN CAST(0.5 AS DOUBLE) END AS confidence FROM orders""")
def checked_platform_ids(spark, sf_dir):
    """Whether identifiers fit their platform, and which hold words of trial data: each distinct one is checked once."""
    key = F.col("o_orderkey").cast("string")
    made = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("TXN-"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("pay_test"), F.lpad(key, 10, "0"))).otherwise(F.concat(F.lit("order-"), key))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), made.alias("value"), F.when(F.col("o_orderkey") % 3 == 0, "quickbooks").otherwise("razorpay").alias("platform"))
    return rows.select("id", platform_ids.checked_id(F.col("value"), F.col("platform")).alias("c")).select("id", "c.is_valid", F.array_join("c.warnings", ",").alias("warnings"), "c.confidence")


@_query("platform_hits", f"WITH {ctes('payloads')}, {_catalog_sql(PLATFORMS)}, texts AS (SELECT id AS key, lower(memo) AS t FROM payloads), {_COUNTED} SELECT label AS platform, count(DISTINCT key) AS rows, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY 1")
def platform_hits(spark, sf_dir):
    """Rows and hits of each platform's words in all payloads."""
    found = view(spark, sf_dir, "payloads").select("id", keywords.keyword_hits(F.col("memo"), _pairs(PLATFORMS)).alias("hits"))
    each = found.select(F.explode(keywords.label_hits(F.col("hits"))).alias("h")).select("h.*")
    return each.groupBy(F.col("label").alias("platform")).agg(F.count("*").alias("rows"), F.sum("hits").alias("n"))


def _known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors by the ends of their names, and every third clerk under an alias."""
    return view(spark, sf_dir, "known_entities").withColumn("aliases", F.split("alias_list", ",")).drop("alias_list")


def _named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_store.event_names(view(spark, sf_dir, "records"), ["event_id", "user_id", "created_at"])


_RESOLVED_SQL = f"""{ctes("records", "known_entities")}, names AS (SELECT event_id, user_id, created_at, 'vendor' AS entity_type, coalesce(vendor_standard, vendor_raw) AS name FROM records UNION ALL SELECT event_id, user_id, created_at, 'employee', employee FROM records),
 known AS (SELECT user_id, entity_type, lower(canonical_name) AS key, entity_id, 0 AS how FROM known_entities UNION ALL SELECT user_id, entity_type, lower(unnest(string_split(alias_list, ','))), entity_id, 1 FROM known_entities),
 best AS (SELECT user_id, entity_type, key, arg_min(entity_id, (how, entity_id)) AS entity_id, min(how) AS how FROM known GROUP BY 1, 2, 3),
 resolved AS (SELECT event_id, n.user_id, n.entity_type, name, created_at, entity_id, CASE how WHEN 0 THEN 'exact_name' WHEN 1 THEN 'alias' ELSE 'new_entity' END AS match_method FROM names n LEFT JOIN best b ON n.user_id = b.user_id AND n.entity_type = b.entity_type AND lower(name) = key)"""


@_query("resolved_event_entities", f"WITH {_RESOLVED_SQL} SELECT event_id, entity_type, name, entity_id, match_method FROM resolved")
def resolved_event_entities(spark, sf_dir):
    """Whom each event names, and which known entity that is."""
    return entity_store.resolved(_named_events(spark, sf_dir), _known_entities(spark, sf_dir)).select("event_id", "entity_type", "name", "entity_id", "match_method")


@_query("merged_entities", f"""WITH {_RESOLVED_SQL}, met AS (SELECT user_id, entity_type, entity_id, CASE WHEN entity_id IS NULL THEN lower(name) END AS new_key, min(name) AS name, list(DISTINCT lower(name)) AS met, count(*) AS n_events, max(created_at) AS met_at FROM resolved GROUP BY 1, 2, 3, 4),
 whole AS (SELECT k.entity_id IS NOT NULL AS known, coalesce(k.user_id, m.user_id) AS user_id, coalesce(k.entity_type, m.entity_type) AS entity_type, coalesce(canonical_name, name) AS canonical_name, list_distinct(list_concat(coalesce(string_split(lower(alias_list), ','), []), coalesce(met, []))) AS names, greatest(last_seen, met_at) AS last_seen, coalesce(n_events, 0) AS n_events
  FROM known_entities k FULL JOIN met m ON k.entity_id = m.entity_id)
 SELECT known, user_id, entity_type, canonical_name, array_to_string(list_sort(list_filter(names, lambda n: n <> lower(canonical_name))), ',') AS aliases, last_seen, n_events FROM whole""")
def merged_entities(spark, sf_dir):
    """The entity table after all events: known entities with new aliases and dates, and those that no one knew."""
    known = _known_entities(spark, sf_dir)
    found = entity_store.merged(known, entity_store.resolved(_named_events(spark, sf_dir), known), "created_at")
    mark = known.select("entity_id", F.lit(True).alias("known"))
    return found.join(mark, "entity_id", "left").select(F.coalesce("known", F.lit(False)).alias("known"), "user_id", "entity_type", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "last_seen", "n_events")


@_query("entity_details", f"""WITH {_RESOLVED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, event_id DESC) AS k FROM resolved WHERE entity_id IS NOT NULL),
 e AS (SELECT entity_id, count(*) AS n_events, string_agg(event_id, ',' ORDER BY k) FILTER (k <= 5) AS newest FROM ranked GROUP BY 1), m AS (SELECT entity_id, string_agg(match_method || ':' || n, ',' ORDER BY match_method) AS history FROM (SELECT entity_id, match_method, count(*) AS n FROM resolved WHERE entity_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
 SELECT k.entity_id, canonical_name, coalesce(n_events, 0) AS n_events, coalesce(newest, '') AS newest, coalesce(history, '') AS history FROM known_entities k LEFT JOIN e USING (entity_id) LEFT JOIN m USING (entity_id)""")
def entity_details(spark, sf_dir):
    """Each known entity with its five newest events and how it was matched."""
    known = _known_entities(spark, sf_dir)
    found = written(entity_store.resolved(_named_events(spark, sf_dir), known), "resolved")
    told = entity_store.details(known, found, found.where("entity_id IS NOT NULL"), "created_at", newest=5)
    newest = F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",")
    history = F.array_join(F.transform("match_history", lambda h: F.concat(h["match_method"], F.lit(":"), h["n"].cast("string"))), ",")
    return told.select("entity_id", "canonical_name", "n_events", F.coalesce(newest, F.lit("")).alias("newest"), F.coalesce(history, F.lit("")).alias("history"))
