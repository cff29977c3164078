"""Search and statistics over records, for all users at once or for one.

Searches are filters that reach the scan; statistics are one aggregation per
user, with counted categories as sorted `key:count` lists.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage_cut import written


def _filtered(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def _equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def _has(column: str, part: str | None) -> Column | None:
    return None if part is None else F.contains(F.lower(column), F.lit(part.lower()))


def _mean(value: Column, digits: int = 3) -> Column:
    """Mean of values of up to six decimals, summed exactly, so that the order of rows cannot turn a rounding."""
    return F.round(F.sum(value.cast("decimal(18,6)")).cast("double") / F.count(value), digits)


def by_document_type(records: DataFrame, user=None, document_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    return _filtered(records, _equals("user_id", user), _equals("document_type", document_type), F.coalesce("document_confidence", F.lit(0.0)) >= min_confidence)


def by_vendor(records: DataFrame, part: str, user=None) -> DataFrame:
    return _filtered(records, _equals("user_id", user), _has("vendor_standard", part))


def by_entity(records: DataFrame, kind: str, name: str, user=None) -> DataFrame:
    """Records whose `entities`, a map of lists, names the entity under the kind."""
    return _filtered(records, _equals("user_id", user), F.array_contains(F.col("entities")[kind], name))


def normalized_events(events: DataFrame, text: str | None = None, document_type: str | None = None, platform: str | None = None, min_confidence: float = 0.0, user=None) -> DataFrame:
    """A missing confidence passes any bound."""
    return _filtered(events, _equals("user_id", user), _has("normalized_payload", text), _equals("document_type", document_type), _equals("platform_label", platform), F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))


def relationships_by(links: DataFrame, term: str | None = None, kind: str | None = None, min_confidence: float = 0.0, user=None) -> DataFrame:
    return _filtered(links, _equals("user_id", user), _has("reasoning", term), _equals("relationship_type", kind), F.col("confidence_score") >= min_confidence)


def field_mappings(mappings: DataFrame, platform: str | None = None, user=None) -> DataFrame:
    """Mappings of the platform or of none."""
    return _filtered(mappings, _equals("user_id", user), None if platform is None else (F.col("platform") == platform) | F.col("platform").isNull())


def mapping_successes(mappings: DataFrame, used: DataFrame) -> DataFrame:
    """mappings with success_count raised by the number of rows of used (id)."""
    more = used.groupBy("id").agg(F.count("*").alias("__more"))
    return mappings.join(more, "id", "left").withColumn("success_count", (F.col("success_count") + F.coalesce("__more", F.lit(0))).cast("bigint")).drop("__more")


def structured_patterns(patterns: DataFrame) -> DataFrame:
    field = lambda name: F.get_json_object("patterns", f"$.{name}")
    return patterns.select("user_id", "platform", field("pattern_type").alias("pattern_type"), field("confidence_score").cast("decimal(3,2)").alias("confidence_score"), field("detection_method").alias("detection_method"), field("pattern_data").alias("pattern_data"), "updated_at")


def counted(df: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """(key, name): how often each value occurs, as a sorted list `value:count`; nulls are not counted."""
    n = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__n"))
    return n.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(value).cast("string"), F.lit(":"), F.col("__n").cast("string")))), ",").alias(name))


def entity_stats(records: DataFrame) -> DataFrame:
    """Per user: how many distinct names each list of `entities` holds, and the names, sorted."""
    kinds = ("employees", "vendors", "customers", "projects")
    names = records.select("user_id", F.explode("entities").alias("kind", "names")).select("user_id", "kind", F.explode("names").alias("name")).distinct()
    of = lambda k: F.when(F.col("kind") == k, F.col("name"))
    return names.groupBy("user_id").agg(*(F.count(of(k)).alias(f"total_{k}") for k in kinds), *(F.array_join(F.array_sort(F.collect_list(of(k))), ",").alias(f"{k[:-1]}_names") for k in kinds))


def enrichment_stats(records: DataFrame) -> DataFrame:
    stats = records.groupBy("user_id").agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("amount_usd") != F.col("amount_original")).alias("events_with_currency_conversion"),
        F.count_if(F.col("vendor_standard") != F.col("vendor_raw")).alias("events_with_vendor_standardization"),
        F.count("platform_id").alias("events_with_platform_ids"),
        F.coalesce(F.sum("amount_usd"), F.lit(0)).cast("double").alias("total_amount_usd"),
        F.round(F.avg("vendor_confidence"), 6).alias("vendor_standardization_accuracy"),
        F.round(F.avg("exchange_rate"), 6).alias("avg_exchange_rate"),
    )
    return stats.join(counted(records, ["user_id"], "currency", "currency_breakdown"), "user_id", "left")


def accuracy_stats(records: DataFrame) -> DataFrame:
    """The twelve figures of a user's records; expenses count by the size of their sum."""
    kind, signed = F.col("transaction_type"), F.col("amount_signed_usd")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, signed)), F.lit(0))
    return records.groupBy("user_id").agg(
        F.count("*").alias("total_events"),
        F.count_if("accuracy_enhanced").alias("accuracy_enhanced_events"),
        F.count_if("requires_review").alias("events_requiring_review"),
        F.count_if(F.col("review_priority") == "high").alias("high_priority_reviews"),
        *(F.count_if(kind == k).alias(f"{k}_events") for k in ("income", "expense", "transfer")),
        total(kind == "income").cast("double").alias("total_income_usd"),
        F.abs(total(kind == "expense")).cast("double").alias("total_expenses_usd"),
        total(F.col("affects_cash")).cast("double").alias("net_cash_flow_usd"),
        F.round(F.avg("document_confidence"), 6).alias("avg_overall_confidence"),
        F.round(F.count_if(~F.col("is_valid")) / F.count("*"), 6).alias("validation_error_rate"),
    )


def review_queue(records: DataFrame, priority: str | None = None) -> DataFrame:
    """Records that require a review, with the rank of their priority: high, medium, low, none."""
    p = F.col("review_priority")
    rank = F.when(p == "high", 1).when(p == "medium", 2).when(p == "low", 3).otherwise(4)
    return _filtered(records, F.col("requires_review"), _equals("review_priority", priority)).withColumn("priority_rank", rank)


def platform_stats(patterns: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per user with patterns; the latest by date, of equal dates the first name. Each side is counted alone, so no product of rows arises."""
    newest = lambda name, at: F.max_by(name, F.struct(F.col(at), F.col(name)))
    held = patterns.groupBy("user_id").agg(F.count_distinct("platform").alias("total_platforms"), newest("platform", "updated_at").alias("most_used_platform"))
    found = discovered.groupBy("user_id").agg(F.count_distinct("platform_name").alias("found"), F.max("discovered_at").alias("latest_discovery"))
    joined = held.join(found, "user_id", "left")
    return joined.select("user_id", "total_platforms", F.col("total_platforms").alias("learned_platforms"), F.coalesce("found", F.lit(0)).alias("discovered_platforms"), "most_used_platform", F.date_format("latest_discovery", "yyyy-MM-dd").alias("latest_discovery"))


def normalization_stats(events: DataFrame) -> DataFrame:
    stats = events.groupBy("user_id").agg(F.count("*").alias("total_normalized"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if("requires_review").alias("requires_review_count"), F.count_distinct("duplicate_group_id").alias("duplicate_groups"))
    return stats.join(counted(events, ["user_id"], "document_type", "by_document_type"), "user_id", "left").join(counted(events, ["user_id"], "platform_label", "by_platform"), "user_id", "left")


def resolution_stats(entities: DataFrame, matches: DataFrame) -> DataFrame:
    held = entities.groupBy("user_id").agg(F.count("*").alias("total_entities"), *(F.count_if(F.col("entity_type") == k).alias(f"{k}s_count") for k in ("employee", "vendor", "customer", "project")))
    how = {"exact_matches": "exact_name", "fuzzy_matches": "fuzzy_name", "email_matches": "email", "bank_matches": "bank_account", "new_entities": "new_entity"}
    made = matches.groupBy("user_id").agg(F.count("*").alias("total_matches"), *(F.count_if(F.col("match_method") == m).alias(n) for n, m in how.items()), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return held.join(made, "user_id", "left")


def semantic_stats(links: DataFrame) -> DataFrame:
    n = F.count("*")
    stats = links.groupBy("user_id").agg(
        n.alias("total_relationships"),
        F.count("semantic_description").alias("with_semantics"),
        F.round(100.0 * F.count("semantic_description") / n, 2).alias("semantic_coverage_percent"),
        _mean(F.col("confidence_score")).alias("avg_confidence"),
        F.count_if(F.col("temporal_causality").isin("source_causes_target", "target_causes_source", "bidirectional")).alias("causal_relationships"),
        F.count_if(F.col("temporal_causality") == "correlation_only").alias("correlation_only"),
    )
    return stats.join(counted(links, ["user_id"], "temporal_causality", "causality_distribution"), "user_id", "left").join(counted(links, ["user_id"], "business_logic", "logic_distribution"), "user_id", "left")


def transaction_stats(transactions: DataFrame) -> DataFrame:
    """With the mean seconds from start to whichever end there is."""
    ended = F.coalesce("committed_at", "rolled_back_at", "failed_at")
    return transactions.groupBy("user_id").agg(
        F.count("*").alias("total_transactions"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_transactions") for s in ("active", "committed", "rolled_back", "failed")),
        F.round(F.avg(F.unix_micros(ended.cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6), 4).alias("avg_processing_time_seconds"),
    )


def with_end_times(transactions: DataFrame, as_of: Column) -> DataFrame:
    """start_time and end_time as a trigger would keep them: an end only for a finished status, as_of if no moment is known."""
    done = F.col("status").isin("committed", "rolled_back", "failed")
    return transactions.withColumn("start_time", F.col("started_at")).withColumn("end_time", F.when(done, F.coalesce("committed_at", "rolled_back_at", "failed_at", as_of)))


def with_transaction_date(records: DataFrame) -> DataFrame:
    return records.withColumn("transaction_date", F.coalesce("transaction_date", F.to_date("source_ts")))


def finished_before(transactions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Transactions that a clean-up removes: finished, and started more than so many days ago."""
    return transactions.where(F.col("status").isin("committed", "rolled_back", "failed") & (F.col("started_at") < as_of - F.make_dt_interval(days=F.lit(days))))


def committed_without_rows(transactions: DataFrame, events: DataFrame, rows: DataFrame) -> DataFrame:
    """Committed transactions that neither events nor rows (id each) refer to."""
    return transactions.where(F.col("status") == "committed").join(events, "id", "left_anti").join(rows, "id", "left_anti")


def user_counts(**tables: DataFrame) -> DataFrame:
    """Per user, the rows of each table (user_id): partial counts, one shuffle of their union."""
    parts = None
    for name, df in tables.items():
        one = df.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(name).alias("what"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("user_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables))


def financial_summary(records: DataFrame, as_of: Column, days: int = 90, newest: int = 1000) -> DataFrame:
    """Revenue, expenses, net and margin of each user's newest records of the last days."""
    from pyspark.sql import Window

    recent = records.where((F.col("source_ts") <= as_of) & (F.col("source_ts") > as_of - F.make_dt_interval(days=F.lit(days))))
    kept = recent.withColumn("__n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("source_ts"), "event_id"))).where(F.col("__n") <= newest)
    amount = F.abs("amount_usd")
    revenue, expenses = (F.coalesce(F.sum(F.when(F.col("category") == k, amount)), F.lit(0)).cast("double") for k in ("revenue", "expense"))
    sums = kept.groupBy("user_id").agg(F.count("*").alias("n_events"), revenue.alias("revenue"), expenses.alias("expenses"))
    net = F.col("revenue") - F.col("expenses")
    return sums.select("*", F.round(net, 2).alias("net"), F.round(F.when(F.col("revenue") > 0, 100 * net / F.col("revenue")).otherwise(0.0), 4).alias("margin"))


def causal_paths(edges: DataFrame, depth: int) -> DataFrame:
    """(depth, path, links, confidence): every cycle-free path over edges (id, src, dst, score), up to so many links.

    Paths, not nodes, so several ways to a node are kept. Each round joins only
    the newest paths by their last event.
    """
    return _paths(edges.withColumn("ends", F.lit(False)), depth).drop("ends")


def _paths(edges: DataFrame, depth: int) -> DataFrame:
    """causal_paths with `ends` of each path's last edge; paths are not carried on beyond an edge that ends."""
    from .lineage_cut import cut

    edges = cut(edges.select("id", "src", "dst", "score", "ends"))
    newest = cut(edges.select(F.lit(1).alias("depth"), F.array("src", "dst").alias("path"), F.array("id").alias("links"), F.col("score").alias("confidence"), F.col("dst").alias("last"), "ends"))
    out = newest
    for d in range(2, depth + 1):
        step = newest.where("NOT ends").drop("ends").join(edges, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        newest = cut(step.select(F.lit(d).alias("depth"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("links", F.col("id")).alias("links"), (F.col("confidence") * F.col("score")).alias("confidence"), F.col("dst").alias("last"), "ends"))
        out = out.unionByName(newest)
    return out.drop("last")


def root_paths(edges: DataFrame, depth: int) -> DataFrame:
    """Causal paths against the direction of edges that end at an event nothing causes: (root, problem, path, depth, score)."""
    # roots are marked on the edges, so that no path is shuffled to be told apart
    caused = edges.select(F.col("dst").alias("__root")).distinct()
    back = edges.join(caused, F.col("src") == F.col("__root"), "left").select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "score", F.col("__root").isNull().alias("ends"))
    return _paths(back, depth).where("ends").select(F.element_at("path", -1).alias("root"), F.col("path")[0].alias("problem"), "path", "depth", F.col("confidence").alias("score"))


def causal_direction(temporal: Column, causality: Column) -> Column:
    """Only where the source precedes clearly; source to target unless told otherwise."""
    told = F.when(causality == "target_causes_source", "target_to_source").when(causality == "bidirectional", "bidirectional").otherwise("source_to_target")
    return F.when(temporal >= 0.7, told).otherwise("none")


def causal_stats(scored: DataFrame, causal_from: float = 0.7) -> DataFrame:
    """Per user, over scores of Bradford Hill's criteria with temporal_causality."""
    x = scored.withColumn("causal", F.col("causal_score") >= causal_from).withColumn("direction", causal_direction(F.col("temporal"), F.col("temporal_causality")))
    causal = F.col("causal")
    stats = x.groupBy("user_id").agg(F.count("*").alias("total_relationships"), F.count_if(causal).alias("causal_relationships"), F.round(100.0 * F.count_if(causal) / F.count("*"), 2).alias("causal_percentage"), _mean(F.col("causal_score")).alias("avg_causal_score"), *(_mean(F.when(causal, F.col(c))).alias(f"avg_{c}") for c in ("temporal", "strength", "consistency", "specificity", "dose", "plausibility")))
    return stats.join(counted(x.where(causal), ["user_id"], "direction", "directions"), "user_id", "left")


def best_paths(edges: DataFrame, source, depth: int = 5) -> DataFrame:
    """(node, hops, path, causal_sum, avg_confidence): an unweighted shortest path from source to each node; of equally short ones the first by path.

    edges: (src, dst, causal, confidence). One row per node and round is kept, so a round shuffles at most the edges of the newest nodes.
    """
    from .lineage_cut import cut

    edges = cut(edges.select("src", "dst", "causal", "confidence"))
    newest = cut(edges.sparkSession.range(1).select(F.lit(source).cast("bigint").alias("node"), F.lit(0).alias("hops"), F.array(F.lit(source).cast("bigint")).alias("path"), F.lit(0.0).alias("causal_sum"), F.lit(0.0).alias("confidence_sum")))
    seen = newest
    for d in range(1, depth + 1):
        way = F.struct(F.array_append("path", F.col("dst")).alias("path"), (F.col("causal_sum") + F.col("causal")).alias("causal_sum"), (F.col("confidence_sum") + F.col("confidence")).alias("confidence_sum"))
        step = newest.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(way).alias("w"))
        newest = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("hops"), "w.*"))
        seen = seen.unionByName(newest)
    found = seen.where("hops > 0")
    return found.select("node", "hops", "path", F.round("causal_sum", 6).alias("causal_sum"), F.round(F.col("confidence_sum") / F.col("hops"), 6).alias("avg_confidence"))


def duplicate_cascade(files: DataFrame, same_from: float = 0.85) -> DataFrame:
    """Per file (file_id, user_id, file_hash, content_hash, tokens): what it is a duplicate of, by the first phase that finds an earlier file of its user.

    exact: the same file hash; near: token sets with a Jaccard similarity of at
    least same_from, joined on the rarest tokens of each set only; content: the
    same content hash; else none. Earlier means a smaller file_id.
    """
    from .lineage_cut import written

    def earliest(key: str, phase: str) -> DataFrame:
        first = files.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.min("file_id").alias("original"))
        return files.join(first, ["user_id", key]).where("original < file_id").select("file_id", F.lit(phase).alias("duplicate_type"), "original", F.lit(1.0).alias("similarity"))

    # files of one token set are alike to the same others, of which the earliest counts: only the first file of each set is compared
    held = files.select("user_id", "file_id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).where(F.size(F.array_compact("tokens")) > 0)
    sets = written(held.groupBy("user_id", "tokens").agg(F.min("file_id").alias("first")), "sets")
    same = held.join(sets, ["user_id", "tokens"]).where("first < file_id").select("file_id", F.lit("near").alias("duplicate_type"), F.col("first").alias("original"), F.lit(1.0).alias("similarity"))
    whole = sets.select("user_id", F.col("first").alias("file_id"), "tokens")
    tokens = whole.select("user_id", "file_id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("user_id", "token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, ["user_id", "token"]).groupBy("user_id", "file_id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    size = F.size("t")
    prefix = ranked.select("user_id", "file_id", size.alias("size"), F.explode(F.slice("t", F.lit(1), (size - F.ceil(size * same_from) + 1).cast("int"))).alias("p")).select("user_id", "file_id", "size", "p.token")
    a, b = prefix.alias("a"), prefix.alias("b")
    close = F.least("a.size", "b.size") >= same_from * F.greatest("a.size", "b.size")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.file_id") > F.col("b.file_id")) & close).select(F.col("a.file_id").alias("file_id"), F.col("b.file_id").alias("original")).distinct()
    jaccard = F.size(F.array_intersect("tokens", "other")) / F.size(F.array_union("tokens", "other"))
    near = pairs.join(whole.select("file_id", "tokens"), "file_id").join(whole.select(F.col("file_id").alias("original"), F.col("tokens").alias("other")), "original").withColumn("similarity", jaccard).where(F.col("similarity") >= same_from)
    near = near.groupBy("file_id").agg(F.max_by("original", F.struct("similarity", -F.col("original"))).alias("original"), F.max("similarity").alias("similarity")).select("file_id", F.lit("near").alias("duplicate_type"), "original", "similarity")
    near = near.unionByName(same)
    found = earliest("file_hash", "exact").unionByName(near).unionByName(earliest("content_hash", "content"))
    phase = F.when(F.col("duplicate_type") == "exact", 1).when(F.col("duplicate_type") == "near", 2).otherwise(3)
    best = found.groupBy("file_id").agg(F.min_by(F.struct("duplicate_type", "original", "similarity"), phase).alias("b"))
    return files.select("file_id").join(best, "file_id", "left").select("file_id", F.coalesce("b.duplicate_type", F.lit("none")).alias("duplicate_type"), F.col("b.original").alias("original"), F.round(F.coalesce("b.similarity", F.lit(0.0)), 6).alias("similarity"))


#: Slots of the sketch of trigrams, and how many keys a name is given at most for one size of its partners, where one trigram each does not take more.
SLOTS, KEYS = 1 << 18, 24
#: How many trigrams make a key where `i` of those that are tried may be missing.
DRAWN = [SLOTS] + [max((n for n in range(1, KEYS) if math.comb(i + n, n) <= KEYS), default=1) for i in range(1, KEYS + 1)]


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _keys(grams: Column, n: Column) -> Column:
    """A hash of each choice of n of the grams, in their order."""

    @F.arrow_udf("array<bigint>")
    def run(rows: pa.Array, sizes: pa.Array) -> pa.Array:
        pairs = zip(rows.to_pylist(), sizes.to_pylist(), strict=True)
        return pa.array([[xxhash.xxh64_intdigest("\0".join(c)) - (1 << 63) for c in combinations(row, k)] for row, k in pairs], pa.list_(pa.int64()))

    return run(grams, n)


def alike_names(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Pairs (user_id, folded, other, by_name, alike) of names of one user whose sets of trigrams are alike by `least` or more; names: (user_id, folded), others: (user_id, other, by_name).

    Sets of a and m trigrams must share `need` of them. Of both, in one order
    (rarest first, by a sketch of fixed size), the first n shared ones lie among
    the first a - need + n and m - need + n; every choice of n of those is a key,
    and pairs that share a key are compared. The more must be shared, the larger
    n may be: where all must, the key is the whole set. So names of the same few
    trigrams (numbers) do not all meet on one of them.
    """
    others = others.where("user_id IS NOT NULL AND other IS NOT NULL").withColumn("m", F.size(_grams(F.col("other"))))
    held = np.zeros(SLOTS, np.int64)
    for slot, n in others.select(F.explode(_grams(F.col("other"))).alias("gram")).groupBy(_slot(F.col("gram"))).count().collect():  # at most SLOTS
        held[slot] = n
    longest = others.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]

    @F.arrow_udf("array<bigint>")
    def counts(slots: pa.Array) -> pa.Array:
        return pa.array([held[row].tolist() for row in slots.to_pylist()], pa.list_(pa.int64()))

    def ordered(grams: Column) -> Column:
        """Trigrams that the others may hold, rarest first."""
        told = F.zip_with(counts(F.transform(grams, _slot)), grams, lambda n, g: F.struct(n.alias("n"), g.alias("g")))
        return F.transform(F.array_sort(F.filter(told, lambda t: t["n"] > 0)), lambda t: t["g"])

    grams = _grams(F.col("folded"))
    tried = names.where("user_id IS NOT NULL AND folded IS NOT NULL").select("user_id", "folded", F.size(grams).alias("a"), ordered(grams).alias("t"))
    tried = written(tried.where(F.size("t") >= F.col("a") * least - 1e-6), "tried")
    low = F.greatest(F.ceil(F.col("a") * least - 1e-6), F.lit(1)).cast("int")
    high = F.least(F.floor(F.col("a") / least + 1e-6), F.lit(longest)).cast("int") if least > 0 else F.lit(longest)
    sizes = F.when(low <= high, F.sequence(low, high))
    need = F.greatest(F.ceil((F.col("a") + F.col("m")) * (least / (1 + least)) - 1e-6), F.lit(1)).cast("int")
    sized = tried.withColumn("m", F.explode(sizes)).withColumn("need", need).where(F.col("need") <= F.least(F.size("t"), F.col("m")))
    asked = sized.groupBy("user_id", "m").agg(F.min("need").alias("fewest"), F.max(F.greatest(F.size("t"), F.col("m")) - F.col("need")).alias("off"))
    drawn = F.least(F.get(F.array(*map(F.lit, DRAWN)), F.least("off", F.lit(KEYS)).cast("int")), F.col("fewest"))
    asked = written(asked.select("user_id", "m", "fewest", drawn.alias("n")), "asked")
    a = sized.join(asked, ["user_id", "m"]).select("user_id", "m", "folded", _keys(F.slice("t", F.lit(1), F.size("t") - F.col("need") + F.col("n")), F.col("n")).alias("keys"))
    b = others.join(asked, ["user_id", "m"]).select("user_id", "m", "other", "by_name", _keys(F.slice(ordered(_grams(F.col("other"))), F.lit(1), F.col("m") - F.col("fewest") + F.col("n")), F.col("n")).alias("keys"))
    a, b = (df.withColumn("key", F.explode("keys")).drop("keys") for df in (a, b))
    met = a.join(b, ["user_id", "m", "key"]).select("user_id", "folded", "other", "by_name").distinct()
    pairs = met.withColumn("g", grams).withColumn("h", _grams(F.col("other")))
    return pairs.withColumn("alike", F.size(F.array_intersect("g", "h")) / F.size(F.array_union("g", "h"))).where(F.col("alike") >= least).drop("g", "h")


def resolve_entities(mentions: DataFrame, known: DataFrame, fuzzy_from: float = 0.75) -> DataFrame:
    """Per mention (id, user_id, name, email): the entity by e-mail, else by folded name, else by the best trigram similarity within the user, else new.

    known: (entity_id, user_id, name, email). Returns (id, entity_id, method, confidence, entropy = 1 - confidence).
    """
    fold = lambda c: F.lower(F.trim(c))
    by_mail = known.where("email IS NOT NULL").groupBy("user_id", F.lower("email").alias("mail")).agg(F.min("entity_id").alias("by_mail"))
    by_name = written(known.groupBy("user_id", fold("name").alias("folded")).agg(F.min("entity_id").alias("by_name")), "names")
    asked = mentions.withColumn("mail", F.lower("email")).withColumn("folded", fold("name"))
    first = written(asked.join(by_mail, ["user_id", "mail"], "left").join(by_name, ["user_id", "folded"], "left").select("id", "user_id", "folded", "by_mail", "by_name"), "first")
    names = first.where("by_mail IS NULL AND by_name IS NULL").select("user_id", "folded").distinct()
    fuzzy = alike_names(names, by_name.select("user_id", F.col("folded").alias("other"), "by_name"), fuzzy_from)
    fuzzy = fuzzy.groupBy("user_id", "folded").agg(F.max_by("by_name", F.struct("alike", -F.col("by_name"))).alias("by_fuzzy"), F.max("alike").alias("alike"))
    joined = first.join(fuzzy, ["user_id", "folded"], "left")
    confidence = F.when(F.col("by_mail").isNotNull(), 0.95).when(F.col("by_name").isNotNull(), 1.0).otherwise(F.coalesce(F.round("alike", 6), F.lit(0.0)))
    method = F.when(F.col("by_mail").isNotNull(), "email").when(F.col("by_name").isNotNull(), "exact_name").when(F.col("by_fuzzy").isNotNull(), "fuzzy_name").otherwise("new")
    return joined.select("id", F.coalesce("by_mail", "by_name", "by_fuzzy").alias("entity_id"), method.alias("method"), confidence.alias("confidence"), F.round(1 - confidence, 6).alias("entropy"))
