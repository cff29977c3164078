"""Relationships between events: range joins, enrichment, causal and temporal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage_cut import cut, written


def _top(pairs: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` pairs of each key with the largest confidence; of equal ones, by ids."""
    best = Window.partitionBy(key).orderBy(F.desc("confidence"), "source_event_id", "target_event_id")
    return pairs.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= limit).drop("__n")


def cross_document_links(ledger: DataFrame, source: str, target: str, amount_within: float, days_within: int, limit: int = 1000) -> DataFrame:
    """Per user, the `limit` best pairs of the two document types, close in amount and in time.

    Confidence .4 for the amount, .3 for the date, .3 for the same vendor. A range
    join as an equi join: days and amounts are cut into bands as wide as the
    tolerances, and the target side is copied to its neighbour bands.
    """
    second = F.unix_seconds(F.col("source_ts").cast("timestamp"))
    width, step = (days_within + 1) * 86400, F.floor(F.col("amount_usd").cast("double") / (amount_within + 1)).cast("bigint")
    held = ledger.select("user_id", "event_id", "document_type", "amount_usd", "vendor_standard", second.alias("at"), F.floor(second / width).cast("bigint").alias("band"), step.alias("step"))
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    a = held.where(F.col("document_type") == source).select("user_id", "band", "step", F.col("event_id").alias("source_event_id"), F.col("amount_usd").alias("a"), F.col("at").alias("d"), F.col("vendor_standard").alias("v"))
    b = held.where(F.col("document_type") == target).withColumn("band", around("band")).withColumn("step", around("step")).select("user_id", "band", "step", F.col("event_id").alias("target_event_id"), F.col("amount_usd").alias("b"), F.col("at").alias("e"), F.col("vendor_standard").alias("w"))
    amount_gap, gap = F.abs(F.col("a") - F.col("b")), F.abs(F.col("d") - F.col("e")) / 86400
    same_vendor = F.coalesce(F.col("v") == F.col("w"), F.lit(False))
    pairs = a.join(b, ["user_id", "band", "step"]).where((amount_gap <= amount_within) & (gap <= days_within) & (F.col("source_event_id") != F.col("target_event_id")))
    confidence = F.lit(0.7) + F.when(same_vendor, 0.3).otherwise(0.0)  # amount and date match in every pair
    return _top(pairs.select("user_id", "source_event_id", "target_event_id", F.round(confidence, 2).alias("confidence"), same_vendor.alias("entity_match"), amount_gap.cast("double").alias("amount_gap"), F.round(gap, 6).alias("day_gap")), "user_id", limit)


def _first(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n rows of each key with the smallest event_id."""
    ordered = Window.partitionBy(*key).orderBy("event_id")
    return rows.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") <= n).drop("__n")


def _leading(sources: DataFrame, key: list[str], enough: int) -> DataFrame:
    """Of each key's events, in order, those up to the one with which their `partners` come to `enough`; such without partners are left out."""
    few = _first(sources.where("partners >= 1"), key, enough)
    before = F.sum("partners").over(Window.partitionBy(*key).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return few.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < enough).drop("__before")


def within_file_links(ledger: DataFrame, limit: int = 1000) -> DataFrame:
    """Per file, the `limit` best ordered pairs of one user: revenue with expense .7, else the same vendor .8, else amounts less than 1 apart .6, else other categories .5.

    Pairs of one confidence are ordered by their ids. For each kind, how many
    partners an event has is counted without forming pairs; then only the first
    events whose partners come to the limit meet the first limit partners. The two
    lower kinds are formed only in files where the upper ones do not fill the
    limit, with room for the pairs that count as an upper kind. So a file forms
    a few times `limit` pairs, however large it is.
    """
    file, rest = ["user_id", "file_id"], ["category", "vendor_standard", "amount_usd"]
    events = written(ledger.select(*file, "event_id", *rest).where("user_id IS NOT NULL AND file_id IS NOT NULL"), "events")
    revenue, expense = F.coalesce(F.col("category") == "revenue", F.lit(False)), F.coalesce(F.col("category") == "expense", F.lit(False))
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))

    def pairs(sources: DataFrame, targets: DataFrame, on: list[str], confidence: float, holds: Column) -> DataFrame:
        theirs = targets.select(*on, F.col("event_id").alias("target_event_id"), *(F.col(c).alias(f"their_{c}") for c in rest))
        met = sources.select(*file, F.col("event_id").alias("source_event_id"), *rest, *(c for c in on if c not in file + rest)).join(theirs, on)
        return met.where((F.col("source_event_id") != F.col("target_event_id")) & holds).select("file_id", "source_event_id", "target_event_id", F.lit(confidence).alias("confidence"))

    both = revenue & F.coalesce(F.col("their_category") == "expense", F.lit(False))
    vendor = F.coalesce(F.col("vendor_standard") == F.col("their_vendor_standard"), F.lit(False))
    near = F.coalesce(F.abs(F.col("amount_usd") - F.col("their_amount_usd")) < 1, F.lit(False))
    differ = F.coalesce(F.col("category") != F.col("their_category"), F.lit(False))

    files = events.groupBy(*file).agg(number(revenue).alias("revenues"), number(expense).alias("expenses"), F.count("category").alias("categorised"))
    vendors = events.where("vendor_standard IS NOT NULL").groupBy(*file, "vendor_standard").agg(F.count("*").alias("n"), number(revenue).alias("r"), number(expense).alias("e"))
    flows = pairs(_leading(events.where(revenue).join(files, file).withColumn("partners", F.col("expenses")), file, limit), _first(events.where(expense), file, limit), file, 0.7, F.lit(True))
    peers = events.join(vendors, [*file, "vendor_standard"]).withColumn("partners", F.col("n") - 1 - F.when(revenue, F.col("e")).otherwise(0))
    known = _first(events.where("vendor_standard IS NOT NULL").withColumn("__spends", expense), [*file, "vendor_standard", "__spends"], limit + 1)
    alike = pairs(_leading(peers, file, limit), known, [*file, "vendor_standard"], 0.8, ~both)

    upper = vendors.groupBy(*file).agg(F.sum(F.col("n") * (F.col("n") - 1) - F.col("r") * F.col("e")).alias("alike"))
    open_files = files.join(upper, file, "left").where(F.col("revenues") * F.col("expenses") + F.coalesce("alike", F.lit(0)) < limit).select(*file, "categorised")
    left = events.join(open_files, file).withColumn("band", F.floor("amount_usd").cast("bigint"))
    # events of one band are near each other, so their number is a lower bound
    banded = left.where("band IS NOT NULL").groupBy(*file, "band").agg((F.count("*") - 1).alias("partners"))
    led = _leading(left.join(banded, [*file, "band"]), file, 2 * limit).groupBy(*file).agg(F.max("event_id").alias("last"), F.sum("partners").alias("got"))
    until = led.where(F.col("got") >= 2 * limit).select(*file, "last")
    sources = left.join(until, file, "left").where(F.col("last").isNull() | (F.col("event_id") <= F.col("last")))
    around = left.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    close = pairs(sources, around, [*file, "band"], 0.6, near & ~vendor & ~both)
    own = left.where("category IS NOT NULL").groupBy(*file, "category").agg(F.count("*").alias("mine"))
    others = left.join(own, [*file, "category"]).withColumn("partners", F.col("categorised") - F.col("mine"))
    apart = pairs(_leading(others, file, 3 * limit), _first(left.where("category IS NOT NULL"), [*file, "category"], 3 * limit), file, 0.5, differ & ~near & ~vendor & ~both)
    return _top(flows.unionByName(alike).unionByName(close).unionByName(apart), "file_id", limit)


def enriched(relationships: DataFrame, ledger: DataFrame) -> DataFrame:
    """Relationships with both ends' platforms, days between them, and flags."""
    s = ledger.select(F.col("event_id").alias("source_event_id"), F.col("source_platform").alias("p1"), F.col("source_ts").alias("t1"))
    t = ledger.select(F.col("event_id").alias("target_event_id"), F.col("source_platform").alias("p2"), F.col("source_ts").alias("t2"))
    return relationships.join(s, "source_event_id", "left").join(t, "target_event_id", "left").select(
        "relationship_id",
        "relationship_type",
        F.datediff("t2", "t1").alias("days_between"),
        F.when(F.col("p1") == F.col("p2"), "same_platform").otherwise("cross_platform").alias("platform_relation"),
        F.col("temporal_causality").isin("source_causes_target", "target_causes_source").alias("is_causal"),
    )


def learned_patterns(relationships: DataFrame) -> DataFrame:
    n = F.count("*")
    return relationships.groupBy("relationship_type").agg(
        n.alias("n"),
        F.round(F.avg("confidence_score"), 6).alias("avg_confidence"),
        F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low").alias("strength"),
        F.round(F.least(F.lit(0.9), 0.5 + 0.1 * n), 2).alias("predicted_confidence"),
    )


def degrees(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.explode(F.array("source_event_id", "target_event_id")).alias("event_id")).groupBy("event_id").agg(F.count("*").alias("degree"))


def bradford_hill(relationships: DataFrame, ledger: DataFrame) -> DataFrame:
    """Six criteria per relationship and their mean."""
    end = lambda side: ledger.select(F.col("event_id").alias(f"{side}_event_id"), F.col("amount_usd").cast("double").alias(f"{side}_amount"), F.to_date("source_ts").alias(f"{side}_day"), F.col("document_type").alias(f"{side}_type"))
    by_type = relationships.groupBy("user_id", "relationship_type").agg(F.count_if(F.col("confidence_score") >= 0.7).alias("similar"))
    outs = relationships.groupBy("user_id", "source_event_id").agg(F.count("*").alias("outs"))
    ins = relationships.groupBy("user_id", "target_event_id").agg(F.count("*").alias("ins"))
    both = relationships.groupBy("user_id", "source_event_id", "target_event_id").agg(F.count("*").alias("both"))
    x = relationships.join(end("source"), "source_event_id").join(end("target"), "target_event_id").join(by_type, ["user_id", "relationship_type"])
    x = x.join(outs, ["user_id", "source_event_id"]).join(ins, ["user_id", "target_event_id"]).join(both, ["user_id", "source_event_id", "target_event_id"])
    edges, causality = F.col("outs") + F.col("ins") - F.col("both"), F.col("temporal_causality")  # links of the same user with this source or this target
    days = F.datediff("target_day", "source_day")
    temporal = F.when(days > 0, F.least(F.lit(1.0), days / 90)).otherwise(0.0)
    consistency = F.least(F.lit(1.0), F.col("similar") / 10)
    specificity = F.when(edges == 1, 1.0).when(edges <= 3, 0.7).otherwise(0.3)
    dose = F.when(F.col("source_amount") > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.col("source_amount") - F.col("target_amount")) / F.greatest("source_amount", "target_amount"))).otherwise(0.0)
    plausible = F.when(causality == "source_causes_target", 1.0).when(causality == "bidirectional", 0.8).when(causality == "target_causes_source", 0.3).otherwise(0.5)
    scores = {"temporal": temporal, "strength": F.coalesce("confidence_score", F.lit(0.0)), "consistency": consistency, "specificity": specificity, "dose": dose, "plausibility": plausible}
    mean = sum(scores.values(), F.lit(0.0)) / 6
    return x.select("relationship_id", *(F.round(v, 6).alias(k) for k, v in scores.items()), F.round(mean, 6).alias("causal_score"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth, score): every node that each start reaches within depth, by its first arrival and best score.

    A frontier loop: each round joins only the newest arrivals with the edges.
    edges: (src, dst, score); start: (root).
    """
    seen = cut(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("score")))
    edges, frontier = cut(edges.select("src", "dst", F.col("score").alias("gain"))), seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.lit(d).alias("depth"), F.max(F.col("score") * F.col("gain")).alias("score"))
        frontier = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def counterfactual_impact(events: DataFrame, new_amount: Column) -> DataFrame:
    """(event_id, impact): what a changed amount of an ancestor changes in each event, in proportion."""
    ratio = (new_amount - F.col("old_amount")) / F.nullif(F.col("old_amount"), F.lit(0.0))
    return events.select("root", "node", F.round(F.coalesce(F.col("amount") * ratio, F.lit(0.0)), 4).alias("impact"))


def temporal_patterns(enriched_links: DataFrame) -> DataFrame:
    """Per type: gaps in days, only positive ones, at least three."""
    gap = F.col("days_between")
    n = F.count("*")
    return (
        enriched_links.where(gap > 0)
        .groupBy("relationship_type")
        .agg(n.alias("n"), F.round(F.avg(gap), 2).alias("avg_days"), F.round(F.stddev_samp(gap), 2).alias("sd_days"), F.min(gap).alias("min_days"), F.max(gap).alias("max_days"), F.round(F.percentile(gap, F.lit(0.5)), 2).alias("median_days"))
        .where("n >= 3")
        .withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10))
        .withColumn("band", F.when(F.col("avg_days") <= 7, "weekly").when(F.col("avg_days") <= 30, "monthly").when(F.col("avg_days") <= 90, "quarterly").otherwise("long"))
    )


def temporal_anomalies(enriched_links: DataFrame, patterns: DataFrame, k: float = 2.0) -> DataFrame:
    """Gaps more than k standard deviations from their type's mean."""
    off = F.abs(F.col("days_between") - F.col("avg_days"))
    rows = enriched_links.join(F.broadcast(patterns.select("relationship_type", "avg_days", "sd_days")), "relationship_type").where((F.col("sd_days") > 0) & (off > k * F.col("sd_days")))
    return rows.select("relationship_id", "days_between", F.when(off > 3 * F.col("sd_days"), "high").otherwise("medium").alias("severity"))


def missing_relationships(ledger: DataFrame, relationships: DataFrame, patterns: DataFrame, as_of: Column) -> DataFrame:
    """Events without an outgoing link whose type's usual gap has passed. patterns: one row per type."""
    open_events = ledger.join(relationships.select(F.col("source_event_id").alias("event_id")), "event_id", "left_anti")
    typed = open_events.withColumn("relationship_type", F.concat("document_type", F.lit("_to_next"))).join(F.broadcast(patterns.select("relationship_type", "avg_days")), "relationship_type")
    due = F.date_add(F.to_date("source_ts"), F.ceil("avg_days").cast("int"))
    return typed.where(due < F.to_date(as_of)).select("event_id", "relationship_type", F.date_format(due, "yyyy-MM-dd").alias("expected_day"), F.datediff(F.to_date(as_of), due).alias("days_overdue"))


def vendor_recurrence(ledger: DataFrame) -> DataFrame:
    """Per vendor with at least three dates: mean gap and its name."""
    day = F.to_date("source_ts")
    gap = F.datediff(day, F.lag(day).over(Window.partitionBy("vendor_standard").orderBy(day, "event_id")))
    stats = ledger.select("vendor_standard", gap.alias("gap")).groupBy("vendor_standard").agg(F.count("*").alias("n_events"), F.round(F.avg("gap"), 4).alias("avg_gap"), F.round(F.stddev_samp("gap"), 4).alias("sd_gap")).where("n_events >= 3")
    g = F.col("avg_gap")
    return stats.withColumn("recurrence", F.when(g.between(6, 8), "weekly").when(g.between(28, 32), "monthly").when(g.between(85, 95), "quarterly").otherwise("irregular"))


def unlinked(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left without a row of right."""
    return left.join(right.select(F.col(right_key).alias("__k")), F.col(left_key) == F.col("__k"), "left_anti")
