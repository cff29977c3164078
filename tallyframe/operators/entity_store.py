"""Entities of events: their names, whom they stand for, and the entity table after what was learned.

Names are compared in lower case with the canonical names and aliases of the
user's entities of the same type. Nothing is gathered by entity but bounded
lists: the distinct names it was met by, and its newest events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns that hold an entity's name, by type; the first that is not empty counts.
NAME_COLUMNS = {
    "vendor": ["vendor_standard", "vendor_raw", "vendor", "name"],
    "customer": ["customer_standard", "customer_raw", "customer"],
    "employee": ["employee_name", "employee"],
}


def event_names(events: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, entity_type, name): a row for each type of which an event names someone."""
    named: list[Column] = []
    for kind, columns in NAME_COLUMNS.items():
        here = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns if c in events.columns]
        if here:
            named.append(F.struct(F.lit(kind).alias("entity_type"), F.coalesce(*here).alias("name")))
    each = events.select(*keep, F.explode(F.array(*named)).alias("n")) if named else events.select(*keep, F.lit(None).cast("struct<entity_type:string,name:string>").alias("n"))
    return each.select(*keep, "n.*").where("name IS NOT NULL")


def resolved(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (user_id, entity_type, name, ...) with entity_id and match_method: exact_name, alias or new_entity, which has no id yet.

    entities: (entity_id, user_id, entity_type, canonical_name, aliases). Of several
    that fit, canonical names count before aliases, then the smallest id. Distinct
    names are resolved once, so a name of very many events costs one row.
    """
    on = ["user_id", "entity_type", "key"]
    known = entities.select("user_id", "entity_type", F.lower("canonical_name").alias("key"), "entity_id", F.lit(0).alias("how"))
    known = known.unionByName(entities.select("user_id", "entity_type", F.explode("aliases").alias("alias"), "entity_id").select("user_id", "entity_type", F.lower("alias").alias("key"), "entity_id", F.lit(1).alias("how")))
    best = known.groupBy(*on).agg(F.min(F.struct("how", "entity_id")).alias("best"))
    distinct = names.select("user_id", "entity_type", F.lower("name").alias("key")).distinct().join(best, on, "left")
    told = distinct.select(*on, F.col("best.entity_id").alias("entity_id"), F.when(F.col("best.how") == 0, "exact_name").when(F.col("best.how") == 1, "alias").otherwise("new_entity").alias("match_method"))
    return names.withColumn("key", F.lower("name")).join(told, on).drop("key")


def merged(entities: DataFrame, found: DataFrame, seen: str) -> DataFrame:
    """The entity table after resolved names: what is known with the names it was met by among its aliases and the newest date, and new entities.

    New ones have the id that a hash of user, type and name gives, so that the same
    run makes the same ids. found: as `resolved` gives it, with a date `seen`.
    """
    ours = found.withColumn("entity_id", F.coalesce("entity_id", F.pmod(F.xxhash64("user_id", "entity_type", F.lower("name")), F.lit(1 << 62))))
    met = ours.groupBy("entity_id").agg(
        F.min("user_id").alias("user_id"), F.min("entity_type").alias("entity_type"), F.min("name").alias("met_name"), F.collect_set(F.lower("name")).alias("met"), F.count("*").alias("n_events"), F.max(seen).alias("met_at")
    )
    both = entities.withColumnsRenamed({"user_id": "own_user", "entity_type": "own_type"}).join(met, "entity_id", "full")
    names = F.array_union(F.coalesce(F.transform("aliases", F.lower), F.array().cast("array<string>")), F.coalesce("met", F.array().cast("array<string>")))
    canonical = F.coalesce("canonical_name", "met_name")
    return both.select(
        "entity_id",
        F.coalesce("own_user", "user_id").alias("user_id"),
        F.coalesce("own_type", "entity_type").alias("entity_type"),
        canonical.alias("canonical_name"),
        F.array_sort(F.filter(names, lambda n: n != F.lower(canonical))).alias("aliases"),
        F.greatest("last_seen", "met_at").alias("last_seen"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


def details(entities: DataFrame, found: DataFrame, matches: DataFrame, seen: str, newest: int = 100) -> DataFrame:
    """entities with their number of events, the `newest` ones (event_id and date, latest first) and the counts of earlier matches by method.

    Spark ranks before it shuffles, so each task hands on no more than `newest` events of an entity.
    """
    held = found.where("entity_id IS NOT NULL").select("entity_id", F.col(seen).alias("seen"), "event_id")
    counts = held.groupBy("entity_id").agg(F.count("*").alias("n_events"))
    last = Window.partitionBy("entity_id").orderBy(F.desc("seen"), F.desc("event_id"))
    kept = held.withColumn("n", F.row_number().over(last)).where(F.col("n") <= newest)
    events = kept.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("n", "event_id", "seen"))).alias("events"))
    by_method = matches.groupBy("entity_id", "match_method").agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("match_method", "n"))).alias("match_history"))
    out = entities.join(counts, "entity_id", "left").join(events, "entity_id", "left").join(by_method, "entity_id", "left")
    return out.withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "events": F.transform("events", lambda e: F.struct(e["event_id"].alias("event_id"), e["seen"].alias("seen")))})
