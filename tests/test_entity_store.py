"""Names of events, whom they stand for, and the entity table after them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyframe.operators import entity_store
from tallyframe.plans import detection

SF = "/root/testdata/sf0.001"


def test_names_resolve_and_merge(spark):
    events = spark.createDataFrame(
        [(1, "u", "", "ACME", "Bob", date(2024, 1, 1)), (2, "u", "acme gmbh", "x", None, date(2024, 3, 1)), (3, "u", None, None, " ", date(2024, 1, 1)), (4, "v", "Acme", None, "bob", date(2024, 2, 2)), (5, "u", "New One", None, None, date(2024, 5, 5)), (6, "u", "new one", None, None, date(2023, 5, 5))],
        "event_id int, user_id string, vendor_standard string, vendor string, employee string, day date",
    )
    known = spark.createDataFrame(
        [(7, "u", "vendor", "Acme", ["ACME GmbH"], date(2024, 2, 1)), (8, "u", "vendor", "other", ["acme"], None), (9, "u", "employee", "bob", None, date(2025, 1, 1))],
        "entity_id bigint, user_id string, entity_type string, canonical_name string, aliases array<string>, last_seen date",
    )
    names = entity_store.event_names(events, ["event_id", "user_id", "day"])
    assert {(r["event_id"], r["entity_type"], r["name"]) for r in names.collect()} == {(1, "vendor", "ACME"), (1, "employee", "Bob"), (2, "vendor", "acme gmbh"), (4, "vendor", "Acme"), (4, "employee", "bob"), (5, "vendor", "New One"), (6, "vendor", "new one")}
    found = entity_store.resolved(names, known)
    told = {(r["event_id"], r["entity_type"]): (r["entity_id"], r["match_method"]) for r in found.collect()}
    new = (None, "new_entity")
    assert told == {(1, "vendor"): (7, "exact_name"), (1, "employee"): (9, "exact_name"), (2, "vendor"): (7, "alias"), (4, "vendor"): new, (4, "employee"): new, (5, "vendor"): new, (6, "vendor"): new}
    after = {(r["user_id"], r["canonical_name"]): r for r in entity_store.merged(known, found, "day").collect()}
    assert len(after) == 6 and after["u", "Acme"]["aliases"] == ["acme gmbh"] and after["u", "Acme"]["last_seen"] == date(2024, 3, 1) and after["u", "other"]["n_events"] == 0
    fresh = after["u", "New One"]
    assert fresh["n_events"] == 2 and fresh["last_seen"] == date(2024, 5, 5) and fresh["entity_id"] not in (7, 8, 9) and fresh["aliases"] == []
    again = entity_store.merged(known, found, "day").where("canonical_name = 'New One'").first()["entity_id"]
    assert again == fresh["entity_id"]
    # the next run knows it
    later = entity_store.resolved(names, entity_store.merged(known, found, "day"))
    assert later.where("match_method = 'new_entity'").count() == 0
    shown = {r["entity_id"]: r for r in entity_store.details(known, found, found.where("entity_id IS NOT NULL"), "day", newest=1).collect()}
    assert [e["event_id"] for e in shown[7]["events"]] == [2] and shown[7]["n_events"] == 2 and shown[8]["events"] is None and [tuple(m) for m in shown[7]["match_history"]] == [("alias", 1), ("exact_name", 1)]
    assert entity_store.event_names(events.select("event_id", "user_id"), ["event_id"]).count() == 0


def test_queries_reach_every_way_of_matching(spark):
    ways = {r["match_method"] for r in detection.QUERIES["resolved_event_entities"](spark, SF).select("match_method").distinct().collect()}
    assert ways == {"exact_name", "alias", "new_entity"}
    assert detection.QUERIES["merged_entities"](spark, SF).where(F.col("known") & (F.col("n_events") > 0)).count() > 0
