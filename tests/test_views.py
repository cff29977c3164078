"""The stored views against full joins after streams of changes, repeats and removals."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyframe.streaming import views

KINDS = {
    "relationships": "id bigint, user_id bigint, source_event_id bigint, target_event_id bigint, relationship_type string, confidence_score double, pattern_id bigint",
    "causal": "relationship_id bigint, user_id bigint, causal_score double, causal_direction string",
    "temporal": "id bigint, user_id bigint, relationship_type string, confidence_score double, avg_days_between double, seasonal_period_days int, seasonal_amplitude double",
    "patterns": "id bigint, user_id bigint, relationship_type string",
    "cross_platform": "id bigint, user_id bigint, source_event_id bigint, target_event_id bigint, source_platform string",
    "predicted": "id bigint, user_id bigint, source_event_id bigint, status string, confidence_score double, prediction_reasoning string",
    "causes": "id bigint, user_id bigint, problem_event_id bigint, root_cause_description string",
}


def made(rng, name, i):
    user, event, kind = rng.randrange(3), rng.randrange(8), rng.choice(["a", "b", None])
    return {
        "relationships": (i, user, event, rng.randrange(8), kind, rng.random(), rng.choice([0, 1, None])),
        "causal": (rng.randrange(14), user, rng.random(), "x"),
        "temporal": (i, user, kind, rng.random(), float(i), i, 1.0),
        "patterns": (rng.randrange(3), user, "p"),
        "cross_platform": (i, user, event, rng.randrange(8), "s"),
        "predicted": (i, user, event, rng.choice(["pending", "expired"]), rng.random(), "r"),
        "causes": (i, user, event, "c"),
    }[name]


def test_view_follows_streams_of_changes(spark, tmp_path):
    rng = random.Random(6)
    rows = {name: {i: made(rng, name, i) for i in range(12)} for name in KINDS}
    tables = lambda: {name: spark.createDataFrame(list(held.values()), KINDS[name]) for name, held in rows.items()}
    view = views.EnrichedView(spark, str(tmp_path / "view"), tables)
    view.build()

    def same():
        want = views.enriched(tables())
        got = view.current()
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))

    same()
    for turn in range(2):
        told = None
        for name in KINDS:
            before = [rows[name].pop(i) for i in rng.sample(sorted(rows[name]), 2)]  # removed, or changed
            after = {20 * (turn + 1) + i: made(rng, name, 20 * (turn + 1) + i) for i in range(2)}
            rows[name] |= after
            keys = views.changed_keys(name, spark.createDataFrame([*before, *after.values()], KINDS[name]))
            told = keys if told is None else told.unionByName(keys)
        told.coalesce(1).write.mode("append").json(str(tmp_path / "changes"))
        stream = spark.readStream.schema("name string, user_id bigint, key string").json(str(tmp_path / "changes"))
        query = view.follow(stream, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
        same()
    view.merge(told, 2)  # the last batch again
    same()
    copy = view.table.compact(str(tmp_path / "copy"), views.enriched(tables()).schema)
    assert copy.current(views.enriched(tables()).schema).count() == view.current().count()


def test_metrics_of_changed_users(spark, tmp_path):
    now = {"rows": spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "user string, x int")}
    view = views.MetricsView(spark, str(tmp_path / "m"), lambda: now["rows"], lambda df: df.groupBy("user").agg(F.sum("x").alias("total")), "user")
    view.refresh()
    assert {r["user"]: r["total"] for r in view.current().collect() if r["user"]} == {"a": 3, "b": 3}
    now["rows"] = spark.createDataFrame([("a", 10), ("c", 1)], "user string, x int")
    view.refresh(1, spark.createDataFrame([("a",), ("b",), ("c",)], "user string"))
    view.refresh(1, spark.createDataFrame([("a",), ("b",), ("c",)], "user string"))
    assert {r["user"]: r["total"] for r in view.current().collect() if r["user"]} == {"a": 10, "c": 1}


def test_relationships_of_the_enriched_view_are_made_once(spark, monkeypatch):
    """They were joined from orders and customers for each of seven tables."""
    from tallyframe.plans import algorithms
    from tallyframe.sources import records

    calls = []
    for module in (algorithms, records):
        made = module.relationships
        monkeypatch.setattr(module, "relationships", lambda ledger, made=made: calls.append(1) or made(ledger))
    assert algorithms.QUERIES["enriched_view_after_batches"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
