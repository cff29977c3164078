"""Links within files against all pairs, with files of one vendor, of many, of none, and of equal amounts; and how many pairs a large file forms."""

from __future__ import annotations

import random

from tallyframe.operators import relations

KIND = "user_id int, file_id int, event_id int, category string, vendor_standard string, amount_usd double"


def plain(rows, limit):
    found = {}
    for u, f, i, c, v, x in rows:
        for w, g, j, d, y, z in rows:
            if u == w and f == g and i != j and None not in (u, f):
                differ, vendor, near = None not in (c, d) and c != d, v is not None and v == y, None not in (x, z) and abs(x - z) < 1
                if differ or vendor or near:
                    found.setdefault(f, []).append((-(0.7 if (c, d) == ("revenue", "expense") else 0.8 if vendor else 0.6 if near else 0.5), i, j))
    return {(f, i, j, -s) for f, pairs in found.items() for s, i, j in sorted(pairs)[:limit]}


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    rows, event = [], 0
    for f in range(14):
        vendors = [["a"], ["a", "b", "c"], [None], [f"v{i}" for i in range(40)], ["a", None]][f % 5]
        categories = [["revenue", "expense"], ["revenue", "expense", "transfer", None], ["transfer"], ["x", "y", "z"]][f % 4]
        for _ in range(rng.choice([1, 6, 25])):
            event += 1
            rows.append((f % 2 if f else None, f, event, rng.choice(categories), rng.choice(vendors), rng.choice([None, 5.0, 5.5, 6.2, round(rng.random() * 30, 2)])))
    df = spark.createDataFrame(rows, KIND).repartition(3)
    for limit in (3, 20, 1000):
        got = {(r["file_id"], r["source_event_id"], r["target_event_id"], r["confidence"]) for r in relations.within_file_links(df, limit).collect()}
        assert got == plain(rows, limit), limit


def test_large_files_form_few_pairs(spark):
    """A file of many vendors, and one of equal amounts without vendors: joins put out a few times the limit, not the square of the file."""
    rows = [(1, 1, i, ["revenue", "expense"][i % 2], f"v{i}", float(i * 10)) for i in range(2000)] + [(1, 2, 5000 + i, "transfer", None, 7.0) for i in range(2000)]
    found = relations.within_file_links(spark.createDataFrame(rows, KIND), 100)
    assert found.groupBy("file_id").count().collect() and sorted(r["count"] for r in found.groupBy("file_id").count().collect()) == [100, 100]
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert made and max(made) <= 10_000
