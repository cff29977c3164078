"""Work that must not grow with the square of a group of copies, and results beside plain ones."""

from __future__ import annotations

import random

from tallyframe.operators import duplicates, entities, records
from tallyframe.plans import detection

JOINED = "JoinExec"


def most_joined_rows(df) -> int:
    """The largest number of rows that a join of the executed plan made."""

    def walk(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        if "QueryStage" in plan.getClass().getSimpleName():
            plan = plan.plan()
        rows = plan.metrics().apply("numOutputRows").value() if plan.getClass().getSimpleName().endswith(JOINED) else 0
        children = plan.children()
        return max([rows] + [walk(children.apply(i)) for i in range(children.size())])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_copies_of_a_token_set_are_compared_once(spark):
    rng = random.Random(5)
    kinds = [sorted(rng.sample("abcdefgh", rng.randrange(1, 6))) for _ in range(12)] + [[]]
    rows = [(i, i % 2, None, f"c{rng.randrange(40)}" if i % 3 else None, rng.sample(k := kinds[rng.randrange(13)], len(k))) for i in range(1500)]
    rows += [(2000, 0, "h", "z", ["q"]), (2001, 0, "h", "z", ["r"])]
    got = records.duplicate_cascade(spark.createDataFrame(rows, "file_id bigint, user_id int, file_hash string, content_hash string, tokens array<string>"), 0.6)
    assert most_joined_rows(got) < 20_000  # a tenth of the pairs of copies
    want, alike = {}, lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
    for n, (i, user, whole, content, tokens) in enumerate(rows):
        earlier = [r for r in rows[:n] if r[1] == user]
        exact = [r[0] for r in earlier if whole is not None and r[2] == whole]
        near = max(((alike(tokens, r[4]), -r[0]) for r in earlier), default=(0.0, 0))
        same = [r[0] for r in earlier if content is not None and r[3] == content]
        want[i] = ("exact", exact[0], 1.0) if exact else ("near", -near[1], round(near[0], 6)) if near[0] >= 0.6 else ("content", same[0], 1.0) if same else ("none", None, 0.0)
    assert {r["file_id"]: (r["duplicate_type"], r["original"], r["similarity"]) for r in got.collect()} == want


def test_families_of_texts_are_compared_by_kind(spark):
    rng, vocabulary = random.Random(9), [f"w{i}" for i in range(30)]
    rows, families = [], [rng.sample(vocabulary, 20) for _ in range(4)]
    for i in range(900):
        words = list(families[rng.randrange(4)])
        words[rng.randrange(20)] = f"own{i}" if i % 3 else rng.choice(vocabulary)
        rows.append((i, i % 2, " ".join(words) if i % 50 else rng.choice(["", "  ", None, "Own W1", "w1 own"])))
    got = duplicates.first_alike(spark.createDataFrame(rows, "id int, user int, memo string"), ["user"], "id", "memo", 0.85)
    sets, want = [(i, u, {*(t or "").lower().split()}) for i, u, t in rows], {}
    for n, (i, user, ours) in enumerate(sets):
        best = max(((len(ours & theirs) / len(ours | theirs), -k) for k, u, theirs in sets[:n] if u == user and ours and theirs), default=(0.0, 0))
        if best[0] >= 0.85:
            want[i] = (-best[1], best[0])
    assert {r["key"]: (r["first"], r["similarity"]) for r in got.collect()} == want and len(want) > 700


def test_near_rows_of_a_family_grow_with_the_rows(spark, tmp_path):
    """Texts that differ in one word were compared in pairs: 400 of a user made 80,000 pairs of signatures."""
    rows = [(12 * i + 11, 25) for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = detection.QUERIES["near_duplicate_rows"](spark, str(tmp_path))
    assert most_joined_rows(got) <= 800
    assert {r["id"]: (r["duplicate_of"], r["kind"], r["similarity"]) for r in got.collect()} == {k: (11, "near", 0.857143) for k, _ in rows[1:]}


def test_classes_of_names_stand_for_all_pairs(spark):
    names = ["machinery 1", "machinery 12", "Machinery 1", "building 1", "--", None]
    left = spark.createDataFrame([(i, names[i % 6], i % 4) for i in range(240)], "id bigint, name string, nation int")
    right = spark.createDataFrame([(i, names[(i * 5) % 6], i % 4) for i in range(180)], "id bigint, name string, nation int")
    all_pairs = {(r["block"], r["left_id"], r["right_id"]): r["similarity"] for r in entities.trigram_matches(left, right, "nation", 0.8).collect()}
    got = entities.trigram_links(left, right, "nation", 0.8)
    assert most_joined_rows(got) <= 500 < len(all_pairs)
    rows = got.collect()
    members = {side: [(r["block"], r["class_id"], r["id"], r["n_links"]) for r in rows if r["kind"] == side] for side in ("left", "right")}
    assert {m[2] for m in members["left"]} == {*range(240)} and len(members["left"]) == 240 and len(members["right"]) == 180
    spread = {(p["block"], a[2], b[2]): p["similarity"] for p in rows if p["kind"] == "pair" for a in members["left"] if a[:2] == (p["block"], p["id"]) for b in members["right"] if b[:2] == (p["block"], p["class_id"])}
    assert spread == all_pairs and sum(p["n_links"] for p in rows if p["kind"] == "pair") == len(all_pairs)
    for at, side in ((1, "left"), (2, "right")):
        assert all(m[3] == sum(p[at] == m[2] for p in all_pairs) for m in members[side])


def test_copies_of_a_dropped_text_go_with_it(spark, monkeypatch):
    """Copies of a text that goes for an earlier one's sake stayed."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, 1, 2, "t", long), (2, 2, 3, "t", long + " x"), (3, 3, 4, "t", long + " x"), (4, 4, 5, "t", "other")]
    links = spark.createDataFrame(rows, "relationship_id bigint, source_event_id bigint, target_event_id bigint, relationship_type string, semantic_description string")
    monkeypatch.setattr(detection, "view", lambda *_: links)
    assert {r["relationship_id"] for r in detection.QUERIES["unique_relationships"](spark, "").collect()} == {1, 4}


def test_numbered_names_do_not_all_meet(spark):
    """Names that differ in a number met on each of their rarer trigrams: 500 names of a user made tens of thousands of pairs."""
    known = [(i, 0, f"Customer#{7919 * i % 10**6:09d}", None) for i in range(1, 501)]
    asked = [(i, u, f"{n} ltd", m) for i, u, n, m in known]
    columns = "user_id int, name string, email string"
    got = records.resolve_entities(spark.createDataFrame(asked, f"id int, {columns}"), spark.createDataFrame(known, f"entity_id int, {columns}"))
    assert most_joined_rows(got) < 2_000
    found = {r["id"]: (r["entity_id"], r["method"]) for r in got.collect()}
    assert found == {i: (i, "fuzzy_name") for i in range(1, 501)}


def test_fuzzy_names_beside_all_pairs(spark):
    rng = random.Random(3)
    words = ["acme", "north", "steel", "trading", "aaaa", "aaaaaa", "07", "1999", "x", "\u00e9t\u00e9"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    changed = lambda s: "".join(rng.choice([c, c, c, c, c, c, c, "z"]) for c in s)
    known = [(i, rng.randrange(2), name(), None) for i in range(150)] + [(150, None, "acme", None), (151, 0, None, None), (152, 0, "", None)]
    asked = [(i, u, changed(n) if n else n, m) for i, u, n, m in known] + [(200 + i, i % 2, name(), None) for i in range(40)] + [(300, 0, "zz", None)]
    grams = lambda s: {s[i : i + 3] for i in range(max(len(s) - 2, 1))}
    columns = "user_id int, name string, email string"
    for least in (0.3, 0.6, 0.75, 0.9):
        want = {}
        for i, u, n, _ in asked:
            same = [k for k, v, o, _ in known if v == u and u is not None and n is not None and o == n]
            near = max(((len(grams(n) & grams(o)) / len(grams(n) | grams(o)), -k) for k, v, o, _ in known if v == u and None not in (u, n, o)), default=(0.0, 0))
            want[i] = (min(same), "exact_name", 1.0) if same else (-near[1], "fuzzy_name", round(near[0], 6)) if near[0] >= least else (None, "new", 0.0)
        got = records.resolve_entities(spark.createDataFrame(asked, f"id int, {columns}"), spark.createDataFrame(known, f"entity_id int, {columns}"), least)
        assert {r["id"]: (r["entity_id"], r["method"], r["confidence"]) for r in got.collect()} == want
        assert len({w[1] for w in want.values()}) == 3
