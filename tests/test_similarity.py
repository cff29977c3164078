"""Edit ratios against plain dynamic programming, and the stored index of signatures against exact similarity."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import cleaning, edits
from tallyframe.operators import lsh_index
from tallyframe.plans import detection

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100.0 if not a + b else 200 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    """Best ratio of the shorter string with any stretch of the longer one of at most its length."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    ways = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max((ratio(x, y[i:k]) for x, y in ways for i in range(len(y) + 1) for k in range(i, min(len(y), i + len(x)) + 1) if k - i == len(x) or i == 0 or k == len(y)), default=0.0)


def words(rng, n, alphabet="abcé日 "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_common_subsequences_of_short_and_long_strings():
    rng = random.Random(1)
    pairs = [(words(rng, rng.randrange(90)), words(rng, rng.randrange(200))) for _ in range(300)]
    pairs += [(words(rng, n), words(rng, n)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 700)] + [("a" * 64, "a" * 64), ("", "x"), ("𝕏y", "y𝕏")]
    assert edits.common(pairs).tolist() == [lcs(a, b) for a, b in pairs]
    assert edits.common([]).tolist() == []
    a = words(rng, 3000)
    assert edits.common([(a, a[:1000] + "!" + a[1000:])]).tolist() == [3000]


def test_ratios_equal_plain_ones():
    rng = random.Random(2)
    pairs = [(words(rng, rng.randrange(14)), words(rng, rng.randrange(22))) for _ in range(250)] + [("", ""), ("", "a"), ("INV-12", "inv 12"), ("abcd", "dabc")]
    for got, want in ((edits.ratios(pairs), [ratio(a, b) for a, b in pairs]), (edits.partial_ratios(pairs), [partial(a, b) for a, b in pairs])):
        assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 1e-9
    assert edits.token_sort_ratios([("b a", "a  b"), ("new york mets", "mets york new")]).tolist() == [100, 100]
    sets = edits.token_set_ratios([("a b c", "c b"), ("", "a"), ("a b", "c d"), ("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("invoice march pdf", "invoice april pdf")])
    shared, left, right = len("invoice pdf"), "march", "april"
    best = max(100 - 100 * (10 - 2 * lcs(left, right)) / (2 * shared + 12), 100 - 100 * 6 / (2 * shared + 6))
    assert sets[0] == 100 and sets[1] == 0 and sets[3] == 100 and abs(sets[4] - best) < 1e-9 and abs(sets[2] - 100 * (1 - (6 - 2 * lcs("a b", "c d")) / 6)) < 1e-9


def test_ratio_columns(spark):
    rows = [("ACME Inc", "acme"), (None, "x"), ("", ""), ("ACME Inc", "acme"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r["r"] for r in df.select(edits.ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [ratio("ACME Inc", "acme"), 0.0, 100.0, ratio("ACME Inc", "acme"), 0.0]
    ids = spark.createDataFrame([(["INV-1", "x"], ["x", None]), (["INV-12"], ["INV12"]), ([], ["a"]), (None, None), ([None], ["a"])], "a array<string>, b array<string>")
    assert [r["r"] for r in ids.select(edits.id_score(F.col("a"), F.col("b")).alias("r")).collect()] == pytest.approx([1.0, partial("INV-12", "INV12") / 100, 0, 0, 0])
    vendors = spark.createDataFrame([("Acme Inc.",), ("  ",), (None,)], "v string").select(cleaning.standard_vendor(F.col("v")).alias("s")).select("s.*").collect()
    assert vendors[0]["vendor_standard"] == "Acme" and vendors[0]["confidence"] == pytest.approx(0.7 + 0.25 * ratio("acme inc.", "acme") / 100)
    assert [tuple(r) for r in vendors[1:]] == [("", 0.0, "empty")] * 2


def test_relationship_id_scores(spark):
    got = detection.QUERIES["relationship_id_scores"](spark, SF).limit(40).collect()
    assert got and all(0 <= r["id_score"] <= 1 for r in got)


def jaccard(a, b):
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [[f"w{rng.randrange(4000)}" for _ in range(100)] for _ in range(60)]
    out = {}
    for i, words_ in enumerate(base):
        for j in range(5):  # from the same to about .7 alike
            changed = list(words_)
            for k in range(4 * j):
                changed[rng.randrange(100)] = f"n{i}_{j}_{k}"
            out[i * 5 + j] = (f"u{i % 3}", " ".join(changed))
    return out | {900: ("u0", None), 901: ("u0", "  "), 902: (None, "a b"), 903: (None, "B a")}


def test_index_finds_removes_and_keeps_versions(spark, tmp_path, texts):
    index = lsh_index.LshIndex(spark, str(tmp_path / "index"), parts=16)
    assert index.version() == 0
    rows = spark.createDataFrame([(u, k, t) for k, (u, t) in texts.items()], "who string, id bigint, body string").repartition(3)
    assert index.insert(rows.where("id < 200 OR id >= 900"), "who", "id", "body") == 1
    assert index.insert(rows.where("id >= 200 AND id < 900"), "who", "id", "body") == 2
    found = {(r["query"], r["key"]): r["similarity"] for r in index.query(rows, "who", "id", "body").collect()}
    close = {(a, b) for a, (u, s) in texts.items() for b, (v, t) in texts.items() if a != b and u == v and jaccard(s, t) >= 0.8}
    assert len(close & found.keys()) >= 0.9 * len(close) > 100 and (902, 903) in found
    assert all(texts[a][0] == texts[b][0] and jaccard(texts[a][1], texts[b][1]) > 0.6 for a, b in found)
    # removal, replacement, an earlier version, a copy of what is live
    gone, other = next(p for p in sorted(found) if p[0] < 900)
    assert index.remove(spark.createDataFrame([(texts[gone][0], gone)], "who string, id bigint"), "who", "id") == 3
    left = {(r["query"], r["key"]) for r in index.query(rows, "who", "id", "body").collect()}
    assert left == {p for p in found if p[1] != gone}
    assert {(r["query"], r["key"]) for r in index.query(rows, "who", "id", "body", version=2).collect()} == found.keys()
    index.insert(spark.createDataFrame([(texts[gone][0], gone, "quite another text")], rows.schema), "who", "id", "body")
    assert not [r for r in index.query(rows.where(F.col("id") == other), "who", "id", "body").collect() if r["key"] == gone]
    copy = index.compact(str(tmp_path / "copy"))
    for i in (index, copy):
        assert {(r["query"], r["key"]) for r in i.query(rows.where(F.col("id") != gone), "who", "id", "body").collect()} == {p for p in left if p[0] != gone}
    assert {r["user"]: r["n_entries"] for r in copy.stats().collect()} == {r["user"]: r["n_entries"] for r in index.stats().collect()} == {"u0": 102, "u1": 100, "u2": 100, None: 2}


def test_query_reads_its_own_buckets(spark, tmp_path):
    index = lsh_index.LshIndex(spark, str(tmp_path / "index"), parts=512)
    rows = spark.createDataFrame([("u", i, f"a{i} b{i} c{i}") for i in range(200)], "who string, id bigint, body string")
    index.insert(rows, "who", "id", "body")
    asked = spark.createDataFrame([("u", 1000, "a7 b7 c7")], rows.schema)
    plan = index.query(asked, "who", "id", "body")
    assert [(r["key"], r["similarity"]) for r in plan.collect()] == [(7, 1.0)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    listed = next(line for line in text.splitlines() if "band#" in line and "PartitionFilters: [part#" in line)
    assert " IN (" in listed or "INSET" in listed


def test_keep_first(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (7, 8)]
    keys, gone = sorted({x for p in pairs for x in p}), set()
    for k in keys:
        if k not in gone:
            gone |= {b for a, b in pairs if a == k}
    found = lsh_index.dropped_by_first(spark.createDataFrame(pairs, "first int, second int"))
    assert {r["key"] for r in found.collect()} == gone == {2, 4, 5, 8}
    assert lsh_index.dropped_by_first(spark.createDataFrame([], "first int, second int")).count() == 0


def test_near_duplicate_rows(spark):
    from tallyframe.sources.records import view

    by_user = defaultdict(list)
    for r in view(spark, SF, "payloads").where("memo <> ''").orderBy("id").collect():
        by_user[r["user_id"]].append((r["id"], r["memo"]))
    want = {}
    for rows in by_user.values():
        for n, (key, memo) in enumerate(rows):
            if same := [k for k, m in rows[:n] if m == memo]:
                want[key] = (same[0], "exact")
    got = {r["id"]: r for r in detection.QUERIES["near_duplicate_rows"](spark, SF).collect()}
    assert {k: (r["duplicate_of"], r["kind"]) for k, r in got.items() if r["kind"] == "exact"} == want
    memos = {k: m for rows in by_user.values() for k, m in rows}
    assert all(jaccard(memos[k], memos[r["duplicate_of"]]) > 0.7 for k, r in got.items())


def test_near_duplicate_files(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {(r["doc_id"], r["other"]): r["similarity"] for r in detection.QUERIES["stored_lsh_matches"](spark, SF).collect()}
    close = {(a, b) for a in docs if a % 100 == 0 for b in docs if a != b and docs[a]["lang"] == docs[b]["lang"] and jaccard(docs[a]["text"], docs[b]["text"]) >= 0.85}
    assert len(close & found.keys()) >= 0.9 * len(close)
    for r in detection.QUERIES["near_duplicate_files"](spark, SF).collect():
        assert found[r["doc_id"], r["other"]] == max(s for (a, _), s in found.items() if a == r["doc_id"]) and 0.7 <= r["confidence"] <= 1
