"""Keyword automata, document models, edit distances and identifiers against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.catalogs import DOCUMENT_TYPES, PLATFORMS, read_catalog
from tallyframe.operators import keywords
from tallyframe.plans import detection

SF = "/root/testdata/sf0.001"


def occurrences(text, word):
    return [m.start() for m in re.finditer(f"(?={re.escape(word)})", text)]


def test_catalogues():
    assert len(PLATFORMS) == 25 and len(DOCUMENT_TYPES) == 18
    assert all(x.id and x.name and x.words and x.field_patterns and 0 < x.boost <= 1 for x in PLATFORMS + DOCUMENT_TYPES)


def test_catalogue_files(tmp_path):
    (tmp_path / "a.json").write_text('{"money": {"bill": {"name": "Bill", "keywords": ["due", 1040], "indicators": ["amount due"], "field_patterns": ["due_date"], "confidence_boost": 0.5}}, "memo": {"indicators": ["note"]}}')
    bill, memo = read_catalog(str(tmp_path / "a.json"))
    assert (bill.id, bill.name, bill.category, bill.words, bill.boost) == ("bill", "Bill", "money", ("due", "1040", "amount due"), 0.5)
    assert (memo.name, memo.category, memo.words, memo.boost) == ("memo", "unknown", ("note",), 1.0)


def test_ten_thousand_words_overlapping(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(20_000)] + ["Ünï", "aa", ""]
    texts = ["".join(rng.choice("abc ") for _ in range(300)) for _ in range(40)] + [None, "", "ÜNÏ ünïünï", "A" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    own = dict.fromkeys(w.lower() for w in words if w)
    assert len(own) > 10_000
    for r in df.select("id", keywords.keyword_hits(F.col("text"), [("x", w) for w in words]).alias("h")).collect():
        text = (texts[r["id"]] or "").lower()
        want = {w: p for w in own if (p := occurrences(text, w))}
        assert {h["word"]: (h["hits"], h["first"]) for h in r["h"]} == {w: (len(p), p[0] + len(w) - 1) for w, p in want.items()}


def test_shared_words_and_limits():
    assert dict(keywords.owners([("a", "Bill"), ("b", "bill"), ("b", "")])) == {"bill": "b"}
    with pytest.raises(ValueError):
        keywords.owners([("a", str(i)) for i in range(keywords.MOST_WORDS + 1)])


def test_platforms_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", []), (3, "Stripe ch_1", ["Charge_ID"]), (4, "qb xero", None)], "__hits int, memo string, fields array<string>")
    found = {r["__hits"]: r["platform"] for r in keywords.detect_platform(df, F.col("memo"), F.col("fields"), PLATFORMS).collect()}
    assert found[1] == found[2] and (found[1]["name"], found[1]["confidence"]) == ("unknown", 0.1)
    assert found[3]["name"] == "Stripe" and abs(found[3]["confidence"] - min((0.95 + 0.1) * 0.9, 1)) < 1e-12
    assert found[4]["name"] == "QuickBooks" and abs(found[4]["confidence"] - (1 - 1 / 2 + 0.1) * 0.9) < 1e-12


def test_benchmark_word_hits(spark):
    lower = [r["t"] for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.lower("text").alias("t")).collect()]
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for w in {w for t in items for w in re.findall(r"\w\w+", t)}:
        counts = [len(occurrences(t, w)) for t in lower if w in t]
        if counts:
            want[w] = (len(counts), sum(counts))
    assert {r["word"]: (r["n_docs"], r["hits"]) for r in detection.QUERIES["benchmark_word_hits"](spark, SF).collect()} == want


def test_profile_cosines(spark):
    profiles = {"a": "tax tax refund", "b": "bank tax", "c": "school"}
    texts = {1: "Tax refund, tax!", 2: "nothing here", 3: None, 4: "bank school school x"}
    grams = {k: Counter(re.findall(r"\w\w+", (t or "").lower())) for k, t in {**profiles, **texts}.items()}
    df = Counter(t for k in profiles for t in grams[k])
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in df.items()}
    unit = lambda g: (lambda v: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()})({t: n * idf[t] for t, n in g.items() if t in idf})
    model = keywords.fit_profiles(spark.createDataFrame(list(profiles.items()), "label string, text string"))
    got = {(r["id"], r["label"]): r["cosine"] for r in keywords.profile_cosines(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", F.col("text"), model).collect()}
    want = {(k, p): sum(x * unit(grams[p]).get(t, 0) for t, x in unit(grams[k]).items()) for k in texts for p in profiles}
    assert {k: v for k, v in want.items() if v > 0}.keys() == got.keys() and all(abs(want[k] - v) < 1e-12 for k, v in got.items())


def test_word_totals_hold_counts_only(spark):
    texts = ["Abc abcab", "", None, "zzz", "ab" * 500] * 300
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = keywords.word_totals(df, "text", [("x", "ab"), ("y", "ABC"), ("z", "nowhere")])
    want = {w: (sum(w in (t or "").lower() for t in texts), sum(len(occurrences((t or "").lower(), w)) for t in texts)) for w in ("ab", "abc")}
    assert {r["word"]: (r["n_docs"], r["hits"]) for r in got.collect()} == want and {r["label"] for r in got.collect()} == {"x", "y"}
    assert keywords.word_totals(df, "text", []).count() == 0
