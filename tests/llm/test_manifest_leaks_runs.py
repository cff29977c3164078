"""Merkle manifest, benchmark decontamination and periodic runs: plain versions of their contracts, and odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontamination, merkle, periodic, queries
from test_operators import ODD, none, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def crc(key):
    return zlib.crc32(str(key).encode())


def levels_of(nodes):
    """All levels of a tree, by the plain rule."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, i):
    """The siblings of leaf i, left and right of it, level by level."""
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        run = level[first : first + 8]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= 8
    return out


def written(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest(rows):
    """Contract of op11 by one pass over all rows; the rows are (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, written(row), row))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: levels_of([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    top = levels_of([made[t][-1][0] for t in names])
    out = Counter()
    for k, t in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            path = path_of(made[t], i) + path_of(top, k)
            low = row[4] and re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
            at = written((*row[:4], low)) if row[0] is not None and crc(row[0]) % 3 == 0 else leaf
            for left, right in path:
                at = digest(*left, at, *right)
            out[row[0], leaf, made[t][-1][0], top[-1][0], digest(*(x for left, right in path for x in left + right)), at, at == top[-1][0]] += 1
    return out


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_op11(spark):
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "source", "lang", "n_chars", "text")
    got = Counter(rows_of(queries.QUERIES["op11_merkle_manifest"](spark, SF), *MANIFEST))
    assert got == manifest(docs) and {k[-1] for k in got} == {True, False}


def test_manifest_of_many_rows_trees_nulls_and_repeats(spark, tmp_path):
    """Trees of one row, of exactly one run and block, and beyond one block; null trees, keys and texts; rows given twice; more trees than a block."""
    rng = random.Random(5)
    rows = [(i, "s", "big", i, f"Text {i}") for i in range(1300)] + [(i, None, "block", None, "T") for i in range(512)] + [(i, "s", "run", 1, "T") for i in range(8)]
    rows += [(i, "s", f"tree {i}", 1, None if i % 2 else "") for i in range(600)]
    rows += [(7, "s", None, 1, "A"), (None, "s", None, 1, "A"), (None, "s", None, 1, "A"), (7, "s", None, 1, "A"), (7, "s", None, 1, "b"), (8, None, "é", 1, "A"), (8, None, "Z", 1, "A")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(rows_of(queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)), *MANIFEST)) == manifest(rows)


def test_walk_and_treehash():
    for n in [*range(1, 75), 448, 449, 511, 512]:
        nodes = [digest(str(i)) for i in range(n)]
        levels, stack = levels_of(nodes), merkle.Treehash(merkle.height(n))
        for node in nodes:
            stack.feed(node)
            assert all(len(run) < 8 for run in stack.waiting)
        assert stack.take() == levels[-1] and len(levels) == merkle.height(n) + 1
        assert list(merkle.walk(nodes, merkle.height(n))) == [[("".join(a), "".join(b)) for a, b in path_of(levels, i)] for i in range(n)]


def test_manifest_of_odd_rows(odd, none):  # noqa: F811
    found = merkle.manifest(odd, ["doc_id", "text"], tree="bucket", carry={"digest": F.col("score"), "tree": F.col("n")})
    out = found.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(out) == len(ODD) and all(r["again"] == r["root"] and r["digest"] == 1.5 and r["tree"] == r["doc_id"] for r in out)
    assert Counter((r["doc_id"], r["leaf"]) for r in out) == Counter((k, written((k, t))) for k, t in ODD)
    assert merkle.manifest(none, ["doc_id", "text"], tree="bucket").count() == 0
    assert merkle.manifest(odd.where("doc_id = 5"), ["doc_id", "text"], tree="bucket").select("proof", (F.col("leaf") == F.col("root")).alias("lone")).collect() == [([], True)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items, size=10):
    """Contract of op12 by looking every window up at every place."""
    owners = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            owners.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = Counter()
    for key, text in docs:
        w, hit, own = words(text), set(), set()
        for length in {len(g) for g in owners}:
            for i in range(len(w) - length + 1):
                if (g := tuple(w[i : i + length])) in owners:
                    hit |= set(range(i, i + length))
                    own |= owners[g] - {None}
        out[key, len(w), len(hit), len(own), digest(",".join(sorted(map(str, own)))), bool(hit)] += 1
    return out


LEAKS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_op12(spark):
    docs, items = rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"), rows_of(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    want = leaks(docs, items)
    assert Counter(rows_of(queries.QUERIES["op12_decontamination"](spark, SF), *LEAKS)) == want and any(k[-1] for k in want)


ITEMS = [(1, "A b, c"), (2, "a B c d e f g h i j k l"), (2, "k l"), (3, None), (4, ""), (None, "is 3"), (5, "m m m m m m m m m m m"), (6, "日本語 Текст"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 nowhere"), (8, "b c d e f g h i j k")]


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, -1])
def test_windows_in_odd_rows(spark, odd, none, limit):  # noqa: F811
    texts = [t for _, t in ODD] + ["x a b c d e f g h i j k l a b c", "m " * 25, "A--B.c", "\x00it'S 3"]
    docs = spark.createDataFrame([(i if i else None, t, "row", 1, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, id string, at int, words array<int>").repartition(3)
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id int, text string, window string")
    got = decontamination.occurrences(docs, items, limit=limit)
    rows = Counter((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), digest(",".join(sorted(map(str, r["items"])))), bool(r["spans"])) for r in got.withColumn("n_hit", decontamination.covered(F.col("spans"))).collect())
    assert rows == leaks([(i if i else None, t) for i, t in enumerate(texts)], ITEMS)
    assert decontamination.occurrences(none, items, limit=limit).count() == 0
    clean = decontamination.occurrences(odd, items.limit(0), limit=limit).collect()
    assert len(clean) == len(ODD) and not any(r["spans"] or r["items"] for r in clean)


def plain_runs(w, exponent=4, least=6):
    """All maximal stretches of each period, without those of a smaller one."""
    found = set()
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, exponent * p):
                found.add((s, i + p - s, p))
            i = max(i, s + 1)
    return sorted((r for r in found if not any(w[r[0] : r[0] + r[1] - q] == w[r[0] + q : r[0] + r[1]] for q in range(1, r[2]))), key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


def periods(docs):
    """Contract of op13."""
    out = Counter()
    for key, text in docs:
        w, h = split(text), 1 if key is None else crc(key)
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        out[key, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest(*(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(collapsed(w, found)))] += 1
    return out


PERIODS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op13(spark):
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 8000"), "doc_id", "text")
    want, whole = periods(docs), Counter(rows_of(queries.QUERIES["op13_periodic_runs"](spark, SF), *PERIODS))
    short = {k for k, _ in docs}
    assert Counter({k: n for k, n in whole.items() if k[0] in short}) == want and sum(k[1] > 0 for k in want) > 10
    assert len(short) > 150 and sum(whole.values()) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_op13_on_odd_texts(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "a\x0ba\x0ca\ra\ta\na b", "é é é é é é x", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, "a"), (3, "a")]
    spark.createDataFrame([(*d, 1, []) for d in docs], "doc_id bigint, text string, g int, words array<int>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(rows_of(queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)), *PERIODS)) == periods(docs)


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for turn in range(1500):
        w = []
        for _ in range(rng.randrange(1, 5)):
            block = [rng.randrange(2 + turn % 3) for _ in range(rng.randrange(1, 7))]
            w += (block * rng.randrange(1, 9))[: rng.randrange(1, 40)]
        w *= rng.choice([1, 1, 5])
        assert periodic.runs(w) == plain_runs(w) and periodic.runs(w, 2, 2) == plain_runs(w, 2, 2)
        ((n, found, text),) = periodic.collapse([" ".join(map(str, w)).encode()])
        assert (n, found, text.decode().split()) == (len(w), plain_runs(w), list(map(str, collapsed(w, plain_runs(w)))))


def test_runs_survive_wrong_hashes(monkeypatch):
    """Verification on the words finds equal hashes of unequal stretches."""
    monkeypatch.setattr(periodic, "PRIME", 3)
    monkeypatch.setattr(periodic, "_powers", [1])
    rng = random.Random(4)
    for _ in range(300):
        w = ([rng.randrange(3) for _ in range(rng.randrange(1, 8))] * 12)[: rng.randrange(8, 70)]
        w[rng.randrange(len(w))] = 9
        assert periodic.runs(w) == plain_runs(w)


def test_long_periodic_text_is_quick():
    words = [b"w%d" % i for i in range(300)]
    ((n, found, text),) = periodic.collapse([b" ".join(words * 400)])
    assert (n, found, text) == (120_000, [(0, 120_000, 300)], b" ".join(words))


def test_collapse_of_odd_rows(odd, none):  # noqa: F811
    out = periodic.collapse_runs(odd).collect()
    assert Counter((r["doc_id"], r["collapsed"]) for r in out) == Counter((k, " ".join(collapsed(split(t), plain_runs(split(t)) if len(split(t)) < 1000 else [(0, 20_000, 977)]))) for k, t in ODD)
    assert periodic.collapse_runs(none).count() == 0


def test_numbers_of_a_hot_group_and_of_equal_rows_are_dealt(spark):
    """One group with nine tenths of the rows, and rows that agree in all but the tie, spread over the tasks; numbers are gapless."""
    from tallyframe.llm.ranking import numbered
    from tallyframe.llm.store import Tables, materialise

    rows = spark.range(6000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("g"), F.lit(None).cast("bigint").alias("key"))
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    tables = Tables(spark)
    out = numbered(rows, ["g"], ["key", "tie"], tables, "x", "k", "n", parts=8).collect()
    found = {}
    for r in out:
        found.setdefault(r["g"], []).append((r["k"], r["n"]))
    assert len(out) == 6000 and all(sorted(v) == [(i, len(v)) for i in range(len(v))] for v in found.values())
    sizes = [r["count"] for r in spark.read.parquet(tables.paths["x_sorted"]).groupBy(F.shiftright("__at", 33).alias("task")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 6000 / 8


def test_sketch_rows_that_are_nearly_empty_and_nearly_full(spark):
    """Sparse and whole rows of the count sketch add up to the counts of all n-grams, over several tasks."""
    import numpy as np

    from tallyframe.llm import ngram_join

    rng, shift = np.random.default_rng(3), np.uint64(20)
    dense = [int(x) for x in (np.arange(ngram_join.SKETCH_ROW, dtype=np.uint64) << shift).repeat(2)]
    thin = [int(x) for x in (rng.integers(ngram_join.SKETCH_ROW, ngram_join.SKETCH, 500).astype(np.uint64) << shift)]
    lists = [dense[i::4] for i in range(4)] + [thin, thin[:100], dense, []]
    level = ngram_join.rarity(spark.createDataFrame([(g,) for g in lists], "grams array<bigint>").repartition(5))
    counts = np.bincount((np.array([g for x in lists for g in x], np.uint64) >> shift).astype(np.int64) % ngram_join.SKETCH, minlength=ngram_join.SKETCH)
    assert (level == np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)).all()
