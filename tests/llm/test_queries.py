"""The queries opN_ over whole small tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tallyframe.llm import license_scan, pii, queries

from test_operators import jump, library, near, tik

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    groups = defaultdict(list)
    for k, t in docs.items():
        groups[t or ""].append(k)
    want = {(k, max(ks), len(ks), k == max(ks), hashlib.sha256(t.encode()).hexdigest()) for t, ks in groups.items() for k in ks}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in run(spark, "op1_exact_dedup")} == want


def test_op2(spark, docs):
    rows = run(spark, "op2_quality_mil")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    told = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(told) > 10 and np.mean(told) >= 0.9


def test_op3(spark, docs):
    encode, pieces, held = library(), defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_packing"):
        pieces[r["doc_id"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in docs.items():
        ids, at = [*encode(t), 0], 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for found in held.values():
        found.sort()
        assert [o for o, _ in found] == np.concatenate([[0], np.cumsum([n for _, n in found])[:-1]]).tolist() and sum(n for _, n in found) <= 1024
    assert sum(n for f in held.values() for _, n in f) > 0.98 * 1024 * (len(held) - 1)


def test_op4(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    want = set()
    for q in (i for i in range(len(ids)) if ids[i] % 20 == 0):
        order = sorted((-float(s), i) for s, i in zip(x @ x[q], ids, strict=True) if i != ids[q])[:20]
        want |= {(ids[q], i) for _, i in order}
    got = {(r["query_id"], r["vec_id"]) for r in run(spark, "op4_anisotropic_mips")}
    assert len(got & want) >= 0.999 * len(want) and len(got) == len(want)


def test_op5(spark, docs):
    """Surrogates put back by plain replacement of each detected mention give the original text, and none of it shows."""
    rows = {r["doc_id"]: r for r in run(spark, "op5_surrogates")}
    assert rows.keys() == docs.keys()
    stands_for: dict = {}
    for k, t in docs.items():
        was, now = pii.detect(t), rows[k]
        assert now["n_entities"] == sum(e[5] for e in was) and now["kinds"] == ",".join(sorted({e[2] for e in was}))
        shift, plain = 0, []
        at = 0
        for a, b, kind, canonical, *_ in was:
            plain.append(t[at:a])
            at = b
            made = now["text"][a + shift :]
            end = len(made) if not t[b : b + 1] else made.find(t[b : b + 8])
            shift += end - (b - a)
            assert made[:end] != t[a:b]
            stands_for.setdefault((kind, canonical), set()).add(pii._canonical(kind, made[:end]))
            plain.append(made[:end])
        assert "".join([*plain, (t or "")[at:]]) == (now["text"] or "")
    assert all(len(v) == 1 for v in stands_for.values())
    assert len({(k[0], *v) for k, v in stands_for.items()}) == len(stands_for) > 3


def test_op6(spark, docs):
    encode = library()
    want = Counter(len(encode(t)) for t in docs.values())
    total = sum(n * c for n, c in want.items())
    for r in run(spark, "op6_token_counts"):
        assert want[r["n_tokens"]] == r["n_docs"] and r["tokens_total"] == total
        assert r["truncated_total"] == sum(min(n, r["n_tokens"]) * c for n, c in want.items())


def test_op7(spark, docs):
    own = tik()
    for r in run(spark, "op7_byte_bpe"):
        text = docs[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op8(spark, docs):
    slots = defaultdict(list)
    for r in run(spark, "op8_jump_shards"):
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "key", jump(r["doc_id"], 24), jump(r["doc_id"], 25))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, docs):
    found = 0
    for r in run(spark, "op9_license_scan"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]] or ""))
        base = sorted((i, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
        labels = {label for _, label in base}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(base), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 and (not base or r["score"] == 1)
        found += len(base)
    assert found > 0


def test_op10(spark, docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, "op10_ngram_join"))
    assert got == near(list(docs.items()), 3, 90)
