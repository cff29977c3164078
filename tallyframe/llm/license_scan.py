"""License notices found through a positional index of rare words.

All templates share one inverted index, word -> (template, position). A first
pass counts, over all documents, how many hold each indexed word. A second pass
goes through a file's indexed words from the highest inverse document frequency
down, and lets each vote for the alignments (file position less template
position) of the templates it names, up to RAREST words a template. Alignments
with two votes, and those at which the template's mandatory phrase stands, are
verified: the phrase must be there and enough of the other words in their places.
So a notice is reported exactly where its phrase stands and its words are
covered. Phrases that imply a label by themselves are searched for exactly.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
A-Z in lower case. Null text counts as empty and has no words, places or
labels, and score 0. Repeated rows are scanned alike, an empty table gives an
empty result, and extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices, small_batches

# Labels, the paragraphs of public licences and notices, and the phrase each must hold.
TEMPLATES = [
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided by the copyright holders and contributors as is"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license", "the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license v 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
]
# Phrases whose consecutive words imply a label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Rare words of a file that vote for a template, and the share of its words that an alignment must match.
RAREST, COVERAGE = 3, 0.6

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


@dataclass
class Index:
    """The templates (label, words, mandatory phrase, its position) and the postings of all their words."""

    templates: list[tuple[str, list[bytes], list[bytes], int]]
    postings: dict[bytes, list[tuple[int, int]]]


def build_index(templates: list[tuple[str, str, str]]) -> Index:
    index = Index([], {})
    for t, (label, text, phrase) in enumerate(templates):
        words, must = words_of(text), words_of(phrase)
        at = next((i for i in range(len(words)) if words[i : i + len(must)] == must), None)
        if at is None or not must:
            raise ValueError(f"the mandatory phrase of {label} is not in its template")
        index.templates.append((label, words, must, at))
        for i, w in enumerate(words):
            index.postings.setdefault(w, []).append((t, i))
    return index


def notices(words: list[bytes], index: Index, idf: dict[bytes, float], rarest: int = RAREST, coverage: float = COVERAGE) -> list[tuple[int, int, float]]:
    """(template, file position of its first word, share of its words in place) of each verified alignment."""
    held = index.postings.keys() & set(words)
    if not held:
        return []
    where: dict[bytes, list[int]] = {w: [] for w in held}
    for i, w in enumerate(words):
        if w in where:
            where[w].append(i)
    whole = {t for t, (_, _, must, _) in enumerate(index.templates) if held.issuperset(must)}
    votes: dict[int, Counter[int]] = {}
    voters: Counter[int] = Counter()
    for w in sorted(held, key=lambda w: (-idf.get(w, 0.0), w)):
        spots: dict[int, list[int]] = {}
        for t, q in index.postings[w]:
            if t in whole and voters[t] < rarest:
                spots.setdefault(t, []).append(q)
        for t, positions in spots.items():
            voters[t] += 1
            votes.setdefault(t, Counter()).update({i - q for q in positions for i in where[w]})
    found = []
    for t in sorted(whole):
        label, text, must, must_at = index.templates[t]
        key = min(must, key=lambda w: len(where[w]))  # the phrase's own places
        at_phrase = {i - must.index(key) - must_at for i in where[key]}
        for at in sorted({a for a, n in votes.get(t, {}).items() if n >= min(2, voters[t])} | at_phrase):
            if at + must_at < 0 or words[at + must_at : at + must_at + len(must)] != must:
                continue
            same = sum(1 for q, w in enumerate(text) if 0 <= at + q < len(words) and words[at + q] == w)
            if same >= coverage * len(text):
                found.append((t, at, same / len(text)))
    return found


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every position at which the phrase's words stand consecutively, overlaps included."""
    joined, needle = b" " + b" ".join(words) + b" ", b" " + b" ".join(phrase) + b" "
    out, at, seen, upto = [], joined.find(needle), 0, 0
    while at >= 0:
        seen += joined.count(b" ", upto, at)
        upto = at
        out.append(seen)
        at = joined.find(needle, at + 1)
    return out


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """(documents, documents that hold each word); the result has a row per indexed word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in slices(batches, "__text"):
            rows += batch.num_rows
            for t in batch.column("__text").to_pylist():
                seen.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), rows], pa.int64())], names=["word", "n"])

    source = docs.select(F.col(f"`{text}`").cast("string").alias("__text"))
    counts = {bytes(r["word"]): r["n"] for r in source.transform(small_batches).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.pop(b"", 0), counts


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, base (label and word position of each phrase) and notices (label, position, coverage)."""
    index = build_index(templates)
    searched = [(words_of(p), label) for p, label in phrases]
    vocabulary = set(index.postings) | {w for p, _ in searched for w in p}
    total, counts = document_frequency(docs, vocabulary, text)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    notice_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            n_words, base, found = [], [], []
            for t in batch.column("__text").to_pylist():
                words = words_of(t)
                held = vocabulary.intersection(words)
                n_words.append(len(words))
                base.append([{"label": label, "word": at} for phrase, label in searched if held.issuperset(phrase) for at in places(words, phrase)])
                found.append([{"label": index.templates[t][0], "word": at, "coverage": share} for t, at, share in notices(words, index, idf)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(base, base_type), pa.array(found, notice_type)], names=[key, "n_words", "base", "notices"])

    source = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text"))
    kind = source.schema[key].dataType.simpleString()
    return source.transform(small_batches).mapInArrow(run, f"`{key}` {kind}, n_words bigint, base array<struct<label:string,word:bigint>>, notices array<struct<label:string,word:bigint,coverage:double>>")
