"""Token ids of whole texts by a file of the `tokenizers` library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


#: Whitespace characters in a row from which a text goes to `tokenizers`: the regex engine of `tiktoken` keeps one entry for each on a stack of about a million.
LONG_RUN = 100_000


def same_merges(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The ranks and the added tokens of a plain byte-level BPE file of the `tokenizers` library, else None.

    Plain means: no normaliser, no prefix space, no dropout, each merge makes the
    entry of the next id, and added tokens are found as they are written. Merging
    by ids is then merging by the file's list.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) or len({bool(t.get("normalized")) for t in added}) > 1:
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    vocab = model["vocab"]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(map(chars.__getitem__, token)): i for token, i in vocab.items() if i < 256 + len(merged)}
    return ranks, {t["content"]: vocab.get(t["content"], t["id"]) for t in added if t["content"]}


@lru_cache(maxsize=4)
def library(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes texts to int32 ids in `tokenizers` itself, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [np.array(e.ids, dtype="<i4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes texts to the int32 ids of Tokenizer.encode(text, add_special_tokens=False), once per worker.

    Added tokens of the file that stand in a text are one id each. Plain
    byte-level files run their merges in `tiktoken`, which gives the same ids in a
    quarter of the time; texts with very long whitespace runs, which overflow its
    regex, and all other files run in `tokenizers` itself.
    """
    if (found := same_merges(path)) is None:
        return library(path)
    import public_tokenizers
    import tiktoken

    ranks, added = found
    own = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    long_run = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}").search

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and long_run(text):
            return library(path)([text])[0]
        if not any(t in text for t in added):
            return np.array(own.encode_ordinary(text), dtype="<i4")
        ids = []
        for i, part in enumerate(split(text)):
            ids += [added[part]] if i % 2 else own.encode_ordinary(part)
        return np.array(ids, dtype="<i4")

    return lambda texts: [encode(t) for t in texts]


def int_lists(blobs: list[bytes]) -> pa.Array:
    """Arrow list<int32> of little-endian int32 blobs, without going through Python ints."""
    ends = np.cumsum([0, *[len(b) // 4 for b in blobs]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))


#: Bytes in an Arrow batch between Spark and Python; Spark's own bound of 64 MB counts twice in each running task.
BATCH_BYTES, SPARK_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands batches of about 4 MB to Python unless it has set a bound of its own."""
    conf = df.sparkSession.conf
    if str(conf.get(BATCH_BYTES)).rstrip("bB") == str(SPARK_BATCH_BYTES):
        conf.set(BATCH_BYTES, 4 << 20)
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about max_bytes of `column`; memory of a batch is given back after it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // max_bytes)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
        pa.default_memory_pool().release_unused()


def with_length(docs: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, n_tokens) of every row; a null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "__text"):
            counts = [len(ids) for ids in encode([t or "" for t in batch.column("__text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    source = docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("__text"))
    return source.mapInArrow(run, f"`{key}` {source.schema['__key'].dataType.simpleString()}, n_tokens bigint")
