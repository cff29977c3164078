"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a few dozen words. Each passage is encoded
by a small layer over counts of its characters and its words, words hashed to
WORD_SLOTS slots; gated attention,
learned from document labels alone, weighs the passages; the weighted mean of
their encodings is scored. Passage features are counted for whole batches of
documents at once.

The model is fitted on a bounded sample: at most `max_documents` labelled rows
with the smallest hash of their key, and of these as many as have `max_passages`
passages together; of rows that repeat a key, one. Every row of the scored table is scored
over its whole text.

Null and empty texts are one passage without words. Rows that repeat a key are
scored alike. Labels that are null, or whose key is null or has no document,
teach nothing; with no label at all, or only one kind, every score is the
share of good labels, or 0.5. An empty table gives no scores. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .tokens import slices, small_batches

#: Words in a passage, size of an encoded passage and of the attention layer.
PASSAGE_WORDS, ENCODED, ATTENTION = 32, 16, 8
#: Kinds of bytes that are counted; bytes in none of them are letters in lower case.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!?", b".,;:'\"-()", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256))]
#: Slots that words are hashed to.
WORD_SLOTS = 64
#: How much less than a plain feature a slot counts at first, as there are many of them.
SLOT_DAMPING = 15.0
FEATURES = len(KINDS) + 6 + WORD_SLOTS
#: Features besides the slots.
PLAIN = FEATURES - WORD_SLOTS


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages in order, first passage of each text and the end)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b" ".join(texts) + b" " + bytes(8), dtype=np.uint8)
    kind_of = np.full(256, len(KINDS), dtype=np.uint8)
    for k, members in enumerate(KINDS):
        kind_of[list(members)] = k
    body = text[:-8]
    space = (body == 32) | ((body >= 9) & (body <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edge[0::2], edge[1::2]
    if len(start) == 0:
        return np.zeros((len(texts), FEATURES), np.float32), np.arange(len(texts) + 1)
    owner = np.searchsorted(ends, start, side="right")
    first_word = np.searchsorted(owner, np.arange(len(texts)))
    n_words = np.diff(np.append(first_word, len(start)))
    bags = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(bags)])
    passage = first[owner] + (np.arange(len(start)) - first_word[owner]) // PASSAGE_WORDS
    total = int(first[-1])
    words = np.bincount(passage, minlength=total)
    length = stop - start
    kinds = kind_of[body]
    out = np.zeros((total, FEATURES), np.float64)
    filled = np.flatnonzero(words)
    begin = start[np.searchsorted(passage, filled)]
    for k in range(len(KINDS)):
        out[filled, k] = np.add.reduceat(kinds == k, begin, dtype=np.int64)
    letters = np.bincount(passage, weights=length, minlength=total)
    out[:, : len(KINDS)] /= np.maximum(letters, 1)[:, None]
    head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[start]).view("<u8")[:, 0]
    head &= np.where(length < 8, (np.uint64(1) << (8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
    same = np.concatenate([[False], (head[1:] == head[:-1]) & (length[1:] == length[:-1]) & (owner[1:] == owner[:-1])])
    slot = ((head ^ length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64) % WORD_SLOTS
    last = kinds[stop - 1]
    share = np.maximum(words, 1)
    out[:, PLAIN - 6] = np.bincount(passage, weights=same, minlength=total) / share
    out[:, PLAIN - 5] = np.bincount(passage, weights=length, minlength=total) / share / 10
    out[:, PLAIN - 4] = np.bincount(passage, weights=length == 1, minlength=total) / share
    out[:, PLAIN - 3] = np.bincount(passage, weights=(last == 5) | (last == 3), minlength=total) / share
    out[:, PLAIN - 2] = np.bincount(passage, weights=length > 20, minlength=total) / share
    out[:, PLAIN - 1] = np.log1p(words) / 4
    out[:, PLAIN:] = np.bincount(passage * WORD_SLOTS + slot, minlength=total * WORD_SLOTS).reshape(total, WORD_SLOTS) / share[:, None]
    return out.astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Weights of the encoder, the attention's two branches, and the scorer; `prior` alone if nothing was learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.5

    def _bags(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        hidden = np.tanh(x @ w["encode"] + w["encode_bias"])
        told, gate = np.tanh(hidden @ w["tell"]), _sigmoid(hidden @ w["gate"])
        raw = (told * gate) @ w["attend"]
        starts = first[:-1]
        owner = np.repeat(np.arange(len(starts)), np.diff(first))
        heavy = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        share = heavy / np.add.reduceat(heavy, starts)[owner]
        pooled = np.add.reduceat(share[:, None] * hidden, starts, axis=0)
        return {"x": x, "hidden": hidden, "told": told, "gate": gate, "share": share, "pooled": pooled, "owner": owner, "score": _sigmoid(pooled @ w["score"] + w["score_bias"][0])}

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(first) - 1, self.prior)
        return self._bags(features.astype(np.float64), first)["score"]

    def gradient(self, features: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w, b = self.weights, self._bags(features, first)
        owner, starts = b["owner"], first[:-1]
        off = (b["score"] - label) / len(label)
        pooled = off[:, None] * w["score"]
        share = (pooled[owner] * b["hidden"]).sum(axis=1)
        raw = b["share"] * (share - np.add.reduceat(b["share"] * share, starts)[owner])
        mixed = raw[:, None] * w["attend"]
        told, gate = mixed * b["gate"] * (1 - b["told"] ** 2), mixed * b["told"] * b["gate"] * (1 - b["gate"])
        hidden = b["share"][:, None] * pooled[owner] + told @ w["tell"].T + gate @ w["gate"].T
        inner = hidden * (1 - b["hidden"] ** 2)
        return {
            "encode": b["x"].T @ inner,
            "encode_bias": inner.sum(axis=0),
            "tell": b["hidden"].T @ told,
            "gate": b["hidden"].T @ gate,
            "attend": (b["told"] * b["gate"]).T @ raw,
            "score": b["pooled"].T @ off,
            "score_bias": off.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], label: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 7) -> AttentionModel:
    """Adam on the log loss, one shuffled pass over the bags per epoch."""
    stacked = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    spread = stacked.std(axis=0, dtype=np.float64) + 1e-3
    spread[PLAIN:] *= SLOT_DAMPING
    model = AttentionModel(stacked.mean(axis=0, dtype=np.float64), spread, prior=float(np.mean(label)) if len(label) else 0.5)
    if len(set(label.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    shapes = {"encode": (FEATURES, ENCODED), "encode_bias": (ENCODED,), "tell": (ENCODED, ATTENTION), "gate": (ENCODED, ATTENTION), "attend": (ATTENTION,), "score": (ENCODED,), "score_bias": (1,)}
    model.weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    step = 0
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            some = order[at : at + batch]
            edges = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            slope = model.gradient(np.concatenate([bags[i] for i in some]).astype(np.float64), edges, label[some])
            step += 1
            for k, g in slope.items():
                g = g + 1e-4 * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] -= rate * (1 - epoch / epochs) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, max_documents: int, max_passages: int, key: str, text: str, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Passage features and labels of a sample bounded in documents and in passages, those with the smallest hash of their key.

    Documents of more than a twentieth of max_passages come after all others, the
    shortest first, so that one of them cannot take the room of the rest.
    """
    known = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").alias("__label")).dropna()
    chosen = known.groupBy("__key").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(max_documents)
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text")).join(F.broadcast(chosen), "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            features, first = passage_features([(t or "").encode() for t in batch.column("__text").to_pylist()])
            blobs = [features[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__label").cast(pa.int64()), pa.array(blobs, pa.binary())], names=["key", "label", "features"])

    kind = rows.schema["__key"].dataType.simpleString()
    read = rows.transform(small_batches).mapInArrow(run, f"key {kind}, label bigint, features binary")
    found = materialise(read.groupBy("key", "label").agg(F.min("features").alias("features")), "bags")
    size = F.octet_length("features") / (4 * FEATURES)
    long = F.greatest(F.col("n") - max_passages / 20, F.lit(0.0))
    before = Window.orderBy(long, F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)  # max_documents rows at most
    within = found.select("key", size.alias("n")).withColumn("sum", F.sum("n").over(before)).where(F.col("sum") <= max_passages)
    bags = found.join(F.broadcast(within.select("key")), "key", "left_semi").toPandas().sort_values("key")
    return [np.frombuffer(f, np.float32).reshape(-1, FEATURES) for f in bags["features"]], bags["label"].to_numpy(dtype=np.float64)


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 8000, max_passages: int = 200_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel:
    bags, marks = labelled_sample(docs, labels, max_documents, max_passages, key, text, label)
    return fit(bags, marks)


def score(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`: the probability of label 1, from the whole text."""
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            features, first = passage_features([(t or "").encode() for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(features, first))], names=[*kept, out])

    source = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in kept))
    return source.transform(small_batches).mapInArrow(run, source.withColumn(out, F.lit(0.0)).schema)


def held_out(key: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether a row is in the fold that labels are not learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == 0, F.lit(False))
