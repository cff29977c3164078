"""Similarity of strings by Indel distance: insertions and deletions only, lengths less twice the longest common subsequence.

Common subsequences are computed bit-parallel, one bit for each character of
the shorter string: many pairs at once where it has at most 64 characters, one
pair at a time with wide integers otherwise. Ratios run from 0 to 100; two empty
strings are alike (100), a null string is like none (0).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a machine word, and pairs of strings in one batch.
WORD, BATCH = 64, 4096
Pair = tuple[str, str]


def _codes(texts: Sequence[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _narrow(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """Longest common subsequences of pairs whose shorter string fits in a word."""
    a, b = _codes(short, WORD, 0xFFFFFFFF), _codes(long, max(map(len, long)), 0xFFFFFFFE)
    state = np.full(len(short), 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(b.shape[1]):
            same = state & np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
            state = (state + same) | (state - same)
    size = np.fromiter(map(len, short), np.uint64, len(short))
    within = np.where(size == WORD, ~np.uint64(0), (np.uint64(1) << (size % np.uint64(WORD))) - np.uint64(1))
    return np.bitwise_count(~state & within).astype(np.int64)


def _wide(short: str, long: str) -> int:
    places: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    within = (1 << len(short)) - 1
    state = within
    for c in long:
        same = state & places.get(c, 0)
        state = ((state + same) | (state - same)) & within
    return len(short) - state.bit_count()


def common(pairs: Sequence[Pair]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    out = np.zeros(len(ordered), np.int64)
    # pairs of like lengths go together, so that a long string does not widen a batch
    narrow = sorted((i for i, (a, _) in enumerate(ordered) if 0 < len(a) <= WORD), key=lambda i: len(ordered[i][1]))
    for at in range(0, len(narrow), BATCH):
        some = narrow[at : at + BATCH]
        out[some] = _narrow([ordered[i][0] for i in some], [ordered[i][1] for i in some])
    for i, (a, b) in enumerate(ordered):
        if len(a) > WORD:
            out[i] = _wide(a, b)
    return out


def ratios(pairs: Sequence[Pair]) -> np.ndarray:
    """100 times one less the Indel distance over the sum of lengths."""
    total = np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))
    return np.where(total == 0, 100.0, 200.0 * common(pairs) / np.maximum(total, 1))


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratios(pairs: Sequence[Pair]) -> np.ndarray:
    """Ratios of the strings with their words in order."""
    return ratios([(sorted_tokens(a), sorted_tokens(b)) for a, b in pairs])


def _windows(a: str, b: str) -> list[Pair]:
    """The shorter string with every stretch of the longer one that it can lie on, shorter ones at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return [(a, b)]
    n = len(a)
    cuts = [b[:i] for i in range(1, n)] + [b[i : i + n] for i in range(len(b) - n + 1)] + [b[i:] for i in range(len(b) - n + 1, len(b))]
    return [(a, w) for w in dict.fromkeys(cuts)]


#: Cells of the largest table of matches that is held at once.
CELLS = 1 << 20


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings in one row, where each string starts, and its length. Nulls have length 0."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = "".join(plain.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(whole, np.uint32), np.cumsum(size) - size, size


def _best_stretch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best ratio of each row of a with the stretches of the same row of b that it can lie on; a is no wider than b and a word at most.

    The characters of b that each of a's equal are one word; all stretches of one length go through it at once.
    """
    n, m = a.shape[1], b.shape[1]
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= n)
    within = ~kind(0) >> kind(np.iinfo(kind).bits - n)
    hits, back = np.zeros(b.shape, kind), np.zeros(b.shape, kind)
    for i in range(n):
        same = (b == a[:, i : i + 1]).astype(kind)
        hits |= same << kind(i)
        back |= same << kind(n - 1 - i)
    back = back[:, ::-1]
    common = lambda state: np.bitwise_count(~state & within)
    state = np.full((len(a), m - n + 1), ~kind(0), kind)
    for j in range(n):
        same = state & hits[:, j : j + m - n + 1]
        state = (state + same) | (state - same)
    best = 200.0 * common(state).max(axis=1) / (2 * n)
    for way in (hits, back):  # shorter stretches at the start, then at the end
        state = np.full(len(a), ~kind(0), kind)
        for j in range(n - 1):
            same = state & way[:, j]
            state = (state + same) | (state - same)
            best = np.maximum(best, 200.0 * common(state) / (n + j + 1))
    return best


def partial_ratios_of(texts: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Partial ratios of pairs of strings of an array, given by their places in it."""
    points, start, size = _points(texts)
    left, right = np.where(size[left] <= size[right], left, right), np.where(size[left] <= size[right], right, left)
    out = np.where(size[right] == 0, 100.0, 0.0)
    short = np.flatnonzero((size[left] > 0) & (size[left] <= WORD))
    by_sizes = short[np.lexsort((size[right[short]], size[left[short]]))]
    cuts = np.flatnonzero(np.diff(size[left[by_sizes]]) | np.diff(size[right[by_sizes]])) + 1
    for group in np.split(by_sizes, cuts) if len(by_sizes) else ():
        n, m = int(size[left[group[0]]]), int(size[right[group[0]]])
        step = max(1, CELLS // m)
        for at in range(0, len(group), step):
            some = group[at : at + step]
            a, b = points[start[left[some]][:, None] + np.arange(n)], points[start[right[some]][:, None] + np.arange(m)]
            out[some] = np.maximum(_best_stretch(a, b), _best_stretch(b, a)) if n == m else _best_stretch(a, b)
    for i in np.flatnonzero(size[left] > WORD):
        a, b = texts[int(left[i])].as_py(), texts[int(right[i])].as_py()
        out[i] = ratios(_windows(a, b) + (_windows(b, a) if len(a) == len(b) else [])).max()
    return out


def partial_ratios(pairs: Sequence[Pair]) -> np.ndarray:
    """The best ratio of the shorter string with a stretch of the longer one; of equal lengths, either way."""
    n = len(pairs)
    return partial_ratios_of(pa.array([a for a, _ in pairs] + [b for _, b in pairs], pa.string()), np.arange(n), np.arange(n, 2 * n))


def token_set_ratios(pairs: Sequence[Pair]) -> np.ndarray:
    """100 if one string's words are all in the other; else the best of what the words not shared, and each side with the shared ones, have in common."""
    out, rest, asks = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both = x & y
        if both and (x <= y or y <= x):
            out[i] = 100.0
            continue
        left, right, shared = " ".join(sorted(x - both)), " ".join(sorted(y - both)), len(" ".join(sorted(both)))
        gap = 1 if shared else 0
        rest.append((left, right))
        asks.append((i, shared, gap, len(left), len(right)))
    for (i, shared, gap, n, m), lcs in zip(asks, common(rest), strict=True):
        best = 100 - 100 * (n + m - 2 * lcs) / (2 * (shared + gap) + n + m)
        if shared:
            best = max(best, *(100 - 100 * (gap + k) / (2 * shared + gap + k) for k in (n, m)))
        out[i] = best
    return out


def _column(measure: Callable[[Sequence[Pair]], np.ndarray]) -> Callable[[Column, Column], Column]:
    def ratio(a: Column, b: Column) -> Column:
        @F.arrow_udf("double")
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            pairs = list(zip(x.to_pylist(), y.to_pylist(), strict=True))
            distinct = {p: i for i, p in enumerate(dict.fromkeys(p for p in pairs if None not in p))}
            values = measure(list(distinct))
            return pa.array([0.0 if None in p else float(values[distinct[p]]) for p in pairs], pa.float64())

        return run(a.cast("string"), b.cast("string"))

    ratio.__doc__ = measure.__doc__
    return ratio


ratio, token_sort_ratio, partial_ratio, token_set_ratio = map(_column, (ratios, token_sort_ratios, partial_ratios, token_set_ratios))


def nearest_ratio(text: Column, words: Sequence[str]) -> Column:
    """The best partial ratio of a text with any of some fixed words; 0 for a null text."""

    @F.arrow_udf("double")
    def best(texts: pa.Array) -> pa.Array:
        n, k = len(texts), len(words)
        both = pa.concat_arrays([texts.cast(pa.string()), pa.array(words, pa.string())])
        found = partial_ratios_of(both, np.repeat(np.arange(n), k), np.tile(np.arange(n, n + k), n)).reshape(n, k).max(axis=1)
        return pa.array(np.where(texts.is_valid().to_numpy(zero_copy_only=False), found, 0.0))

    return best(text.cast("string"))


def id_score(ours: Column, theirs: Column) -> Column:
    """1 if two lists of identifiers share one, else the best partial ratio of any two, as 0 to 1; 0 if either list is empty or null."""

    @F.arrow_udf("double")
    def best(x: pa.Array, y: pa.Array) -> pa.Array:
        held = [(a.flatten().cast(pa.string()), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for a in (x, y)]
        (ours, n), (theirs, m) = held
        owner = np.repeat(np.arange(len(n)), n * m)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        left = np.repeat(np.cumsum(n) - n, n * m) + nth // np.maximum(m[owner], 1)
        right = len(ours) + np.repeat(np.cumsum(m) - m, n * m) + nth % np.maximum(m[owner], 1)
        both = pa.concat_arrays([ours, theirs])
        told = pc.fill_null(pc.greater(pc.utf8_length(both), 0), False).to_numpy(zero_copy_only=False)
        kept = told[left] & told[right]
        out = np.zeros(len(n))
        np.maximum.at(out, owner[kept], partial_ratios_of(both, left[kept], right[kept]) / 100)
        return pa.array(out)

    clean = lambda ids: F.array_distinct(F.array_compact(F.coalesce(ids.cast("array<string>"), F.array().cast("array<string>"))))
    return F.when(F.arrays_overlap(clean(ours), clean(theirs)), 1.0).otherwise(best(clean(ours), clean(theirs)))
