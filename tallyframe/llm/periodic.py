"""Runs of repeated words: maximal periodic stretches of a text's words, and the text with each run cut to its first period.

A run is a stretch of words with smallest period q, at least `exponent` periods
long, that no neighbouring word extends. By the runs theorem each run holds a
copy of its period that is the longest Lyndon word at its start, under the order
of words or under the reverse order. A stack of Lyndon factors, scanned right to
left under either order, gives the longest Lyndon word at every start; the
comparisons of suffixes it needs, and the extension of each candidate to both
sides, are longest common extensions found by binary search over rolling hashes
and then verified on the words themselves.

The scan is run where runs can be. Each word of a run occurs at least `exponent`
times in it, and again within a quarter of its length (for exponent 4), so words
that are too rare or too far apart in a stretch are in no run and cut it into
shorter stretches, to which the same applies. This leaves no run out and shortens
none: a neighbouring word that extended a run would be part of it and so not cut.

Words are the bytes between ASCII white space. A null text has no words, no runs
and an empty collapsed text. Rows that repeat a key are separate rows; an empty
table gives an empty result; extra columns are not read. Memory grows with the
longest text, about a hundred bytes a word where it is periodic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import slices, small_batches

#: Modulus and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 1_000_003_271_939
#: Words compared directly before hashes are used.
DIRECT = 4
#: Times that stretches are cut; what is left then is scanned, so this changes no result.
CUTS = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_powers = [1]


class Extensions:
    """Longest common extensions of two places of a sequence of numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.raw = np.array(words, np.int64)
        self.hashes = list(accumulate(words, lambda h, w: (h * BASE + w + 1) % PRIME, initial=0))
        while len(_powers) <= self.n:
            _powers.append(_powers[-1] * BASE % PRIME)
        #: By distance, a stretch whose words are verified to repeat at that distance, the first word after which does not.
        self.verified: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, k: int) -> bool:
        h, power = self.hashes, _powers[k]
        return (h[i + k] - h[i] * power - h[j + k] + h[j] * power) % PRIME == 0

    def _differ(self, i: int, j: int, k: int) -> np.ndarray:
        """The words, of k, in which the places differ; read directly."""
        return np.flatnonzero(self.raw[i : i + k] != self.raw[j : j + k])

    def right(self, i: int, j: int) -> int:
        """Words from i on that are those from j on; i < j."""
        words, most = self.words, self.n - j
        k, direct = 0, min(DIRECT, most)
        while k < direct and words[i + k] == words[j + k]:
            k += 1
        if k < DIRECT:
            return k
        low, high = self.verified.get(j - i, (-1, -1))
        if low <= i < high:
            return high - i
        if i < low and self._equal(i, j, low - i) and not self._differ(i, j, low - i).size:
            k = high - i
        else:
            step = 2 * DIRECT
            while step <= most and self._equal(i, j, step):
                k, step = step, 2 * step
            k = self._search(k, min(step, most + 1), lambda m: self._equal(i, j, m))
            if (differ := self._differ(i, j, k)).size:
                k = int(differ[0])
        self.verified[j - i] = (i, i + k)
        return k

    def left(self, i: int, j: int) -> int:
        """Words before i that are those before j; i < j."""
        words, k, direct = self.words, 0, min(DIRECT, i)
        while k < direct and words[i - 1 - k] == words[j - 1 - k]:
            k += 1
        if k < DIRECT:
            return k
        step = 2 * DIRECT
        while step <= i and self._equal(i - step, j - step, step):
            k, step = step, 2 * step
        k = self._search(k, min(step, i + 1), lambda m: self._equal(i - m, j - m, m))
        if (differ := self._differ(i - k, j - k, k)).size:
            k -= int(differ[-1]) + 1
        return k

    @staticmethod
    def _search(low: int, high: int, holds) -> int:
        """The last of low <= m < high for which `holds`; it holds for low."""
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low


def runs(words: list[int], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `exponent` periods and `least` words; exponent 2 or more."""
    n, found, at = len(words), set(), Extensions(words)
    for reverse in (False, True):
        stack: list[int] = []  # starts of the Lyndon factors of what lies right of i, the nearest last
        last: dict[int, tuple[int, int]] = {}  # by period, the run found last under this order
        for i in range(n - 1, -1, -1):
            same, word = 0, words[i]
            while stack:
                j = stack[-1]
                same = at.right(i, j) if word == words[j] else 0
                if j + same == n or (words[i + same] < words[j + same]) == reverse:
                    break  # the suffix at j is smaller: the longest Lyndon word at i ends before it
                stack.pop()
            period = (stack[-1] if stack else n) - i
            stack.append(i)
            # of a run's periods that are Lyndon words, the first has less than one period before it
            if i + period < n and same > (exponent - 2) * period:
                start, end = last.get(period, (n, n))
                if not start <= i < end:
                    start, end = i - at.left(i, i + period), i + period + same
                    last[period] = start, end
                    if end - start >= max(least, exponent * period):
                        found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, doc: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that may hold runs. ids: numbers of words; doc: the text that each is in, ascending."""
    place, part, size = np.arange(len(ids)), doc.astype(np.int64), np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
    most = int(ids.max()) + 1 if len(ids) else 1
    for _ in range(CUTS):
        if not len(place):
            return []
        key = part * most + ids[place]
        order = np.argsort(key, kind="stable")
        key, at = key[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([first, [len(key)]]))
        gap = np.concatenate([[len(ids)], np.diff(at), [len(ids)]]) * exponent
        gap[first] = len(ids) * exponent
        near = np.minimum(gap[:-1], gap[1:])
        keep = np.zeros(len(place), bool)
        keep[order] = (np.repeat(count, count) >= exponent) & (near <= size[part[order]])
        before, place, was = len(place), place[keep], part[keep]
        cut = np.concatenate([[True], (np.diff(place) != 1) | (was[1:] != was[:-1])]) if len(place) else np.zeros(0, bool)
        part = np.cumsum(cut) - 1
        size = np.bincount(part)
        long = size[part] >= least
        place, part = place[long], part[long]
        if len(place) == before:
            break
    if not len(place):
        return []
    cut = np.flatnonzero(np.diff(place) != 1) + 1
    cut = np.union1d(cut, np.flatnonzero(np.diff(doc[place]) != 0) + 1)
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip([0, *cut], [*cut, len(place)], strict=True)]


class Numbers(dict):
    """Numbers of words in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def collapse(texts: list[bytes], exponent: int = 4, least: int = 6) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, text without the words that repeat a run's first period) of each text."""
    split = [t.split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    ids = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
    doc = np.repeat(np.arange(len(split)), counts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(ids, doc, exponent, least):
        d = int(doc[a])
        if own := runs(ids[a:b].tolist(), exponent, least):
            found.setdefault(d, []).extend((a - int(ends[d]) + s, length, period) for s, length, period in own)
    for d, words in enumerate(split):
        own = sorted(found.get(d, []), key=lambda r: (r[0], r[2]))
        kept = words
        if own:
            keep = np.ones(len(words), bool)
            for s, length, period in own:
                keep[s + period : s + length] = False
            kept = [words[i] for i in np.flatnonzero(keep)]
        yield len(words), own, b" ".join(kept)


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """Per row: the key, n_words, runs (start, length and period in words, by start, then period) and collapsed, the text without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            n_words, found, texts = zip(*collapse([t or b"" for t in batch.column("__text").to_pylist()], exponent, least), strict=True)
            flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), parts)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(n_words, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    source = small_batches(docs.select(docs[key].alias("__key"), docs[text].cast("string").cast("binary").alias("__text")))
    return source.mapInArrow(run, f"`{key}` {source.schema['__key'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
