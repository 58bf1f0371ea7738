"""Periodic runs of words, by Lyndon roots from the grouping phase of Baier's suffix sorter.

A run is a stretch of words with smallest period ``q``, at least ``max(MIN_WORDS, 2 * q)`` words long, that no
neighbouring word extends. Every run holds a root that is the longest Lyndon word at its start under one of two orders
of the words, the given one or its reverse. So for each order:

1. The grouping phase sorts suffixes into groups by their Lyndon prefix (``lyndon_array``): groups are intervals, taken
   from the highest down. Each member points to the nearest earlier suffix in a lower group; those gain the group's
   context as often as they are pointed at and move up, behind what is left of their own group. The length of a group's
   context when it is taken is the length of the longest Lyndon word at its members.
2. Each such word is extended to both sides by longest common extensions (``runs_of``). A root inside a run of its
   period that is known already is passed over.

The order of the words is that of their first occurrence; any total order gives the same runs.

Most texts hold no run, and the grouping is done only where one can be: a run repeats at distance ``q`` for
``max(MIN_WORDS - q, q)`` words or more, so each of its words lies in a stretch of ``MIN_WORDS / 2`` words that stands
twice in the text. Stretches are compared by 64-bit hashes of their words (a chance collision only adds work), and each
maximal stretch of such words is searched by itself: no run crosses its ends.

Nulls and empty texts have no words and no run. With a null doc_id, ``planted`` leaves the words as they are. A text is
handled whole by one task; texts are taken from a batch one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 12
_HALF = MIN_WORDS // 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def lyndon_array(word: list[int], size: int) -> list[int]:
    """Length of the longest Lyndon word at each place of ``word`` (letters 0 to size - 1)."""
    n = len(word)
    ends = [0] * (size + 1)
    for c in word:
        ends[c + 1] += 1
    for c in range(size):
        ends[c + 1] += ends[c]
    # A group is an interval of ``order``, known by its first place; ``stop`` is its end, ``context`` its context's length.
    group = [ends[c] for c in word]
    order, place, fill = [0] * n, [0] * n, ends[:-1]
    for i, c in enumerate(word):
        order[fill[c]], place[i] = i, fill[c]
        fill[c] += 1
    stop, context = [0] * n, [0] * n
    for c in range(size):
        if ends[c] < ends[c + 1]:
            stop[ends[c]], context[ends[c]] = ends[c + 1], 1
    lower, length, top = [-1] * n, [0] * n, n
    while top:
        at = group[order[top - 1]]
        own = sorted(order[at:top])
        times: dict[int, int] = {}
        for i in own:
            length[i] = context[at]
            p = i - 1
            while p >= 0 and group[p] >= at:
                p = lower[p]
            j = i - 1
            while j >= 0 and j != p:
                lower[j], j = p, lower[j]
            lower[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, k in times.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            by_group: dict[int, list[int]] = {}
            for p in levels[k]:
                by_group.setdefault(group[p], []).append(p)
            for g, moved in by_group.items():
                end = stop[g]
                new = end - len(moved)
                # Members go behind those that stay, by swaps inside the interval.
                going, free = set(moved), end - 1
                for p in moved:
                    if place[p] >= new:
                        continue
                    while order[free] in going:
                        free -= 1
                    other, here = order[free], place[p]
                    order[here], place[other] = other, here
                    order[free], place[p] = p, free
                    free -= 1
                for p in moved:
                    group[p] = new
                longer = context[g] + k * context[at]
                if new > g:
                    stop[g] = new
                stop[new], context[new] = end, longer
        top = at
    return length


class Extensions:
    """Longest common extensions of two places, by comparing blocks of growing size."""

    def __init__(self, word: np.ndarray):
        self.n, self.forth, self.back = len(word), word.astype("<u4").tobytes(), word[::-1].astype("<u4").tobytes()

    def _common(self, text: bytes, i: int, j: int) -> int:
        """Of text at i < j, in letters."""
        most, found, step = self.n - j, 0, 1
        while found < most:
            step = min(step, most - found)
            a, b = 4 * (i + found), 4 * (j + found)
            if text[a : a + 4 * step] == text[b : b + 4 * step]:
                found, step = found + step, 2 * step
            elif step == 1:
                break
            else:
                step = max(1, step // 4)
        return found

    def right(self, i: int, j: int) -> int:
        return self._common(self.forth, i, j) if j < self.n else 0

    def left(self, i: int, j: int) -> int:
        """Equal words before i and before j."""
        return self._common(self.back, self.n - j, self.n - i) if i > 0 else 0


def runs_of(word: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a sequence of ids as (start, length, period), by start and period."""
    letters = np.unique(word, return_inverse=True)[1]
    size = int(letters.max()) + 1 if len(letters) else 0
    common, found = Extensions(letters), set()
    for order in (letters, size - 1 - letters):
        last: dict[int, tuple[int, int]] = {}
        for i, p in enumerate(lyndon_array(order.tolist(), size)):
            start, end = last.get(p, (0, 0))
            if start <= i and i + p <= end:
                continue
            right = common.right(i, i + p)
            left = common.left(i, i + p)
            if left + right >= p:
                last[p] = (i - left, i + p + right)
                if left + p + right >= MIN_WORDS:
                    found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: maximal stretches of words covered by half-length grams that stand twice, as (start, end)."""
    n = len(hashes) - _HALF + 1
    if n < 2:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(_HALF):
        grams += hashes[k : k + n] * _ODD[k % len(_ODD)]
    by = np.argsort(grams, kind="stable")
    same = grams[by[1:]] == grams[by[:-1]]
    if not same.any():
        return []
    covered = np.zeros(len(hashes) + 1, dtype=np.int32)
    twice = np.unique(np.concatenate([by[1:][same], by[:-1][same]]))
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + _HALF, -1)
    inside = np.concatenate([[0], (np.cumsum(covered[:-1]) > 0).view(np.int8), [0]])
    edges = np.diff(inside)
    pairs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    return [(a, b) for a, b in pairs if b - a >= MIN_WORDS]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's words: in a tenth of the documents the words from some place on repeat with a period."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    found = []
    for a, b in stretches(hashes):
        ids: dict[bytes, int] = {}
        part = np.array([ids.setdefault(w, len(ids)) for w in words[a:b]], dtype=np.int64)
        found += [(a + s, length, p) for s, length, p in runs_of(part)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: each run keeps its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.array(runs, dtype=np.int64)
    np.add.at(gone, at[:, 0] + at[:, 2], 1)
    np.add.at(gone, at[:, 0] + at[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def measure(text: str | None, doc_id: int | None, plant: bool) -> tuple:
    words = (text or "").encode().split()  # bytes are parted at \x20 and \x09-\x0D
    words = planted(words, doc_id) if plant else words
    runs = text_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    kept = collapsed(words, runs)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    exponent = 1000 * best[1] // best[2] if runs else None
    digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
    return (doc_id, len(runs), *best, exponent, *digests, len(words), len(words) - len(kept))


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: its runs (number, longest, digest) and the digest of the text with each run cut to one period.

    ``plant`` applies the contract's periodic rewriting to the words first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [measure(t.as_py(), d.as_py(), plant) for d, t in zip(batch.column(0), batch.column(1), strict=True)]
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def run_rows(docs: DataFrame) -> DataFrame:
    """Every run as a row: doc_id, start, length, period (word numbers from 0), and the text of its first period."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                words = (t.as_py() or "").encode().split()
                rows += [(d.as_py(), s, length, p, b" ".join(words[s : s + p]).decode()) for s, length, p in text_runs(words)]
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "period", "unit"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, period long, unit string")
