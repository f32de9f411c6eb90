"""Periodic runs of words by online dyadic square catching (operator 11).

A run is a stretch of consecutive words with smallest period q and at least
max(6, 4 q) words that no neighbouring word extends keeping period q.

Words are appended to a stream. Whenever the last word of a block of 2^l words
(aligned to multiples of 2^l) has arrived, the block is completed and gets a
catcher for the periods 2^l <= q < 2^(l+1): the catcher compares the block with
the suffix of the same length of every word appended after it, and a suffix that
equals the block q words later starts a square. A run of four periods holds a
whole block within its first 2^l words and three periods from there on, so a
catcher keeps a match only if the suffix comparison of the next level also equals
itself one period on: three periods from the block. Two periods of one catcher
that both last so long are multiples of a smaller one, so the smallest is enough.
Caught squares of one period that lie in one another are merged into a run, which
is then extended to both sides word by word and checked for a smaller period.

Suffixes are compared by 64-bit fingerprints that are doubled from level to level;
what is caught is verified on the words, so a result never rests on a fingerprint
alone. n words cost O(n log n) and the levels keep O(n) numbers. The catchers of
all appended words of a chunk advance together as NumPy vectors.

Scale: one pass over the texts, no shuffle. A task takes the texts of a batch in
groups of about ``GROUP_WORDS`` words, one after another in one stream with a word
between them that equals no other; a single longer text is a group of its own.

Defined cases: null and empty texts have no words (no runs, four nulls, digests of
the empty string); a null id passes through, and ``spliced`` leaves its words as they
are; ties for the longest run go to the smallest start, then period; repeated rows give repeated results; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile("[^\x20\x09-\x0d]+")
#: fixed values: a run has at least so many words, and so many periods
MIN_WORDS, MIN_PERIODS = 6, 4
GROUP_WORDS = 1 << 18
CHUNK_WORDS = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Level:
    """Fingerprints of all suffixes of ``size`` words, by start, from ``base`` on."""

    def __init__(self, size: int):
        self.size, self.base, self.next = size, 0, 0
        self.prints = np.empty(0, np.uint64)

    @property
    def end(self) -> int:
        return self.base + len(self.prints)

    def at(self, lo: int, hi: int) -> np.ndarray:
        return self.prints[lo - self.base:hi - self.base]

    def forget(self, before: int) -> None:
        if before > self.base:
            self.prints, self.base = self.prints[before - self.base:], before


class Catchers:
    """Online catchers for the periods below 2^levels."""

    def __init__(self, levels: int):
        self.levels = [Level(1 << k) for k in range(levels + 1)]
        self.top = levels
        self.words = 0

    def append(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Appends words (numbers); (start, period) of the squares caught now."""
        new = _mix(words.astype(np.uint64) * _ODD + np.uint64(1))
        low = self.levels[0]
        low.prints = np.concatenate([low.prints, new])
        self.words += len(words)
        for one, two in zip(self.levels, self.levels[1:]):  # doubled from level to level
            lo, hi = two.end, one.end - one.size
            if hi > lo:
                pair = one.at(lo, hi) * _ODD + _mix(one.at(lo + one.size, hi + one.size))
                two.prints = np.concatenate([two.prints, _mix(pair)])
        found = [self._advance(k) for k in range(self.top)]
        for k, level in enumerate(self.levels):
            need = [x.next * x.size for x in self.levels[max(0, k - 1):min(k + 1, self.top)]]
            level.forget(min([*need, max(0, self.words - 2 * level.size)]))
        start = [f[0] for f in found]
        return np.concatenate(start or [np.empty(0, np.int64)]), \
            np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])

    def _advance(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The catchers of one level whose last suffix has been appended."""
        one, two = self.levels[k], self.levels[k + 1]
        size = one.size
        first, last = one.next, max(one.next, (self.words - 6 * size) // size)
        one.next = last
        lo, hi = first * size, last * size
        if hi <= lo:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        block = one.at(lo, hi)[::size]
        same = np.flatnonzero((one.at(lo + size, hi + size).reshape(-1, size) == block[:, None]).ravel())
        at = lo + same // size * size
        q = lo + size + same - at
        # equal one period on, for two more periods
        p = two.prints
        a, b = at - two.base, at - two.base + 2 * q - 2 * size
        ok = (p[a] == p[a + q]) & (p[b] == p[b + q])
        at, q = at[ok], q[ok]
        keep = np.flatnonzero(np.diff(at, prepend=-1))  # the smallest period of each block
        return at[keep], q[keep]


def _reach(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words equal each other from w[i] and w[j] on, going up or down."""
    n, width = 0, 64
    while True:
        room = min(width, len(w) - j - n if step > 0 else i + 1 - n)
        if room <= 0:
            return n
        if step > 0:
            differ = w[i + n:i + n + room] != w[j + n:j + n + room]
        else:
            differ = (w[i - n - room + 1:i - n + 1] != w[j - n - room + 1:j - n + 1])[::-1]
        stop = int(differ.argmax())
        if differ[stop]:
            return n + stop
        n, width = n + room, width * 2


def _smallest(w: np.ndarray, start: int, q: int) -> bool:
    """Whether q is the smallest period of a run of at least 2 q words."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(w[start:start + q], w[start + d:start + d + q]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbered words, by start and period.
    ``longest``: a bound of the words between two that equal no other."""
    longest = len(words) if longest is None else longest
    if longest < MIN_WORDS:
        return []
    catchers = Catchers(max(1, (longest // MIN_PERIODS).bit_length()))
    # what follows the last word equals nothing: lets the last catchers end
    after = -1 - np.arange(6 << catchers.top, dtype=np.int64) - (1 << 40)
    found = [catchers.append(words[i:i + CHUNK_WORDS]) for i in range(0, len(words), CHUNK_WORDS)]
    found += [catchers.append(after[i:i + CHUNK_WORDS]) for i in range(0, len(after), CHUNK_WORDS)]
    at, q = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((at, q))
    out, period, end = [], 0, 0
    for i, d in zip(at[order].tolist(), q[order].tolist()):
        if d == period and i + 2 * d <= end:
            continue  # merged: this square lies in the run before it
        right = i + d + _reach(words, i, i + d, 1)
        left = i - _reach(words, i - 1, i - 1 + d, -1) if i else 0
        if right - left >= max(MIN_WORDS, MIN_PERIODS * d) and _smallest(words, left, d):
            out.append((left, right - left, d))
        period, end = d, right
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def number(texts: list[list[str]]) -> np.ndarray:
    """Words as numbers, texts one after another, each followed by a number of its own."""
    known: dict[str, int] = {}
    out = []
    for k, words in enumerate(texts):
        out += [known.setdefault(w, len(known)) for w in words]
        out.append(-1 - k)
    return np.array(out, np.int64)


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts (lists of words)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for start, length, q in runs(number(texts), max(map(len, texts), default=0)):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[k].append((start - int(starts[k]), length, q))
    return out


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def spliced(words: list[str], key) -> list[str]:
    """The contract's planted repeats: every tenth id has its words from a place on
    replaced by a repetition of period p."""
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _grouped(batch: pa.RecordBatch, change) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, lists of words) of a batch in groups of about GROUP_WORDS words."""
    group, first, size = [], 0, 0
    for i, (key, text) in enumerate(zip(batch.column(0), batch.column(1))):
        words = WORD.findall(text.as_py() or "")
        group.append(change(words, key.as_py()) if change else words)
        size += len(words)
        if size >= GROUP_WORDS:
            yield first, group
            group, first, size = [], i + 1, 0
    if group:
        yield first, group


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """(key, runs array<struct<start, length, period>>, collapsed string) of every row.
    ``change(words, key)`` may alter the words of a text first."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " \
             "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _grouped(b, change):
                found = runs_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], run_type),
                     pa.array([" ".join(collapse(t, f)) for t, f in zip(texts, found)], pa.string())],
                    names=[key, "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256):
    the longest run of every row (ties: smallest start, then period) and digests of
    all its runs and of the text without their repeats."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_runs long, start long, length long, " \
             "period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _grouped(b, change):
                rows = []
                for words, found in zip(texts, runs_of(texts)):
                    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                    rows.append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                                 hashlib.sha256(listed.encode()).hexdigest(),
                                 hashlib.sha256(" ".join(collapse(words, found)).encode()).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), *[pa.array(c, pa.int64()) for c in cols[:5]],
                     *[pa.array(c, pa.string()) for c in cols[5:]]],
                    names=[key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)
