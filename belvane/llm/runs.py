"""Operator 13: runs, the stretches of words that repeat with a period, caught as a text's words are appended.

A square is a stretch of 2q words with period q. Whatever its place, the first q words of one with 2L - 1 <= q <= 4L - 2
hold a whole block of L words whose place is a multiple of L; the block comes again q words later. So each completed block
of each power of two L has a catcher, which lives while words within those distances are appended. Every appended word
completes one suffix of L words for each L, and this is compared with the catchers that are alive (two of each size). Where
they agree, the words on both sides are compared one by one, and the stretch of agreement goes on with further appended
words: from q words on it is a square, and squares of one period that touch are one run. A suffix is compared by a mark of
64 bits; since the words themselves are compared next, a mark that two differing blocks share does no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are appended at once; any number gives the same runs.
BATCH = 1 << 15
_NONE = np.zeros(0, dtype=np.int64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(29))
RUN = "struct<start:long,length:long,period:long>"


class Catchers:
    """The runs of a text of ``n`` words, which ``append`` takes in any number of steps."""

    def __init__(self, n: int, least: int = 12):
        if least < 5:
            raise ValueError("runs of fewer than 5 words are not caught by blocks of two")
        self.total, self.least, self.n = n, least, 0
        self.words = np.empty(n, dtype=np.int64)
        self.marks = {1: np.empty(n, dtype=np.uint64)}
        self.kept: list[list[int]] = []  # period, first word that equals the one a period before, end
        self.last: dict[int, list[int]] = {}

    def append(self, ids: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(ids)
        self.words[old : self.n] = ids
        self.marks[1][old : self.n] = ids.astype(np.uint64) * _MIX[0] ^ _MIX[1]
        for s in self.kept:
            if s[2] == old:
                s[2] = self._ahead(old, s[0])
        live = [s for s in self.kept if s[2] > old]
        size = 2
        while (low := 1 if size == 2 else 2 * size - 1) * 2 <= self.total and size <= self.n:
            self._mark(size, old)
            for q, p in self._matches(size, low, 4 * size - 2, old):
                # one stretch has many blocks; and inside a run whose period divides q, the stretch of q is that run
                if q in self.last and p < self.last[q][2] or any(q % s[0] == 0 and s[1] - s[0] <= p - q and p + size <= s[2] and s[2] - s[1] >= s[0] for s in live):
                    continue
                s = self.last[q] = [q, self._back(p, q), self._ahead(p, q)]
                if s[2] == self.n or s[2] - s[1] >= max(q, self.least - q):
                    self.kept.append(s)
                    live.append(s)
            size *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        """start, length, period of each run, by start and period."""
        least: dict[tuple[int, int], int] = {}
        for q, first, end in self.kept:
            if end - first >= max(q, self.least - q):
                at = (first - q, end - first + q)
                least[at] = min(q, least.get(at, q))
        return sorted((*at, q) for at, q in least.items())

    def _mark(self, size: int, old: int) -> None:
        """The marks of the suffixes of ``size`` words that the words from ``old`` on complete."""
        half, start = self.marks[size // 2], max(0, old - size + 1)
        if size not in self.marks:
            self.marks[size] = np.zeros(self.total + 2 * size, dtype=np.uint64)
        a, b = half[start : self.n - size + 1], half[start + size // 2 : self.n - size // 2 + 1]
        self.marks[size][start : self.n - size + 1] = (a ^ a >> _MIX[2]) * _MIX[0] + (b ^ b >> _MIX[2]) * _MIX[1]

    def _matches(self, size: int, low: int, high: int, old: int) -> list[tuple[int, int]]:
        """Period and place of the new suffixes that equal a living catcher's block, by period and place; of blocks side by
        side that come again side by side, the first. Row j of ``new`` holds the suffixes that start ``low`` and more words
        after block j, and so within reach of it and of the block or blocks before it."""
        ends, marks = self.n - size + 1, self.marks[size]
        j0, j1 = max(0, (old - size + 1 - low) // size), max(0, -(-(ends - low) // size))
        new, blocks = marks[low + j0 * size : low + j1 * size].reshape(-1, size), marks[::size]
        found = []
        for back in range(-(-(high - low + 1) // size)):
            from_ = max(back - j0, 0)
            j, r = np.nonzero(new[from_:] == blocks[max(j0 - back, 0) : j1 - back, None]) if j1 > back else (_NONE, _NONE)
            found.append((low + r + back * size, low + (j0 + from_ + j) * size + r))
        q, p = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        good = (p < ends) & (q <= self.total // 2)
        q, p = q[good], p[good]
        if not len(q):
            return []
        order = np.lexsort((p, q))
        q, p = q[order], p[order]
        first = np.ones(len(q), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1] + size)
        return list(zip(q[first].tolist(), p[first].tolist(), strict=True))

    def _ahead(self, at: int, q: int) -> int:
        """The first word from ``at`` on that differs from the one q before, or the end."""
        w, step = self.words, 16
        while at < self.n:
            end = min(at + step, self.n)
            differ = w[at:end] != w[at - q : end - q]
            k = int(differ.argmax())
            if differ[k]:
                return at + k
            at, step = end, min(4 * step, 1 << 16)
        return at

    def _back(self, at: int, q: int) -> int:
        """The first of the words before ``at`` that all equal the ones q before."""
        w, step = self.words, 16
        while at > q:
            start = max(at - step, q)
            differ = w[start:at] != w[start - q : at - q]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = start, min(4 * step, 1 << 16)
        return at


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def runs_of(words: list[bytes], least: int = 12, batch: int = BATCH) -> list[tuple[int, int, int]]:
    ids = np.fromiter(map(_Numbers().__getitem__, words), dtype=np.int64, count=len(words))
    catchers = Catchers(len(words), least)
    for at in range(0, len(words), batch):
        catchers.append(ids[at : at + batch])
    return catchers.runs()


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as query ``op13_periodic_runs`` takes them: of one document in ten, the rest of the text from a word on is
    replaced by the repetition of its beginning. A document without a doc_id stays."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _find(batches: Iterator[pa.RecordBatch], least: int, edit: Callable[[int | None, list[bytes]], list[bytes]] | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, collapsed = [], []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            # bytes.split() cuts at the six white-space characters of ASCII
            words = (text.as_py() or b"").split()
            words = edit(doc_id, words) if edit else words
            runs = runs_of(words, least)
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, period in runs:
                drop[start + period] += 1
                drop[start + length] -= 1
            if runs:
                words = [w for w, k in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not k]
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            collapsed.append(b" ".join(words))
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def find(docs: DataFrame, *, least: int = 12, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length and period of each, by start and period; words are numbered from 0) and collapsed (the
    words that no run holds after its first period, joined by one space) for every row.

    A run is a stretch of at least ``least`` words and two periods that no neighbouring word extends; its period is its
    smallest. ``edit`` may change a document's words first. A null or blank text has no words and no runs; a text of any
    length is read whole, in one task, with memory for some 20 numbers a word. Repeated rows each come back. Other columns are
    not read. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(partial(_find, least=least, edit=edit), f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def digests(docs: DataFrame, *, least: int = 12, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = looped) -> DataFrame:
    """doc_id, n_runs, the longest run (of the longest, the one that starts first; null where there is none) and the
    digests of all runs and of the collapsed text. Nulls and other cases are as in ``find``."""
    found = find(docs, least=least, edit=edit)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    text: Column = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("__best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("__best.start").alias("start"), (-F.col("__best.less")).alias("length"), F.col("__best.period").alias("period"),
        F.floor(-1000 * F.col("__best.less") / F.col("__best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
