"""Suffix-array dedup of bytes with a run-length index.

Each byte that a string of ``WIDTH`` bytes covers is removed if that string also starts in a
document with a smaller id. Candidate spans are brought together by their anchors
(``firstseen``); a shard concatenates its distinct spans and builds a run-length compressed
Burrows-Wheeler transform with suffix positions sampled at the run ends. Spans are then streamed
through it from right to left, all at once: each step maps a row to the row of the string one byte
longer, and the row tells the interval of strings that agree for ``WIDTH`` bytes, with the smallest
document id in it. A match is long where such an interval starts; the id says whether it is earlier.

A null text is empty. A text under ``WIDTH`` bytes loses nothing. Of equal texts all but those of the
smallest id lose everything, if they have ``WIDTH`` bytes. Rows with one id are not earlier than each
other. A null id counts as the largest. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytegrams import byte_grams16, joined, sliding_min
from loomline.llm.firstseen import Cut, remove_seen, spans_of

WIDTH = 50
GRAM = 16


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of some contents, each ended by a symbol of its own.

    Rows 0 to len(contents) - 1 are the ends of the contents in order.
    """

    def __init__(self, contents: list[bytes], depth: int):
        text, self.begin, self.end = joined(contents, b"\0")
        n, m = len(text), len(contents)
        span = np.repeat(np.arange(m, dtype=np.int32), self.end - self.begin + 1)
        left = self.end[span] - np.arange(n)
        order, rank, deep = self._suffixes(text, span, left, m, depth)
        before = text[order - 1].astype(np.int16) + 1
        before[left[order - 1] == 0] = 0
        starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        sizes = np.diff(np.append(starts, n))
        #: A run's symbol, its first row, and where that row leads.
        self.heads, self.starts = before[starts], starts
        by_head = np.argsort(self.heads, kind="stable")
        target = np.zeros(len(starts), dtype=np.int64)
        target[by_head] = np.cumsum(sizes[by_head]) - sizes[by_head]
        self.target = target
        #: Suffix positions at the last row of each run.
        self.samples = order[np.append(starts[1:], n) - 1]
        self.n = n
        #: The run of each row.
        self.run = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        # Intervals of rows that agree for ``depth`` bytes.
        near = np.zeros(n, dtype=bool)
        a, b = order[:-1], order[1:]
        long_a, long_b = left[a] >= depth, left[b] >= depth
        both = np.flatnonzero(long_a & long_b)
        same = self._agree(deep, order[both], order[both + 1], depth)
        near[both + 1] = same
        self.interval = (np.cumsum(~near) - 1).astype(np.int32)
        self.owner = span[order]

    @staticmethod
    def _sorted(major: np.ndarray, minor: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Order by two numbers of so many bits, and where in it a new pair begins."""
        n = len(major)
        at = max(1, (n - 1).bit_length())
        new = np.ones(n, dtype=bool)
        if sum(bits) + at <= 64:  # the position fits into the number that is sorted
            packed = (major.astype(np.uint64) << np.uint64(bits[1] + at)) | (minor.astype(np.uint64) << np.uint64(at))
            packed |= np.arange(n, dtype=np.uint64)
            packed.sort()
            order = (packed & np.uint64((1 << at) - 1)).astype(np.int64)
            packed >>= np.uint64(at)
            new[1:] = packed[1:] != packed[:-1]
        else:
            order = np.lexsort((minor, major))
            a, b = major[order], minor[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, new

    def _suffixes(self, text, span, left, m, depth):
        """Suffix order by doubling, where each round sorts only what is still tied; a rank is the first row of
        its ties. Also the ranks by a number of symbols that is at least half of ``depth``."""
        n = len(text)
        used = np.zeros(257, dtype=bool)
        used[text.astype(np.int16) + 1] = True
        letters = np.cumsum(used)  # symbols from 1 up, in the order of the bytes
        bits = int(letters[-1]).bit_length()
        symbols = np.where(left == 0, 0, letters[text.astype(np.int16) + 1])
        width = max(1, min(42 // bits, depth - 1))
        padded = np.concatenate((symbols, np.zeros(width, dtype=np.int64)))
        keys = np.zeros(n, dtype=np.int64)
        for j in range(width):
            keys = (keys << bits) | np.where(left >= j, padded[j : j + n], 0)
        order, new = self._sorted(keys, np.zeros(n, dtype=np.int8), (width * bits, 0))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.repeat(starts, sizes)
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        deep, high = None, (m + n).bit_length()
        while True:
            if deep is None and width * 2 >= depth:
                deep = (width, rank.copy())
            if not len(rows) and deep is not None:
                return order, rank, deep
            if len(rows):
                at = order[rows]
                ahead = rank[np.minimum(at + width, n - 1)]
                ties, new = self._sorted(rank[at], np.where(left[at] < width, span[at], m + ahead), (n.bit_length(), high))
                at = at[ties]
                order[rows] = at
                starts = np.flatnonzero(new)
                sizes = np.diff(np.append(starts, len(rows)))
                rank[at] = np.repeat(rows[starts], sizes)
                rows = rows[np.repeat(sizes > 1, sizes)]
            width *= 2

    @staticmethod
    def _agree(deep: tuple[int, np.ndarray], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        width, rank = deep
        shift = depth - width
        return (rank[a] == rank[b]) & (rank[a + shift] == rank[b + shift])

    def step(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the strings one byte longer to the left."""
        run = self.run[rows]
        return self.target[run] + rows - self.starts[run]

    def locate(self, row: int) -> int:
        """The position of a row: steps until a run end, whose position is sampled."""
        steps = 0
        while True:
            run = int(self.run[row])
            last = (self.starts[run + 1] if run + 1 < len(self.starts) else self.n) - 1
            if row == last:
                return int(self.samples[run]) + steps
            if self.heads[run] == 0:
                raise ValueError("the row is the start of a content")
            row = int(self.target[run] + row - self.starts[run])
            steps += 1

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """The interval at every byte of every content, read from right to left; and where each content starts in it."""
        sizes = self.end - self.begin
        order = np.argsort(-sizes, kind="stable")
        ranked = sizes[order]
        base = np.concatenate(([0], np.cumsum(sizes)))
        out = np.zeros(int(base[-1]), dtype=np.int32)
        rows, at = order.astype(np.int64), (base[:-1] + sizes)[order]
        longest = int(ranked[0]) if len(ranked) else 0
        active = np.searchsorted(-ranked, -np.arange(longest), side="left").tolist()
        for n in active:
            rows, at = self.step(rows[:n]), at[:n] - 1
            out[at] = self.interval[rows]
        return out, base


class Bytes:
    """The method for ``firstseen``: windows of bytes, and the run-length index."""

    width = WIDTH

    def cut(self, texts: list[bytes]) -> tuple[Cut, Callable[[np.ndarray], list[bytes]]]:
        buf, begin, end = joined(texts)
        sizes = end - begin
        base = np.append(begin, len(buf))
        data = buf.tobytes()
        minima = sliding_min(byte_grams16(buf), WIDTH - GRAM + 1)
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(minima)]
        valid = np.arange(len(minima)) + WIDTH <= end[doc] if len(doc) else np.zeros(0, dtype=bool)
        anchor, own, first, count = spans_of(minima, valid, doc, WIDTH - GRAM + 1)

        def contents(hit: np.ndarray) -> list[bytes]:
            at = first[hit]
            return [data[a:b] for a, b in zip(at.tolist(), (at + count[hit] + WIDTH - 1).tolist())]

        return Cut(anchor, own, first, count, base), contents

    def windows(self, content: bytes) -> int:
        return len(content) - WIDTH + 1

    def index(self, contents: list[bytes], firsts: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
        if not contents:
            return []
        index = RunLengthIndex(contents, WIDTH)
        least = np.full(int(index.interval[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, index.interval, firsts[index.owner])
        where, base = index.stream()
        return [least[where[base[k] : base[k + 1] - WIDTH + 1]] for k in range(len(contents))]

    def kept(self, text: bytes, n: int, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
        rest, at = [], 0
        for a, b in gone:
            rest.append(text[at:a])
            at = b
        return n, b"".join([*rest, text[at:]])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_units (bytes), removed runs of bytes, kept bytes."""
    return remove_seen(docs, Bytes(), key, text)


def digest(found: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id", F.col("n_units").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
