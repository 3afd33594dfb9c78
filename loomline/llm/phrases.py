"""Substring dedup by repeated-phrase automata.

A window is ``WIDTH`` words in a row. Each word that a window covers is removed if the window's words
also start in a document with a smaller id. Spans of text with anchors that recur are brought together
(``firstseen``); a shard confirms which windows recur in them, word by word, compiles those into an
Aho-Corasick automaton over word numbers, and streams every distinct span of every document through
it to locate every occurrence. Stretches without a recurring anchor cannot hold a recurring window.

Words are runs of characters that are not white space, unchanged. A null text has no words. A text under
``WIDTH`` words loses nothing. Of equal texts all but those of the smallest id lose everything, if they
have ``WIDTH`` words. Rows with one id are not earlier than each other. A null id counts as the largest.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytegrams import grams, joined, sliding_min, word_hashes, words
from loomline.llm.firstseen import Cut, remove_seen, spans_of

WIDTH = 13
GRAM = 5


class Words:
    """The method for ``firstseen``: windows of words, and the automata."""

    width = WIDTH

    def cut(self, texts: list[bytes]) -> tuple[Cut, Callable[[np.ndarray], list[bytes]]]:
        buf, begin, _ = joined(texts, b" ")
        data = buf.tobytes()
        start, end = words(buf)
        base = np.append(np.searchsorted(start, begin), len(start))
        doc = np.repeat(np.arange(len(texts)), np.diff(base))
        minima = sliding_min(grams(word_hashes(buf, start, end), GRAM), WIDTH - GRAM + 1)
        valid = doc[: len(minima)] == doc[WIDTH - 1 : WIDTH - 1 + len(minima)]
        anchor, own, first, count = spans_of(minima, valid, doc[: len(minima)], WIDTH - GRAM + 1)

        def contents(hit: np.ndarray) -> list[bytes]:
            a, b = start[first[hit]], end[first[hit] + count[hit] + WIDTH - 2]
            return [b" ".join(data[x:y].split()) for x, y in zip(a.tolist(), b.tolist())]

        return Cut(anchor, own, first, count, base), contents

    def windows(self, content: bytes) -> int:
        return content.count(b" ") + 2 - WIDTH

    def index(self, contents: list[bytes], firsts: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
        numbers: dict[bytes, int] = {}
        texts = [tuple(numbers.setdefault(w, len(numbers)) for w in c.split(b" ")) for c in contents]
        once: dict[tuple, int] = {}
        again: dict[tuple, int] = {}
        for text, first, many in zip(texts, firsts.tolist(), shared.tolist()):
            for j in range(len(text) - WIDTH + 1):
                window = text[j : j + WIDTH]
                if window in again:
                    again[window] = min(first, again[window])
                elif many:
                    again[window] = min(first, once.pop(window, first))
                elif window in once:
                    again[window] = min(first, once.pop(window))
                else:
                    once[window] = first
        out = [np.full(len(t) - WIDTH + 1, first, dtype=np.int64) for t, first in zip(texts, firsts.tolist())]
        del once
        if not again:
            return out
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        ids = list(again.values())
        for k, window in enumerate(again):
            machine.add_word(window, k)
        machine.make_automaton()
        for text, answer in zip(texts, out):
            for last, k in machine.iter(text):
                answer[last - WIDTH + 1] = ids[k]
        return out

    def kept(self, text: bytes, n: int, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
        rest, at = text.split(), 0
        out = []
        for a, b in gone:
            out += rest[at:a]
            at = b
        return n, b" ".join(out + rest[at:])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_units (words), removed runs of words, kept words joined by one space."""
    return remove_seen(docs, Words(), key, text)


def digest(found: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id", F.col("n_units").alias("n_words"), n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"),
    )
