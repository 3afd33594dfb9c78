"""The audit against a plain version, in one slice and in many."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        groups = {s: c for (one, s), c in counts.items() if one == lang}
        whole = sum(groups.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))

        def value(p, q):
            return (p - q) ** 2 // q

        for s, c in groups.items():
            pairs = [(o, sum(value(share(c, t), share(d, t)) for t in kept)) for o, d in groups.items() if o != s]
            terms = [(t, value(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


ROWS = [
    (1, "The the THE cat-dog dog", "en", "a"), (2, "the, cat dog! x1y", "en", "b"), (3, "the dog dog été", "en", "a"), (3, "the dog", "en", "b"),
    (None, "x1y cat x1y2x", "en", None), (5, None, "en", "empty"), (6, "", None, None), (7, "Ünd ünd Ünd\x1cund", "de", "a"), (8, "Ünd ünd", "de", "b"),
    (9, "Ünd z", "de", "b"), (9, "Ünd z", "de", "b"), (10, "1 2 3", "fr", "a"), (11, "one\ttwo\x0bthree\ntwo", "fr", "b"), (12, "cat-cat cat.dog dog's", "en", "c"),
]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_a_small_table(frame, min_docs):
    extra = frame(ROWS).withColumns({c: F.lit(c) for c in ("g", "l", "row", "term", "cells", "item", "value", "rank")})
    assert found(divergence.audit(extra.repartition(3), min_docs=min_docs)) == brute(ROWS, min_docs)


def test_many_slices_and_merges(spark, frame, monkeypatch):
    import random

    rng = random.Random(2)
    words = ["the", "The,", "a.b", "dog", "dog's", "x", "été", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "en", "de"]), rng.choice(["hot", "hot", "b", "c"])) for k in range(150)]
    want = brute(rows, top=7)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 300)
    monkeypatch.setattr(divergence, "PART_BYTES", 5000)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 20)
    assert found(divergence.audit(frame(rows).repartition(4), top_terms=7)) == want


def test_merging_in_between_changes_nothing(monkeypatch):
    monkeypatch.setattr(divergence, "MERGE_ROWS", 3)
    import numpy as np
    import pyarrow as pa

    merger = divergence._Merger(4, divergence._merge_terms(3))
    for k in range(10):
        rows = np.array([[1, 0, 5, 1], [1, 1, k % 4, 0], [2, 1, k % 2, 0]])
        merger.add(pa.array(["t"]), divergence.packed(rows, np.array([0])))
    names, _, rows = merger.settle()
    assert names.to_pylist() == ["t"]
    assert sorted(map(tuple, rows.tolist())) == [(1, 0, 5, 10), (1, 2, 0, 1), (2, 1, 0, 0), (2, 1, 1, 0)]


def test_no_rows_and_no_terms(frame):
    assert found(divergence.audit(frame([]))) == []
    assert found(divergence.audit(frame([(1, "1 2", "en", "a"), (2, None, "en", "b")]))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_beyond_64_bits():
    import numpy as np

    big = np.array([[10**13, 0]])
    got = divergence.shares(big, np.array([[10**13]]), np.array([[2]]))
    assert got.tolist() == [[1 + 10**9 * (10**13 + 1) // (10**13 + 2), 1 + 10**9 // (10**13 + 2)]]
