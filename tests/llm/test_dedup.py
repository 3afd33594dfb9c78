import hashlib
import random

import numpy as np
import pytest
from brute import byte_dedup, jaccard, shingles, word_dedup
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import firstseen, phrases, substrings
from loomline.llm import jaccard as joins
from loomline.llm.components import components
from loomline.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, periodic and very long texts, short and empty ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé ") for _ in range(r.randint(1, 7))).strip() or "z" for _ in range(60)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = text(40), text(120)
    out = []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 2:
            t = text(r.randint(0, 30)) + "\n" + passage + "\t " + text(20)
        elif kind == 3:
            t = text(r.randint(0, 4))
        elif kind == 4:
            t = "ab" * r.randint(0, 90)
        else:
            t = text(r.randint(5, 200))
        out.append((i * 3, t))
    return [*out, (1, ""), (2, None), (4, "x" * 3000), (5, "x" * 2990 + "yy"), (7, base)]


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_bytes_seen_before(docs, block_bytes):
    rows = corpus()
    found = firstseen.remove_seen(docs(*rows), substrings.Bytes(), block_bytes=block_bytes)
    assert tuples(substrings.digest(found)) == byte_dedup(rows)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_words_seen_before(docs, block_bytes):
    rows = corpus(2)
    found = firstseen.remove_seen(docs(*rows), phrases.Words(), block_bytes=block_bytes)
    assert tuples(phrases.digest(found)) == word_dedup(rows)


def test_bytes_of_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    assert tuples(substrings.digest(substrings.dedup(table(spark, FOLDER, "documents")))) == byte_dedup(rows)


def test_index_parts_agree(docs, monkeypatch):
    monkeypatch.setattr(firstseen, "INDEX_BYTES", 500)
    rows = corpus(3)
    assert tuples(substrings.digest(substrings.dedup(docs(*rows)))) == byte_dedup(rows)


def test_removed_runs_and_kept_text(docs):
    shared = "".join(chr(97 + i % 26) for i in range(60))
    found = {r.doc_id: r for r in substrings.dedup(docs((1, shared), (2, "<<" + shared + ">>"))).collect()}
    assert [tuple(x) for x in found[2].removed] == [(2, 62)] and bytes(found[2].kept) == b"<<>>"
    assert found[1].removed == [] and bytes(found[1].kept) == shared.encode()


def test_null_ids_and_equal_ids(docs):
    long = " ".join(f"w{i}" for i in range(30))
    rows = docs((None, long), (3, long), (3, long), (9, long))
    found = sorted(((r.doc_id, r.n_removed) for r in phrases.digest(phrases.dedup(rows)).collect()), key=str)
    assert found == [(3, 0), (3, 0), (9, 30), (None, 30)]


@given(st.lists(st.binary(min_size=8, max_size=60), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_run_length_index(contents):
    contents = list(dict.fromkeys(contents))
    index = substrings.RunLengthIndex(contents, 8)
    text = b"".join(c + b"\0" for c in contents)
    where, base = index.stream()
    strings = {}
    for k, c in enumerate(contents):
        for j in range(len(c) - 7):
            strings.setdefault(c[j : j + 8], set()).add(int(where[base[k] + j]))
    assert all(len(v) == 1 for v in strings.values())
    assert len(set().union(*strings.values())) == len(strings)
    for row in range(len(contents), index.n):
        at = None
        try:
            at = index.locate(row)
        except ValueError:
            continue
        suffix = text[at : at + 8]
        if b"\0" not in suffix:
            assert strings[suffix] == {int(index.interval[row])}


@pytest.mark.parametrize("block_bytes,cell", [(1 << 20, 4096), (2000, 4096), (2000, 3)])
def test_jaccard_components(docs, block_bytes, cell):
    r = random.Random(4)
    rows = corpus(4, 40)
    words = [f"w{i}" for i in range(200)]
    for i in range(60):  # a large group of near copies, chained at the edge of the limit
        w = list(words)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(200)] = f"x{r.randrange(1000)}"
        rows.append((1000 + i, " ".join(w)))
    found = joins.link_components(docs(*rows), block_bytes=block_bytes, cell=cell)
    assert tuples(found) == jaccard(rows)


def test_jaccard_small_sets(docs):
    rows = [(1, "A b"), (2, "a B"), (3, "a b c"), (4, "a b c"), (5, ""), (6, None), (7, "a"), (8, "b a"), (9, "...")]
    assert tuples(joins.link_components(docs(*rows))) == jaccard(rows)


def test_no_documents(docs, spark):
    none = docs((1, "x")).filter("false")
    assert joins.link_components(none).count() == 0
    assert substrings.dedup(none).count() == 0 and phrases.dedup(none).count() == 0


def test_clashing_columns(docs):
    rows = docs((1, "a b c d"), (2, "a b c d"))
    for name in ("block", "shard", "sign", "digest", "n_units", "u", "leader"):
        rows = rows.selectExpr("*", f"'{name}' AS {name}")
    assert [r.component_id for r in joins.link_components(rows).collect()] == [1, 1]
    assert phrases.dedup(rows).count() == 2


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=25), st.integers(60, 95))
@settings(max_examples=60, deadline=None)
def test_occurrence_search(sets, percent):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sorted(sets, key=len)]
    index = joins.Occurrences(arrays, percent)
    for k in range(len(arrays)):
        want = [j for j in range(k + 1, len(arrays)) if 100 * len(np.intersect1d(arrays[k], arrays[j])) >= percent * len(np.union1d(arrays[k], arrays[j]))]
        assert sorted(index.search(k)) == want


@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=40), min_size=2, max_size=10), st.sampled_from([50, 60, 80, 90, 95]), st.integers(0, 4))
@settings(max_examples=80, deadline=None)
def test_linked_sets_share_a_part(lists, percent, splits):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(joins, "SPLITS", splits)
        linked_sets_share_a_part([" ".join(w) for w in lists], percent)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_edited_texts_share_a_part(percent):
    rng = np.random.default_rng(percent)
    texts = []
    for n in (3, 8, 30, 200):
        base = [f"w{k}" for k in range(n)]
        for edits in (0, 1, 2, n // 30, n // 12):
            words = list(base)
            for k in rng.choice(n, min(n, edits), replace=False):
                words[k] = f"new{rng.integers(9)}"
            texts.append(" ".join(words))
    linked_sets_share_a_part(texts, percent)


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80)])
def test_unlike_texts_share_no_part(shingle, percent):
    rng = np.random.default_rng(7)
    for n in (12, 60, 250):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, n)).encode() for _ in range(3000)]
        key, _ = joins.Sets(texts, shingle).parts(percent)
        assert np.unique(key, return_counts=True)[1].max() == 1


@pytest.mark.parametrize("most_slots, compared", [(14, 1 << 21), (6, 1 << 21), (14, 8)])
def test_sketches_leave_out_no_set_that_links(monkeypatch, most_slots, compared):
    monkeypatch.setattr(joins, "MOST_SLOTS", most_slots)
    monkeypatch.setattr(joins, "COMPARED_WORDS", compared)
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        sets = []
        for n in (1, 2, 5, 63, 64, 65, 130, 700):
            base = rng.integers(0, 1 << 63, n).astype(np.uint64)
            sets.append(np.unique(base))
            for cut in (1, n // 12, n // 6, n // 4):
                sets.append(np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, rng.integers(0, cut + 1)).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        keep = joins.may_link([joins.parity(s) for s in sets], percent)
        linked = np.zeros(len(sets), dtype=bool)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    linked[[a, b]] = True
        assert not (linked & ~keep).any()
        if most_slots > 6 and percent > 50:
            alone = joins.may_link([joins.parity(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(40)], percent)
            assert not alone.any()


def linked_sets_share_a_part(texts, percent):
    sets = joins.Sets([t.encode() for t in texts], 3)
    key, own = sets.parts(percent)
    held = [set(key[own == k].tolist()) for k in range(len(texts))]
    for a in range(len(texts)):
        x = shingles(texts[a])
        assert sets.size[a] == len(x)
        for b in range(a):
            y = shingles(texts[b])
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                assert held[a] & held[b]


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    random.Random(5).shuffle(links)
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_kept_hash_is_of_the_text(docs):
    (row,) = substrings.digest(substrings.dedup(docs((1, "é short")))).collect()
    assert row.kept_sha256 == hashlib.sha256("é short".encode()).hexdigest() and row.n_bytes == 8
