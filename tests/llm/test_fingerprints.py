import hashlib

from pyspark.sql import functions as F

from loomline.llm import fingerprints as fp
from loomline.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def rolled(spark, words):
    if len(words) < fp.GRAM:
        grams = [words + [None] * (fp.GRAM - len(words))] if words else []
    else:
        grams = [words[i : i + fp.GRAM] for i in range(len(words) - fp.GRAM + 1)]
    if not grams:
        return []
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i long, g array<string>")
    hashes = [F.when(F.get("g", F.lit(j)).isNotNull(), F.xxhash64(F.get("g", F.lit(j)))) for j in range(fp.GRAM)]
    return [r.h for r in df.orderBy("i").select(F.xxhash64(*hashes).alias("h")).collect()]


def test_smallest_of_each_window_rightmost_of_ties(spark):
    words = ("a b c d a b c d a b c d e f g h i j k l m n o p a b c d a b c d q r s t".split()) + ["x"] * 20
    hashes = [h >> 24 for h in rolled(spark, words)]
    want = []
    for at in range(len(hashes) - fp.WINDOW + 1):
        window = hashes[at : at + fp.WINDOW]
        place = at + max(i for i, h in enumerate(window) if h == min(window))
        if (hashes[place], place) not in want:
            want.append((hashes[place], place))
    one = spark.createDataFrame([(" ".join(words),)], "t string").select(F.explode(fp.fingerprint(F.col("t"))).alias("v"))
    got = [tuple(r) for r in one.select(fp.hash_of(F.col("v")), fp.position_of(F.col("v"))).collect()]
    assert got == want


def test_short_texts(spark):
    rows = [(None,), ("",), (" \n",), ("one",), ("one two",), ("one two three",), ("one two three four",)]
    df = spark.createDataFrame(rows, "t string").select(F.size(fp.fingerprint(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 0, 1, 1, 1, 1]


def brute(rows):
    ordered = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    return out


def check(df, rows):
    got = {r.doc_id: r for r in fp.digest(fp.edited_fingerprints(df)).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    return got


def test_whole_table_in_many_buckets(spark, monkeypatch):
    df = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    monkeypatch.setattr(fp, "MAX_BOUNDS", 7)
    monkeypatch.setattr(fp.in_order, "__defaults__", (5000,))
    got = check(df, rows)
    texts = dict(rows)
    same = {}
    for i, r in got.items():
        assert same.setdefault(texts[i], r.fingerprint) == r.fingerprint
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:]):
        if texts[a] == texts[b]:
            assert got[a].near_next == 1.0


def test_one_document_and_none(docs):
    got = check(docs((5, "a b c d e f")), [(5, "a b c d e f")])
    assert got[5].near_next == 1.0
    assert fp.edited_fingerprints(docs((1, "x")).filter("false")).count() == 0


def test_null_text_null_id_and_repeated_ids(docs):
    rows = fp.digest(fp.edited_fingerprints(docs((None, "zz"), (1, None), (1, "q"), (2, "a b c d")))).collect()
    assert sorted((r.n_chars for r in rows)) == [0, 1, 2, 7]
    (first,) = [r for r in rows if r.doc_id is None]
    assert first.n_chars == 2


def test_odd_lengths_and_wide_characters(docs):
    rows = [(1, "a𝄞é"), (2, "𝄞𝄞"), (3, "xyzxyz")]
    check(docs(*rows), rows)
