"""The pipeline stage by stage against plain versions, on the given small tables."""

import base64
import random
import string
import zlib

import brute
import numpy as np
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from loomline.llm import language
from loomline.llm.scratch import stash
from loomline.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]

    def step(k, frame):
        out = stash(pipeline.STAGES[k][1](spark, frame, FOLDER))
        assert k == 4 or out.columns == pipeline.COLUMNS
        return out, {r.doc_id: r for r in out.collect()}

    one, got = step(0, docs)
    assert set(got) == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    two, kept = step(1, one)
    assert set(kept) == {i for i, _, c in brute.jaccard([(i, r.text) for i, r in got.items()], 80, 5) if i == c}
    three, clean = step(2, two)
    assert set(clean) == {i for i, r in kept.items() if not brute.hits(r.text, items)[-1]}
    four, safe = step(3, three)
    assert set(safe) == set(clean)
    for i, r in safe.items():
        found = brute.secrets(clean[i].text)
        assert (r.text == clean[i].text) or sum(found[:3]) > 0 or "<secret>" in r.text
        assert r.n_chars == (len(r.text) if r.text != clean[i].text else clean[i].n_chars)
    _, drawn = step(4, four)
    assert set(drawn) <= set(safe)
    tokens = sum(len(brute.SPACED.findall(r.text)) for r in safe.values())
    final = pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in final} == set(drawn)
    longest = max(len(brute.SPACED.findall(r.text)) for r in safe.values())
    assert abs(sum(r.n_tokens for r in final) - tokens) <= longest * len({r.source for r in final})


def test_a_text_without_letters_is_rejected(spark, docs):
    frame = docs((1, "12345 !!"), (2, None), (3, "the words of it"), (4, "the words of it and more"))
    frame = frame.selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars")
    out = pipeline.language_stage(spark, frame, FOLDER)
    learned = language.learn(frame.filter(~language.held_out()))
    assert {r.doc_id for r in out.collect()} == ({3, 4} if learned else set())


def test_one_row_of_a_component_stays(spark, docs):
    one, two, three = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    near = two + " more"
    frame = docs(
        (1, one), (1, one), (None, one), (5, two), (3, near), (5, three), (None, "no id has this text"), (None, "no id has this text"),
        (7, None), (7, None), (None, ""), (9, "alone with this one"),
    )
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_copy_stage(spark, frame, FOLDER).collect()), key=repr)
    want = [(1, one), (3, near), (5, three), (None, "no id has this text"), (7, None), (7, None), (None, ""), (9, "alone with this one")]
    assert got == sorted(want, key=repr)


def test_near_copies_share_four_fifths_of_five_words(spark, docs):
    base = [f"w{k}" for k in range(60)]
    more = base + [f"x{k}" for k in range(12)]  # 56 of 68 shingles
    other = base + [f"y{k}" for k in range(20)]  # 56 of 76
    got = {r.doc_id for r in pipeline.near_copy_stage(spark, docs((4, " ".join(base)), (5, " ".join(more)), (6, " ".join(other))), FOLDER).collect()}
    assert got == {4, 6}


def test_language_stage_rejects_what_fits_no_language(spark):
    given = table(spark, FOLDER, "documents").select(*pipeline.COLUMNS)
    rows = {r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")}
    rng = random.Random(1)
    junk = [base64.b64encode(rng.randbytes(600)).decode(), "".join(rng.choices(string.ascii_lowercase + " ", k=600)), "12 !!", None, "ok"]
    more = spark.createDataFrame([(-1 - k, t, None, "s", 0) for k, t in enumerate(junk)], given.schema)
    kept = {r.doc_id for r in pipeline.language_stage(spark, given.unionByName(more), FOLDER).collect()}
    assert kept == rows | {-5}
    none = given.limit(20).unionByName(more).withColumn("lang", F.lit(None).cast("string"))
    want = {r.doc_id for r in none.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in pipeline.language_stage(spark, none, FOLDER).collect()} == want


def test_bounds_come_from_every_held_out_text_whole(spark):
    rng = random.Random(3)
    words = {"en": ["the", "house", "water", "light", "street", "money"], "de": ["der", "wasser", "strasse", "licht", "geld", "haus"]}
    training = {k: " ".join(rng.choices(v, k=3000)) for k, v in words.items()}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(100, 400))), lang) for k, lang in enumerate(["en", "de"] * 100)]
    rows += [(1000, "x" * 39, "en"), (1001, None, "en"), (1002, "the house", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser, want = language.Parser(training), {}
    for k, name in enumerate(parser.languages):
        plain, mixed = [], []
        for doc_id, text, lang in rows:
            if lang != name or text is None or parser.codes(text)[1] < language.JUDGED_LETTERS:
                continue
            seed = zlib.crc32(f"{doc_id}\x00{text}".encode())
            for t, out in ((text, plain), ("".join(np.random.default_rng([17, seed]).permutation(list(text)).tolist()), mixed)):
                codes, _, chars = parser.codes(t)
                out.append(parser.phrases([codes])[k][0] * parser.costs[k] / chars)
        if np.quantile(plain, 0.95) < np.quantile(mixed, 0.05):
            want[name] = float(np.quantile(mixed, 0.05))
    got = language.learn_bounds(labelled, training)
    assert set(got) == set(want) == {"de", "en"}
    assert all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in want)
