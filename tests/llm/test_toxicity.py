"""Scores of planted insults, held-out accuracy on the given tables, and the edges of the input."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import toxicity
from loomline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark, n=600, seed=1):
    """Ordinary texts of random words; one in four holds insults at random places."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(["an", "the", "er", "in", "sto", "ment", "li"], k=rng.randint(1, 3))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        body, toxic = rng.choices(words, k=rng.randint(5, 200)), int(i % 4 == 0)
        for _ in range(rng.randint(1, 3) if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(["blockhead", "Numbskull!", "dimwit"]))
        rows.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = planted(spark)
    return toxicity.learn(docs, labels)


def test_planted_insults_are_found(spark, model):
    docs, labels = planted(spark, 300, seed=9)
    found = toxicity.score(docs, model).join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    wrong = [r for r in found if r.predicted != r.toxic]
    assert len(wrong) <= 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_one_insult_in_a_very_long_text(spark, model):
    rng = random.Random(3)
    plain = " ".join(rng.choices(["the", "an", "in", "ersto", "liment"], k=200_000))
    rows = [(1, plain, None, None, 0), (2, plain[:700_000] + " you dimwit " + plain[700_000:], None, None, 0)]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, DOCS), model, keep=["doc_id"]).collect()}
    assert got == {1: 0, 2: 1}


def test_held_out_documents_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op13_toxicity"](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL")
    held = found.filter("held_out").join(labels, "doc_id").collect()
    ordinary = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in ordinary) <= 0.05 * len(ordinary)
    insults = ["idiot", "clown", "trash", "moron", "loser", "scum", "stupid", "pathetic", "worthless", "disgusting"]
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    meant = found.join(texts, "doc_id").filter(F.lower("text").rlike(rf"\b({'|'.join(insults)})\b")).collect()
    assert sum(r.predicted for r in meant) >= 0.85 * len(meant) > 0


def test_edges_of_the_input(spark, model):
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "12 !! 34", None, None, 0), (4, "漢字" * 5000, None, None, 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old")).withColumn("y", F.lit(1))
    got = toxicity.score(frame, model).collect()
    assert len(got) == 5 and all(r.predicted == 0 and r.y == 1 for r in got)
    assert {r.margin for r in got if r.doc_id != 4} == {0}
    assert toxicity.score(frame.filter("false"), model).count() == 0


def test_labels_that_teach_nothing(spark):
    docs, labels = planted(spark, 40)
    none = toxicity.learn(docs, labels.filter("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.learn(docs, labels.filter("toxic = 1"))
    assert {r.predicted for r in toxicity.score(docs, one).collect()} == {1}
    null = labels.withColumn("toxic", F.lit(None).cast("int")).unionByName(labels.filter("doc_id < 0"))
    assert {r.predicted for r in toxicity.score(docs, toxicity.learn(docs, null)).collect()} == {0}
    twice = labels.unionByName(labels).unionByName(labels.withColumn("toxic", F.lit(0)))
    assert toxicity.learn(docs.unionByName(docs), twice) == toxicity.learn(docs, labels)
