"""A training-data pipeline over ``documents``: five stages, each written and read again as the next one's input.

Language ID rejects what has no letters and what fits no learned language; if none is learned, texts with letters stay. Of each group of near copies one document stays.
Documents that hold a benchmark window go. Live secrets are replaced by a mark. Mixing draws the rest by
budgets for the sources; only this last stage returns other columns than those of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import contamination, jaccard, language, mixing, secrets
from loomline.llm.queries import ENTROPY_RATIO, REPETITIONS
from loomline.llm.scratch import stash
from loomline.sources.tables import table

#: Near copies share four fifths of their shingles of five words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can express neither the trained first stage nor the exponent of the last.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bounds are fitted on held-out labelled texts; short texts, and languages without a bound, are not judged by them."""
    training = language.learn(docs.filter(~language.held_out()))
    letters = F.char_length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    if not any(language.plain(t).strip() for t in training.values()):
        return docs.filter(letters > 0).select(*COLUMNS)
    fits = F.lit(True)
    for name, bound in sorted(language.learn_bounds(docs.filter(language.held_out()), training).items()):
        fits = F.when(F.col("lang_pred") == name, F.col("bits_per_char") <= bound).otherwise(fits)
    found = language.identify(docs, training).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.filter(fits | (letters < language.JUDGED_LETTERS)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component the row with the smallest id stays, null ids last, then the smallest row number."""
    rows = stash(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    found = stash(jaccard.link_components(rows, row="_row", shingle=NEAR_WORDS, percent=NEAR_PERCENT).select("doc_id", "_row", "component").filter("component IS NOT NULL"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    firsts = found.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    later = found.select("_row").join(firsts, "_row", "left_anti")
    return rows.join(later, "_row", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_words") == 0).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean, found = secrets.scan(docs)
    safe = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans"))).withColumn("n_chars", F.char_length("text").cast("long"))
    return clean.select(*COLUMNS).unionByName(safe.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, entropy_ratio=ENTROPY_RATIO, repetitions=REPETITIONS, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the stages before it are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
