"""The queries of this subpackage over the given tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import contamination, conversations, divergence, fingerprints, jaccard, language, licences, mixing, phrases, secrets, substrings, toxicity, urls
from loomline.sources.tables import table

#: The longest fitting rule decides; the method judges the rest.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]
#: Mixing: nine tenths of the largest possible entropy, and no source more than four times.
ENTROPY_RATIO, REPETITIONS = 0.9, 4.0


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    training = language.learn(docs.filter(~F.col("held_out")))
    return language.identify(docs, training, keep=["doc_id", "held_out"])


def winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup(table(spark, sf_dir, "documents")))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each source is a tree with a directory for each language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(table(spark, sf_dir, "documents").withColumn("path", path))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(*secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def mixing_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, entropy_ratio=ENTROPY_RATIO, repetitions=REPETITIONS, keep=["doc_id", "source"])


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.digest(contamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.dedup(table(spark, sf_dir, "documents")))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out())
    model = toxicity.learn(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": languages,
    "op2_winnowing": winnowing,
    "op3_suffix_dedup": suffix_dedup,
    "op4_jaccard_join": jaccard_join,
    "op5_licence_scan": licence_scan,
    "op6_secret_scan": secret_scan,
    "op7_url_filter": url_filter,
    "op8_mixing": mixing_draws,
    "op9_decontamination": decontamination,
    "op10_phrase_dedup": phrase_dedup,
    "op11_source_divergence": source_divergence,
    "op12_conversation_repair": conversation_repair,
    "op13_toxicity": toxic_texts,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE 10 * q.n >= 9 * p.n AND 10 * p.n >= 9 * q.n
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""

_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), win AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON win.p = pat.p AND win.n = pat.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PHRASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS p
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), seen AS (SELECT p, min(doc_id) AS m FROM win GROUP BY p),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM win JOIN seen USING (p) WHERE m < doc_id
), each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
rest AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
), cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

_DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(v.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source) s USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1)::HUGEINT // (any_value(total) + any_value(v))::HUGEINT AS q
  FROM cells JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op11_source_divergence": _DIVERGENCE_SQL, "op4_jaccard_join": _JACCARD_SQL, "op9_decontamination": _CONTAMINATION_SQL, "op10_phrase_dedup": _PHRASE_SQL}
