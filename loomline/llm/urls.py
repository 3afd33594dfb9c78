"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules are ``host/path`` prefixes with a verdict. A rule fits its host and all subdomains if the
path of the url starts with the rule's; the longest rule wins. Urls that a rule fits are the
labelled ones. The trees learn from a bounded sample of them (``train_rows``, taken by a hash of
the url, the same at every input size); everything else covers all rows.

Features: length, host length, labels, path depth, digits, hyphens, digit ratio, entropy of the
characters, parameters, how often the host's suffix occurs in the corpus and which share of its
labelled urls is blocked. Suffix counts are folded map-side, and joined by broadcast only when
their number is checked to be small.

A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features like any other. With labels of one class only, or none, the verdict is that class, or
allow. Equal urls get equal verdicts. Other columns are kept; result columns replace those of their
name.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 4
BROADCAST_SUFFIXES = 10_000
FEATURES = ["f_length", "f_host", "f_labels", "f_depth", "f_digits", "f_hyphens", "f_digit_ratio", "f_entropy", "f_params", "f_suffix", "f_blocked"]
RESULTS = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]], pick: int) -> Column:
    """The longest fitting rule (``pick`` 0) or its verdict (1); null where none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = rule[0].partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(fits & F.col("path").startswith("/" + path), F.lit(rule[pick])).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    zero = F.lit(0.0)
    bits = F.aggregate(F.array_distinct(chars), zero, lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(F.length(text) > 0, bits).otherwise(zero)


def lexical(urls: DataFrame, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    count = lambda s, found: F.length(s) - F.length(F.translate(s, found, ""))
    n = F.length(text)
    digits = count(text, "0123456789")
    out = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumns({"rule": rule_of(rules, 0), "_label": rule_of(rules, 1)})
    out = out.withColumn("_suffix", F.substring_index("host", ".", -2))
    return out.withColumns({
        "f_length": n, "f_host": F.length("host"), "f_labels": count(F.col("host"), "."), "f_depth": count(F.col("path"), "/"),
        "f_digits": digits, "f_hyphens": count(text, "-"), "f_digit_ratio": digits / F.greatest(n, F.lit(1)),
        "f_entropy": entropy(text), "f_params": count(text, "?&"),
    })


def with_suffixes(urls: DataFrame) -> DataFrame:
    blocked = F.sum(F.when(F.col("_label") == "block", 1).otherwise(0))
    labelled = F.count("_label")
    stats = urls.groupBy("_suffix").agg(
        F.log2(F.count(F.lit(1)).cast("double")).alias("f_suffix"), ((blocked + 1) / (labelled + 2)).alias("f_blocked")
    )
    few = stats.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES
    return urls.join(F.broadcast(stats) if few else stats, "_suffix")


def judge(
    urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """``urls`` with host, path, the rule that fits and the verdict."""
    wanted = [c for c in urls.columns if c not in [*RESULTS, *FEATURES, "_label", "_suffix"] or c == url]
    data = with_suffixes(lexical(urls.select(*[f"`{c}`" for c in wanted]), url, rules))
    sizes = dict(data.filter("_label IS NOT NULL").groupBy("_label").count().collect())
    if len(sizes) < 2:
        other = F.lit(next(iter(sizes), "allow"))
        return data.select(*[f"`{c}`" for c in wanted], *RESULTS[:3], F.coalesce("_label", other).alias("verdict"))
    share = min(1.0, train_rows / sum(sizes.values()))
    picked = data.filter("_label IS NOT NULL").filter(F.pmod(F.xxhash64(F.col(url), F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    train = assembler.transform(picked.withColumn("_y", (F.col("_label") == "block").cast("double"))).select("_features", "_y")
    classes = [r[0] for r in train.select("_y").distinct().collect()]
    if len(classes) < 2:
        other = F.lit(max(sizes, key=lambda k: (sizes[k], k)))
        return data.select(*[f"`{c}`" for c in wanted], *RESULTS[:3], F.coalesce("_label", other).alias("verdict"))
    model = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=trees, maxDepth=depth, seed=7).fit(train)
    scored = model.transform(assembler.transform(data))
    guess = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(*[f"`{c}`" for c in wanted], *RESULTS[:3], F.coalesce("_label", guess).alias("verdict"))
