"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into tokens: runs of up to ``TOKEN`` characters without white space. Hashes of
``gram`` tokens in a row are taken; of each ``window`` neighbouring hashes the smallest is chosen,
the rightmost of equal ones, and kept with its position. Texts that share ``gram + window - 1``
tokens in a row therefore share a chosen hash. A text of fewer tokens than ``gram`` is one gram;
one without tokens has an empty fingerprint.

A chosen hash is one number: 40 bits of the hash above 24 bits that fall with the position, so that
the smaller number is the smaller hash and then the more rightward position. Positions are kept
modulo 2**24; the order within a window stays right except where a window spans a multiple of it.

The likeness of two fingerprints is the Jaccard similarity of their sets of hashes: 1 for equal
texts, also if both are empty; 0 if one is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM = 3
WINDOW = 8
TOKEN = 16
BUCKET_BYTES = 8 << 20
MAX_BOUNDS = 1024
BROADCAST_BUCKETS = 1_000_000
_LOW = 0xFFFFFF


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def against(step: int) -> Callable[[Column], Column]:
    """Each entry or the one ``step`` further on, whichever is smaller."""
    return lambda v: F.zip_with(v, F.slice(v, step + 1, F.greatest(F.size(v) - step, F.lit(0))), lambda a, b: F.least(a, b))


def winnow(tokens: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Chosen (hash, position) numbers of the tokens, by position."""

    def chosen(hashes: Column) -> Column:
        n = F.size(hashes)
        last = F.greatest(n - F.lit(gram), F.lit(0))
        rolled = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(gram)]))
        placed = F.transform(
            rolled, lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR((F.lit(_LOW) - i).bitwiseAND(F.lit(_LOW)).cast("long"))
        )
        low, span = placed, 1
        while span < window:
            step = min(span, window - span)
            low = let(low, against(step))
            span += step
        windows = F.greatest(last + 2 - window, F.lit(1))
        return F.array_distinct(F.slice(low, 1, windows))

    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return F.when(F.size(tokens) > 0, let(hashes, chosen)).otherwise(F.array().cast("array<long>"))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s]{1,%d}" % TOKEN), F.lit(0))
    return winnow(tokens, gram, window)


def hash_of(number: Column) -> Column:
    return F.shiftright(number, 24)


def position_of(number: Column) -> Column:
    return F.lit(_LOW) - number.bitwiseAND(F.lit(_LOW))


def shown(numbers: Column) -> Column:
    """Hash and falling position of each choice as hexadecimal digits."""
    return F.array_join(F.transform(numbers, lambda v: F.lower(F.hex(v))), ",")


def hash_set(numbers: Column) -> Column:
    return F.array_distinct(F.transform(numbers, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(1.0))


def in_order(docs: DataFrame, key: str, text: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in buckets of neighbouring keys, with the first rows of each bucket repeated, marked, at the
    end of the bucket before (of the last bucket for the very first): so the next row of every row is in its bucket.

    Buckets are even cuts between at most ``MAX_BOUNDS`` quantiles of the key, about ``bucket_bytes`` of text each.
    A null key comes first; rows of one key are ordered by a hash of their text.
    """
    low, high, size, n = docs.agg(F.min(key), F.max(key), F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    buckets = max(1, -(-int(size or 0) // bucket_bytes))
    low = 0 if low is None else low
    high = low if high is None else high
    cuts = min(buckets, MAX_BOUNDS)
    marks = [k / cuts for k in range(1, cuts)]
    bounds = docs.agg(F.percentile_approx(key, marks, 10 * MAX_BOUNDS)).first()[0] if marks and n else []
    edges = sorted({low, *(bounds or [])})
    within = -(-buckets // cuts)
    keyed = docs.withColumn("_key", F.coalesce(F.col(key), F.lit(low - 1)).cast("long"))
    ranges = F.array(*[F.lit(e).cast("long") for e in [*edges, high + 1]])
    at = F.greatest(F.size(F.filter(ranges, lambda e: e <= F.col("_key"))) - 1, F.lit(0))
    sub = F.lit(0)
    if within > 1:
        start, end = F.get(ranges, at), F.get(ranges, at + 1)
        sub = F.floor((F.greatest(F.col("_key") - start, F.lit(0))) * within / F.greatest(end - start, F.lit(1))).cast("int")
    keyed = keyed.withColumn("_bucket", (at * within + sub).cast("long"))
    firsts = keyed.select("_bucket", "_key").groupBy("_bucket").agg(F.min("_key").alias("_first"))
    # One row for each bucket_bytes of text: the only step that sees all buckets in one place.
    order = Window.orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select("_first", F.coalesce(F.lag("_bucket").over(order), last).alias("_before"))
    small = buckets <= BROADCAST_BUCKETS
    marked = keyed.join(F.broadcast(firsts) if small else firsts, F.col("_key") == F.col("_first"), "left").drop("_first")
    here = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("m"))
    ahead = F.struct(F.col("_before").alias("b"), F.lit(1).alias("m"))
    places = F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, ahead))
    return marked.withColumn("_place", F.explode(places)).withColumns({"_bucket": F.col("_place.b"), "_marked": F.col("_place.m")}).drop("_place", "_before")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to it and to the next document.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many of the first
    code points of the next document. A null text is empty; a single document is its own next one. Whole texts are
    shuffled once, by bucket; both looks at the next row use that one order.
    """
    lean = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    placed = in_order(lean, key, "_text").withColumn("_tie", F.xxhash64("_text"))
    order = Window.partitionBy("_bucket").orderBy("_marked", "_key", "_tie")
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    ahead = F.coalesce(F.lead("_text").over(order), F.lit(""))
    seen = placed.withColumn("_ahead", ahead)
    edited = F.concat(F.substr("_text", F.lit(1), n - half), F.substr("_ahead", F.lit(1), half))
    seen = seen.select(
        F.col(key), "_bucket", "_marked", "_key", "_tie", n.cast("long").alias("n_chars"), F.col("_text"), edited.alias("_edited")
    )
    seen = seen.select(
        F.col(key), "_bucket", "_marked", "_key", "_tie", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_text"), gram, window).alias("_mine"), fingerprint(F.col("_edited"), gram, window).alias("_theirs"),
    )
    seen = seen.withColumns({"_set": hash_set(F.col("_mine")), "_edited_set": hash_set(F.col("_theirs"))})
    seen = seen.withColumn("_next_set", F.lead("_set").over(order)).filter("_marked = 0")
    return seen.select(
        F.col(key), "n_chars", "edited_sha256", F.col("_mine").alias("choices"), F.col("_theirs").alias("edited_choices"),
        likeness(F.col("_set"), F.col("_edited_set")).alias("near_edited"),
        likeness(F.col("_set"), F.coalesce("_next_set", F.array().cast("array<long>"))).alias("near_next"),
    )


def digest(prints: DataFrame) -> DataFrame:
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("choices")).alias("fingerprint"),
        shown(F.col("edited_choices")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
