"""Mixing sources by temperature, realised as budgeted block permutations; DataFrame functions only.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent
is narrowed until the weights have the wanted entropy, or until no source is repeated more often
than a limit; where both are given the larger exponent (closer to the natural shares) is taken.
Each round tries ``TRIES`` exponents in one aggregate over the table of sources.

A source's budget is its weight times the token budget. It is drawn in passes: whole passes over
the source, then a part of one. A source is cut into blocks of about ``block_tokens`` by a hash of
the document; each pass visits the blocks, and the documents of a block, in a new order made from a
hash of the pass. The last pass stops in the block where the budget ends. The running sums over the
blocks of a source go by about as many ranges of their order as a range has blocks, first over the
ranges and then within each; so no task sorts all blocks of a source, or all rows of it.

Tokens are words between white space. A null or empty text has no tokens and is not drawn; nor is
anything where there are no tokens at all. A null source is a source of its own. Equal rows are
drawn as often as they occur. A column named like a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.scratch import stash

BLOCK_TOKENS = 1 << 16
TRIES = 16
ROUNDS = 9
LARGEST_EXPONENT = 8.0
BROADCAST_SOURCES = 10_000
RESULTS = ["n_tokens", "weight", "pass", "block", "position"]


def token_count(text: Column) -> Column:
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\t-\r]+", "")
    return F.when(F.length(body) == 0, 0).otherwise(F.size(F.split(F.rtrim(body), r"[\x20\t-\r]+"))).cast("long")


def source_tokens(rows: DataFrame) -> DataFrame:
    """Tokens and share of each source that has any."""
    sums = rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    return stash(sums)


def _sums(exponents: list[float], log_share: Column) -> list[Column]:
    out = []
    for k, t in enumerate(exponents):
        p = F.exp(log_share * t)
        out += [F.sum(p).alias(f"z{k}"), F.sum(p * log_share * t).alias(f"e{k}"), F.max(F.exp(log_share * (t - 1.0))).alias(f"r{k}")]
    return out


def solve_exponent(sources: DataFrame, entropy: float | None, repetitions: float | None, budget_ratio: float = 1.0) -> float:
    """The exponent whose weights have the wanted entropy (in nats), or keep every source within ``repetitions`` passes.

    Entropy falls as the exponent grows; so does, up to 1, the largest number of passes. Wants that no
    exponent meets give the nearest end of the range 0 to 8 (for repetitions 0 to 1).
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(total)))

    def narrow(high: float, enough: bool) -> float:
        low = 0.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * (k + 1) / (TRIES + 1) for k in range(TRIES)]
            r = sources.agg(*_sums(grid, log_share)).first()
            for k, t in enumerate(grid):
                z = r[f"z{k}"]
                met = (math.log(z) - r[f"e{k}"] / z <= entropy) if enough else (budget_ratio * r[f"r{k}"] / z <= repetitions)
                if met:
                    high = t
                    break
                low = t
        return high

    found = []
    if entropy is not None:
        flat = sources.agg(*_sums([0.0], log_share)).first()
        found.append(0.0 if math.log(flat["z0"]) <= entropy else narrow(LARGEST_EXPONENT, True))
    if repetitions is not None:
        flat = sources.agg(*_sums([0.0], log_share)).first()
        found.append(0.0 if budget_ratio * flat["r0"] / flat["z0"] <= repetitions else narrow(1.0, False))
    return max(found) if found else 1.0


def weights(sources: DataFrame, exponent: float, budget: int | None, block_tokens: int) -> DataFrame:
    """Per source: weight, whole passes, tokens of the last pass, number of blocks."""
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    share = F.round(power / F.lit(norm), 12)
    budgeted = F.round(share * F.lit(float(total if budget is None else budget))).cast("long")
    return sources.select(
        "_source", share.alias("weight"), F.floor(budgeted / F.col("tokens")).alias("whole"),
        (budgeted % F.col("tokens")).alias("rest"), F.ceil(F.col("tokens") / F.lit(block_tokens)).alias("blocks"),
    )


def what_is_left(sizes: DataFrame) -> DataFrame:
    """``sizes`` (_source, block, size, rest, blocks, _order) with ``left``: the rest when the block's turn comes."""
    # Ranges of the 64-bit order by its upper 31 bits: about the root of the number of blocks.
    ranges = F.ceil(F.sqrt(F.col("blocks")))
    upper = F.shiftright("_order", 33) + F.lit(1 << 30)
    sizes = sizes.withColumn("_range", F.floor(upper * ranges / F.lit(float(1 << 31))).cast("long"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_source", "_range").orderBy("_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    totals = totals.select("_source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_past"))
    before = F.col("_past") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return sizes.join(totals, ["_source", "_range"]).withColumn("left", F.col("rest") - before)


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", entropy: float | None = None,
    entropy_ratio: float | None = None, repetitions: float | None = None, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 11, keep: list[str] | None = None,
) -> DataFrame:
    """The draws: one row per document and pass, with its place (pass, block, position) in the order of its source.

    ``entropy`` is in nats; ``entropy_ratio`` gives it as a part of the largest possible. ``budget`` is in
    tokens, by default as many as there are.
    """
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    rows = docs.select(*[f"`{c}`" for c in wanted], F.coalesce(F.col(source), F.lit("\x00")).alias("_source"), F.col(key).alias("_key"), token_count(F.col(text)).alias("n_tokens"))
    if text not in wanted:
        rows = stash(rows)
    sources = source_tokens(rows)
    count, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if entropy_ratio is not None and count:
        entropy = entropy_ratio * math.log(count)
    ratio = 1.0 if budget is None or not total else budget / total
    exponent = solve_exponent(sources, entropy, repetitions, ratio)
    table = weights(sources, exponent, budget, block_tokens)
    small = count <= BROADCAST_SOURCES
    table = F.broadcast(table) if small else table
    token = lambda *parts: F.xxhash64(F.lit(seed), *parts)
    placed = rows.filter("n_tokens > 0").join(table, "_source")
    placed = placed.withColumn("block", F.pmod(token(F.col("_key")), F.col("blocks")))
    # What the last pass takes: whole blocks while they fit, then documents of the block where it ends.
    sizes = placed.filter("rest > 0").groupBy("_source", "block").agg(F.sum("n_tokens").alias("size"), *[F.max(c).alias(c) for c in ("rest", "whole", "blocks")])
    sizes = sizes.withColumn("_order", token(F.col("_source"), F.col("whole"), F.col("block")))
    ends = what_is_left(sizes).select("_source", "block", "left").filter("left > 0")
    inner = Window.partitionBy("_source", "block").orderBy("_order", "_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        placed.filter("rest > 0").join(ends, ["_source", "block"])
        .withColumn("_order", token(F.col("whole"), F.col("_key")))
        .withColumn("_before", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        .filter(F.col("_before") < F.col("left")).withColumn("pass", F.col("whole"))
    )
    whole = placed.filter("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    out = [*[f"`{c}`" for c in wanted], "n_tokens", "weight", "pass", "block"]
    place = [
        token(F.col("_source"), F.col("pass"), F.col("block")).alias("block_order"),
        token(F.col("pass"), F.col("_key")).alias("position"),
    ]
    return whole.select(*out, *place).unionByName(last.select(*out, *place))
