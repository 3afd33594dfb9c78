"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in whole texts. The hash of each candidate value is counted over
the corpus by distinct repositories and owners. A value that ``example_owners`` or more owners
hold is a widely copied example; a value of fewer owners that looks random (letters and digits,
no placeholder word) is live. Where such a live value also stands bare in a text (without its
keyword), that place is added as a span of kind ``bare``.

Only texts with candidates are written and shuffled, and of the values only hashes: a value that
a third of all rows hold is folded map-side. Positions are running sums over the rows of one text's
matches, overlaps are found against the running ends in order of position, and a text is redacted by
joining its slices once, so a text with very many candidates takes time in proportion to them.

A null text is empty. A null owner or repository counts as one more owner or repository. Equal rows
are scanned and counted as they stand; counts are of distinct owners, so copies within an owner change
nothing. A live value is compared without full stops at its end, and found from six characters on. Other
columns are kept under any name; one that is called ``spans`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.scratch import stash

#: Fixed patterns of the base kinds, in their order; a kind's minimum is applied to the match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Tokens with a digit, as credentials are; they count only where a base kind found the value elsewhere.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{6,}+"
KINDS = ["assign", "access", "hex", "bare"]
EXAMPLE_OWNERS = 3
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your|dummy|xxxx|test"

_MATCH = "array<struct<rank:int,i:int,chars:int,bytes:int,m:string>>"
_SPAN = "start:long,rank:int,kind:string,end:long,live:boolean,n_owners:long,n_repos:long,byte:long,byte_end:long,behind:long"


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """The matches of a pattern in order, each with the characters and bytes between it and the one before."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.transform(gaps, lambda g: F.struct(F.char_length(g).alias("chars"), F.octet_length(g).alias("bytes")))
    each = F.transform(
        F.arrays_zip(F.slice(sizes, 1, F.size(found)).alias("gap"), found.alias("m")),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["gap"]["chars"].alias("chars"), x["gap"]["bytes"].alias("bytes"), x["m"].alias("m")),
    )
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast(_MATCH))


def _placed(matches: DataFrame) -> DataFrame:
    """(row, owner, repo, rank, start, end, byte, byte_end, value) of the matches of all texts."""
    upto = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = {"end": F.sum(F.col("chars") + F.char_length("m")).over(upto), "byte_end": F.sum(F.col("bytes") + F.octet_length("m")).over(upto)}
    value = F.when(F.col("rank") == 0, F.regexp_extract("m", ASSIGN, 2)).otherwise(F.col("m"))
    # Bare tokens are ASCII, so their bytes are their characters; a sentence's full stop is none of them.
    dots = F.when(F.col("rank") == 3, F.char_length("m") - F.char_length(F.rtrim("m", F.lit(".")))).otherwise(0)
    placed = matches.withColumns(ends).select(
        "row", "owner", "repo", "rank", (F.col("end") - F.char_length("m")).alias("start"), (F.col("end") - dots).alias("end"),
        (F.col("byte_end") - F.octet_length("m")).alias("byte"), (F.col("byte_end") - dots).alias("byte_end"), value.alias("value"),
    )
    return placed.filter((F.col("rank") != 0) | (F.char_length("value") >= 6)).filter("end > start")


def ownership(spans: DataFrame, example_owners: int) -> DataFrame:
    """Per value hash: distinct owners and repositories, and whether it is an example or live."""
    n_owners, n_repos = F.countDistinct("owner"), F.countDistinct("repo")
    is_live = (n_owners < example_owners) & F.max("looks_live")
    return spans.groupBy("hash").agg(
        n_owners.alias("n_owners"), n_repos.alias("n_repos"), F.max(F.col("rank") < 3).alias("found"), is_live.alias("live")
    )


def scan(
    docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "source", keep: list[str] | None = None,
    example_owners: int = EXAMPLE_OWNERS,
) -> tuple[DataFrame, DataFrame]:
    """Two frames that make up ``docs`` (its columns ``keep``, all by default): rows without a candidate as they
    are, and rows with candidates and their ``spans`` (start, rank, kind, end, live, n_owners, n_repos, and for
    :func:`redacted` the bytes they cover and where the live ones before them end)."""
    wanted = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.lit("\x00")
    # The caller's columns travel in one struct, so no name of theirs meets one from here.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in wanted]).alias("kept"), F.coalesce(F.col(f"`{owner}`").cast("string"), none).alias("owner"),
        F.coalesce(F.col(f"`{repo}`").cast("string"), none).alias("repo"),
        F.concat(*[_matches(body, p, k) for k, p in enumerate([ASSIGN, ACCESS, HEX, BARE])]).alias("matches"),
    )
    clean = packed.filter(F.size("matches") == 0).select("kept.*")
    rows = stash(packed.filter(F.size("matches") > 0).withColumn("row", F.monotonically_increasing_id()))
    placed = _placed(rows.select("row", "owner", "repo", F.inline("matches")))
    value = F.col("value")
    looks_live = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
    each = placed.withColumns({"hash": F.sha2(F.rtrim(value, F.lit(".")), 256), "looks_live": looks_live}).drop("value")
    judged = each.join(ownership(each, example_owners), "hash")
    kept = uncovered(judged.filter((F.col("rank") < 3) | (F.col("found") & F.col("live"))))
    one = F.struct("start", "rank", F.element_at(F.lit(KINDS), F.col("rank") + 1).alias("kind"), "end", "live", "n_owners", "n_repos", "byte", "byte_end", "behind")
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    out = rows.select("row", "kept").join(lists, "row", "left")
    return clean, out.select("kept.*", F.coalesce("spans", F.array().cast(f"array<struct<{_SPAN}>>")).alias("spans"))


def uncovered(spans: DataFrame) -> DataFrame:
    """Bare spans stay only where no base span covers any of them; ``behind`` is the last byte of the live ones before."""
    along = Window.partitionBy("row").orderBy("start", "rank")
    # Both sums run from one end: a frame that ends at the last row would be summed anew for each row.
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firm = F.col("rank") < 3
    left, right = F.max(F.when(firm, F.col("end"))).over(before), F.min(F.when(firm, F.col("start"))).over(back)
    marked = spans.withColumns({"left": left, "right": right})
    covered = (F.col("left") > F.col("start")) | (F.col("right") < F.col("end"))
    kept = marked.filter((F.col("rank") < 3) | ~F.coalesce(covered, F.lit(False))).drop("left", "right")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("behind", F.coalesce(F.max(F.when(F.col("live"), F.col("byte_end"))).over(earlier), F.lit(0)).cast("long"))


def listed(spans: Column, base_only: bool) -> Column:
    """``kind:start:end`` of the spans by start and kind, comma-joined."""
    chosen = F.filter(spans, lambda s: s["rank"] < 3) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _ranked(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def digest(clean: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document: counts per kind, the hash of the base spans, all spans, live and example counts."""
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    none = F.lit(0).cast("long")
    columns = ["n_assign", "n_access", "n_hex"]
    hits = found.select(
        "doc_id", *[count(_ranked(k)).alias(c) for k, c in enumerate(columns)],
        F.sha2(listed(F.col("spans"), True), 256).alias("base_sha256"), listed(F.col("spans"), False).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"),
    )
    rest = clean.select(
        "doc_id", *[none.alias(c) for c in columns], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"),
        none.alias("n_live"), none.alias("n_example"),
    )
    return hits.unionByName(rest)


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every live span replaced by a mark; spans that touch an earlier live one are cut short."""
    live = F.filter(spans, lambda s: s["live"])
    heads = F.filter(live, lambda s: s["byte"] >= s["behind"])
    end = F.coalesce(F.array_max(F.transform(live, lambda s: s["byte_end"])), F.lit(0))

    def cut(raw: Column, start: Column, stop: Column | None = None) -> Column:
        size = (F.lit(2147483647) if stop is None else stop - start).cast("int")
        return F.decode(F.substr(raw, (start + 1).cast("int"), size), "UTF-8")

    def joined(raw: Column) -> Column:
        pieces = F.transform(heads, lambda s: F.concat(cut(raw, s["behind"], s["byte"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), cut(raw, end))

    # A list of one: its bytes are made once and not once for each slice.
    return F.element_at(F.transform(F.array(text.cast("binary")), joined), 1)
