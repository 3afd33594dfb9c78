"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Texts are lower-cased in A-Z and cut into words at every ASCII character that is neither a
digit nor a letter. A window is ``window`` words in a row of an item; an item of fewer words
is one window. Each text is read once by the automaton; matches are mapped back to words and
to character offsets of the text as it was.

One slice of items, up to ``slice_bytes``, makes one automaton of about 400 bytes for each byte of
text, kept by the worker for its next tasks; then the pass is narrow. More items go in slices, so
what is broadcast and held by a task has a fixed bound however many items there are: each slice
is a pass of its own over numbered rows that hands on only the rows it hits, and these are joined back.

Null or empty texts have no words and no hits. Items without words match nothing. Items with
equal texts are all reported. A null item_id takes part in hits but is not listed. Other columns
of the documents are kept; one that is named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import stash

WINDOW = 10
SLICE_BYTES = 1 << 20
RESULTS = ["n_words", "hit_words", "hit_chars", "items"]

#: Bytes of UTF-8: A-Z become a-z, other ASCII that is no digit or letter becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KEEPS = np.array([b != 32 for b in _FOLD])


def folded(text: str | None) -> tuple[str, int]:
    """The words between single spaces, each byte of UTF-8 as one character; and their number."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return (b" " + b" ".join(found) + b" ").decode("latin-1"), len(found)


def windows(text: str | None, size: int) -> set[str]:
    flat, n = folded(text)
    found = flat.split(" ")[1 : n + 1]
    return {" " + " ".join(found[i : i + size]) + " " for i in range(max(1, n - size + 1))} if n else set()


def automaton(items: list[tuple[int | None, str | None]], size: int) -> ahocorasick.Automaton | None:
    """All windows; each leads to its number of words and the items it comes from."""
    owners: dict[str, list] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, []).append(item)
    if not owners:
        return None
    machine = ahocorasick.Automaton()
    for w, ids in owners.items():
        machine.add_word(w, (w.count(" ") - 1, ids))
    machine.make_automaton()
    return machine


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def hits(machine: ahocorasick.Automaton | None, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words; runs of hit words (first, one past the last); items that occur."""
    flat, n_words = folded(text)
    found = list(machine.iter(flat)) if machine and n_words else []
    if not found:
        return n_words, [], set()
    gaps = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), dtype=np.uint8) == 32)
    runs, items = [], set()
    for end, (count, ids) in found:
        last = int(np.searchsorted(gaps, end))
        runs.append((last - count, last))
        items.update(ids)
    return n_words, merged(runs), items


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code points of the text as it was."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.ones(len(points) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    plain = points < 128
    inside[1:-1][plain] = _KEEPS[points[plain]]
    step = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


_PAIR = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, hit_words array<struct<start:long,end:long>>, hit_chars array<struct<start:long,end:long>>, items array<long>"
#: The last automaton of this worker, next to the items it was made of.
_made: list = []


def _machine(items: list[tuple[int | None, str | None]], window: int) -> ahocorasick.Automaton | None:
    """The automaton of broadcast items; tasks that follow in one worker share it."""
    if not (_made and _made[0] is items and _made[1] == window):
        _made[:] = [items, window, automaton(items, window)]
    return _made[2]


def _scan(shared, window: int, at: int, only_hits: bool) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value, window)
        for batch in batches:
            counts, runs, chars, ids, rows = [], [], [], [], []
            for j in range(batch.num_rows):
                text = batch.column(at)[j].as_py()
                n, found, items = hits(machine, text)
                if only_hits and not found:
                    continue
                rows.append(j)
                counts.append(n)
                runs.append([{"start": a, "end": b} for a, b in found])
                chars.append([{"start": a, "end": b} for a, b in (offsets(text, found) if found else [])])
                ids.append(sorted(items - {None}))
            kept = batch.take(pa.array(rows, pa.int64())) if only_hits else batch
            results = [pa.array(counts, pa.int64()), pa.array(runs, _PAIR), pa.array(chars, _PAIR), pa.array(ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *results], names=[*batch.schema.names, *RESULTS])

    return scan


def _united(runs: Column) -> Column:
    """Lists of runs of several slices as one list of runs that neither touch nor overlap."""
    flat = F.array_sort(F.flatten(runs))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        longer = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))
        return F.when(last["end"] >= r["start"], longer).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(flat, empty, step)


def _words_of(text: Column) -> Column:
    """Number of words, as ``folded`` counts them."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, the runs of hit words, the same runs as offsets, and the items that occur.

    Character offsets of runs that touch in words are joined where one slice finds both; of several slices
    they are listed by slice where they do not overlap.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-int(total) // slice_bytes))
    out = docs.select(*[f"`{c}`" for c in docs.columns if c not in RESULTS])

    def passed(rows: DataFrame, part: DataFrame, only_hits: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(_scan(shared, window, rows.columns.index(text), only_hits), f"{schema}, {_FOUND}")

    if slices == 1:
        return passed(out, known, False)
    row = "_row_" + max(out.columns, key=len)  # longer than any name there is
    rows = stash(out.withColumn(row, F.monotonically_increasing_id()))
    part_of = F.pmod(F.xxhash64("i", "t"), F.lit(slices))
    found = [passed(rows.select(f"`{row}`", f"`{text}`"), known.filter(part_of == k), True).drop(text) for k in range(slices)]
    each = reduce(DataFrame.unionByName, found).groupBy(f"`{row}`").agg(
        *[F.collect_list(c).alias(c) for c in ("hit_words", "hit_chars", "items")]
    )
    empty = F.array().cast("array<struct<start:long,end:long>>")
    joined = rows.join(each, row, "left")
    return joined.select(
        *[f"`{c}`" for c in out.columns], _words_of(F.col(f"`{text}`")).alias("n_words"),
        *[F.coalesce(_united(F.col(c)), empty).alias(c) for c in ("hit_words", "hit_chars")],
        F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.array().cast("array<long>")).alias("items"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, and a hash of the sorted item ids."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
