"""Source divergence audit by chunk factorization: how far sources of one language differ in their words.

Each document's whitespace chunks are counted where the document lies, and summed to groups (language and
source) before anything is shuffled. All counts of a chunk then meet in one partition, where each globally
distinct chunk is cut into terms once and its terms are joined back to its counts. Terms are runs of letters
or of characters beyond ASCII, with only A-Z lower-cased; a term never crosses a chunk. All counts of a term
of one language meet in a second shuffle, already summed over the chunks of a partition.

A language keeps the terms of at least ``min_docs`` of its documents. A chunk's documents are a plain sum,
since a document lies in one task; a chunk in ``min_docs`` or more documents settles its terms. Other chunks
have at most two documents, which their smallest and largest row numbers name, so the distinct documents of
the remaining terms are counted exactly from these numbers; this holds for ``min_docs`` up to 3. No more than
``min_docs`` numbers of a term are ever held.

The smoothed share of a term in a group is p = 1 + floor(10^9 (count + 1) / (N + V)), N the group's count of
kept terms, V the kept terms of the language. The divergence from q is floor((p - q)^2 / q), in integers.
Pairs of sources are summed over blocks of terms: within a block, terms of equal counts in all sources are
one column, and a matrix of sources by columns stays in numpy; no pairs of rows are formed.

Counts travel as arrays of whole numbers, one row for each chunk or term, and are merged in numpy, in arrays
that are merged down again whenever ``MERGE_ROWS`` have come together. Groups are named by a 64-bit hash;
two groups of one hash raise.

Null text, language or source is ''. Documents are rows: repeated rows, ids or null ids count each. A document
without terms still makes its group occur. Equal values are ranked by the item's UTF-8. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import count_blocks, stash

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text that are counted together, and that make one partition of chunks and of terms.
SLICE_BYTES, PART_BYTES = 16 << 20, 12 << 20
#: Entries that may come together before they are merged.
MERGE_ROWS = 2_000_000
#: Terms in a block of the pair sums, and cells of a matrix of sources by columns that is worked at once.
BLOCK_TERMS, TILE_CELLS = 200_000, 1 << 20

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- arrays in binary columns


def packed(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of whole numbers as one binary value for each run that begins at ``starts``."""
    width = rows.shape[1] * 8
    offsets = np.append(starts, len(rows)).astype(np.int64) * width
    data = pa.py_buffer(np.ascontiguousarray(rows, dtype=np.int64).tobytes())
    large = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), data])
    return large.cast(pa.binary())


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a packed column, and for each the value it lies in."""
    if not len(column):
        return np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=np.int64)
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    rows = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.int64) if at[-1] > at[0] else np.zeros(0, dtype=np.int64)
    return rows.reshape(-1, width), np.repeat(np.arange(len(wide)), np.diff(at) // (8 * width))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the first matters most), and where a run of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    return order, np.flatnonzero(new)


# ---------------------------------------------------------------- chunks


def _count_slice(rows: np.ndarray, groups: np.ndarray, langs: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """(chunk, counts): per chunk and group its language, occurrences, documents, smallest and largest row."""
    # Splits at \x20 and \x09-\x0D, nothing else.
    lists = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    words = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(words), 0)
    owner, words = owner[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
    codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    each, times = np.unique(owner * max(1, len(names)) + codes, return_counts=True)
    doc, code = np.divmod(each, max(1, len(names)))
    order, starts = _runs(code, groups[doc])
    doc, code, times = doc[order], code[order], times[order]
    if not len(starts):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.binary())], names=["chunk", "counts"])
    first, numbers = doc[starts], rows[doc]
    found = np.stack([
        groups[first], langs[first], np.add.reduceat(times, starts), np.diff(np.append(starts, len(doc))),
        np.minimum.reduceat(numbers, starts), np.maximum.reduceat(numbers, starts),
    ], 1)
    code = code[starts]
    begin = np.flatnonzero(np.append(True, np.diff(code) != 0))
    return pa.RecordBatch.from_arrays([names.take(pa.array(code[begin])), packed(found, begin)], names=["chunk", "counts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        numbers = [whole.column(c).to_numpy() for c in ("row", "g", "l")]
        return _count_slice(*numbers, pa.concat_arrays(whole.column("text").chunks))

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, side="right")))
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1]) - before
            at = upto
            if size >= SLICE_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class _Merger:
    """Named arrays that are concatenated and, when they are many, merged down by ``merge(names, owner, rows)``."""

    def __init__(self, width: int, merge: Callable):
        self.width, self.merge = width, merge
        self.names, self.owner, self.rows, self.size = [], [], [], 0

    def add(self, names: pa.Array, column: pa.Array) -> None:
        rows, owner = unpacked(column, self.width)
        self.owner.append(owner + sum(len(n) for n in self.names))
        self.names.append(names)
        self.rows.append(rows)
        self.size += len(rows)
        if self.size >= 2 * MERGE_ROWS or (self.size >= MERGE_ROWS and len(self.names) == 1):
            self.settle()

    def settle(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct names, and merged rows with the number of their name."""
        if not self.names:
            return pa.array([], pa.string()), np.zeros(0, dtype=np.int64), np.zeros((0, self.width), dtype=np.int64)
        coded = pa.concat_arrays(self.names).dictionary_encode()
        owner = coded.indices.to_numpy().astype(np.int64)[np.concatenate(self.owner)]
        owner, rows = self.merge(owner, np.concatenate(self.rows))
        self.names, self.owner, self.rows, self.size = [coded.dictionary], [owner], [rows], len(rows)
        return coded.dictionary, owner, rows


def _merge_chunks(owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, starts = _runs(owner, rows[:, 0])
    if not len(starts):
        return owner, rows
    rows, owner = rows[order], owner[order][starts]
    sums = [np.add.reduceat(rows[:, c], starts) for c in (2, 3)]
    return owner, np.stack([rows[starts, 0], rows[starts, 1], *sums, np.minimum.reduceat(rows[:, 4], starts), np.maximum.reduceat(rows[:, 5], starts)], 1)


#: Columns of a term's entries: language, kind, name, amount. Kind 0: occurrences of a group; 1: a document's
#: row number; 2: settled.
_COUNT, _ROW, _SETTLED = 0, 1, 2


def _merge_terms(min_docs: int) -> Callable:
    """Sums occurrences per term, language and group; keeps at most ``min_docs`` rows of a term, then settles it."""

    def merge(owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, starts = _runs(owner, rows[:, 0], rows[:, 1], rows[:, 2])
        if not len(starts):
            return owner, rows
        rows, owner = rows[order], owner[order][starts]
        amounts = np.add.reduceat(rows[:, 3], starts)
        rows = np.concatenate([rows[starts, :3], amounts[:, None]], 1)
        _, runs = _runs(owner, rows[:, 0])  # already in order
        which = np.zeros(len(rows), dtype=np.int64)
        which[runs] = 1
        which = np.cumsum(which) - 1
        n_rows = np.bincount(which, weights=rows[:, 1] == _ROW)
        settled = np.bincount(which, weights=rows[:, 1] == _SETTLED) > 0
        late = ~settled & (n_rows >= min_docs)
        stays = ~((rows[:, 1] == _ROW) & (settled | late)[which])
        marks = np.flatnonzero(late)
        first = runs[marks]
        more = np.stack([rows[first, 0], np.full(len(marks), _SETTLED), np.zeros(len(marks), dtype=np.int64), np.ones(len(marks), dtype=np.int64)], 1)
        return np.concatenate([owner[stays], owner[first]]), np.concatenate([rows[stays], more])

    return merge


def _terms_of(min_docs: int) -> Callable:
    """All counts of a chunk are in this partition: each chunk is cut into terms once, and they take over its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Merger(6, _merge_chunks)
        for batch in batches:
            chunks.add(batch.column("chunk"), batch.column("counts"))
        names, owner, rows = chunks.settle()
        if not len(rows):
            return
        flat, of, times = [], [], []
        for i, name in enumerate(pc.ascii_lower(names).to_pylist()):
            found = _TERM.findall(name)
            if len(found) == 1:
                flat.append(found[0])
                of.append(i)
                times.append(1)
            elif found:
                for term, k in Counter(found).items():
                    flat.append(term)
                    of.append(i)
                    times.append(k)
        # Documents of a chunk in its language.
        order, starts = _runs(owner, rows[:, 1])
        owner, rows = owner[order], rows[order]
        docs = np.add.reduceat(rows[:, 3], starts)
        ends = [np.minimum.reduceat(rows[:, 4], starts), np.maximum.reduceat(rows[:, 5], starts)]
        sure = docs >= min_docs
        chunk, lang = owner[starts], rows[starts, 1]
        zeros = np.zeros(len(starts), dtype=np.int64)
        marks = [
            (chunk[sure], np.stack([lang, zeros + _SETTLED, zeros, zeros + 1], 1)[sure]),
            *[(chunk[~sure], np.stack([lang, zeros + _ROW, e, zeros], 1)[~sure]) for e in ends],
        ]
        counts = np.stack([rows[:, 1], np.zeros(len(rows), dtype=np.int64) + _COUNT, rows[:, 0], rows[:, 2]], 1)
        owner, rows = np.concatenate([owner, *[m[0] for m in marks]]), np.concatenate([counts, *[m[1] for m in marks]])
        # Every entry of a chunk goes to every term of the chunk.
        of, times = np.array(of, dtype=np.int64), np.array(times, dtype=np.int64)
        per_chunk = np.bincount(of, minlength=len(names))
        first = np.cumsum(per_chunk) - per_chunk
        many = per_chunk[owner]
        entry = np.repeat(np.arange(len(owner)), many)
        term = np.repeat(first[owner] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        rows = rows[entry]
        counted = rows[:, 1] == _COUNT
        rows[counted, 3] *= times[term][counted]
        coded = pa.array(flat, pa.string()).dictionary_encode()
        owner, rows = _merge_terms(min_docs)(coded.indices.to_numpy().astype(np.int64)[term], rows)
        yield from _by_language(coded.dictionary, owner, rows)

    return run


def _by_language(names: pa.Array, owner: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    order, starts = _runs(owner, rows[:, 0])
    owner, rows = owner[order], rows[order]
    if len(starts):
        columns = [pa.array(rows[starts, 0]), names.take(pa.array(owner[starts])), packed(rows[:, 1:], starts)]
        yield pa.RecordBatch.from_arrays(columns, names=["l", "term", "entries"])


def _kept_of(min_docs: int) -> Callable:
    """(l, term, all_n, cells): the kept terms with their occurrences in all groups of the language, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Merger(4, _merge_terms(min_docs))
        for batch in batches:
            entries, at = unpacked(batch.column("entries"), 3)
            langs = batch.column("l").to_numpy()[at]
            starts = np.flatnonzero(np.append(True, np.diff(at) != 0)) if len(at) else np.zeros(0, dtype=np.int64)
            terms.add(batch.column("term").take(pa.array(at[starts])), packed(np.concatenate([langs[:, None], entries], 1), starts))
        names, owner, rows = terms.settle()
        if not len(rows):
            return
        order, runs = _runs(owner, rows[:, 0])
        owner, rows = owner[order], rows[order]
        which = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(rows))))
        kept = np.bincount(which, weights=rows[:, 1] == _SETTLED) > 0
        use = kept[which] & (rows[:, 1] == _COUNT)
        owner, rows = owner[use], rows[use]
        order, _ = _runs(owner, rows[:, 0], rows[:, 2])
        owner, rows = owner[order], rows[order]
        _, starts = _runs(owner, rows[:, 0])
        if len(starts):
            columns = [
                pa.array(rows[starts, 0]), names.take(pa.array(owner[starts])), pa.array(np.add.reduceat(rows[:, 3], starts)), packed(rows[:, 2:], starts),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["l", "term", "all_n", "cells"])

    return run


def kept_terms(rows: DataFrame, parts: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """(l, term, all_n, cells) from (row, g, l, text): see the module's text."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is 1, 2 or 3")
    counts = rows.mapInArrow(_counted, "chunk string, counts binary").repartition(parts, "chunk")
    terms = counts.mapInArrow(_terms_of(min_docs), "l long, term string, entries binary").repartition(parts, "l", "term")
    return terms.mapInArrow(_kept_of(min_docs), "l long, term string, all_n long, cells binary")


# ---------------------------------------------------------------- divergences


def shares(counts: np.ndarray, totals: np.ndarray, kept: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (counts + 1) / (totals + kept)), exactly: in 64 bits where the product fits, else in whole numbers."""
    if int(counts.max(initial=0)) + 1 <= ((1 << 63) - 1) // scale:
        return 1 + (counts + 1) * scale // (totals + kept)
    return (1 + (counts.astype(object) + 1) * scale // (totals + kept).astype(object)).astype(np.int64)


def _block(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the divergences over a block of terms, for every ordered pair of the language's sources."""
    groups = groups.sort_by("g")
    ids, totals, kept = (groups.column(c).to_numpy() for c in ("g", "total", "kept"))
    sources = groups.column("source").to_pylist()
    # Cells are in the order of groups, so equal counts are equal bytes.
    alike = list(Counter(cells.column("cells").to_pylist()).items())
    sums = np.zeros((len(ids), len(ids)), dtype=np.int64)
    width = max(1, TILE_CELLS // max(1, len(ids)))
    for at in range(0, len(alike), width):
        part = alike[at : at + width]
        found, column = unpacked(pa.array([c for c, _ in part], pa.binary()), 2)
        counts = np.zeros((len(ids), len(part)), dtype=np.int64)
        counts[np.searchsorted(ids, found[:, 0]), column] = found[:, 1]
        times = np.array([t for _, t in part], dtype=np.int64)
        p = shares(counts, totals[:, None], kept[:, None])
        for i in range(len(ids)):
            sums[i] += ((p[i] - p) ** 2 // p) @ times
    a, b = np.divmod(np.arange(len(ids) ** 2), max(1, len(ids)))
    a, b = a[a != b], b[a != b]
    return pa.table({
        "g": pa.array(ids[a]), "item": pa.array(sources, pa.string()).take(pa.array(b)), "value": pa.array(sums[a, b], pa.int64())
    })


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cell."""
    for batch in batches:
        cells, at = unpacked(batch.column("cells"), 2)
        columns = [pa.array(cells[:, 0]), batch.column("term").take(pa.array(at)), pa.array(cells[:, 1]), batch.column("all_n").take(pa.array(at))]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "item", "n", "all_n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, _ = unpacked(batch.column("cells"), 2)
        order, starts = _runs(cells[:, 0])
        if len(starts):
            yield pa.RecordBatch.from_arrays([pa.array(cells[order][starts, 0]), pa.array(np.add.reduceat(cells[order, 1], starts))], names=["g", "n"])


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of every source from each other one of its language
    (``pair``), and the terms that it uses more than its language, most divergent first (``term``)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = rows.withColumns({"g": F.xxhash64("lang", "source"), "l": F.xxhash64("lang"), "row": F.monotonically_increasing_id()})
    parts = count_blocks(rows, "text", PART_BYTES)
    cells = stash(kept_terms(rows.select("row", "g", "l", "text"), parts, min_docs))
    groups = _groups(rows.select("g", "l", "lang", "source").distinct(), cells)
    ranked = _in_order(pair_values(cells, groups), groups, "pair").unionByName(
        _in_order(term_values(cells, groups), groups, "term").filter(F.col("rank") <= top_terms)
    )
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _groups(named: DataFrame, cells: DataFrame) -> DataFrame:
    """(g, l, lang, source, total, kept, all_total): every group that occurs, with its count and its language's."""
    totals = cells.select("cells").mapInArrow(_summed, "g long, n long").groupBy("g").agg(F.sum("n").alias("total"))
    sizes = cells.groupBy("l").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("all_total"))
    zero = F.lit(0).cast("long")
    known = stash(named.join(totals, "g", "left").join(sizes, "l", "left").withColumns({c: F.coalesce(c, zero) for c in ("total", "kept", "all_total")}))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("g"), F.count_distinct("l").alias("l"), F.count_distinct("lang").alias("lang")).first()
    if n["g"] != n["n"] or n["l"] != n["lang"]:
        raise ValueError("two groups of one hash")
    return known


def _in_order(items: DataFrame, groups: DataFrame, part: str) -> DataFrame:
    rank = F.expr("row_number() OVER (PARTITION BY g ORDER BY value DESC, item)")
    ranked = items.select("g", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked.join(groups.select("g", "lang", "source"), "g")


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, item, value) for every ordered pair of sources of a language; blocks of terms follow their number."""
    blocks = max(1, -(-cells.count() // BLOCK_TERMS))
    work = cells.select("l", "cells", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    every = groups.select("l", "g", "source", "total", "kept", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sums = work.groupBy("l", "block").cogroup(every.groupBy("l", "block")).applyInArrow(_block, "g long, item string, value long")
    return sums.groupBy("g", "item").agg(F.sum("value").alias("value"))


def term_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, item, value) of the terms that a group has and uses more than its language."""
    share = f"1L + cast({SCALE} as decimal(10,0)) * cast(%s + 1 as decimal(28,0)) div cast(%s + kept as decimal(28,0))"
    each = cells.select("term", "all_n", "cells").mapInArrow(_single, "g long, item string, n long, all_n long")
    each = each.join(groups.select("g", "total", "kept", "all_total"), "g")
    each = each.select("g", "item", F.expr(share % ("n", "total")).alias("p"), F.expr(share % ("all_n", "all_total")).alias("q"))
    return each.filter("p > q").select("g", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
