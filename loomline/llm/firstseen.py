"""Windows that also start in an earlier document, found over all documents without a hot key.

A window is a fixed number of units (bytes or words) in a row. Each window has an anchor: the
smallest hash of the short grams inside it, so equal windows have equal anchors wherever they stand.
Neighbouring windows with one anchor form a span. The work goes in four steps:

1. *anchors*: each block of documents sends each of its anchors once to the anchor's shard;
2. *verdict*: a shard tells the blocks which anchors occur in different texts;
3. *spans*: a block sends each distinct span with such an anchor once, with its smallest document
   id; the shard's index gives for each window the smallest id of all documents that hold it;
4. *marks*: a block removes, in each of its documents, the windows with a smaller id.

What a passage costs a shard grows with the blocks that hold it, not with the documents, and spans of
equal content are folded in the block; so groups of copies need no splitting. Texts are shuffled once
(the three reads of the blocks share one exchange). An index is built over at most ``INDEX_BYTES`` of
distinct spans at a time. Shards know anchors by 32 bits, which can only add spans to check, and
texts by 64.

Documents with equal texts: all but those with the smallest id lose every window. A null id counts
as larger than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytegrams import pieces
from loomline.llm.scratch import count_blocks, in_blocks

BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 17
INDEX_BYTES = 1 << 20
SHARDS_PER_BLOCK = 3
NO_ID = np.iinfo(np.int64).max


class Cut:
    """The windows of some texts as spans; positions count units over all of them."""

    def __init__(self, anchor, doc, first, count, base):
        self.anchor, self.doc, self.first, self.count = anchor, doc, first, count
        #: For each text the position of its first unit, and one past the last text's end.
        self.base = base


class Method(Protocol):
    width: int  # units in a window

    def cut(self, texts: list[bytes]) -> tuple[Cut, Callable[[np.ndarray], list[bytes]]]:
        """The spans of some texts, and what gives the contents of chosen spans."""

    def index(self, contents: list[bytes], firsts: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
        """For each content the smallest document id of each of its windows."""

    def windows(self, content: bytes) -> int: ...

    def kept(self, text: bytes, base: int, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
        """Number of units of a text, and what is left of it."""


def spans_of(minima: np.ndarray, valid: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring valid windows of one document with one minimum: anchor, document, first, count.

    Only in periodic text is a run longer than ``most``; it is cut into spans of that many windows.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, none
    low, own = minima[at], doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (low[1:] != low[:-1]) | (own[1:] != own[:-1])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(at)))
    if int(count.max()) > most:
        parts = -(-count // most)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, count = np.repeat(starts, parts) + step * most, np.minimum(np.repeat(count, parts) - step * most, most)
    return low[starts], own[starts], at[starts], count


def _texts(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a block in an order that depends on nothing else."""
    ids = [NO_ID if i is None else i for i in table.column("doc_id").to_pylist()]
    rows = sorted(zip(ids, table.column("text").cast(pa.binary()).to_pylist()))
    return [r[0] for r in rows], [r[1] or b"" for r in rows]


def _shards(anchor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return ((anchor >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _anchors(method: Method, shards: int) -> Callable:
    def send(table: pa.Table) -> pa.Table:
        _, texts = _texts(table)
        tags = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") | 1 for t in texts], dtype=np.uint64)
        found, owner = [], []
        for a, b in pieces([len(t) for t in texts], PIECE_BYTES):
            cut, _ = method.cut(texts[a:b])
            pair = _pairs(cut.anchor, tags[a:b][cut.doc])
            found.append(pair[0])
            owner.append(pair[1])
        anchor, tag = _pairs(np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(owner or [np.zeros(0, np.uint64)]))
        # One entry for each anchor; tag 0 where different texts of the block share it.
        first = np.ones(len(anchor), dtype=bool)
        first[1:] = anchor[1:] != anchor[:-1]
        many = np.zeros(len(anchor), dtype=bool)
        many[:-1] = ~first[1:]
        anchor, tag = anchor[first], np.where(many, np.uint64(0), tag)[first]
        shard, low = _shards(anchor, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        rows = [(int(shard[order[a]]), low[part].tobytes(), tag[part].tobytes()) for a, part in zip(cuts, np.split(order, cuts[1:]))] if len(order) else []
        block = table.column("block")[0].as_py()
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "low": pa.array([r[1] for r in rows], pa.binary()), "tag": pa.array([r[2] for r in rows], pa.binary()),
        })

    return send


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _verdict(table: pa.Table) -> pa.Table:
    """Anchors that two different texts hold, for each block that has them."""
    blocks = table.column("block").to_pylist()
    lows = [np.frombuffer(x, dtype=np.uint32) for x in table.column("low").to_pylist()]
    tags = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tag").to_pylist()]
    low, tag = np.concatenate(lows), np.concatenate(tags)
    block = np.repeat(np.arange(len(blocks)), [len(x) for x in lows])
    order = np.argsort(low, kind="stable")
    low, tag, block = low[order], tag[order], block[order]
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, dtype=np.int64)
    again = np.zeros(len(low), dtype=bool)
    if len(low):
        least, most = np.minimum.reduceat(tag, starts), np.maximum.reduceat(tag, starts)
        again = np.repeat((least != most) | (least == 0), np.diff(np.append(starts, len(low))))
    low, block = low[again], block[again]
    order = np.argsort(block, kind="stable")
    low, block = low[order], block[order]
    cuts = np.searchsorted(block, np.arange(len(blocks) + 1))
    some = [k for k in range(len(blocks)) if cuts[k + 1] > cuts[k]]
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "block": pa.array([blocks[k] for k in some], pa.int32()), "shard": pa.array([shard] * len(some), pa.int32()),
        "low": pa.array([np.unique(low[cuts[k] : cuts[k + 1]]).tobytes() for k in some], pa.binary()),
    })


def _wanted(shards: list[int], lows: list[bytes]) -> np.ndarray:
    """Sorted numbers of the anchors named by (shard, low)."""
    parts = [np.frombuffer(x, dtype=np.uint32).astype(np.uint64) | np.uint64(s << 32) for s, x in zip(shards, lows)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _selected(method: Method, texts: list[bytes], wanted: np.ndarray, shards: int):
    """For each piece of the block: where it starts and ends, its cut, and (span, document, shard, low, content) of the wanted spans."""
    for a, b in pieces([len(t) for t in texts], PIECE_BYTES):
        cut, contents = method.cut(texts[a:b])
        shard, low = _shards(cut.anchor, shards)
        number = low.astype(np.uint64) | (shard.astype(np.uint64) << np.uint64(32))
        at = np.searchsorted(wanted, number)
        hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == number) if len(wanted) else np.zeros(0, dtype=np.int64)
        yield a, b, cut, zip(hit.tolist(), (cut.doc[hit] + a).tolist(), shard[hit].tolist(), low[hit].tolist(), contents(hit))


def _spans(method: Method, shards: int) -> Callable:
    def send(docs: pa.Table, verdict: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        wanted = _wanted(verdict.column("shard").to_pylist(), verdict.column("low").to_pylist())
        own: dict[int, dict[bytes, list]] = {}
        for *_, found in _selected(method, texts, wanted, shards):
            for _, j, shard, low, content in found:
                doc, there = ids[j], own.setdefault(shard, {})
                seen = there.get(content)
                if seen is None:
                    there[content] = [low, doc, 0]
                elif doc != seen[1]:
                    seen[1], seen[2] = min(seen[1], doc), 1
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        rows = [(s, v) for s, v in sorted(own.items())]
        return pa.table({
            "shard": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "low": pa.array([np.array([x[0] for x in v.values()], dtype=np.uint32).tobytes() for _, v in rows], pa.binary()),
            "first": pa.array([np.array([x[1] for x in v.values()], dtype=np.int64).tobytes() for _, v in rows], pa.binary()),
            "shared": pa.array([np.array([x[2] for x in v.values()], dtype=np.uint8).tobytes() for _, v in rows], pa.binary()),
            "size": pa.array([np.array([len(c) for c in v], dtype=np.uint32).tobytes() for _, v in rows], pa.binary()),
            "data": pa.array([b"".join(v) for _, v in rows], pa.binary()),
        })

    return send


def _runs(values: np.ndarray) -> tuple[bytes, bytes]:
    if not len(values):
        return b"", b""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts].tobytes(), np.diff(np.append(starts, len(values))).astype(np.uint32).tobytes()


def _index(method: Method) -> Callable:
    def look_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        number: dict[bytes, int] = {}
        first, shared, lows, sent = [], [], [], []
        for row in rows:
            ends = np.cumsum(np.frombuffer(row["size"], dtype=np.uint32).astype(np.int64))
            firsts, many = np.frombuffer(row["first"], dtype=np.int64).tolist(), row["shared"]
            low, mine = np.frombuffer(row["low"], dtype=np.uint32).tolist(), []
            start = 0
            for j, end in enumerate(ends.tolist()):
                content = row["data"][start:end]
                start = end
                k = number.setdefault(content, len(first))
                if k == len(first):
                    first.append(firsts[j])
                    shared.append(many[j])
                    lows.append(low[j])
                else:
                    shared[k] = 1
                    first[k] = min(first[k], firsts[j])
                mine.append(k)
            sent.append(mine)
        contents = list(number)
        # Windows with one anchor stay together; so the index can be built for some anchors at a time.
        order = np.argsort(np.array(lows, dtype=np.uint32), kind="stable")
        edges, total = [0], 0
        for pos, k in enumerate(order.tolist()):
            if total >= INDEX_BYTES and lows[k] != lows[order[pos - 1]]:
                edges.append(pos)
                total = 0
            total += len(contents[k]) + 1
        edges.append(len(order))
        answers: list[np.ndarray | None] = [None] * len(contents)
        for a, b in zip(edges, edges[1:]):
            part = order[a:b].tolist()
            got = method.index([contents[k] for k in part], np.array([first[k] for k in part], dtype=np.int64), np.array([shared[k] for k in part], dtype=bool))
            for k, answer in zip(part, got):
                answers[k] = answer
        out = {"block": [], "shard": [], "low": [], "value": [], "length": []}
        for row, mine in zip(rows, sent):
            value, length = _runs(np.concatenate([answers[k] for k in mine]))
            for name, x in zip(out, (row["block"], row["shard"], row["low"], value, length)):
                out[name].append(x)
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    return look_up


class _Stream:
    """The smallest ids of the windows that a block sent to a shard, as runs, taken content by content."""

    def __init__(self, value: bytes, length: bytes):
        self.value = np.frombuffer(value, dtype=np.int64).tolist()
        self.end = np.cumsum(np.frombuffer(length, dtype=np.uint32).astype(np.int64)).tolist()
        self.run = self.at = 0
        self.known: dict[bytes, tuple[int, int, np.ndarray | None]] = {}

    def take(self, n: int) -> tuple[int, int, np.ndarray | None]:
        """The smallest id of the next ``n`` windows, ``n``, and the id of each where they differ."""
        stop = self.at + n
        while self.end[self.run] <= self.at:
            self.run += 1
        if self.end[self.run] >= stop:
            self.at = stop
            return self.value[self.run], n, None
        ids = []
        while self.at < stop:
            if self.end[self.run] <= self.at:
                self.run += 1
            part = min(stop, self.end[self.run]) - self.at
            ids += [self.value[self.run]] * part
            self.at += part
        return min(ids), n, np.array(ids, dtype=np.int64)


def _inside(up: np.ndarray, down: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """The runs from ``up`` to ``down`` that lie in a range, counted from its start; a run may go on over its ends."""
    if start == end:
        return []
    x, y = np.searchsorted(down, start, side="right"), np.searchsorted(up, end, side="left")
    return [(max(int(p), start) - start, min(int(q), end) - start) for p, q in zip(up[x:y], down[x:y])]


def _marks(method: Method, shards: int) -> Callable:
    def mark(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        rows = replies.to_pylist()
        told = [r for r in rows if r["copy"] is None]
        copies: dict[int, set[str]] = {}
        for r in rows:
            if r["copy"] is not None:
                copies.setdefault(r["copy"], set()).add(r["digest"])
        wanted = _wanted([r["shard"] for r in told], [r["low"] for r in told])
        streams = {r["shard"]: _Stream(r["value"], r["length"]) for r in told}
        n_units, removed, kept = [], [], []
        for a, b, cut, found in _selected(method, texts, wanted, shards):
            change = np.zeros(int(cut.base[-1]) + 1, dtype=np.int32)
            first, width = cut.first.tolist(), method.width
            for i, j, shard, _, content in found:
                stream, doc = streams[shard], ids[j]
                answer = stream.known.get(content)
                if answer is None:
                    answer = stream.known[content] = stream.take(method.windows(content))
                least, n, each = answer
                if least >= doc:
                    continue
                at = first[i]
                if each is None:  # all windows of the span have one id
                    change[at] += 1
                    change[at + n + width - 1] -= 1
                else:
                    early = each < doc
                    change[at : at + n] += early
                    change[at + width : at + width + n] -= early
            gone = np.cumsum(change[:-1]) > 0
            step = np.diff(gone.astype(np.int8), prepend=0, append=0)
            up, down = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            edges = cut.base.tolist()
            for j in range(a, b):
                start, end = edges[j - a], edges[j - a + 1]
                if ids[j] in copies and end - start >= width and hashlib.md5(texts[j]).hexdigest() in copies[ids[j]]:
                    runs = [(0, end - start)]
                else:
                    runs = _inside(up, down, start, end)
                n, rest = method.kept(texts[j], end - start, runs)
                n_units.append(n)
                removed.append([{"start": x, "end": y} for x, y in runs])
                kept.append(rest)
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": pa.array([None if i == NO_ID else i for i in ids], pa.int64()), "n_units": pa.array(n_units, pa.int64()),
            "removed": pa.array(removed, pair), "kept": pa.array(kept, pa.binary()),
        })

    return mark


def remove_seen(docs: DataFrame, method: Method, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_units, removed (runs of units, merged), kept (bytes)."""
    blocks = count_blocks(docs, text, block_bytes)
    shards = blocks * SHARDS_PER_BLOCK
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = in_blocks(lean, ["doc_id"], ["doc_id", "text"], blocks)
    shard, block = F.col("shard"), F.col("block")
    anchors = parts.groupBy(block).applyInArrow(_anchors(method, shards), "shard int, block int, low binary, tag binary")
    verdict = anchors.groupBy(shard).applyInArrow(_verdict, "block int, shard int, low binary")
    spans = parts.groupBy(block).cogroup(verdict.groupBy(block)).applyInArrow(
        _spans(method, shards), "shard int, block int, low binary, first binary, shared binary, size binary, data binary"
    )
    replies = spans.groupBy(shard).applyInArrow(_index(method), "block int, shard int, low binary, value binary, length binary")
    own = lean.select("doc_id", F.md5("text").alias("digest"))
    least = own.groupBy("digest").agg(F.min("doc_id").alias("least"))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    later = own.join(least, "digest").filter(F.coalesce(F.col("doc_id"), F.lit(int(NO_ID))) > F.col("least"))
    copies = later.select(number.alias("block"), F.coalesce(F.col("doc_id"), F.lit(int(NO_ID))).alias("copy"), "digest")
    told = replies.withColumns({"copy": F.lit(None).cast("long"), "digest": F.lit(None).cast("string")}).unionByName(copies, allowMissingColumns=True)
    return parts.groupBy(block).cogroup(told.groupBy(block)).applyInArrow(
        _marks(method, shards), "doc_id long, n_units long, removed array<struct<start:long,end:long>>, kept binary"
    )
