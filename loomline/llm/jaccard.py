"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists.

A document's set holds its distinct word shingles; documents link when the Jaccard similarity is at
least ``percent`` per cent. Equal sets are one class from the start. Classes that can link are brought
together exactly: sets of nearly one size are cut by hash into so many parts that more of them hold
something than linked sets can differ in, so linked sets agree in a part that is not empty. The smallest class of those that share a part leads it, and every class goes
to the groups of its leaders, first as a sketch: a set that differs from all others of its group in more
slots than linked sets differ in items goes no further. In a group the T-occurrence search runs: inverted lists of the shingles,
the longest set aside (DivideSkip), the short ones merged (by heap, or by counting where they are many),
the candidates probed by bisection in the long ones, and those that reach the required overlap are links. A group hands back a spanning
forest, not all pairs. Components are found by alternating stars.

A block of documents names a part or sends a set once however many of its documents have it, and only
the first block that holds a set sends it: groups of equal documents cost nothing more. A group of more
than ``CELL`` classes is cut into slots and worked as pairs of slots, each in its own task, so no task
holds an unbounded group and no link is lost.

A text with fewer words than a shingle is one shingle; without words its set is empty and it links with
nothing. A null text is empty. Rows are judged one by one, also if they share an id; the component is the
smallest id reachable, null ids aside (a component of null ids only is null).
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytegrams import ODD, grams, joined, mix, pieces, word_hashes, words
from loomline.llm.components import components
from loomline.llm.scratch import count_blocks, in_blocks, stash

SHINGLE = 3
PERCENT = 90
CELL = 4096
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 17
#: Slots of a sketch are at most 2 to this power; words of sketches that are compared at once.
MOST_SLOTS, COMPARED_WORDS = 14, 1 << 21
#: Short lists of more entries than this in all are merged by counting in place of a heap: the same result.
HEAP_ENTRIES = 256
#: Seeds by which a set is split until enough of its parts are not empty.
SPLITS = 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEED = np.uint64(0xD6E8FEB86659FD93)
_SLOTS = np.uint64(0xA0761D6478BD642F)


class Sets:
    """Shingle sets of some texts: sorted hashes of all, one after the other."""

    def __init__(self, texts: list[bytes], shingle: int):
        buf, begin, _ = joined([t.translate(_LOWER) for t in texts], b" ")
        start, end = words(buf)
        base = np.append(np.searchsorted(start, begin), len(start))
        per = np.diff(base)
        hashes = word_hashes(buf, start, end)
        doc = np.repeat(np.arange(len(texts)), per)
        rolled = grams(hashes, shingle)
        whole = doc[: len(rolled)] == doc[shingle - 1 : shingle - 1 + len(rolled)]
        value, owner = rolled[whole], doc[: len(rolled)][whole]
        for j in np.flatnonzero((per > 0) & (per < shingle)):
            short = grams(hashes[base[j] : base[j + 1]], int(per[j])) + np.uint64(per[j])
            value, owner = np.append(value, short), np.append(owner, j)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.size)))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.value ^ _SEED), dtype=np.uint64)))
        #: One number for the whole set; 0 only for the empty one.
        self.sign = mix((sums[self.base[1:]] - sums[self.base[:-1]]) * ODD + self.size.astype(np.uint64)) | np.uint64(1)
        self.sign[self.size == 0] = 0

    def parts(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(part hash, text): sets that link share one. A set goes by its size class and the next.

        Linked sets of a class differ in at most so many parts; a set with more parts that are not empty shares one
        of these with every set it links with. Sets with fewer are split once more by another seed, and only pairs
        of such sets depend on that; those that ``SPLITS`` seeds leave (few down to 75 per cent, many far below) go by
        their empty parts too.
        """
        ratio = 100.0 / percent
        some = np.flatnonzero(self.size > 0)
        if not len(some) or percent >= 100:  # only equal sets link then, and these are one class
            return np.zeros(0, dtype=np.uint64), some[:0]
        level = np.floor(np.log(self.size[some]) / math.log(ratio) + 1e-9).astype(np.int64)
        out, own = [], []
        for up in (0, 1):
            kind = level + up
            differ, count = np.array([_part_count(int(c), percent) for c in range(int(kind.max()) + 1)]).T[:, kind]
            left = np.arange(len(some))
            for seed in range(SPLITS + 1):
                place = np.full(len(self.size), -1, dtype=np.int64)
                place[some[left]] = np.arange(len(left))
                which = place[self.owner]
                mine = which >= 0
                which, spread = which[mine], mix(self.value[mine] + _SEED + np.uint64(seed))
                first = np.concatenate(([0], np.cumsum(count[left])))
                part = first[which] + ((spread >> np.uint64(20)) % count[left][which].astype(np.uint64)).astype(np.int64)
                sums = np.zeros(int(first[-1]), dtype=np.uint64)
                np.add.at(sums, part, mix(spread))
                full = np.bincount(part, minlength=len(sums)) > 0
                text = np.repeat(np.arange(len(left)), count[left])
                index = np.arange(len(sums)) - first[text]
                name = (kind[left] * (SPLITS + 1) + seed).astype(np.uint64)
                key = mix(sums + mix(name[text] * ODD + index.astype(np.uint64)))
                sent = full if seed < SPLITS else np.ones(len(sums), dtype=bool)
                out.append(key[sent])
                own.append(some[left[text[sent]]])
                left = left[np.bincount(text, weights=full, minlength=len(left)) <= differ[left]]
                if not len(left):
                    break
        return np.concatenate(out), np.concatenate(own)


@functools.cache
def _part_count(kind: int, percent: int) -> tuple[int, int]:
    """In how many parts linked sets of a size class can differ, and the parts that leave more than these not empty."""
    ratio = 100.0 / percent
    differ = math.floor((100 - percent) / (100 + percent) * 2 * (ratio ** (kind + 1) + 1e-6))
    least, parts = ratio ** (kind - 1), differ + 1
    while parts < 4 * (differ + 2):
        empty = parts * math.exp(-least / parts)
        if parts - empty - 3 * math.sqrt(empty) > differ:
            break
        parts += 1 + parts // 50
    return differ, parts


def _bodies(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signs(shingle: int, at: int) -> Callable:
    """Size and sign of each text, in place of the text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bodies(batch.column(at))
            size, signs = [], []
            for a, b in pieces([len(t) for t in texts], PIECE_BYTES):
                sets = Sets(texts[a:b], shingle)
                size.append(sets.size)
                signs.append(sets.sign.astype(np.int64))
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            none = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(size or none)), pa.array(np.concatenate(signs or none))], names=[*names, "n_shingles", "sign"])

    return sign


def _parts(shingle: int, percent: int, shards: int) -> Callable:
    """Each distinct (part, set) of a block, once, to the shard of the part."""

    def send(table: pa.Table) -> pa.Table:
        texts = _bodies(table.column("text"))
        keys, signs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        seen: set[int] = set()
        for a, b in pieces([len(t) for t in texts], PIECE_BYTES):
            sets = Sets(texts[a:b], shingle)
            key, text = sets.parts(percent)
            new = np.zeros(b - a, dtype=bool)
            for j, s in enumerate(sets.sign.tolist()):
                if s not in seen:
                    seen.add(s)
                    new[j] = True
            take = new[text]
            keys.append(key[take])
            signs.append(sets.sign[text[take]].astype(np.int64))
        key, sign = np.concatenate(keys), np.concatenate(signs)
        shard = ((key >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else np.zeros(0, dtype=np.int64)
        groups = np.split(order, cuts[1:]) if len(order) else []
        block = table.column("block")[0].as_py()
        return pa.table({
            "shard": pa.array([int(shard[g[0]]) for g in groups], pa.int32()), "block": pa.array([block] * len(groups), pa.int32()),
            "low": pa.array([low[g].tobytes() for g in groups], pa.binary()), "sign": pa.array([sign[g].tobytes() for g in groups], pa.binary()),
        })

    return send


def _leaders(table: pa.Table) -> pa.Table:
    """(block, sign, leader): sets that share a part with another, the first block that holds them, and the part's smallest set."""
    blocks = np.array(table.column("block").to_pylist(), dtype=np.int64)
    lows = [np.frombuffer(x, dtype=np.uint32) for x in table.column("low").to_pylist()]
    low = np.concatenate(lows)
    sign = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("sign").to_pylist()])
    block = np.repeat(blocks, [len(x) for x in lows])
    order = np.lexsort((block, sign, low))
    low, sign, block = low[order], sign[order], block[order]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != low[:-1]) | (sign[1:] != sign[:-1])
    low, sign, block = low[keep], sign[keep], block[keep]
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(low)))
    many = np.repeat(sizes > 1, sizes)
    leader = np.repeat(sign[starts], sizes)
    found = np.unique(np.stack([block[many], sign[many], leader[many]]), axis=1)
    return pa.table({"block": pa.array(found[0].astype(np.int32)), "sign": pa.array(found[1]), "leader": pa.array(found[2])})


def parity(values: np.ndarray) -> bytes:
    """How many items there are, and for each of about as many slots whether it holds an odd number of them.

    An item that only one of two sets has changes one slot, so sets differ in at least as many items as slots.
    """
    slots = 1 << min(MOST_SLOTS, max(6, (len(values) - 1).bit_length()))
    where = (mix(values ^ _SLOTS) & np.uint64(slots - 1)).astype(np.int64)
    odd = (np.bincount(where, minlength=slots) & 1).astype(np.uint8)
    return len(values).to_bytes(8, "little") + np.packbits(odd).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches of twice, four times, ... as many slots as sketches of ``words`` words: slots that meet are added."""
    while bits.shape[1] > words:
        # Slots are numbered from the highest bit, so a sketch's halves hold the slots that agree in their lower digits.
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def may_link(sketches: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a group are near enough to another one by size and sketch; no set that links is left out."""
    sizes = np.array([int.from_bytes(x[:8], "little") for x in sketches], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    rows = [np.frombuffer(sketches[i], dtype=np.uint64, offset=8) for i in order]
    words = np.array([len(r) for r in rows])
    found = np.zeros(len(rows), dtype=bool)
    for few in np.unique(words):
        # Sets of this many slots and larger ones that they may link with, folded to as many.
        mine = np.flatnonzero(words == few)
        reach = np.searchsorted(ordered, ordered[mine] * 100 // percent, side="right")
        stop = int(reach.max())
        all_bits = np.concatenate([_folded(rows[k][None, :], int(few)) for k in range(int(mine[0]), stop)])
        step = max(1, COMPARED_WORDS // max(1, len(all_bits) * int(few)))
        for a in range(0, len(mine), step):
            left, upto = mine[a : a + step], reach[a : a + step]
            low, high = int(left[0]), int(upto.max())
            other = np.arange(low, high)
            apart = np.bitwise_count(all_bits[left - mine[0]][:, None, :] ^ all_bits[None, low - mine[0] : high - mine[0], :]).sum(2, dtype=np.int64)
            most = (100 - percent) * (ordered[left][:, None] + ordered[other][None, :]) // (100 + percent)
            near = (apart <= most) & (other[None, :] > left[:, None]) & (other[None, :] < upto[:, None])
            found[left] |= near.any(1)
            found[low:high] |= near.any(0)
    out = np.zeros(len(rows), dtype=bool)
    out[order] = found
    return out


def _near(percent: int) -> Callable:
    """(leader, cell, sign) of the sets that may link with another one of their group."""

    def near(table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int], dict[int, bytes]] = {}
        for leader, cell, sign, items in zip(*[table.column(c).to_pylist() for c in ("leader", "cell", "sign", "items")]):
            groups.setdefault((leader, cell), {})[sign] = items
        out: list[tuple[int, int, int]] = []
        for (leader, cell), group in groups.items():
            signs = list(group)
            for sign, keep in zip(signs, may_link(list(group.values()), percent).tolist() if len(signs) > 1 else [False]):
                if keep:
                    out.append((leader, cell, sign))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"leader": pa.array(columns[0], pa.int64()), "cell": pa.array(columns[1], pa.int32()), "sign": pa.array(columns[2], pa.int64())})

    return near


def _send_sets(shingle: int, body: Callable[[np.ndarray], bytes]) -> Callable:
    def send(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        goes: dict[int, list[tuple[int, int, int]]] = {}
        for row in wanted.to_pylist():
            goes.setdefault(row["sign"], []).append((row["shard"], row["leader"], row["cell"]))
        out: dict[str, list] = {"shard": [], "leader": [], "cell": [], "sign": [], "items": []}
        if goes:
            texts = _bodies(docs.column("text"))
            for a, b in pieces([len(t) for t in texts], PIECE_BYTES):
                sets = Sets(texts[a:b], shingle)
                for j, s in enumerate(sets.sign.astype(np.int64).tolist()):
                    places = goes.pop(s, [])
                    made = body(sets.value[sets.base[j] : sets.base[j + 1]]) if places else b""
                    for shard, leader, cell in places:
                        for name, x in zip(out, (shard, leader, cell, s, made)):
                            out[name].append(x)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    return send


class Occurrences:
    """Inverted lists over the sets of a group, numbered by size, and the T-occurrence search on them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets])
        value = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(value, kind="stable")
        value, self.owner = value[order], owner[order]
        #: Distinct items, and where the list of each begins and ends among the owners.
        self.item, self.at = np.unique(value, return_index=True)
        self.stop = np.append(self.at[1:], len(value))

    def needed(self, a, b):
        """The overlap with which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def search(self, k: int, skip: np.ndarray | None = None) -> list[int]:
        """Later sets that link with set ``k``, leaving out those that ``skip`` marks."""
        mine = self.sets[k]
        n = len(mine)
        least = self.needed(n, n)
        lists = np.searchsorted(self.item, mine)
        at, stop = self.at[lists], self.stop[lists]
        shared = stop - at > 1
        at, stop = at[shared], stop[shared]
        if len(at) < least:
            return []
        order = np.argsort(at - stop, kind="stable")  # longest first
        at, stop = at[order], stop[order]
        # DivideSkip: the more and the longer the lists, the more of them are only probed.
        aside = min(least - 1, int(least / (math.log2(int(stop[0] - at[0])) + 1)))
        found, count = self._merge(at[aside:], stop[aside:], least - aside)
        later = found > k if skip is None else (found > k) & ~skip[found]
        found, count = found[later], count[later]
        need = self.needed(n, self.sizes[found])
        for j in range(aside - 1, -1, -1):
            alive = count + (j + 1) >= need
            found, count, need = found[alive], count[alive], need[alive]
            if not len(found):
                break
            long = self.owner[at[j] : stop[j]]
            where = np.minimum(np.searchsorted(long, found), len(long) - 1)
            count = count + (long[where] == found)
        return found[count >= need].tolist()

    def _merge(self, at: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that stand in at least ``least`` of the lists, and in how many."""
        sizes = stop - at
        total = int(sizes.sum())
        if total > HEAP_ENTRIES:
            entries = self.owner[np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]
            counts = np.bincount(entries)
            found = np.flatnonzero(counts >= least)
            return found, counts[found]
        found, counts, last, count = [], [], -1, 0
        for x in [*heapq.merge(*[self.owner[a:b].tolist() for a, b in zip(at, stop)]), -1]:
            if x == last:
                count += 1
                continue
            if count >= least:
                found.append(last)
                counts.append(count)
            last, count = x, 1
        return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets that connect all that link: at most one fewer than there are sets."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    index = Occurrences([sets[k] for k in order], percent)
    part = np.arange(len(sets))
    out = []
    for k in range(len(sets)):
        for other in index.search(k, part == part[k]):
            if part[k] != part[other]:
                part[part == part[other]] = part[k]
                out.append((order[k], order[other]))
    return out


def _link(percent: int) -> Callable:
    def link(table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int], dict[int, bytes]] = {}
        for leader, cell, sign, items in zip(*[table.column(c).to_pylist() for c in ("leader", "cell", "sign", "items")]):
            groups.setdefault((leader, cell), {})[sign] = items
        u, v = [], []
        for group in groups.values():
            signs = sorted(group)
            sets = [np.frombuffer(group[s], dtype=np.uint64) for s in signs]
            for a, b in forest(sets, percent) if len(sets) > 1 else []:
                u.append(signs[a])
                v.append(signs[b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return link


def _cells(pairs: DataFrame, cell: int) -> DataFrame:
    """(block, sign, leader, cell): one cell for a group of at most ``cell`` classes, else one for each pair of slots it is in."""
    sizes = pairs.groupBy("leader").agg(F.countDistinct("sign").alias("n")).filter(F.col("n") > cell)
    slots = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    slot = F.pmod(F.xxhash64("sign", F.lit(3)), slots).cast("int")
    with_others = F.transform(F.sequence(F.lit(0), slots - 1), lambda j: F.greatest(j, slot) * slots + F.least(j, slot))
    cells = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(with_others)
    return pairs.join(sizes, "leader", "left").select("block", "sign", "leader", F.explode(cells).alias("cell"))


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    block_bytes: int = BLOCK_BYTES, cell: int = CELL, row: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id; with ``row`` (a column of longs) also it and ``component``,
    a number of its own for each component, also where ids are null or repeated (null for an empty set)."""
    blocks = count_blocks(docs, text, block_bytes)
    own = [] if row is None else [row]
    lean = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).cast("long").alias(c) for c in own]
    )
    parts = in_blocks(lean, ["doc_id"], ["text"], blocks)
    block, shard = F.col("block"), F.col("shard")
    sent = parts.groupBy(block).applyInArrow(_parts(shingle, percent, blocks), "shard int, block int, low binary, sign binary")
    pairs = stash(sent.groupBy(shard).applyInArrow(_leaders, "block int, sign long, leader long").distinct())
    # A set goes from the first of its blocks only.
    first = pairs.groupBy("sign", "leader").agg(F.min("block").alias("block"))
    cells = stash(_cells(first, cell).withColumn("shard", F.pmod(F.xxhash64("leader", "cell"), F.lit(blocks)).cast("int")))
    sent_schema = "shard int, leader long, cell int, sign long, items binary"
    # Sketches go first, a bit for each shingle: sets that they part from all of their group need not be sent.
    sketches = parts.groupBy(block).cogroup(cells.groupBy(block)).applyInArrow(_send_sets(shingle, parity), sent_schema)
    near = stash(sketches.groupBy(shard).applyInArrow(_near(percent), "leader long, cell int, sign long"))
    wanted = cells.join(near, ["leader", "cell", "sign"], "left_semi")
    sets = parts.groupBy(block).cogroup(wanted.groupBy(block)).applyInArrow(_send_sets(shingle, np.ndarray.tobytes), sent_schema)
    links = sets.groupBy(shard).applyInArrow(_link(percent), "u long, v long")
    named = components(links)
    signs = stash(lean.mapInArrow(_signs(shingle, 1), ", ".join(f"{c} long" for c in ["doc_id", *own, "n_shingles", "sign"])))
    classes = signs.filter("n_shingles > 0").groupBy("sign").agg(F.min("doc_id").alias("least"))
    placed = classes.join(named, classes["sign"] == named["node"], "left").select("sign", "least", F.coalesce("component", "sign").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    number = [] if row is None else ["component"]
    known = placed.join(least, "component").select("sign", "component_id", *number)
    out = signs.join(known, "sign", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *own, *number)
