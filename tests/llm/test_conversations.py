"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import conversations
from loomline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """Least cost, then least edits, by a search over (message, what stands last) in the order of (cost, edits)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, edits, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        new = "a" if last == "u" else "u"
        full = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 5, edits + "I", i, new, (*lines, full + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, new, (*lines, f"{full}:{text}")))


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for r in broken(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, found in convs.items():
        key = lambda r: hashlib.md5(f"{' ' if r[0] is None else r[0]}|{len(r[2])}|{r[2]}|{r[3]}".encode()).hexdigest()
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))
        turns = [r[1] for r in found if r[1] is not None]
        counts, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, _, role, text in found:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, edits, lines = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(seed, convs, longest, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "  ", "", None, "Go on.\n", "x y", "Ünd so!", "Yes.", " "]
    out = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}{rng.choice('.?!x')}"))
    return out


def result(df):
    assert len(rows := df.collect()) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in conversations.RESULTS[1:]) for r in rows}


def test_the_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_conversation_repair"](spark, folder)) == brute(rows)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_pieces_over_many_partitions(spark, monkeypatch, parts):
    rows = rows_of(parts, 60, 12) + rows_of(50 + parts, 3, 200)
    monkeypatch.setattr(conversations, "PART_ROWS", -(-len(rows) // parts))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit("x")).withColumn("piece", F.lit(1))
    assert result(conversations.repair(conversations.damaged(frame))) == brute(rows)


def test_one_conversation_in_many_pieces(spark, monkeypatch):
    rows = [(7, t, r, x) for t, (_, _, r, x) in enumerate(rows_of(5, 40, 12))]
    monkeypatch.setattr(conversations, "PART_ROWS", 20)
    assert result(conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_equal_messages_and_an_empty_table(spark, monkeypatch):
    rows = [(1, 2, "user", "Same.")] * 30 + [(1, 3, "assistant", "Same.")] * 2 + [(2, None, None, None)] * 3
    monkeypatch.setattr(conversations, "PART_ROWS", 10)
    assert result(conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_crossings_are_the_least_edits():
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.choice([0, 1, 4, 5, 6, 8, 9, 10, 12, 14]) for _ in range(rng.randint(0, 9))]
        steps = [conversations.STEPS[c] for c in codes]
        cost, end = conversations.last_state(steps)
        audit, _ = conversations._edited(bytes(codes), [""] * len(codes), [""] * len(codes), 0, end, True)
        names = ["s", "u", "a", "x"]
        plain = [(names[c >> 2], "", "blank" if c & 2 else "truncated" if c & 1 else None) for c in codes]
        assert (cost, audit) == cheapest(plain)[:2]
