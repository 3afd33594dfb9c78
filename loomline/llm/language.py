"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily:
each phrase is the longest match with the language's text that starts where the last phrase
ended. The language that needs the fewest phrases wins, each phrase costed at the logarithm of
the length of the language's text (so languages with less labelled text are not favoured).

Texts are lower-cased; every run of characters that are no letters counts as one space. The symbols
are the bytes of the UTF-8 that is left, so the alphabet stays small in every script; a byte that a
language's sample lacks is a phrase of its own. Whole texts are parsed, in blocks of ``BLOCK`` bytes
at whose ends phrases end too, in every language alike, so that all blocks of a batch advance
together in numpy. The automata take at most about 2 * 4 * 257 bytes for each byte of the samples.

Labelled text is a bounded sample, the same at every input size: per language the first
``train_chars`` characters of labelled documents in the order of a hash. The bounds of ``learn_bounds`` are no sample: they
come from every held-out labelled text. A text that is null
or has no letter is ``und`` with score 0. Ties go to the smaller language name. Without any
labelled text all texts are ``und``. The score is 1 - cost(best) / cost(second), or 1 if only one
language is known. Other columns are kept; ``lang_pred``, ``score`` and ``bits_per_char`` replace
columns of these names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sample bound: characters of labelled text for each language, and labelled rows read for them.
TRAIN_CHARS = 30_000
TRAIN_ROWS = 64
BLOCK = 1024
BATCH_BYTES = 1 << 21
#: Texts of fewer letters are too short for a verdict by their bits per character.
JUDGED_LETTERS = 40
RESULTS = ["lang_pred", "score", "bits_per_char"]
UNKNOWN = "und"


def suffix_automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton: [state, symbol] to a state, -1 where there is none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new, at = len(nxt), last
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and s not in nxt[at]:
            nxt[at][s] = new
            at = link[at]
        if at >= 0:
            to = nxt[at][s]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and nxt[at].get(s) == to:
                    nxt[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    table = np.full((len(nxt), n_symbols), -1, dtype=np.int32)
    for state, edges in enumerate(nxt):
        for s, to in edges.items():
            table[state, s] = to
    return table


def plain(text: str | None) -> str:
    return "".join(c if c.isalpha() else " " for c in (text or "").lower())


class Parser:
    """Automata of all languages in one table: an entry is (next row << 1) | 1 if a phrase starts there.

    The root is where a text starts and where a byte leads that the sample lacks: what follows is a new phrase.
    """

    def __init__(self, training: dict[str, str]):
        samples = {k: " ".join(plain(v).split()).encode() for k, v in training.items()}
        self.languages = sorted(k for k, v in samples.items() if v)
        # Symbol 0 stands for bytes that no language has: it matches nothing.
        used = sorted({c for v in samples.values() for c in v})
        self.symbols = np.zeros(256, dtype=np.int32)
        self.symbols[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        automata = [suffix_automaton(self.symbols[list(samples[k])].tolist(), width) for k in self.languages]
        self.costs = [float(np.log2(len(samples[k]) + 1)) for k in self.languages]
        bases = np.cumsum([0, *(len(a) for a in automata)])
        size = np.int32 if int(bases[-1]) * width * 2 < 1 << 31 else np.int64
        self.roots = (bases[:-1] * width).astype(size)
        parts = []
        for table, base in zip(automata, bases):
            starts = table < 0
            starts[0] = True
            restart = np.where(table[0] >= 0, table[0], 0)[None, :]
            to = np.where(table >= 0, table, restart).astype(np.int64) + base
            parts.append(((to * width) << 1 | starts).astype(size))
        self.table = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, dtype=size)

    def codes(self, text: str) -> tuple[np.ndarray, int, int]:
        """Symbols of a text, runs of other characters as one space; its number of letters, and of characters left."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
        letters = _letters()[points]
        keep = letters | np.concatenate(([True], letters[:-1]))
        left = np.where(letters, points, 32)[keep].astype(np.uint32)
        found = np.frombuffer(left.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        return self.symbols[found], int(letters.sum()), len(left)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text: [language, text]."""
        owner, blocks = [], []
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), BLOCK):
                owner.append(i)
                blocks.append(codes[at : at + BLOCK])
        out = np.zeros((len(self.languages), len(texts)))
        if not blocks:
            return out
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        sizes = np.array([len(blocks[j]) for j in order])
        grid = np.zeros((BLOCK, len(blocks)), dtype=np.int32)
        for col, j in enumerate(order):
            grid[: sizes[col], col] = blocks[j]
        counts = np.zeros((len(self.languages), len(blocks)), dtype=np.int32)
        state = np.repeat(self.roots[:, None], len(blocks), axis=1)
        active = np.searchsorted(-sizes, -np.arange(BLOCK), side="left")
        for t in range(int(sizes[0])):
            n = int(active[t])
            step = self.table[state[:, :n] + grid[t, :n]]
            counts[:, :n] += step & 1
            state[:, :n] = step >> 1
        owners = np.array(owner)[order]
        for k in range(len(self.languages)):
            out[k] = np.bincount(owners, weights=counts[k], minlength=len(texts))
        return out


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _sample(labelled: DataFrame, text: str, lang: str, key: str, chars: int, train_rows: int) -> dict[str, list[str]]:
    """Language to the first ``chars`` characters of at most ``train_rows`` labelled rows, in the order of a hash."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return {}
    order = F.xxhash64(F.col(key).cast("string"), F.lit(17))
    share = F.lit(1.0)
    for name, n in sorted(sizes.items()):
        if n > 4 * train_rows:
            share = F.when(F.col(lang) == name, F.lit(4 * train_rows / n)).otherwise(share)
    picked = known.filter(F.pmod(order, F.lit(1 << 32)) < share * float(1 << 32))
    rows = picked.select(F.col(lang).alias("l"), F.substring(text, 1, chars).alias("t"), order.alias("o")).collect()
    return {name: [r.t for r in sorted((r for r in rows if r.l == name), key=lambda r: (r.o, r.t))][:train_rows] for name in sorted(sizes)}


def learn(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    train_chars: int = TRAIN_CHARS, train_rows: int = TRAIN_ROWS,
) -> dict[str, str]:
    """Language to its labelled text: at most ``train_rows`` rows and ``train_chars`` characters each."""
    found = _sample(labelled, text, lang, key, train_chars, train_rows)
    return {name: " ".join(texts)[:train_chars] for name, texts in found.items()}


def learn_bounds(labelled: DataFrame, training: dict[str, str], text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, float]:
    """Language to the bits per character above which a text is in no language, from labelled texts not learned from.

    It is what the cheapest twentieth of these texts cost with their characters shuffled; texts of several languages
    stay below it. All such texts of at least ``JUDGED_LETTERS`` letters count, each whole, costed in Spark tasks; the
    quantiles are Spark's exact percentiles. A language without such texts, or where all but the worst twentieth
    unshuffled are not below it, has no bound.
    """
    parser = Parser(training)
    if not parser.languages:
        return {}
    shared = labelled.sparkSession.sparkContext.broadcast(parser)
    known = labelled.filter(F.col(lang).isin(parser.languages) & F.col(text).isNotNull())
    rows = known.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.col(key).cast("string").alias("k"))
    costs = rows.mapInArrow(_costs(shared), "l string, plain double, mixed double")
    found = costs.groupBy("l").agg(F.percentile("plain", 0.95).alias("plain"), F.percentile("mixed", 0.05).alias("mixed")).collect()
    return {r.l: float(r.mixed) for r in found if r.plain < r.mixed}


def _costs(shared) -> Callable:
    """Bits per character of each text of ``JUDGED_LETTERS`` letters or more in its own language, as it is and shuffled.

    The shuffle of a text is seeded by its key and its text, so it is the same wherever the row is.
    """

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        index = {name: k for k, name in enumerate(parser.languages)}
        for batch in batches:
            langs, plains, mixeds, pending, total = [], [], [], [], 0
            names, texts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for j, (name, t) in enumerate(zip(names, texts)):
                found = parser.codes(t)
                if found[1] >= JUDGED_LETTERS:
                    seed = zlib.crc32(f"{keys[j]}\x00{t}".encode("utf-8", "surrogatepass"))
                    mixed = "".join(np.random.default_rng([17, seed]).permutation(list(t)).tolist())
                    pending.append((index[name], found, parser.codes(mixed)))
                    total += len(found[0])
                if pending and (total >= BATCH_BYTES or j == len(names) - 1):
                    ks = np.array([k for k, _, _ in pending])
                    for at, which in ((1, plains), (2, mixeds)):
                        phrases = parser.phrases([p[at][0] for p in pending])[ks, np.arange(len(pending))]
                        chars = np.array([p[at][2] for p in pending], dtype=np.float64)
                        which.extend((phrases * np.array(parser.costs)[ks] / chars).tolist())
                    langs.extend(parser.languages[k] for k in ks)
                    pending, total = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(plains, pa.float64()), pa.array(mixeds, pa.float64())], names=["l", "plain", "mixed"]
            )

    return cost


def _label(shared, at: int, keep: list[int]) -> Callable:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in batches:
            names, scores, bits, texts, total = [], [], [], [], 0
            for j in range(batch.num_rows):
                text = batch.column(at)[j].as_py()
                texts.append(parser.codes(text or ""))
                total += len(texts[-1][0])
                if total >= BATCH_BYTES or j == batch.num_rows - 1:
                    for best, score, cost in _decide(parser, texts):
                        names.append(best)
                        scores.append(score)
                        bits.append(cost)
                    texts, total = [], 0
            results = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *results], names=[*[batch.schema.names[i] for i in keep], *RESULTS])

    return label


def _decide(parser: Parser, texts: list[tuple[np.ndarray, int, int]]) -> Iterator[tuple[str, float, float | None]]:
    if not parser.languages:
        yield from ((UNKNOWN, 0.0, None) for _ in texts)
        return
    costs = parser.phrases([codes for codes, _, _ in texts]) * np.array(parser.costs)[:, None]
    order = np.argsort(costs, axis=0, kind="stable")
    for i, (_, letters, chars) in enumerate(texts):
        if not letters:
            yield UNKNOWN, 0.0, None
            continue
        best = costs[order[0, i], i]
        score = 1.0 - best / costs[order[1, i], i] if len(order) > 1 else 1.0
        yield parser.languages[order[0, i]], float(min(1.0, max(0.0, score))), float(best / chars)


def identify(docs: DataFrame, training: dict[str, str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the predicted language, a score and bits per character.

    A narrow pass: nothing is shuffled, and the automata have the size of the sample.
    """
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    read = list(dict.fromkeys([*wanted, text]))
    shared = docs.sparkSession.sparkContext.broadcast(Parser(training))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in wanted]).schema)
    body = _label(shared, read.index(text), [read.index(c) for c in wanted])
    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(body, f"{fields}, lang_pred string, score double, bits_per_char double")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
