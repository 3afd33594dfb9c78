"""Toxicity by compression distance: windows of a text compressed with two zstandard dictionaries.

Both dictionaries end in content that zstandard trains on ordinary labelled text. Before it the toxic one has
phrases of toxic text, the ordinary one phrases of ordinary text: words that one side uses in significantly
more contexts (pairs of neighbours, so that copies count once) than the other. Both parts are equally long,
so what ordinary text has in common costs the same with either. (Two dictionaries trained apart differ by
chance in far more than these phrases: they did not tell the given tables apart.) A window
that compresses shorter with the toxic dictionary speaks for toxicity: the margin of a text is the largest
saving of any of its windows, in bytes. How many phrases the dictionaries get, and the logistic curve from
margin to score, are chosen on labelled rows that the dictionaries have not seen.

Texts are lower-cased, runs of other characters than letters count as one space. Windows are ``WINDOW`` bytes
of UTF-8, ``STEP`` apart, over the whole text. Labelled rows are a bounded sample, the same at every size:
``TRAIN_ROWS`` of each label in the order of a hash, two thirds for the dictionaries (their first
``TRAIN_CHARS`` characters), one third, whole, for the curve.

A null or empty text has no window and margin 0; it gets the score of that margin. Rows without a label, or
whose label is null, teach nothing; several labels of one id count as toxic if one is; an id with several
texts teaches the smallest. Without labels every score is 0, with one label only it is that label's share,
smoothed. Repeated rows are scored one by one. Other columns are kept; ``margin``, ``score`` and
``predicted`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STEP = 64, 48
TRAIN_ROWS, TRAIN_CHARS = 1500, 16_384
COMMON_BYTES = 16_384
#: Phrases of at least this share of the strongest phrase's weight are taken; the curve's rows choose one.
SHARES = (0.5, 0.25, 0.1, 0.05, 0.02, 0.01)
#: Windows handed to the compressor at once.
BATCH_WINDOWS = 1 << 14
RESULTS = ["margin", "score", "predicted"]

_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """The two dictionaries, and the curve: score = 1 / (1 + exp(-(slope * margin + level)))."""

    ordinary: bytes
    toxic: bytes
    slope: float
    level: float

    def score(self, margin: float) -> float:
        x = self.slope * margin + self.level
        return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


def plain(text: str | None) -> bytes:
    return f" {_NO_LETTERS.sub(' ', (text or '').lower()).strip()} ".encode("utf-8", "replace")


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    """Matches of six bytes or more; no header fields, so that lengths differ by content alone."""
    parameters = zstd.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=14, search_log=3, min_match=6, target_length=64, strategy=zstd.STRATEGY_LAZY2,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def _windows(size: int) -> np.ndarray:
    """Starts and lengths of the windows of so many bytes: none of a text without letters."""
    if size <= 2:
        return np.zeros((0, 2), dtype=np.uint64)
    starts = np.arange(0, max(1, size - (WINDOW - STEP)), STEP)
    return np.stack([starts, np.minimum(WINDOW, size - starts)], 1).astype(np.uint64)


class Scales:
    """Both compressors of a task."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [_compressor(ordinary), _compressor(toxic)]

    def margins(self, texts: list[bytes]) -> list[int]:
        """Per text the most bytes that a window saves with the toxic dictionary; 0 without windows."""
        out = [0] * len(texts)
        spans = [_windows(len(t)) for t in texts]
        base = np.cumsum([0, *(len(t) for t in texts)])
        owners = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
        if not len(owners):
            return out
        each = np.concatenate(spans)
        each[:, 0] += base[:-1].astype(np.uint64)[owners]
        whole = b"".join(texts)
        best = np.full(len(texts), -WINDOW, dtype=np.int64)
        for at in range(0, len(each), BATCH_WINDOWS):
            part = each[at : at + BATCH_WINDOWS]
            low, high = int(part[0, 0]), int(part[-1, 0] + part[-1, 1])
            shifted = part - np.array([low, 0], dtype=np.uint64)
            ordinary, toxic = (self._lengths(c, whole[low:high], shifted) for c in self.pair)
            np.maximum.at(best, owners[at : at + BATCH_WINDOWS], ordinary - toxic)
        seen = np.unique(owners)
        for i in seen.tolist():
            out[i] = int(best[i])
        return out

    @staticmethod
    def _lengths(compressor: zstd.ZstdCompressor, data: bytes, spans: np.ndarray) -> np.ndarray:
        packed = compressor.multi_compress_to_buffer(zstd.BufferWithSegments(data, np.ascontiguousarray(spans).tobytes()))
        return np.fromiter((len(x) for x in packed), dtype=np.int64, count=len(packed))


def contexts(texts: list[bytes]) -> Counter:
    """Words by the number of different pairs of neighbours they have."""
    seen = set()
    for text in texts:
        words = [b"", *text.split(), b""]
        seen.update(zip(words[1:-1], words[:-2], words[2:]))
    return Counter(w for w, _, _ in seen)


def phrases(own: Counter, other: Counter) -> list[tuple[float, bytes]]:
    """Words of one side that it uses more than twice as often, by their log-likelihood ratio, strongest first."""
    n_own, n_other, out = max(1, sum(own.values())), max(1, sum(other.values())), []
    for word, k in own.items():
        o = other[word]
        if k >= 3 and len(word) <= WINDOW - STEP and k * n_other > 2 * o * n_own:
            both = (k + o) / (n_own + n_other)
            out.append((2 * (k * math.log(k / (both * n_own)) + (o * math.log(o / (both * n_other)) if o else 0.0)), word))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _trained(texts: list[bytes]) -> bytes:
    """Content of a dictionary trained on windows of the texts; the texts themselves where they are too few to train on."""
    pieces = [t[int(a) : int(a + n)] for t in texts for a, n in _windows(len(t))]
    try:
        return zstd.train_dictionary(COMMON_BYTES, pieces, k=200, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(texts)[:COMMON_BYTES]


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> list[tuple[bytes, bytes]]:
    """For each of ``SHARES`` the ordinary and the toxic dictionary: phrases of the side, then the common content."""
    common = _trained(ordinary)
    plain_words, toxic_words = contexts(ordinary), contexts(toxic)
    sides = [phrases(plain_words, toxic_words), phrases(toxic_words, plain_words)]
    top = sides[1][0][0] if sides[1] else 0.0
    out = []
    for share in SHARES:
        # The strongest phrases stand last, nearest to the window; both parts are padded to one length.
        parts = [b"".join(b" " + w + b" " for weight, w in reversed(side) if weight >= share * top)[-COMMON_BYTES:] for side in sides]
        size = max(len(p) for p in parts)
        out.append(tuple(p.rjust(size, b"\0") + common for p in parts))
    return out


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and mean loss of the logistic curve, by Newton steps with a small penalty on the slope."""
    x, y = np.stack([margins, np.ones(len(margins))], 1), labels.astype(float)
    beta, penalty = np.zeros(2), np.diag([0.05, 1e-6])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(np.logaddexp(0, z) - y * z) + b @ penalty @ b / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(0.0, float(beta[0]))
    return slope, float(beta[1]), loss(beta) / max(1, len(y))


def _labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Text, label and part (0 to 2) of at most about ``rows`` labelled documents of each label, and how many there are."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r.y: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect() if r.y in (0, 1)}
    order = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(13)), F.lit(1 << 32))
    limit = F.lit(0.0)
    for y, n in sizes.items():
        limit = F.when(F.col("y") == y, F.lit(min(1.0, rows / n) * float(1 << 32))).otherwise(limit)
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(14)), F.lit(3))
    # The picked ids are few by construction: about ``rows`` of each of two labels.
    picked = F.broadcast(known.filter(order < limit).select(F.col(key).alias("_id"), "y", part.alias("part")))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("t")).join(picked, "_id")
    return texts.groupBy("_id").agg(F.min("t").alias("t"), F.first("y").alias("y"), F.first("part").alias("part")), sizes


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
    train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS,
) -> Model:
    """Dictionaries and curve from the labelled ones of ``docs``; hand in only the rows that may be learned from."""
    rows, sizes = _labelled(docs, labels, text, key, label, train_rows)
    if len(sizes) < 2:
        n, ones = sum(sizes.values()), sizes.get(1, 0)
        return Model(b"", b"", 0.0, math.log((ones + 0.5) / (n - ones + 0.5)) if n else -1000.0)
    shown = rows.filter("part < 2").select("_id", "y", F.substring("t", 1, train_chars).alias("t")).collect()
    sides = [[plain(r.t) for r in sorted(shown, key=lambda r: r["_id"]) if r.y == y] for y in (0, 1)]
    pairs = dictionaries(*sides)
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    found = rows.filter("part = 2").select("y", "t").mapInArrow(_all_margins(shared), "y int, m array<int>").collect()
    y = np.array([r.y for r in found])
    best = None
    for k, (ordinary, toxic) in enumerate(pairs):
        slope, level, loss = curve(np.array([r.m[k] for r in found], dtype=float), y)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, Model(ordinary, toxic, slope, level))
    return best[1]


def _all_margins(shared) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = [Scales(*pair) for pair in shared.value]
        for batch in batches:
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            each = [s.margins(texts) for s in scales]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(zip(*each)), pa.list_(pa.int32()))], names=["y", "m"])

    return measure


def _scored(shared, at: int, keep: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scales = Scales(model.ordinary, model.toxic) if model.toxic else None
        for batch in batches:
            margins, held, size = [], [], 0
            for j in range(batch.num_rows):
                held.append(plain(batch.column(at)[j].as_py()))
                size += len(held[-1])
                if size >= BATCH_WINDOWS * STEP or j == batch.num_rows - 1:
                    margins += scales.margins(held) if scales else [0] * len(held)
                    held, size = [], 0
            scores = [model.score(m) for m in margins]
            results = [pa.array(margins, pa.int32()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *results], names=[*[batch.schema.names[i] for i in keep], *RESULTS])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with margin, score and prediction: a narrow pass over whole texts."""
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    read = list(dict.fromkeys([*wanted, text]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in wanted]).schema]
    schema = ", ".join([*fields, "margin int, score double, predicted int"])
    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(_scored(shared, read.index(text), [read.index(c) for c in wanted]), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
