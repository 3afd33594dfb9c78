"""Hashes of words and byte windows over many texts at once, with numpy inside a task."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse for i below at least n; tables grow by doubling."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, ODD), np.full(size, ODD_INVERSE)
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[size]


def joined(texts: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte array of all texts with ``gap`` after each, and where each text starts and ends."""
    buf = np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + len(gap)) - len(gap)
    return buf, ends - lengths, ends


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not white space."""
    solid = np.zeros(len(buf) + 2, dtype=np.int8)
    solid[1:-1] = ~SPACES[buf]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from running sums."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbours in a row; entry i covers i to i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * ODD + hashes[j : j + n]
    return mix(out)


def byte_grams16(buf: np.ndarray) -> np.ndarray:
    """Hashes of 16 bytes in a row; entry i covers i to i+15."""
    n = len(buf) - 15
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    eights = np.ndarray((n + 8,), dtype="<u8", buffer=buf.tobytes(), strides=(1,)).copy()
    return mix(eights[:n] * ODD + (eights[8:] ^ (eights[8:] >> np.uint64(29))) * ODD_INVERSE)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours; entry i covers i to i+width-1."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:n], low[rest : rest + n])


def pieces(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``limit``; a larger one stands alone."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            out.append((start, i))
            start, total = i, 0
        total += size
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
