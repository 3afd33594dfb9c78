"""Plain versions of the operators, quadratic where they like, to test against."""

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def seen_before(rows, split, width):
    """doc_id to (units, covered positions): windows that start in a document of a smaller id."""
    first = {}
    units = [(i, split(t or "")) for i, t in rows]
    for i, u in units:
        for j in range(len(u) - width + 1):
            w = tuple(u[j : j + width])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, u in units:
        gone = set()
        for j in range(len(u) - width + 1):
            if first[tuple(u[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, u, gone))
    return out


def byte_dedup(rows, width=50):
    out = []
    for i, u, gone in seen_before(rows, lambda t: list(t.encode()), width):
        spans = sum(1 for j in gone if j - 1 not in gone)
        kept = bytes(b for j, b in enumerate(u) if j not in gone)
        out.append((i, len(u), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def word_dedup(rows, width=13):
    out = []
    for i, u, gone in seen_before(rows, SPACED.findall, width):
        kept = " ".join(w for j, w in enumerate(u) if j not in gone)
        out.append((i, len(u), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shingles(text, n=3):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(rows, percent=90, n=3):
    sets = [(i, shingles(t, n)) for i, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def hits(text, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    w, gone, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        for j in range(len(b) - n + 1 if b else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == b[j : j + n]:
                    gone.update(range(k, k + n))
                    found.add(str(item))
    return len(w), len(gone), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(gone)


SECRETS = {
    "assign": (re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def secrets(text):
    spans = []
    for rank, (kind, (pattern, good)) in enumerate(SECRETS.items()):
        spans += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if good(m)]
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    counts = [sum(1 for s in spans if s[2] == k) for k in SECRETS]
    return (*counts, hashlib.sha256(listed.encode()).hexdigest())


def mixed(tokens, entropy=None, repetitions=None):
    """Exponent by plain bisection."""
    import math

    total = sum(tokens)
    p = [t / total for t in tokens]

    def entropy_at(e):
        z = [x**e for x in p]
        s = sum(z)
        return -sum(v / s * math.log(v / s) for v in z)

    def most(e):
        z = [x**e for x in p]
        return max(v / sum(z) / x for v, x in zip(z, p))

    def bisect(high, met):
        if met(0.0):
            return 0.0
        low = 0.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if met(mid) else (mid, high)
        return high

    out = []
    if entropy is not None:
        out.append(bisect(8.0, lambda e: entropy_at(e) <= entropy))
    if repetitions is not None:
        out.append(bisect(1.0, lambda e: most(e) <= repetitions))
    return max(out)
