"""Plain versions of the operators that SQL cannot express."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACES = b" \t\n\r\x0b\x0c"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def fold(word: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def substrings(rows: list[tuple], length: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking at every string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                covered[p : p + length] = b"\1" * length
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by looking at every place, leftmost first for each kind; then by start, then by kind as listed."""
    text, out = text or "", []
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = set(letters + letters.lower() + "0123456789+/_.=-")

    def run(p: int, allowed) -> int:
        while p < len(text) and text[p] in allowed:
            p += 1
        return p

    def assigned(p: int) -> tuple[int, int] | None:
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(word, p):
                q = p + len(word)
                for quoted in (True, False):
                    at = q + 1 if quoted and text[q : q + 1] in ("\"", "'") and q < len(text) else None if quoted else q
                    if at is None:
                        continue
                    at = run(at, " ")
                    if text[at : at + 1] not in (":", "=") or at >= len(text):
                        continue
                    at = run(at + 1, " ")
                    if text[at : at + 1] in ("\"", "'") and at < len(text):
                        at += 1
                    if (end := run(at, value)) > at:
                        return at, end
        return None

    p = 0
    while p < len(text):
        if found := assigned(p):
            if found[1] - found[0] >= 8:
                out.append((p, 0, found[1]))
            p = found[1]
        else:
            p += 1
    for kind, head, allowed, least in ((1, "AKIA", set(letters + "0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        p = 0
        while p < len(text):
            end = run(p + len(head), allowed) if text.startswith(head, p) else p
            if end > p + len(head):
                if end - p >= least:
                    out.append((p, kind, end))
                p = end
            else:
                p += 1
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def passages(rows: list[tuple], length: int = 51) -> list[tuple]:
    """(doc_id, words in strings of ``length`` words that also start elsewhere)."""
    data = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[p : p + length]) for _, w in data for p in range(len(w) - length + 1))
    out = []
    for i, w in data:
        covered = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                covered[p : p + length] = [True] * length
        out.append((i, sum(covered)))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_duplicates(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, n_links) by comparing all pairs; rows are numbered, as ids may repeat."""
    sets = [shingles(t) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
        for x in s:
            by[x].append(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (1, 0)), (0, 0) if d is None else (1, d)) if r in least else ((0, 0) if d is None else (1, d))
    return [(d, None if least[find(i)][0] == 0 else least[find(i)][1], links[i]) for i, (d, _) in enumerate(rows)]


def base_scores(rows: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = lambda t: [fold(w) for w in words(t)] + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    score = lambda x: math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
    return [
        (d, held(d), len(tokens(t)), sum(x in c for x in tokens(t)), n, sum(map(score, tokens(t)))) for d, t in rows
    ]


_PUNCTUATION = bytes(32 if 33 <= c < 127 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def leaks(rows: list[tuple], items: list[tuple], least: float = 0.5) -> dict:
    """{(doc_id, item_id): score} by scoring every item against every passage."""
    split = lambda t: (t or "").encode().translate(_PUNCTUATION).split()
    tokens = [split(t) for _, t in items]
    df = Counter(x for w in tokens for x in set(w))
    n, mean, step = len(items), sum(map(len, tokens)) / max(len(items), 1), max([1, *map(len, tokens)])
    impact = []
    for w in tokens:
        one = {
            x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
            for x, f in Counter(w).items()
        }
        impact.append({x: s / sum(one.values()) for x, s in one.items()})
    out: dict = {}
    for d, text in rows:
        doc = split(text)
        for k, (item, told) in enumerate(items):
            w = tokens[k]
            best = max(
                [sum(s for x, s in impact[k].items() if x in set(doc[a : a + 2 * step])) for a in range(0, max(len(doc), 1), step)]
            )
            if not w or best < least:
                continue
            size = min(5, len(w))
            runs = {tuple(doc[a : a + size]) for a in range(len(doc) - size + 1)}
            covered = [False] * len(w)
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in runs:
                    covered[a : a + size] = [True] * size
            ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", told.strip())]
            q = len(split(told.strip()[: ends[-1]])) if ends else 0
            share = lambda c: sum(c) / len(c) if c else sum(covered) / len(covered)
            if share(covered[:q]) >= 0.5 and share(covered[q:]) >= 0.5:
                out[d, item] = best
    return out


def planted_words(doc_id: int | None, text: str | None) -> list[bytes]:
    w = words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_runs(w: list, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) by looking at every period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            smaller = any(all(stretch[k] == stretch[k + r] for k in range(len(stretch) - r)) for r in range(1, q))
            if len(stretch) >= max(least, 4 * q) and not smaller:
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def op13_row(doc_id: int | None, text: str | None) -> tuple:
    w = planted_words(doc_id, text)
    runs = periodic_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest(told.encode()), digest(kept))
