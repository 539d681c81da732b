"""Vectorised text work inside tasks: words, hashes of words, byte windows. Everything is linear in the text.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; their hashes mix their bytes in one after the other, eight at
a time, as sums of powers modulo 2**64 would be equal for some words of two letters, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Identity, and A-Z as a-z.
SAME = np.arange(256, dtype=np.uint8)
FOLDED = SAME.copy()
FOLDED[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def byte_table(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 4096)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.r_[U(1), np.full(size - 1, x & _MASK, U)], dtype=U)
                    for x in (BASE, pow(BASE, -1, 1 << 64))
                )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and len + 1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with up to limit bytes, or of one that has more."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (begin, end, starts, ends) cut between words; a word ends where its document does."""
    n, begin = len(raw), 0
    edges = np.unique(offsets)
    while begin < n:
        end = min(begin + SLICE, n)
        while end < n:  # back to the last cut in the slice, or on to the first one after it
            spaces = np.flatnonzero(SPACE[raw[begin:end]])
            k = np.searchsorted(edges, end, "right") - 1
            cut = max(begin + int(spaces[-1]) + 1 if len(spaces) else begin, int(edges[k]))
            if cut > begin:
                end = cut
                break
            end = min(end + SLICE, n)
        inside = ~SPACE[raw[begin:end]]
        at = edges[(edges > begin) & (edges < end)] - begin
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        first[at] |= inside[at]
        last[at - 1] |= inside[at - 1]
        yield begin, end, np.flatnonzero(first), np.flatnonzero(last) + 1
        begin = end


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``raw``, and the offsets of each document's words."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, _, s, e in word_bounds(raw, offsets):
        starts.append(s + begin)
        ends.append(e + begin)
    starts = np.concatenate(starts)
    return starts, np.concatenate(ends), np.searchsorted(starts, offsets)


#: Words of more bytes are hashed one by one.
EIGHTS = 8
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of words, their bytes mixed in eight at a time; no two words of one length up to eight bytes share one."""
    sizes = ends - starts
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mixed(sizes.astype(U) * U(0x9FB21C651E98DF25) + U(seed))
        live = np.flatnonzero(sizes <= 8 * EIGHTS)
        for k in range(EIGHTS):
            live = live[sizes[live] > 8 * k]
            if not len(live):
                break
            piece = eights[starts[live] + 8 * k] & _LOW[np.minimum(sizes[live] - 8 * k, 8)]
            h[live] = mixed(h[live] ^ piece) + U(k)
    for i in np.flatnonzero(sizes > 8 * EIGHTS):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return h


def placed_words(raw: np.ndarray, offsets: np.ndarray, fold: bool = False, seed: int = 1) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words in order, their starts and ends in ``raw``, and the offsets of each document's words."""
    table = FOLDED if fold else SAME
    hashes, starts, ends = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end, s, e in word_bounds(raw, offsets):
        hashes.append(word_keys(table[raw[begin:end]], s, e, seed))
        starts.append(s + begin)
        ends.append(e + begin)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offsets of each document's words in them."""
    hashes, _, _, bounds = placed_words(raw, offsets, fold, seed)
    return hashes, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and each document's offsets in them.

    A document of fewer words, but one at least, has the one shingle of all its words.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.r_[0, np.cumsum(made)]
    doc = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out[-1]) - out[doc] + bounds[doc]
    padded = np.r_[words, np.zeros(n, U)]
    h = np.zeros(len(at), U)
    for k in range(n):
        w = np.where(at + k < bounds[doc + 1], padded[at + k], U(0))
        h = (h + w) * U(0x9FB21C651E98DF25) ^ (h >> U(29))
    return mixed(h), out
