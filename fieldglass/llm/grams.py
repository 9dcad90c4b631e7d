"""Words, n-grams and context-chosen anchors of many texts at once, in numpy.

Words are the runs of bytes other than space and 0x09-0x0D, which is how ``bytes.split()`` and the
pattern ``[^\\x20\\x09-\\x0D]+`` cut a text.  Hashes are two polynomials modulo the prime 2**31 - 1, with bases
of their own, over random values of the bytes, passed together through a 64-bit finaliser.  (Modulo a
power of two, strings such as Thue and Morse's collide under every base.)  All of it is a fixed
rule, so any task on any machine, and any retry, computes the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
HIGH = U(0xFFFFFFFF00000000)
LOW = U(0x00000000FFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(BASE))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

P, HALF = U((1 << 31) - 1), U(31)
#: Bases of the two polynomials.
BASES = (1_105_250_839, 1_836_311_903)
LENGTH = U(0xD6E8FEB86659FD93)

_powers = [np.ones(1, np.uint32) for _ in range(4)]


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo P, not fully: below 2**33 of any x, below 2**32 of a product of two."""
    return (x & P) + (x >> HALF)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = folded(folded(x))
    return np.where(x >= P, x - P, x)


def powers(n: int) -> list[np.ndarray]:
    """For i < n at least, each base to the i, then the inverse of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((*BASES, *(pow(b, -1, int(P)) for b in BASES))):
            x, have = np.empty(n, np.uint32), 1
            x[0] = 1
            while have < n:
                more = min(have, n - have)
                x[have : have + more] = reduced(x[:more].astype(U) * U(pow(base, have, int(P))))
                have += more
            _powers[k] = x
    return _powers


def sums(values: np.ndarray) -> np.ndarray:
    """For both polynomials, prefix sums from 0; the first takes the low 31 bits of the values, the second the next."""
    out, n = np.zeros((2, len(values) + 1), U), len(values)
    for k in range(2):
        own = values & P if k == 0 else (values >> HALF) & P
        np.cumsum(folded(own * powers(n)[k][:n]), out=out[k, 1:])
    return out


def settled(between: list[np.ndarray], inverse: list[np.ndarray], length) -> np.ndarray:
    """The hash of a span from its two sums, the inverses of the powers where it starts, and its length."""
    low, high = (reduced(folded(folded(b)) * i) for b, i in zip(between, inverse))
    return mix((low | (high << U(32))) + length * LENGTH)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    if not len(start):
        return np.zeros(0, U)
    inverse = powers(prefix.shape[1])[2:]
    return settled([x[end] - x[start] for x in prefix], [x[start] for x in inverse], (end - start).astype(U))


def run_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = prefix.shape[1] - k
    if n <= 0:
        return np.zeros(0, U)
    inverse = powers(prefix.shape[1])[2:]
    return settled([x[k:] - x[:-k] for x in prefix], [x[:n] for x in inverse], np.array([k], U))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, limit: int):
    """Ranges of whole texts of about limit bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = w & cut[:-1]
    starts[1:] |= w[1:] & ~w[:-1]
    ends = w & cut[1:]
    ends[:-1] |= w[:-1] & ~w[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(sums(BYTES[data]), starts, ends)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; those that cross texts are for the caller to leave out."""
    return run_hashes(sums(values), k)


def window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive keys, in two passes."""
    n = len(keys)
    if n < w:
        return np.zeros(0, U)
    full = np.full(-(-n // w) * w, ~U(0), U)
    full[:n] = keys
    full = full.reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(grams: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor is the least of its grams, the leftmost of equals.  Windows that follow
    each other and share an anchor are a region; returns each region's anchor, first and last window.
    Equal windows have the same anchor at the same place, whatever surrounds them."""
    n, none = int(bounds[-1]), np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    keys = (grams[: n - gram + 1] & HIGH) | np.arange(n - gram + 1, dtype=U)
    least = window_min(keys, window - gram + 1)
    first, last = bounds[:-1], bounds[1:] - window + 1
    long = last > first
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first[long], 1)
    np.add.at(edge, last[long], -1)
    s = np.flatnonzero(np.cumsum(edge)[: len(least)])
    if not len(s):
        return none, none, none
    p = (least[s] & LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
    return p[new], s[new], s[np.r_[new[1:] - 1, len(s) - 1]]


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the ascending table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: each element's run, and its place there."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows, put together where they touch."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)])
    return doc[new], first[new], np.maximum.reduceat(last, new)
