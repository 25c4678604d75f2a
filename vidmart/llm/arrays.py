"""Array kernels over the bytes of many texts at a time: hashes of spans, words, sliding minima."""

from __future__ import annotations

import numpy as np

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
#: Hashes are polynomials over the field of 2**61 - 1 elements at a fixed random place: two
#: different strings of n symbols have the same one with a chance of n / 2**61, whatever they are.
PRIME, _BITS = U((1 << 61) - 1), U(61)
_BASE = 0x13C6EF372FE94F83
_LOW = U((1 << 30) - 1)
#: So many symbols are summed up before the sums are reduced, and so many numbers handled at a time.
_CHUNK, _BLOCK = 1 << 20, 1 << 15
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit integer modulo the prime."""
    x = (x & PRIME) + (x >> _BITS)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime of numbers below it."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & _LOW) << U(31)) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, at least n of each."""
    while len(_powers["up"]) < n:
        size = len(_powers["up"])
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, int(PRIME)))):
            step = np.full(1, pow(base, size, int(PRIME)), U)
            _powers[name] = np.concatenate([_powers[name], times(_powers[name], step)])
    return _powers["up"], _powers["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of 64-bit values, as sums of high and low halves; span() reads it."""
    out = np.empty((2, len(values) + 1), U)
    out[:, 0] = 0
    up = powers(len(values) + 1)[0]
    for at in range(0, len(values), _BLOCK):
        terms = times(reduced(values[at:at + _BLOCK]), up[at:at + _BLOCK][:len(values) - at])
        for half, part in enumerate((terms >> U(30), terms & _LOW)):
            part[0] += out[half, at]
            np.cumsum(part, out=out[half, at + 1:at + 1 + len(part)])
    return out


def byte_prefix(raw: np.ndarray) -> np.ndarray:
    """The same of bytes, whose products need no reduction."""
    out = np.empty((2, len(raw) + 1), U)
    out[:, 0] = 0
    up = powers(len(raw) + 1)[0]
    for at in range(0, len(raw), _BLOCK):
        value = raw[at:at + _BLOCK].astype(U)
        power = up[at:at + len(value)]
        for half, part in enumerate((power >> U(30), power & _LOW)):
            part *= value
            part[0] += out[half, at]
            np.cumsum(part, out=out[half, at + 1:at + 1 + len(value)])
    return out


def span(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of values[lo:hi], the same wherever they stand."""
    out = np.empty(len(lo), U)
    down = powers(hashes.shape[1])[1]
    for at in range(0, len(lo), _BLOCK):
        a, b = lo[at:at + _BLOCK], hi[at:at + _BLOCK]
        size = b - a
        total = np.zeros(len(a), U)
        for begin in range(0, int(size.max()), _CHUNK):
            c, d = np.minimum(a + begin, b), np.minimum(a + begin + _CHUNK, b)
            high, low = hashes[0][d] - hashes[0][c], hashes[1][d] - hashes[1][c]
            # high is below 2**60 here; times 2**30 it goes round at 61 bits
            sums = total + ((high & U((1 << 31) - 1)) << U(30)) + (high >> U(31)) + low
            total = (sums & PRIME) + (sums >> _BITS)
        out[at:at + _BLOCK] = mix(times(total, down[a]) + size.astype(U) * U(0xD6E8FEB86659FD93))
    return out


def gram_hashes(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A quick hash of the ``size`` bytes (a multiple of 8) from each place; not one to settle equality by."""
    words = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw.tobytes(), strides=(1,))
    out = np.full(len(at), size, U)
    for i in range(0, size, 8):
        word = words[at + i]
        out += (word ^ (word >> U(32))) * U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    return mix(out)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word [^ \\t-\\r]+ of the texts raw[offsets[i]:offsets[i+1]]."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.ones(len(raw) + 1, bool)
    inside[:-1] = ~IS_SPACE[raw]
    inside[-1] = False
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a text's first byte starts a word of its own
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | np.concatenate([edge[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, text = word_spans(raw, offsets)
    return span(byte_prefix(raw), starts, ends), text, starts, ends


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint ones, in order (touching ones join)."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return lo[new], reach[last]


def runs(values: np.ndarray) -> np.ndarray:
    """Start of each maximal run of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
