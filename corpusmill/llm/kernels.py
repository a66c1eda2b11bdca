"""NumPy kernels over batches of UTF-8 texts: word hashes, shingles, circulant signatures, fingerprints.

All hashes are 64-bit and depend on content alone, so any executor, run or batch gives the same values.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Base of the rolling polynomial; 5 modulo 8, so its powers have the largest period modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


LETTER = seeded(256, 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PLACE = seeded(64, 2) | U(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept per process."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, U(base))
            x[0] = U(1)
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = the polynomial hash of buf[i:j], times BASE**i."""
    up, _ = powers(len(buf))
    s = np.empty(len(buf) + 1, dtype=U)
    s[0] = 0
    np.cumsum(LETTER[buf] * up, out=s[1:])
    return s


def span_hashes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(s))
    return mix((s[ends] - s[starts]) * down[starts])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, a line feed after each, and where each begins (one more entry: the end)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return buf, at


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts in order, and the bounds of each text's words."""
    buf, at = joined(texts)
    buf = LOWER[buf]
    gap = SPACE[buf]
    before = np.empty_like(gap)
    before[:1] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    return span_hashes(prefix_sums(buf), starts, ends), np.searchsorted(starts, at)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the hashes of its runs of k words, in order; with fewer words, of the whole sequence; none without words."""
    h, bounds = words(texts)
    runs = h * PLACE[0]
    for j in range(1, min(k, len(h))):
        runs[: len(h) - j] += h[j:] * PLACE[j]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(runs[a : b - k + 1])
        elif b > a:
            out.append(mix((h[a:b] * PLACE[: b - a]).sum(dtype=U, keepdims=True) + PLACE[32 + b - a : 33 + b - a]))
        else:
            out.append(h[:0])
    return out


class Circulant:
    """C-MinHash: one permutation scatters the shingles over a circle, a second one, shifted by 0, 1, 2, ..., gives each coordinate."""

    def __init__(self, n_hashes: int, seed: int, bits: int = 20):
        self.n, self.bits, self.seed = n_hashes, bits, U(seed | 1)
        circle = np.random.Generator(np.random.PCG64(seed)).permutation(1 << bits).astype(np.int32)
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[:n_hashes]]), n_hashes)

    def signature(self, shingle_set: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = (mix(shingle_set * self.seed) >> U(64 - self.bits)).astype(np.int64)
        least = np.full(self.n, np.iinfo(np.int32).max, dtype=np.int32)
        for i in range(0, len(at), 1024):
            np.minimum(least, self.rows[at[i : i + 1024]].min(axis=0), out=least)
        return least


@lru_cache(maxsize=4)
def circulant(n_hashes: int, seed: int) -> Circulant:
    return Circulant(n_hashes, seed)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` consecutive coordinates; the band's number is part of it."""
    x = signature.astype(U).reshape(-1, rows)
    key = (x * PLACE[:rows]).sum(axis=1, dtype=U) + np.arange(1, len(x) + 1, dtype=U) * MIX1
    return mix(key).view(np.int64)


def set_hash(shingle_set: np.ndarray) -> int:
    """64 bits that stand for a sorted set."""
    x = mix(shingle_set + U(77)).sum(dtype=U, keepdims=True) * MIX2
    x = x + np.bitwise_xor.reduce(mix(shingle_set ^ MIX1), keepdims=True) + U(len(shingle_set))
    return int(mix(x).view(np.int64)[0])


def simhash(hashes: np.ndarray, words_: int = 2) -> bytes:
    """SimHash of 64 * words_ bits: each distinct hash votes on every bit with its count as weight; no hash at all: all bits 0."""
    if not len(hashes):
        return bytes(8 * words_)
    each, weight = np.unique(hashes, return_counts=True)
    votes = np.empty((len(each), words_), dtype=U)
    for j in range(words_):
        votes[:, j] = mix(each + PLACE[j + 8])
    bits = np.unpackbits(votes.view(np.uint8).reshape(len(each), 8 * words_), axis=1)
    if (weight == 1).all():
        up = bits.sum(axis=0, dtype=np.int64)
    else:
        up = weight @ bits
    return np.packbits(2 * up > weight.sum()).tobytes()
