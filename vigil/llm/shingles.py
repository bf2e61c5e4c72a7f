"""Word shingles of whole texts as sets of 64-bit hashes, and MinHash signatures over them."""

from __future__ import annotations

import numpy as np
import xxhash

from vigil.llm.common import remembered

#: Signature: BANDS bands of ROWS values, or more values for other bands.
BANDS, ROWS = 24, 6
HASHES = BANDS * ROWS
MOST_HASHES = 160
WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Word -> 64-bit hash, with a bound on what is remembered."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = h
        return h


_words = remembered(WordHash())
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_more = _rng.integers(0, 1 << 32, (2, MOST_HASHES - HASHES), dtype=np.uint64)
_A = np.concatenate((_A, (_more[0] | np.uint64(1)).astype(np.uint32)))
_B = np.concatenate((_B, _more[1].astype(np.uint32)))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of characters other than the six ASCII white spaces."""
    if text is None:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.lower().split()


def shingle_set(text: str | bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``k`` words make one shingle, none an empty set."""
    ws = words(text)
    n = len(ws)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), dtype=np.uint64, count=n)
    if n < k:
        one = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in h:
                one = one * _P + x
        return mix(np.array([one], dtype=np.uint64))
    s = h[: n - k + 1].copy()
    for j in range(1, k):
        s *= _P
        s += h[j : n - k + 1 + j]
    return np.unique(mix(s))


def signature(shingles: np.ndarray, step: int = 8192, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` values of 16 bits. Chance agreements (1 in 65536) only ever keep a pair longer."""
    low = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for at in range(0, len(x), step):
        h = np.multiply.outer(_A[:hashes], x[at : at + step])
        h += _B[:hashes, None]
        np.minimum(low, h.min(axis=1), out=low)
    return ((low * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2")
