"""MinHash signatures of character shingles, computed for batches of texts in tasks; rows and shuffles are Spark's.

A worker hashes the distinct shingles that it doesn't know many at a time, and remembers the values of those that come often, so a text
costs a look-up and a minimum for each of its distinct shingles. Whatever is remembered or held at a time is bounded, for texts of any length.
"""

from __future__ import annotations

from hashlib import md5
from itertools import repeat
from math import sin

import numpy as np
import pyarrow as pa

#: Shingles that a worker remembers (8 bytes for each salt), places that are hashed together, shingles whose values are gathered together, shingles that are hashed together.
REMEMBERED, PLACES, GATHERED, HASHED = 400_000, 1 << 18, 1 << 12, 1 << 9
#: Texts of a batch that are Python's at a time.
TEXTS = 1_000
#: MD5 (RFC 1321): first state, constants of the steps, rotations of each round, and where each round takes its words from.
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
WORDS = [(1, 0), (5, 1), (3, 5), (7, 0)]
#: Bytes that one block of a message has room for.
BLOCK = 55


def md5_start(words: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    """(message, 2): the first eight bytes of the MD5 of many messages of one block, as two words in memory order.

    ``words`` are the first words of the padded messages, the others are 0; ``bits`` the messages' lengths.
    """
    u = np.uint32
    a, b, c, d = (np.full(len(bits), x, dtype=u) for x in START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        x, y, z = [(c, d, b), (b, c, d), (b, c, d), (d, b, c)][kind]
        if kind < 2:  # a choice by the last of the three
            np.bitwise_xor(x, y, out=f)
            np.bitwise_and(f, z, out=f)
            np.bitwise_xor(f, y, out=f)
        elif kind == 2:
            np.bitwise_xor(x, y, out=f)
            np.bitwise_xor(f, z, out=f)
        else:
            np.invert(x, out=f)
            np.bitwise_or(f, y, out=f)
            np.bitwise_xor(f, z, out=f)
        np.add(f, a, out=f)
        np.add(f, u(SINES[i]), out=f)
        w = (WORDS[kind][0] * i + WORDS[kind][1]) % 16
        if w < len(words):
            np.add(f, words[w], out=f)
        elif w == 14:
            np.add(f, bits, out=f)
        turn = TURNS[kind][i % 4]
        np.left_shift(f, u(turn), out=t)
        np.right_shift(f, u(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return np.stack([a + u(START[0]), b + u(START[1])], axis=-1)


def hashed(raw: list[bytes], salts: list[bytes]) -> np.ndarray:
    """(text, salt): the first 60 bits of the MD5 of salt and text."""
    out = np.empty((len(raw), len(salts)), dtype=np.int64)
    sizes, longest = np.array([len(r) for r in raw]), max(map(len, salts))
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        for at in range(0, len(mine), HASHED):
            some = mine[at : at + HASHED]
            if longest + size > BLOCK:
                for i in some.tolist():
                    first = b"".join([md5(salt + raw[i]).digest()[:8] for salt in salts])
                    out[i] = np.frombuffer(first, ">u8") >> 4
                continue
            text = np.frombuffer(b"".join([raw[i] for i in some.tolist()]), np.uint8).reshape(len(some), size)
            message = np.zeros((len(salts), len(some), -(-(longest + size + 1) // 4) * 4), dtype=np.uint8)
            for k, salt in enumerate(salts):
                message[k, :, : len(salt)] = np.frombuffer(salt, np.uint8)
                message[k, :, len(salt) : len(salt) + size] = text
                message[k, :, len(salt) + size] = 0x80
            words = message.reshape(-1, message.shape[2]).view("<u4")
            bits = np.repeat(np.array([8 * (len(salt) + size) for salt in salts], dtype=np.uint32), len(some))
            first = md5_start([np.ascontiguousarray(w) for w in words.T[:14]], bits).astype("<u4").view(">u8")
            out[some] = (first >> 4).reshape(len(salts), len(some)).T
    return out


class Memory:
    """Rows of hash values by shingle."""

    def __init__(self, hashes: int, most: int = REMEMBERED):
        self.salts, self.most = [f"{i}:".encode() for i in range(hashes)], most
        self.clear()

    def clear(self) -> None:
        self.row, self.values, self.uses = {}, np.empty((1_024, len(self.salts)), dtype=np.int64), np.zeros(1_024, dtype=np.int64)

    def forget(self) -> None:
        """Keep the half that was asked for most often, and count it half."""
        n = len(self.row)
        kept = np.sort(np.argpartition(-self.uses[:n], n // 2)[: n // 2])
        names = list(self.row)  # in order of their rows
        self.row = {names[i]: at for at, i in enumerate(kept.tolist())}
        self.values[: len(kept)], self.uses[: len(kept)] = self.values[kept], self.uses[kept] // 2

    def rows(self, shingles: list[str]) -> np.ndarray:
        """Places of the distinct ``shingles`` in ``values``. A full memory forgets, all if half is not enough."""
        at = self.known(shingles)
        for less in (self.forget, self.clear):
            if len(self.row) + np.count_nonzero(at < 0) > self.most and self.row:
                less()
                at = self.known(shingles)
        fresh = np.flatnonzero(at < 0)
        n, end = len(self.row), len(self.row) + len(fresh)
        if end > len(self.values):
            size = max(min(2 * len(self.values), self.most), end)
            values, uses = np.empty((size, len(self.salts)), dtype=np.int64), np.zeros(size, dtype=np.int64)
            values[:n], uses[:n] = self.values[:n], self.uses[:n]
            self.values, self.uses = values, uses
        if len(fresh):
            new = [shingles[i] for i in fresh.tolist()]
            self.values[n:end] = hashed([s.encode() for s in new], self.salts)
            self.uses[n:end] = 0
            self.row.update(zip(new, range(n, end), strict=True))
            at[fresh] = np.arange(n, end)
        self.uses[at] += 1
        return at

    def known(self, shingles: list[str]) -> np.ndarray:
        """Places of ``shingles``, -1 for what is not remembered."""
        return np.fromiter(map(self.row.get, shingles, repeat(-1)), dtype=np.int64, count=len(shingles))


_memories: dict[tuple[int, int], Memory] = {}


def memory_of(hashes: int, most: int) -> Memory:
    """The worker's own memory, which outlives a task."""
    if (hashes, most) not in _memories:
        _memories[hashes, most] = Memory(hashes, most)
    return _memories[hashes, most]


def distinct(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct number, which of them stands at each place) of numbers below ``most``."""
    bits = len(key).bit_length()
    if most << bits >= 1 << 63:
        return np.unique(key, return_index=True, return_inverse=True)[1:]
    both = np.sort(key << bits | np.arange(len(key)))
    at, value = both & ((1 << bits) - 1), both >> bits
    new = np.concatenate((np.ones(min(1, len(key)), dtype=bool), value[1:] != value[:-1]))
    which = np.empty(len(key), dtype=np.int64)
    which[at] = np.cumsum(new) - 1
    return at[new], which


def grams(code: np.ndarray, size: int, k: int) -> tuple[np.ndarray, int]:
    """(a number for each run of ``k`` of the codes (below ``size``): equal numbers for equal runs; what they are below)."""
    n = len(code) - k + 1
    key, most = code[:n], size
    for i in range(1, k):
        if most * size >= 1 << 63:
            first, key = distinct(key, most)
            most = len(first)
        key, most = key * size + code[i : i + n], most * size
    return key, most


def signatures(texts: list[str | None], k: int, memory: Memory) -> np.ndarray:
    """(text, salt): least values over the shingles of each text, which is one shingle itself if it is shorter; zeros for none."""
    out = np.full((len(texts), len(memory.salts)), np.iinfo(np.int64).max)
    short = [i for i, t in enumerate(texts) if t and len(t) < k]
    for at in range(0, len(short), PLACES):
        some = short[at : at + PLACES]
        each = {texts[i]: None for i in some}
        row = dict(zip(each, memory.rows(list(each)), strict=True))
        out[some] = memory.values[[row[texts[i]] for i in some]]
    long = [i for i, t in enumerate(texts) if t and len(t) >= k]
    whole = "".join(texts[i] for i in long)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    sizes = np.array([len(texts[i]) for i in long], dtype=np.int64)
    ends, names = np.cumsum(sizes), np.array(long, dtype=np.int64)
    gathered = np.empty((GATHERED, len(memory.salts)), dtype=np.int64)
    for at in range(0, len(points), PLACES):
        part = points[at : at + PLACES + k - 1]
        if len(part) < k:
            break
        used = np.zeros(int(part.max()) + 1, dtype=bool)
        used[part] = True
        code = (np.cumsum(used) - 1)[part]
        key, most = grams(code, int(used.sum()), k)
        place = np.arange(at, at + len(key))
        of = np.searchsorted(ends, place, side="right")
        inside = place + k <= ends[of]
        place, of = place[inside], of[inside]
        if not len(of):
            continue
        first, which = distinct(key[inside], most)
        rows = memory.rows([whole[p : p + k] for p in place[first].tolist()])
        pair = np.sort((of - of[0]) * len(first) + which)  # a text and one of its shingles, each once
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
        of, rows = pair // len(first) + of[0], rows[pair % len(first)]
        for s in range(0, len(rows), GATHERED):
            mine = of[s : s + GATHERED]
            starts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            values = np.take(memory.values, rows[s : s + GATHERED], axis=0, out=gathered[: len(mine)], mode="clip")
            least = np.minimum.reduceat(values, starts, axis=0)
            docs = names[mine[starts]]
            out[docs] = np.minimum(out[docs], least)
    out[[i for i, t in enumerate(texts) if not t]] = 0
    return out


def signed(k: int, hashes: int, most: int = REMEMBERED):
    """Worker function over batches of (id, low): id, sig."""

    def run(batches):
        memory = memory_of(hashes, most)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                sigs = signatures(batch.column("low").to_pylist(), k, memory)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * hashes), pa.array(sigs.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), sig], ["id", "sig"])

    return run
