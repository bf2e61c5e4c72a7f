"""Worker-side encoding with a bounded memory of units that are already encoded.

A unit is a stretch of text that the tokenizer treats alike wherever it stands. Texts repeat the same
units again and again, so each worker encodes a unit once with the library and joins the stored ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from vigil.llm.common import remembered

#: Units that a worker remembers. Bounds memory, never results.
MEMO_UNITS = 400_000
#: Longer units are forgotten after the call that met them.
MEMO_CHARS = 64

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

_loaded: dict = remembered({})


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok
    return _loaded[path]


# How the two kinds of tokenizer files normalise and split texts; splitting them here relies on it
WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


def require(path: str, kind: tuple) -> None:
    """Refuse a tokenizer file whose texts are not normalised and split as ``kind`` says: it would be encoded wrongly."""
    tok = tokenizer(path)
    found = tuple(None if x is None else json.loads(x.__getstate__()) for x in (tok.normalizer, tok.pre_tokenizer))
    if found != kind:
        raise ValueError(f"{path}: the normaliser or pre-tokenizer of this file is not known here: {found}")


def encode_plain(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids, one library call for all texts."""
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


class Memo(dict):
    """Unit -> what ``encode`` makes of it. A full memory starts anew: frequent units are soon back, and no entry is ever moved."""

    def __init__(self, encode, most: int | None = None):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, unit):
        got = self.encode(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= (self.most or MEMO_UNITS):
                self.clear()
            self[unit] = got
        return got


def memo(kind: str, path: str, make) -> Memo:
    """This worker's memory of one kind for one tokenizer file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = Memo(make(path))
    return _loaded[kind, path]


#: Letters outside ASCII that are composed, lower-case one by one, and are letters to every library.
LATIN = "À-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\n\x20-\x7e{LATIN}]*").fullmatch
#: The pre-token patterns of the two files, over the characters that PLAIN admits.
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+").findall
BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^\sA-Za-z0-9{LATIN}]+|\s+(?!\S)|\s+").findall


#: Kind of each byte of a plain text: white space, letter (all bytes beyond ASCII), digit, other.
SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[[10, 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
#: Characters of plain texts that are split and looked up together.
SLICE = 4 << 20
#: A blank between others is the start of a pre-token.
BETWEEN = re.compile(r"\S \S")


def byte_split_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of BYTE_SPLIT start in plain non-empty texts that lie side by side in ``raw`` (UTF-8 bytes), each up to one of ``ends``."""
    kind = KIND[raw]
    space, start = kind == SPACE, np.ones(len(raw), dtype=bool)
    # a run of one kind, with the blank before it; of white space, the last place goes to what follows
    start[1:] = np.where(space[1:], ~space[:-1], (kind[1:] != kind[:-1]) & (raw[:-1] != 32))
    ahead = np.zeros(len(raw), dtype=bool)
    ahead[:-1] = ~space[1:]
    ahead[ends - 1] = False
    start |= space & ahead
    start[ends[:-1]] = True
    # an apostrophe that starts a pre-token takes one of the endings with it
    at = np.flatnonzero(start & (raw == 39))
    stop = ends[np.searchsorted(ends, at, side="right")]
    padded = np.append(raw, np.zeros(2, dtype=np.uint8)).astype(np.int32)
    a, b = padded[at + 1], padded[at + 2]
    short = np.isin(a, list(b"stmd")) & (at + 1 < stop)
    long = np.isin(a << 8 | b, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & (at + 2 < stop)
    start[at[short | long] + 1] = False
    after = at + np.where(short, 2, 3)
    start[after[(short | long) & (after < stop)]] = True
    return np.flatnonzero(start)


def _pieces(text: str):
    """``text`` in pieces of about SLICE characters, cut between pre-tokens where there is such a place."""
    at = 0
    while len(text) - at > SLICE and (cut := BETWEEN.search(text, at + SLICE)):
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def _plain_group(path: str, pieces: list[bytes]) -> list[bytes]:
    """Ids of plain non-empty pieces: each distinct pre-token is looked up once, and its ids are copied to its places."""
    data = b"".join(pieces)
    ends = np.cumsum([len(x) for x in pieces])
    starts = byte_split_starts(np.frombuffer(data, np.uint8), ends)
    bounds = np.append(starts, len(data))
    offsets = bounds.astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    found = list(map(pretokens(path).__getitem__, coded.dictionary.to_pylist()))
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    index, first = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
    n = sizes[index]
    last = np.cumsum(n)
    ids = np.frombuffer(b"".join(found), "<u4")[np.arange(last[-1]) + np.repeat(first[index] - (last - n), n)].tobytes()
    cut = [0, *(4 * last[np.searchsorted(starts, ends) - 1]).tolist()]
    return [ids[a:b] for a, b in zip(cut, cut[1:])]


def plain_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of plain non-empty texts under a byte-level BPE, ``SLICE`` characters at a time."""
    out: list[list[bytes]] = [[] for _ in texts]
    owners, group, size = [], [], 0

    def flush():
        for i, ids in zip(owners, _plain_group(path, group) if group else [], strict=True):
            out[i].append(ids)
        owners.clear()
        group.clear()

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            owners.append(i)
            group.append(piece.encode())
            size += len(piece)
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return [b"".join(x) for x in out]


def _byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    names = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


BYTE_NAMES = _byte_names()


def model_encoder(path: str):
    """Function from a pre-token to its ids as bytes."""
    tokenize, blank, feed = tokenizer(path).model.tokenize, BYTE_NAMES[32], BYTE_NAMES[10]

    def encode(pretoken: str) -> bytes:
        if pretoken.isascii():
            named = pretoken.replace(" ", blank).replace("\n", feed)
        else:
            named = "".join([BYTE_NAMES[b] for b in pretoken.encode()])
        ids = array("I", [t.id for t in tokenize(named)])
        return ids.tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    return encode


def pretokens(path: str) -> Memo:
    return memo("pretoken", path, model_encoder)


def encode_units(path: str, split, units: list[str], specials: str = "<|") -> list[bytes]:
    """Ids of units: pre-tokens known or new to the model; a unit with other characters goes to the library."""
    get = pretokens(path).__getitem__
    ids, other = {}, []
    for u in units:
        if PLAIN(u) and specials not in u:
            ids[u] = b"".join(map(get, split(u)))
        else:
            other.append(u)
    ids.update(zip(other, encode_plain(path, other), strict=True))
    return [ids[u] for u in units]


#: A cut before a blank is a cut between pre-tokens unless blanks stand on both sides of that blank.
RUN = re.compile(r"\s \s")


def byte_level_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of whole texts under a byte-level BPE whose pre-tokens take one leading blank.

    Plain texts are split into pre-tokens here, many at a time. In others the pre-tokenizer still starts a new pre-token at
    a blank, except inside a run of white space; texts with such runs or with special-token strings go to
    the library whole.
    """
    split, whole, plain = {}, {}, {}
    units: set[str] = set()
    out = [b""] * len(texts)
    for i, t in enumerate(texts):
        if not t:
            continue
        if "<|" in t:
            whole[i] = t
        elif PLAIN(t):
            plain[i] = t
        elif t[0].isspace() or t[-1].isspace() or RUN.search(t):
            whole[i] = t
        else:
            first, *rest = t.split(" ")
            split[i] = parts = [first, *[" " + u for u in rest]]
            units.update(parts)
    for i, ids in zip(plain, plain_ids(path, list(plain.values())), strict=True):
        out[i] = ids
    if split:
        get = dict(zip(units, encode_units(path, BYTE_SPLIT, list(units)), strict=True)).__getitem__
        for i, parts in split.items():
            out[i] = b"".join(map(get, parts))
    if whole:
        for i, ids in zip(whole, encode_plain(path, list(whole.values())), strict=True):
            out[i] = ids
    return out
