"""Operator 11: alignment of two tokenizers' tokens, with pair counts of the whole corpus by a postings cogroup.

Tasks encode blocks of whole texts with both tokenizers and mark in one array of byte positions where tokens of either
end: between two marks lie bytes of one token of each side, so the marks are the links, and marks of both sides
the groups. Each block leaves, for every id of side B, its postings (id of A, document, multiplicity) as one packed row,
its pair counts, and one row of figures for every document.

Postings are shuffled by the id of B and sorted, pair counts before postings. A task reads the counts of one id, knows its
highest, and lets the postings stream past: each adds to its document's sums, which leave the task whenever ``HELD``
bytes of them are full, as one packed row for each block. A block's rows meet and are added up by document. An id whose postings are more than a task's share
is dealt over several tasks, each of which gets its counts. So no task holds more than one id's counts (at most the
vocabulary of A) and a bounded part of the sums, and sorting can spill.

Side B's pieces never hold a blank after another character, so texts are cut before blanks and workers remember the
ids of words; a model with other pieces gets whole texts. Texts are aligned in windows of ``WINDOW`` tokens that end where both sides end.

Defined results: null and empty texts, and texts that either side does not give back byte by byte, have zeros and an empty
digest; special tokens' strings are plain text; repeated rows each count and each have a row; a null doc_id has a row as
any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import textcodec as T
from vigil.llm.common import by_bytes, partitions, remembered, staged, table, trimmed

#: Bytes and rows of texts that are one block, tokens of side A that are aligned together (about 150 bytes of arrays each).
BLOCK, BLOCK_ROWS, WINDOW = 5 << 19, 50_000, 1 << 20
#: Words of side B that a worker remembers.
UNITS = 200_000
#: Bytes of sums that a task holds before they leave it.
HELD = 32 << 20
#: Packed sums of one block that are held before they are added up.
MERGED = 64
#: Postings of one id that a task takes in any case.
LEAST_SHARE = 1 << 16

_UNITS = re.compile(r" +[^ ]*").findall


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """One tokenizer: ids of texts (with a blank put before them), and every id's bytes and their number."""

    def __init__(self, of: dict[int, bytes]):
        self.bytes = [of.get(i, b"") for i in range(max(of) + 1)]
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def whole(self, ids: bytes, text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) == text


class ByteSide(Side):
    def __init__(self, path: str):
        self.path = path
        value = {c: i for i, c in enumerate(T.BYTE_NAMES)}
        super().__init__({i: bytes(value[c] for c in s) for s, i in T.tokenizer(path).get_vocab().items() if all(c in value for c in s)})

    @cached_property
    def tok(self):
        """A tokenizer to which the strings of special tokens are plain text; only texts that may hold one need it."""
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = True
        tok.no_truncation()
        tok.no_padding()
        return tok

    def encode(self, texts: list[str]) -> list[bytes]:
        own = [i for i, t in enumerate(texts) if "<|" in t]
        marked = set(own)
        out = T.byte_level_ids(self.path, [None if i in marked else " " + t for i, t in enumerate(texts)])
        if own:
            for i, e in zip(own, self.tok.encode_batch([" " + texts[i] for i in own], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        super().__init__({i: bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)})
        self.words = not any("▁" in p.lstrip("▁") for p in names)
        self.memo = T.Memo(self._unit, UNITS)

    def _unit(self, unit: str) -> bytes:
        ids = [self.sp.piece_to_id("▁")] if unit == " " else self.sp.encode(unit[1:], num_threads=1)  # which puts a blank before all but an empty text
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.words:
            return [self._unit(" " + t) if t else b"" for t in texts]
        get = self.memo.__getitem__
        return [b"".join(map(get, _UNITS(" " + t))) if t else b"" for t in texts]


_sides: dict = remembered({})


def side(kind, path: str) -> Side:
    if (kind, path) not in _sides:
        _sides[kind, path] = kind(path)
    return _sides[kind, path]


def windows(a: np.ndarray, b: np.ndarray, window: int):
    """(first A, end A, first B, end B, end of each A token, end of each B token) over token sizes ``a`` and ``b`` of the
    same bytes: stretches of about ``window`` tokens of A that end where both sides end. Ends count from the stretch."""
    i = j = 0
    while i < len(a):
        step = window
        while True:
            ea, eb = np.cumsum(a[i : i + step]), np.cumsum(b[j : j + step])
            common = ea[np.isin(ea, eb, assume_unique=True)]
            if len(common):
                break
            step *= 2
        n, m = int(np.searchsorted(ea, common[-1])) + 1, int(np.searchsorted(eb, common[-1])) + 1
        yield i, i + n, j, j + m, ea[:n], eb[:m]
        i, j = i + n, j + m


def links(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, place of the A token, place of the B token, whether both end here) of each link, in order."""
    at_a, at_b = np.zeros(int(ea[-1]) + 1, dtype=bool), np.zeros(int(ea[-1]) + 1, dtype=bool)
    at_a[ea] = True
    at_b[eb] = True
    end = np.flatnonzero(at_a | at_b)
    fa, fb = at_a[end], at_b[end]
    return end, np.cumsum(fa) - fa, np.cumsum(fb) - fb, fa & fb


class Digests:
    """What a document's groups are written with: a byte string for each token, by side and place in its group."""

    def __init__(self, a: Side, b: Side):
        self.second = 2 * len(a.bytes)
        self.names = [b"%d%s" % (i // 2, b"|" if i % 2 else b",") for i in range(self.second)]
        self.names += [b"%d%s" % (i // 2, b";" if i % 2 else b",") for i in range(2 * len(b.bytes))]

    def codes(self, ids_a, ids_b, link_a, link_b, both) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names' places of the tokens of all groups in order, group of each A token, group of each B token)."""
        group = np.cumsum(both) - both
        last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
        last_a[link_a[both]] = True
        last_b[link_b[both]] = True
        of_a, of_b = np.empty(len(ids_a), dtype=np.int64), np.empty(len(ids_b), dtype=np.int64)
        of_a[link_a], of_b[link_b] = group, group
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        out = np.empty(len(ids_a) + len(ids_b), dtype=np.int32)
        out[np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[of_a]] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + np.cumsum(n_a)[of_b]] = self.second + 2 * ids_b + last_b
        return out, of_a, of_b


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
STAGED = "kind int, block long, n int, b int, payload binary, a array<int>, c array<long>, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_TYPES = {"kind": pa.int32(), "block": pa.int64(), "n": pa.int32(), "b": pa.int32(), "payload": pa.binary(), "a": pa.list_(pa.int32()), "c": pa.list_(pa.int64()), "pos": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
POSTINGS, COUNTS, DOCUMENTS = range(3)


def _rows(kind: int, block: int, n: int, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    columns |= {"kind": pa.array(np.full(size, kind), pa.int32()), "block": pa.array(np.full(size, block), pa.int64()), "n": pa.array(np.full(size, n), pa.int32())}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in _TYPES.items()], list(_TYPES))


def _postings(block: int, n: int, doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Rows of one window's links: for each id of B its postings and its pair counts."""
    key, m = np.unique((b.astype(np.uint64) << np.uint64(48)) | (a.astype(np.uint64) << np.uint64(24)) | doc.astype(np.uint64), return_counts=True)
    over = m > 0xFFFF  # a posting holds 16 bits; what is more is more postings
    if over.any():
        times = np.where(over, -(-m // 0xFFFF), 1)
        last = np.cumsum(times) - 1
        rest = m - (times - 1) * 0xFFFF
        key, m = np.repeat(key, times), np.full(int(times.sum()), 0xFFFF)
        m[last] = rest
    pair = key >> np.uint64(24)
    p = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    c, pa_ids, pb = np.add.reduceat(m, p), (pair[p] & np.uint64(0xFFFFFF)).astype(np.int32), (pair[p] >> np.uint64(24)).astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], pb[1:] != pb[:-1])))
    bounds = np.append(first, len(pb)).astype(np.int32)
    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x, t))
    yield _rows(COUNTS, block, n, b=pa.array(pb[first], pa.int32()), a=lists(pa_ids, pa.int32()), c=lists(c, pa.int64()))
    at = np.append(p[first], len(key)).tolist()
    parts = ((key >> np.uint64(24)).astype("<u2"), (key & np.uint64(0xFFFFFF)).astype("<u2"), m.astype("<u2"))
    packed = [b"".join([x[s:e].tobytes() for x in parts]) for s, e in zip(at, at[1:])]
    for k in range(0, len(packed), 4_096):
        yield _rows(POSTINGS, block, n, b=pa.array(pb[first][k : k + 4_096], pa.int32()), payload=pa.array(packed[k : k + 4_096], pa.binary()))


def _block(block: int, texts: list[str], ids: pa.Array, a: Side, b: Side, digests: Digests, window: int):
    """The rows of one block of texts."""
    n = len(texts)
    figures = {c: np.zeros(n, dtype=np.int64) for c in FIGURES}
    good, tokens_a, tokens_b, size = [], [], [], []
    for i, (t, x, y) in enumerate(zip(texts, a.encode(texts), b.encode(texts), strict=True)):
        raw = b" " + t.encode()
        if t and a.whole(x, raw) and b.whole(y, raw):
            good.append(i)
            tokens_a.append(x)
            tokens_b.append(y)
            size.append(len(raw))
            figures["n_a"][i], figures["n_b"][i] = len(x) // 4, len(y) // 4
    hashes, sha = {}, [""] * n
    if good:
        ends, of = np.cumsum(size), np.array(good)
        ids_a, ids_b = (np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in (tokens_a, tokens_b))
        base = 0
        for i, i2, j, j2, ea, eb in windows(a.sizes[ids_a], b.sizes[ids_b], window):
            end, link_a, link_b, both = links(ea, eb)
            doc = np.searchsorted(ends, end + base)
            figures["n_links"] += np.bincount(of[doc], minlength=n)
            figures["n_groups"] += np.bincount(of[doc[both]], minlength=n)
            yield from _postings(block, n, of[doc], ids_a[i:i2][link_a], ids_b[j:j2][link_b])
            codes, _, _ = digests.codes(ids_a[i:i2], ids_b[j:j2], link_a, link_b, both)
            cut = [0, *(np.searchsorted(ea, ends - base, side="right") + np.searchsorted(eb, ends - base, side="right")).tolist()]
            for d in range(int(doc[0]), int(doc[-1]) + 1):
                s, e = max(cut[d], 0), cut[d + 1]
                text = b"".join(map(digests.names.__getitem__, codes[s:e].tolist()))
                h = hashes.setdefault(d, hashlib.sha256())
                if ends[d] <= base + end[-1]:
                    h.update(text[:-1])
                    sha[good[d]] = hashes.pop(d).hexdigest()
                else:
                    h.update(text)
            base += int(end[-1])
    yield _rows(DOCUMENTS, block, n, pos=pa.array(np.arange(n), pa.int32()), doc_id=ids, groups_sha256=pa.array(sha), **{c: pa.array(x) for c, x in figures.items()})


def _encode(paths: tuple[str, str], size: int, window: int):
    def run(batches):
        a, b = side(ByteSide, paths[0]), side(PieceSide, paths[1])
        digests = _sides.setdefault(("digests", *paths), Digests(a, b))
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for part in by_bytes(whole, most=size):
                for at in range(0, part.num_rows, BLOCK_ROWS):
                    x = part.slice(at, BLOCK_ROWS)
                    texts = [t or "" for t in x.column("text").to_pylist()]
                    yield from _block(number, texts, x.column("doc_id"), a, b, digests, window)
                    number += 1

    return run


#: A row of sums: places in a block and their sums, packed as 32, 64 and 64 bits.
SUMS = {"block": pa.int64(), "sums": pa.binary()}


def _added(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, best, total) over the packed sums of one block."""
    at, best, total = [], [], []
    for raw in parts:
        n = len(raw) // 20
        at.append(np.frombuffer(raw, "<i4", n))
        best.append(np.frombuffer(raw, "<i8", n, 4 * n))
        total.append(np.frombuffer(raw, "<i8", n, 12 * n))
    place, of = np.unique(np.concatenate(at), return_inverse=True)
    sums = np.zeros((2, len(place)), dtype=np.int64)
    np.add.at(sums[0], of, np.concatenate(best))
    np.add.at(sums[1], of, np.concatenate(total))
    return place, sums[0], sums[1]


def _packed(at: np.ndarray, best: np.ndarray, total: np.ndarray) -> bytes:
    return at.astype("<i4").tobytes() + best.astype("<i8").tobytes() + total.astype("<i8").tobytes()


def _whole(batches):
    """Worker function over rows (block, sums) sorted by block: block, pos, best, total of each document. What a block has so far
    is added up whenever ``MERGED`` parts are held."""
    own = None, []

    def rows(block, parts):
        place, best, total = _added(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block), pa.int64()), pa.array(place, pa.int32()), pa.array(best), pa.array(total)], ["block", "pos", "best", "total"])

    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if block != own[0]:
                if own[1]:
                    yield rows(*own)
                own = block, []
            own[1].append(raw)
            if len(own[1]) >= MERGED:
                own[1][:] = [_packed(*_added(own[1]))]
    if own[1]:
        yield rows(*own)


def _count(most: int):
    """Worker function over rows sorted by (b, salt, kind): counts of an id, then its postings; gives sums of documents."""

    def run(batches):
        count, mine, touched, highest = np.zeros(1 << 16, dtype=np.int64), None, [], 0
        held, size = {}, 0

        def flush():
            for block, (best, total) in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(at, best[at], total[at])], pa.binary())], list(SUMS))
            held.clear()

        for batch in batches:
            b, salt, kind, block, n, a, c = (batch.column(x).fill_null(0).to_numpy(zero_copy_only=False) for x in ("b", "salt", "kind", "block", "n", "one_a", "one_c"))
            payload = batch.column("payload")
            cuts = (np.flatnonzero((b[1:] != b[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(b)]):
                if s == e:
                    continue
                if (b[s], salt[s]) != mine:
                    mine, highest = (b[s], salt[s]), 0
                    for x in touched:
                        count[x] = 0
                    touched = []
                if not kind[s]:
                    x = a[s:e].astype(np.int64)
                    count[x] = c[s:e]
                    touched.append(x)
                    highest = max(highest, int(c[s:e].max()))
                    continue
                for k, raw in enumerate(payload.slice(s, e - s).to_pylist(), start=s):
                    ids, doc, m = np.frombuffer(raw, "<u2").reshape(3, -1)
                    own, m = count[ids], m.astype(np.int64)
                    if block[k] not in held:
                        held[block[k]] = np.zeros((2, n[k]), dtype=np.int64)
                        size += 16 * int(n[k])
                    best, total = held[block[k]]
                    np.add.at(total, doc, own * m)
                    top = own == highest
                    np.add.at(best, doc[top], m[top])
                    if size >= most:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK, window: int = WINDOW, held: int = HELD, share: int = LEAST_SHARE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    T.require(a_path, T.BYTE_KIND)
    spark = docs.sparkSession
    parts = partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = staged(base.mapInArrow(trimmed(_encode((a_path, b_path), block, window)), STAGED), "alignment")
    postings = made.where(F.col("kind") == POSTINGS).select("b", "block", "n", "payload")
    counts = made.where(F.col("kind") == COUNTS).select("b", F.explode(F.arrays_zip("a", "c")).alias("p")).groupBy("b", F.col("p.a").alias("one_a")).agg(F.sum("p.c").alias("one_c"))
    sizes = staged(postings.groupBy("b").agg(F.sum(F.length("payload")).alias("bytes")), "sizes")  # a row for each id of B at most
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    salts = F.broadcast(sizes.select("b", F.ceil(F.col("bytes") / max(share, total // parts + 1)).cast("int").alias("salts")))
    first = counts.join(salts, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("payload"), "one_a", "one_c")
    then = postings.join(salts, "b").select("b", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "block", "n", "payload", F.lit(None).cast("int").alias("one_a"), F.lit(None).cast("long").alias("one_c"))
    streams = first.union(then).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "kind")
    some_sums = streams.mapInArrow(trimmed(_count(held)), "block long, sums binary").repartition(parts, "block").sortWithinPartitions("block")
    sums = some_sums.mapInArrow(trimmed(_whole), "block long, pos int, best long, total long")
    figures = made.where(F.col("kind") == DOCUMENTS).select("block", "pos", "doc_id", *FIGURES, "groups_sha256")
    some = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return figures.join(sums, ["block", "pos"], "left").select("doc_id", *FIGURES, some("best", "n_best"), some("total", "count_sum"), "groups_sha256")


def op11_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), byte_path(), piece_path())
