"""Operator 5: benchmark decontamination by pigeonhole edit matching.

A test item counts as found in a document if some stretch of the document lies within the item's error
budget (insertions, deletions, substitutions). Both are normalised first: A-Z lower-cased, and all ASCII
punctuation and white space between words made one blank. An item with budget k is split into k + 1 pieces; whatever k errors hit, one
piece stays whole. All pieces of all items are sought at once by an Aho-Corasick automaton; each hit fixes
where the item would lie, and Myers' bit-parallel distance decides over that stretch.

Items are met in blocks of at most ``BLOCK_BYTES``; each block is one pass over all documents.

Defined results: null and empty texts and items match nothing; items of fewer than ``LEAST`` bytes need an
exact match; repeated documents each give their rows, repeated items each their item_id, and items without item_id a
null one; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, filtered, table, trimmed

#: Errors that an item of n bytes may have: n // PER_ERROR.
PER_ERROR = 14
LEAST = 40
BLOCK_BYTES = 8 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | bytes | None) -> bytes:
    if not text:
        return b""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return b" ".join(raw.translate(_FOLD).split())


def budget(n: int, per_error: int = PER_ERROR) -> int:
    return n // per_error if n >= LEAST else 0


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    n = len(item)
    ends = [n * (i + 1) // (k + 1) for i in range(k + 1)]
    return [(s, item[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True) if e > s]


def masks(item: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(item: bytes, peq: dict[int, int], text: bytes, k: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` closest to ``item``, if within k: Myers' algorithm, one step a byte."""
    m = len(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = full, 0, m, None
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1  # row 0 is zero everywhere: a match may start at any byte
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score <= k and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int | None, bytes]], per_error: int = PER_ERROR):
        import ahocorasick

        self.items = [(i, t, budget(len(t), per_error), masks(t)) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for off, p in pieces(t, k):
                where.setdefault(p.decode("latin-1"), []).append((n, off, len(p)))
        for p, at in where.items():
            self.automaton.add_word(p, at)
        if where:
            self.automaton.make_automaton()

    def find(self, raw: bytes) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end) of each item found in a normalised text."""
        if not self.items or not raw:
            return []
        starts: dict[int, list[int]] = {}
        for end, hits in self.automaton.iter(raw.decode("latin-1")):
            for n, off, size in hits:
                starts.setdefault(n, []).append(end + 1 - size - off)
        out = []
        for n, at in starts.items():
            ident, item, k, peq = self.items[n]
            best, at = None, sorted(set(at))
            lo = None
            for s in [*at, None]:
                if lo is not None and (s is None or s - k > hi):
                    got = best_end(item, peq, raw[lo:hi], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], lo + got[1])
                    lo = None
                    if best and best[0] == 0:
                        break
                if s is not None:
                    lo, hi = (max(0, s - k) if lo is None else lo), s + len(item) + k
            if best:
                out.append((ident, *best))
        return out


def _scan(items: list[tuple[int | None, bytes]], per_error: int):
    def run(batches):
        matcher = Matcher(items, per_error)
        for b in (part for whole in batches for part in by_bytes(whole)):
            rows = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if raw:
                    rows += [(doc, *hit) for hit in matcher.find(normal(raw))]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "end"])

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark's items, normalised, in blocks of about ``block_bytes``."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark
        yield [(r["item_id"], normal(r["text"])) for r in part.select("item_id", "text").where("text is not null").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, end (byte of the normalised text) for each item found in each row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for some in blocks(items, block_bytes):
        found = base.mapInArrow(trimmed(_scan(some, per_error)), "doc_id long, item_id long, edits long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for some in blocks(items, block_bytes):

        def make(some=some):
            matcher = Matcher(some, per_error)
            return lambda raws: [not (r and matcher.find(normal(r))) for r in raws]

        docs = filtered(docs, make)
    return docs


def op5_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
