"""Operator 7: MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of shingles and a signature; texts with one set form a class, linked at once.
2. Classes that agree in a whole band are candidates. Bands follow from the threshold, so that a pair at it meets
   in one of them with probability 1 - 1.2e-5: 24 bands of 6 values at 0.85, 29 of 5 at 0.80.
3. Candidates of a band meet in cells of bounded size (groups of many classes, or of large sets, are cut into
   blocks, and each two blocks meet in a cell). A cell compares signatures batch by batch and drops a pair as soon as the posterior
   probability that its similarity reaches the threshold falls below ``MISS``.
4. Survivors are checked on their full sets, best first; pairs that are already connected within the cell
   need no check. A cell returns only links that connect something, at most one fewer than its classes.
5. Components over all cells' links.

A pair is compared only in the first band in which it agrees, so no pair is done twice, and pairs of a group
are never rows of a table.

Defined results: null text and text without words have an empty set and link with nothing; repeated rows
are linked as equal texts; classes with one smallest doc_id (a doc_id that is repeated with other text) are
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, give_back, small, staged, table, trimmed
from vigil.llm.components import components
from vigil.llm.shingles import MOST_HASHES, ROWS, shingle_set, signature

#: Similarity in hundredths for links, and the chance at which a true link may be dropped in a batch.
HUNDREDTHS = 85
MISS = 1e-6
#: Chance that a pair at the threshold agrees in no whole band.
UNMET = 1.2e-5
#: Bands compared at a time.
BATCH = 4
#: Classes of a block, and bytes of their sets; a cell holds two blocks.
BLOCK, BLOCK_BYTES = 512, 16 << 20


@cache
def banding(hundredths: int) -> tuple[int, int]:
    """Number of bands and their values: the longest bands whose number keeps ``UNMET`` within a signature."""
    for rows in range(ROWS, 0, -1):
        bands = ceil(log(UNMET) / log(1 - (hundredths / 100) ** rows)) if hundredths < 100 else 1
        if bands * rows <= MOST_HASHES:
            return bands, rows
    raise ValueError(f"no bands for a similarity of {hundredths} hundredths")


@cache
def least_agreement(n: int, hundredths: int = HUNDREDTHS, miss: float = MISS) -> int:
    """Fewest agreements of ``n`` values at which the similarity may still reach the threshold.

    With a uniform prior, P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    t, total = hundredths / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def similar(a: np.ndarray, b: np.ndarray, hundredths: int = HUNDREDTHS) -> bool:
    if min(len(a), len(b)) * 100 < hundredths * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= hundredths * (len(both) - inter)


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, hundredths: int = HUNDREDTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right, i < j) that first agree in ``band`` and outlive every batch; their agreements."""
    i, j = np.meshgrid(left, right, indexing="ij")
    keep = i < j
    i, j = i[keep], j[keep]
    agree = np.zeros(len(i), dtype=np.int32)
    bands, rows = banding(hundredths)
    hashes, width = bands * rows, BATCH * rows
    for at in range(0, hashes, width):
        part = sig[:, at : at + width]
        ok = np.empty(len(i), dtype=bool)
        floor = least_agreement(min(at + width, hashes), hundredths)
        for s in range(0, len(i), 65_536):
            a, b = i[s : s + 65_536], j[s : s + 65_536]
            same = part[a] == part[b]
            agree[s : s + 65_536] += same.sum(axis=1, dtype=np.int32)
            fine = agree[s : s + 65_536] >= floor
            for k in range(BATCH):
                if at // rows + k < band:
                    fine &= ~same[:, k * rows : (k + 1) * rows].all(axis=1)
            ok[s : s + 65_536] = fine
        i, j, agree = i[ok], j[ok], agree[ok]
    return i, j, agree


def links_of(members: list[int], sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int, hundredths: int = HUNDREDTHS) -> list[tuple[int, int]]:
    i, j, agree = survivors(sig, left, right, band, hundredths)
    up = list(range(len(members)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    order = np.argsort(-agree, kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y and similar(sets[a], sets[b], hundredths):
            up[max(x, y)] = min(x, y)
            out.append((members[a], members[b]))
    return out


def _facts(hashes: int):
    def run(batches):
        for b in (part for whole in batches for part in by_bytes(whole)):
            n, cls, sig = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, hashes=hashes).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("print"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "print", "n_shingles", "cls", "sig"])

    return run


def _sets(batches):
    for b in (part for whole in batches for part in by_bytes(whole)):
        sets = [shingle_set(t).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
        cls = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "cls", "shingles"])


def _cell(hundredths: int):
    def run(t: pa.Table) -> pa.Table:
        out = []
        if t.num_rows > 1:
            t = t.take(pc.sort_indices(t, [("rep", "ascending")]))
            block = t.column("block").to_numpy()
            one, two = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())
            sig = np.stack([np.frombuffer(x, "<u2") for x in t.column("sig").to_pylist()])
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]  # not copied
            reps, band = t.column("rep").to_pylist(), int(t.column("band")[0].as_py())
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            out = links_of(reps, sig, sets, left, right, band, hundredths)
            if one != two:  # the smaller rep may stand in either block
                out += links_of(reps, sig, sets, right, left, band, hundredths)
            del sets, t
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _labelled(docs: DataFrame, hundredths: int, block: int) -> DataFrame:
    """doc_id, print (hash of the text), n_shingles, component of each row of ``docs``."""
    bands, rows = banding(hundredths)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = staged(base.withColumn("print", F.xxhash64("text")).mapInArrow(trimmed(_facts(bands * rows)), "doc_id long, print long, n_shingles long, cls binary, sig binary"), "facts")
    classes = staged(facts.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    # bands
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring("sig", 2 * rows * k + 1, 2 * rows)).alias("key")) for k in range(bands)])
    banded = classes.select("cls", "n_shingles", F.explode(keys).alias("x")).select("cls", "n_shingles", "x.band", "x.key")
    groups = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).where("n > 1")
    banded = banded.drop("n_shingles")
    members = staged(banded.join(groups, "key"), "members")
    wanted = members.select("cls").distinct().join(classes.select("cls", "rep", "sig"), "cls")
    # sets of candidates, from their texts
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    picked = base.join(small(ids), "doc_id", "left_semi")
    sets = picked.mapInArrow(trimmed(_sets), "doc_id long, cls binary, shingles binary").dropDuplicates(["cls"]).select("cls", "shingles")
    full = staged(wanted.join(sets, "cls"), "sets")
    # cells
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(3)), blocks).cast("int")
    dealt = members.select("cls", "band", "key", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = dealt.select("cls", "band", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = cells.join(full, "cls").groupBy("key", "i", "j").applyInArrow(_cell(hundredths), "a long, b long")
    reach = components(met)
    labels = classes.join(reach, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = facts.select("doc_id", "print", "n_shingles", "cls").join(labels, "cls", "left")
    return out.select("doc_id", "print", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, hundredths: int = HUNDREDTHS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    out = _labelled(docs, hundredths, block)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, hundredths: int = HUNDREDTHS, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest doc_id, with all columns.

    Rows are told apart by doc_id and text; rows that agree in both are one. Rows without doc_id that link
    with nothing all stay.
    """
    marks = staged(_labelled(docs, hundredths, block).where("component is not null").groupBy("component", "doc_id", "print").agg(F.count("*").alias("n")), "marks")
    best = marks.groupBy("component").agg(F.min(F.struct("doc_id", "print")).alias("best"))
    gone = marks.join(best, "component").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("print") == F.col("best.print")))).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
    gone = small(staged(gone, "gone"))
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_print"]), "left_anti")
    if marks.where("n > 1 and doc_id is not null").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
