"""Operator 2: embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared only within their label. They are scaled to length 1 and turned into the principal
axes of a bounded sample, so that the leading coordinates carry most of the variance. Equal vectors of a
label form a class. A label's classes are ordered along the first axis and cut into tiles; two tiles meet
unless their ranges on that axis are too far apart, which is known before any vector is sent. A pair of tiles adds up products over leading
coordinates, ``STEP`` at a time; what the rest can still add is at most the product of the two suffix norms
(Cauchy-Schwarz), and a pair is dropped once that cannot reach the threshold. Survivors are decided by the
cosine of the original vectors in double precision. A tile pair returns how many vectors each class links
with, and only those links that connect something; pairs are never rows.

Any rotation gives the same results, so the sample behind the axes affects speed alone.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have a null label link with
nothing; vectors of different lengths never link; repeated rows link as equal vectors; rows of one vec_id with
different vectors are rows of their own that link by their vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import small, staged, table
from vigil.llm.components import components

THRESHOLD = 0.93
#: Vectors behind the principal axes.
SAMPLE = 4_096
#: Classes of a tile.
TILE = 4_096
#: Coordinates added between two looks at the bound.
STEP = 8
#: What rounding may take from a sum of products of unit vectors.
SLACK = 1e-9


def axes(vectors: np.ndarray) -> np.ndarray:
    """Principal axes as columns, leading first."""
    if len(vectors) < 2:
        return np.eye(vectors.shape[1])
    _, v = np.linalg.eigh(np.cov(vectors, rowvar=False).reshape(vectors.shape[1], -1))
    return v[:, ::-1]


def suffix_norms(y: np.ndarray) -> np.ndarray:
    """Norm of each row's coordinates from each multiple of STEP on."""
    sq = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([sq[:, ::STEP], np.zeros((len(y), 1))], axis=1))


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows (unit vectors in principal axes) whose cosine may reach ``threshold``."""
    if not len(a) or not len(b):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    na, nb = suffix_norms(a), suffix_norms(b)
    d = a.shape[1]
    lead = min(d, 2 * STEP)
    dots = a[:, :lead] @ b[:, :lead].T
    k = lead // STEP if lead < d else na.shape[1] - 1
    i, j = np.nonzero(dots + np.outer(na[:, k], nb[:, k]) >= threshold - SLACK)
    dots = dots[i, j]
    for at in range(lead, d, STEP):
        dots = dots + np.einsum("ij,ij->i", a[i, at : at + STEP], b[j, at : at + STEP])
        k = at // STEP + 1
        keep = dots + na[i, k] * nb[j, k] >= threshold - SLACK
        i, j, dots = i[keep], j[keep], dots[keep]
    return i, j


def _usable(dim: int):
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as 32-bit numbers where these are exact, else as 64-bit numbers."""
    with np.errstate(over="ignore"):
        f = x.astype("<f4")
    short = (f == x).all(axis=1).tolist()
    return [a.tobytes() if k else b.tobytes() for k, a, b in zip(short, f, x.astype("<f8"), strict=True)]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in rows])


def turned_to(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation


def _turn(rotation: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v, dtype=np.float64) for v in b.column("v").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("label"), b.column("cid"), b.column("weight"), pa.array(pack(x), pa.binary()), pa.array(turned_to(x, rotation[:, :1])[:, 0])], ["label", "cid", "weight", "v", "lead"])

    return run


def _tiles(threshold: float, dim: int, rotation: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        t = t.sort_by("cid")
        tile, i, j = t.column("tile").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rep, weight = t.column("cid").to_numpy(), t.column("weight").to_numpy()
        x = unpack(t.column("v").to_pylist(), dim)
        y = turned_to(x, rotation)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        links = np.zeros(len(rep), dtype=np.int64)
        up = list(range(len(rep)))

        def find(a):
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            p, q = close_pairs(y[part], y[right], threshold)
            p, q = part[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            fit = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
            p, q = p[fit], q[fit]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                u, w = find(a), find(b)
                if u != w:
                    up[max(u, w)] = min(u, w)
                    out.append((None, None, int(rep[a]), int(rep[b])))
        out += [(int(rep[k]), int(links[k]), None, None) for k in np.flatnonzero(links)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("cid", "n", "a", "b"), cols, strict=True)})

    return run


def _sample(classes: DataFrame, dim: int, n: int) -> np.ndarray:
    """About SAMPLE of the ``n`` classes, picked by a hash."""
    draw = F.pmod(F.xxhash64("label", "cid", F.lit("axes")), F.lit(1 << 30))
    drawn = classes.where(draw < int(min(1.0, SAMPLE / n) * (1 << 30))).select("v").limit(2 * SAMPLE).collect()
    x = np.array([r["v"] for r in drawn], dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _tiled(turned: DataFrame, tile: int) -> DataFrame:
    """``turned`` with its tile: ranges of the first axis within the label."""
    n = turned.groupBy("label").agg(F.count("*").alias("n"), F.percentile_approx("lead", F.array(*[F.lit(k / 1024) for k in range(1, 1024)]), 20_000).alias("cuts"))
    tiles = F.least(F.ceil(F.col("n") / tile), F.lit(1024)).cast("int")
    cut = n.select("label", "n", tiles.alias("tiles"), F.transform(F.sequence(F.lit(1), F.greatest(tiles - 1, F.lit(1))), lambda k: F.element_at("cuts", F.least(F.greatest((k * 1024 / tiles).cast("int"), F.lit(1)), F.lit(1023)))).alias("cuts"))
    ranged = turned.join(small(cut, 1_000), "label")
    rank = F.when(F.col("tiles") > 1, F.size(F.filter("cuts", lambda c: c <= F.col("lead")))).otherwise(0)
    ranged = ranged.select("label", "cid", "weight", "v", "lead", rank.cast("long").alias("rank"))
    # a range with more classes than a tile, as ties on the first axis make, is cut further by a hash, by its own size
    parts = ranged.groupBy("label", "rank").agg(F.greatest(F.ceil(F.count("*") / tile), F.lit(1)).alias("parts"))
    cut = ranged.join(small(parts, 1_000_000), ["label", "rank"])
    return cut.select("label", "cid", "weight", "v", "lead", (F.col("rank") * (1 << 32) + F.pmod(F.xxhash64("cid", F.lit(5)), "parts")).alias("tile"))


def _meetings(tiled: DataFrame, threshold: float) -> DataFrame:
    """label, tile, others: the tiles that each tile must meet, from the tiles' ranges alone."""
    ends = tiled.groupBy("label", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    other = ends.select("label", F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.greatest(F.col("low") - F.col("high2"), F.col("low2") - F.col("high"), F.lit(0.0))
    return ends.join(other, "label").where(gap * gap <= 2 - 2 * threshold + SLACK).groupBy("label", "tile").agg(F.collect_list("other").alias("others"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``embeddings`` (vec_id, embedding, label)."""
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = staged(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    sizes = [r[0] for r in rows.groupBy(F.size("embedding")).count().orderBy(F.desc("count")).collect() if r[0] and r[0] > 0]
    counts, links, members = [], [], []
    for dim in sizes:
        good = rows.where(_usable(dim))
        classes = staged(good.groupBy("label", "embedding").agg(F.min("row").alias("cid"), F.count("*").alias("weight")), "vectors").withColumnRenamed("embedding", "v")
        n = classes.count()
        if not n:
            continue
        rotation = axes(_sample(classes, dim, n).reshape(-1, dim))
        tiled = staged(_tiled(staged(classes.mapInArrow(_turn(rotation), "label string, cid long, weight long, v binary, lead double"), "turned"), tile), "tiled")
        dealt = tiled.join(small(_meetings(tiled, threshold), 10_000), ["label", "tile"]).select("label", "cid", "weight", "v", "tile", F.explode("others").alias("other"))
        met = dealt.select("label", "cid", "weight", "v", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        found = staged(met.groupBy("label", "i", "j").applyInArrow(_tiles(threshold, dim, rotation), "cid long, n long, a long, b long"), "found")
        counts.append(found.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n")))
        links.append(found.where("a is not null").select("a", "b"))
        members.append(good.select("row", "label", "embedding").join(classes.withColumnRenamed("v", "embedding"), ["label", "embedding"]).select("row", "cid", "weight"))
    if not members:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    reach = components(union(links))
    known = rows.select("row", "vec_id").join(union(members), "row", "left").join(union(counts), "cid", "left").join(reach, F.col("cid") == F.col("node"), "left")
    known = staged(known.select("row", "vec_id", "weight", "n", F.coalesce("component", "cid", "row").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return known.join(least, "root").select("vec_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_cosine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
