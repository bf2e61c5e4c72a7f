"""Operator 13: exact nearest neighbours by largest inner product, as a block matrix join.

Equal vectors are one class, of which only the first ``k`` + 1 rows can ever be asked for. Every vector has an int8 code:
its components over a scale of its own, rounded. What rounding leaves out bounds the error of a product of codes
(Cauchy-Schwarz on the remainders). Candidate classes are dealt into blocks; a block's rows are held by one task, and
the query classes are sent to each block once and stream past it. The product of a tile of codes gives an
interval for every inner product of the tile; pairs whose interval reaches the k-th best value that the query has in
this block are recomputed in double precision on the vectors as they came and go into the query's heap. Heaps of the
blocks are merged in streams sorted by query.

Costs: products of all queries with all candidates, as in any exact search; each candidate is sent once, each query
once for every block of up to ``MOST`` vectors.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components take no part, neither
do rows without vec_id; vectors of other lengths than the query's are no candidates of it; rows that repeat a vec_id or a
vector are rows of their own; a query is never its own row's candidate; fewer candidates than k give fewer rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import partitions, small, staged, table, trimmed

K, EVERY = 20, 20
#: Classes of a block, at least and at most; rows and columns of a tile.
LEAST, MOST = 4_096, 131_072
TILE_ROWS, TILE_COLUMNS = 256, 4_096
#: Share by which the bounds are widened for the rounding of their own sums.
SLACK = 1e-9


class Codes:
    """Vectors with their int8 codes, scales and the norms that bound the error of code products."""

    def __init__(self, x: np.ndarray):
        self.x = x
        top = np.abs(x).max(axis=1, keepdims=True)
        unit = x / top  # no component above 1, so no square overflows
        codes = np.rint(unit * 127)
        self.codes = codes.astype(np.int8)
        self.top = top[:, 0]
        self.rest = np.linalg.norm(unit - codes / 127, axis=1)
        self.norm = np.linalg.norm(codes / 127, axis=1) + self.rest

    def __len__(self):
        return len(self.x)


def bounds(q: Codes, rows: slice, c: Codes, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the inner products of a tile, divided by the query's largest component."""
    kind = np.float32 if q.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers are exact in either
    dots = (q.codes[rows].astype(kind) @ c.codes[columns].astype(kind).T).astype(np.float64) / (127 * 127)
    error = np.outer(q.norm[rows], c.rest[columns]) + np.outer(q.rest[rows], c.norm[columns])
    error += SLACK * (1 + np.outer(q.norm[rows], c.norm[columns]))
    scale = c.top[columns]
    with np.errstate(over="ignore", invalid="ignore"):
        return (dots - error) * scale, (dots + error) * scale


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in order."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(a.shape[1]):
            out += a[:, i] * b[:, i]
    return out


def search(q: Codes, c: Codes, members: list[list[tuple[int, int]]], k: int) -> list[list[tuple]]:
    """For each query the ``k`` best (score, -vec_id, -row), best first, over the members of all classes of ``c``."""
    found: list[list[tuple]] = [[] for _ in range(len(q))]
    for at in range(0, len(q), TILE_ROWS):
        rows = slice(at, min(at + TILE_ROWS, len(q)))
        for left in range(0, len(c), TILE_COLUMNS):
            columns = slice(left, min(left + TILE_COLUMNS, len(c)))
            low, high = bounds(q, rows, c, columns)
            n = high.shape[1]
            floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
            known = np.array([h[0][0] if len(h) == k else -np.inf for h in found[rows]]) / q.top[rows]
            known -= SLACK * np.abs(known)
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero(~(high < np.fmax(floor, known)[:, None]))
            for part in range(0, len(i), 1 << 16):  # many ties: not all pairs at once
                p, r = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                scores = exact(q.x[at + p], c.x[left + r])
                for a, b, s in zip(p.tolist(), r.tolist(), scores.tolist(), strict=True):
                    if s != s:
                        continue
                    heap = found[at + a]
                    for vec_id, row in members[left + b]:
                        item = (s, -vec_id, -row)
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
                        else:
                            break
    return [sorted(h, reverse=True) for h in found]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _blocks(k: int):
    """Worker function over rows sorted by (dim, block, query): a block's candidates come first, then its queries."""

    def run(batches):
        held, parts, members, mine = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("dim", "block", "query")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if s == e:
                    continue
                dim, block, is_query = keys[s].tolist()
                if (dim, block) != mine:
                    mine, held, parts, members = (dim, block), None, [], []
                part = batch.slice(s, e - s)
                x = _vectors(part.column("v"), dim)
                if not is_query:
                    parts.append(x)
                    members += [[(m["vec_id"], m["row"]) for m in ms] for ms in part.column("members").to_pylist()]
                    continue
                if parts:
                    held, parts = Codes(np.concatenate(parts)), []
                if held is None:  # no candidate fell into this block
                    continue
                got = search(Codes(x), held, members, k)
                cid = np.repeat(part.column("cid").to_numpy(), [len(g) for g in got])
                score, vec, row = (list(z) for z in zip(*[g for gs in got for g in gs], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(score, pa.float64()), pa.array([-v for v in vec], pa.int64()), pa.array([-r for r in row], pa.int64())], ["cid", "score", "vec_id", "row"])

    return run


def _merge(k: int):
    """Worker function over rows sorted by cid: the best ``k`` of each, from the heaps of all blocks."""

    def run(batches):
        cid, heap = None, []

        def done():
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays([pa.array([cid], pa.int64()), pa.array([[{"score": s, "vec_id": -v, "row": -r} for s, v, r in best]], BEST)], ["cid", "best"])

        for batch in batches:
            for c, s, v, r in zip(*(batch.column(n).to_pylist() for n in ("cid", "score", "vec_id", "row")), strict=True):
                if c != cid:
                    if heap:
                        yield done()
                    cid, heap = c, []
                item = (s, -v, -r)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        if heap:
            yield done()

    return run


BEST = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY, block: tuple[int, int] = (LEAST, MOST)) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``embeddings`` (vec_id, embedding) with the largest inner product
    for each row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = staged(rows.where(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id()), "rows")
    # 0.0 and -0.0 are one component
    keyed = rows.select(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "vec_id", "row").withColumn("h", F.xxhash64("v"))
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id", "row"))  # each partition keeps its first rows of a class before they meet
    firsts = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    asked = keyed.where(F.col("vec_id") % every == 0)
    classes = firsts.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    flagged = classes.join(asked.select("h", "v", F.lit(True).alias("asked")).distinct(), ["h", "v"], "left")
    classes = staged(flagged.select("h", "v", "members", F.col("members")[0]["row"].alias("cid"), F.coalesce("asked", F.lit(False)).alias("asked")), "classes").withColumn("dim", F.size("v"))
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n"))
    least, most = block
    n = F.col("n")
    count = F.greatest(F.ceil(n / most), F.least(F.lit(partitions(spark)), F.ceil(n / least))).cast("int")
    dealt = classes.join(small(sizes.select("dim", count.alias("blocks")), 100_000), "dim")
    none = F.lit(None).cast(classes.schema["members"].dataType)
    candidates = dealt.select("dim", F.pmod("h", "blocks").cast("int").alias("block"), F.lit(0).alias("query"), "cid", "v", "members")
    queries = dealt.where("asked").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "cid", "v", none.alias("members"))
    streams = candidates.union(queries).repartition(partitions(spark), "dim", "block").sortWithinPartitions("dim", "block", "query")
    tiles = streams.mapInArrow(trimmed(_blocks(k + 1)), "cid long, score double, vec_id long, row long")
    merged = tiles.repartition(partitions(spark), "cid").sortWithinPartitions("cid").mapInArrow(_merge(k + 1), "cid long, best array<struct<score: double, vec_id: long, row: long>>")
    own = asked.select("h", "v", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    named = own.join(classes.where("asked").select("h", "v", "cid"), ["h", "v"]).select("query_id", "own", "cid")
    listed = named.join(merged, "cid").select("query_id", F.slice(F.filter("best", lambda b: b["row"] != F.col("own")), 1, k).alias("best"))
    return listed.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op13_inner_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op13_sql() -> str:
    """The same rows in DuckDB, by all products."""
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
