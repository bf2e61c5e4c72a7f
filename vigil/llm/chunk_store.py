"""Operator 4: token ids in a content-addressed store.

A rolling hash over the last ids cuts each document's id stream into chunks, so equal passages of ids give
equal chunks wherever they stand. The store has three Parquet folders:

* ``chunks``  key (sha256 of the payload), width (bytes an id takes: 2, or 4 if an id of the chunk needs them),
  payload (ids, little-endian); each key once;
* ``recipes`` doc_id, row (tells equal doc_ids apart), n_tokens, keys (chunk keys in order, 32 bytes each),
  root (Merkle root over the keys), in ascending doc_id order;
* ``manifest`` a row for each recipe file: its documents, ids, and the Merkle root over its documents' roots.

``read_digests`` reads all back: it holds the recipe files against the manifest, hashes every chunk again, joins
recipes to the chunks they name, recomputes the Merkle roots and raises if anything differs. A document's crc32 follows from those of its
chunks, so no payload is moved for it. ``read_ids`` returns the ids themselves.

Defined results: null or empty text is the end id alone; repeated rows are documents of their own, those of
equal doc_id ordered by their place in the input; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, discard, fresh_path, partitions, running, table, trimmed
from vigil.llm.textcodec import BYTE_KIND, SLICE, byte_level_ids, require

#: Rolling hash: ids it looks back on; a cut where the low bits are zero (a chunk has 512 ids on average).
LOOK_BACK = 8
MASK = np.uint32(511 << 8)
LEAST, MOST = 64, 4096
KEY = 32


def candidates(ids: np.ndarray, mask: np.uint32 = MASK) -> np.ndarray:
    """Places after which the rolling hash allows a cut. Streams may lie side by side in ``ids``: the first
    LOOK_BACK places of a stream are too few for a chunk, so that ids of the stream before never count."""
    g = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    g ^= g >> np.uint32(15)
    h = g.copy()
    for j in range(1, LOOK_BACK):
        h[j:] += g[:-j] << np.uint32(j)
    return np.flatnonzero((h & mask) == 0) + 1


def ends_of(places: list[int], start: int, stop: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the stream from ``start`` to ``stop``, whose candidates are ``places``."""
    ends, at = [], start
    for c in places:
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least and c < stop:
            at = c
            ends.append(at)
    while stop - at > most:
        at += most
        ends.append(at)
    return [*ends, stop] if stop > start else ends


def cuts(ids: np.ndarray, least: int = LEAST, most: int = MOST, mask: np.uint32 = MASK) -> list[int]:
    """Ends of the chunks of one id stream."""
    return ends_of(candidates(ids, mask).tolist(), 0, len(ids), least, most)


def merkle(keys: list[bytes]) -> bytes:
    level = list(keys) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack(ids: np.ndarray) -> tuple[int, bytes]:
    return (2, ids.astype("<u2").tobytes()) if not len(ids) or int(ids.max()) < 1 << 16 else (4, ids.astype("<u4").tobytes())


def unpack(width: int, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if width == 2 else "<u4").astype("<u4")


def key_of(width: int, payload: bytes) -> bytes:
    """Equal ids have one width, so they have one key."""
    return hashlib.sha256(payload if width == 2 else b"4" + payload).digest()


def _encode(path: str, end_id: int, most: int = SLICE):
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = ["kind", "doc_id", "row", "n_tokens", "keys", "root", "key", "width", "payload"]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        sent: set[bytes] = set()  # this task's recent chunks; only spares repeats, the store removes the rest
        for b in batches:
            for c in by_bytes(b, most=most):
                streams = [raw + end for raw in byte_level_ids(path, c.column("text").to_pylist())]
                ids = np.frombuffer(b"".join(streams), "<u4")
                narrow = ids.astype("<u2")
                wide = np.concatenate(([0], np.cumsum(ids >> 16 != 0)))
                stops = np.cumsum([len(x) // 4 for x in streams])
                places = candidates(ids)
                bounds = np.searchsorted(places, stops, side="right").tolist()
                places, rows, start, low = places.tolist(), [], 0, 0
                for doc, row, stop, high in zip(c.column("doc_id").to_pylist(), c.column("row").to_pylist(), stops.tolist(), bounds, strict=True):
                    keys, first = [], start
                    for e in ends_of(places[low:high], start, stop):
                        width, payload = (2, narrow[start:e].tobytes()) if wide[e] == wide[start] else (4, ids[start:e].tobytes())
                        keys.append(key := key_of(width, payload))
                        start = e
                        if key not in sent:
                            if len(sent) > 100_000:
                                sent.clear()
                            sent.add(key)
                            rows.append((0, None, None, None, None, None, key, width, payload))
                    rows.append((1, doc, row, stop - first, b"".join(keys), merkle(keys), None, None, None))
                    start, low = stop, high
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

    return run


CHUNK = "key binary, width int, payload binary"
MANIFEST = "file string, documents long, tokens long, root string"


def write_store(docs: DataFrame, path: str, end_id: int, to: str) -> str:
    """Encode ``docs`` (doc_id, text) with the tokenizer file at ``path`` and write the store under ``to``."""
    require(path, BYTE_KIND)
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"kind byte, doc_id long, row long, n_tokens long, keys binary, root binary, {CHUNK}"
    log = f"{to}/log"
    base.mapInArrow(trimmed(_encode(path, end_id)), schema).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(log)
    rows = spark.read.schema(schema).parquet(log)
    chunks = rows.where("kind = 0").select("key", "width", "payload")
    chunks.repartition(partitions(spark), "key").groupBy("key").agg(F.first("width").alias("width"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{to}/chunks")
    recipes = rows.where("kind = 1").select("doc_id", "row", "n_tokens", "keys", "root")
    recipes.repartitionByRange(partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").write.option("compression", "zstd").parquet(f"{to}/recipes")
    discard(spark, log)
    manifest(spark, to).write.parquet(f"{to}/manifest")
    return to


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo that of crc32, bits reflected."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for _ in range(32):
        out ^= np.where(a & np.uint32(0x80000000), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
        a = a << np.uint32(1)
    return out


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What each crc32 adds to that of a longer string in which ``by`` bytes follow."""
    crc, by = crc.astype(np.uint32), by.astype(np.int64).copy()
    power = np.array([0x00800000], dtype=np.uint32)  # x to the 8
    while len(by) and by.max() > 0:
        odd = (by & 1).astype(bool)
        if odd.any():
            crc[odd] = _multiply(crc[odd], np.broadcast_to(power, int(odd.sum())))
        power = _multiply(power, power)
        by >>= 1
    return crc


def _check(batches):
    for b in batches:
        keys, n, crc = b.column("key").to_pylist(), [], []
        for key, width, payload in zip(keys, b.column("width").to_pylist(), b.column("payload").to_pylist(), strict=True):
            raw = unpack(width, payload).tobytes()
            if key_of(width, payload) != key:
                raise ValueError(f"chunk {key.hex()} does not hold what its key says")
            n.append(len(raw) // 4)
            crc.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "n", "crc"])


def _assemble(batches):
    for b in batches:
        parts = b.column("parts")
        flat, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy())
        seq, n, crc = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("seq", "n", "crc"))
        doc = np.repeat(np.arange(b.num_rows), sizes)
        order = np.lexsort((seq, doc))
        keys = [k for k in flat.field("key").take(pa.array(order)).to_pylist()]
        n, crc = n[order], crc[order]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        total = np.add.reduceat(n, starts[:-1]) if len(n) else n
        after = np.repeat(total, sizes) - (np.cumsum(n) - np.repeat(np.concatenate(([0], np.cumsum(total)))[:-1], sizes))
        whole = np.bitwise_xor.reduceat(shifted(crc, after * 4), starts[:-1]) if len(n) else crc
        for i, (want, claimed) in enumerate(zip(b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)):
            if merkle(keys[starts[i] : starts[i + 1]]) != want or total[i] != claimed:
                raise ValueError(f"document {b.column('doc_id')[i]} does not match its recipe")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(total, pa.int64()), pa.array(whole.astype(np.int64), pa.int64())], ["doc_id", "row", "n_tokens", "ids_crc32"])


def _recipe_parts(recipes: DataFrame) -> DataFrame:
    last = (F.octet_length("keys") / KEY).cast("int") - 1
    return recipes.select("doc_id", "row", "n_tokens", "root", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("keys", i * KEY + 1, F.lit(KEY)))).alias("seq", "key"))


def open_store(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema("doc_id long, row long, n_tokens long, keys binary, root binary").parquet(f"{at}/recipes"),
        spark.read.schema(CHUNK).parquet(f"{at}/chunks"),
    )


def read_digests(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    verify(spark, at)
    recipes, chunks = open_store(spark, at)
    facts = chunks.mapInArrow(_check, "key binary, n long, crc long")
    parts = _recipe_parts(recipes).join(facts, "key", "left")  # a chunk that is missing must not go unnoticed
    docs = parts.groupBy("doc_id", "row").agg(F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.collect_list(F.struct("seq", "key", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))).alias("parts"))
    whole = docs.mapInArrow(_assemble, "doc_id long, row long, n_tokens long, ids_crc32 long")
    return running(whole, ["doc_id", "row"], {"start": "n_tokens"}).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, row, ids array<int>: every document rebuilt from its recipe."""
    recipes, chunks = open_store(spark, at)

    def join(batches):
        for b in batches:
            ids = [np.concatenate([unpack(p["width"], p["payload"]) for p in sorted(r, key=lambda p: p["seq"])]).astype("i4").tolist() for r in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "ids"])

    parts = _recipe_parts(recipes).join(chunks, "key")
    docs = parts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("seq", "width", "payload")).alias("parts"))
    return docs.mapInArrow(join, "doc_id long, row long, ids array<int>")


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """One row for each recipe file, computed from it: its name, documents, ids, and a Merkle root over its documents' roots."""

    def roots(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        return pa.table({"file": t.column("file")[:1], "documents": pa.array([t.num_rows], pa.int64()), "tokens": pa.array([sum(t.column("n_tokens").to_pylist())], pa.int64()), "root": [merkle(t.column("root").to_pylist()).hex()]})

    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return open_store(spark, at)[0].select(name.alias("file"), "doc_id", "row", "n_tokens", "root").groupBy("file").applyInArrow(roots, MANIFEST)


def verify(spark: SparkSession, at: str) -> None:
    """Raise unless the recipe files are those, whole and unchanged, of the store's written manifest."""
    listed, now = spark.read.schema(MANIFEST).parquet(f"{at}/manifest"), manifest(spark, at)
    both = listed.withColumn("_listed", F.lit(1)).join(now.withColumn("_now", F.lit(1)), listed.columns, "full_outer")
    if both.where("_listed is null or _now is null").limit(1).count():
        raise ValueError(f"the recipes under {at} are not those of their manifest")


def op4_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, fresh_path(spark, "store"))
    return read_digests(spark, at)
