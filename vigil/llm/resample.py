"""Operator 12: target-distribution importance resampling over a vectorised byte automaton.

A text's features are its words and its pairs of neighbouring words. Tasks read texts as Arrow UTF-8 buffers: a lookup
table says of every byte whether it belongs to a word, differences of these marks give all word boundaries at once,
and the table-driven CRC of all words of a chunk goes on byte by byte in step, a pair's from where its first word's
ended. The corpus and the target are each a histogram over ``BUCKETS``; a bucket's gain is the
logarithm of the target's share over the corpus', a document's weight the mean gain of its features, and Gumbel noise
from a hash of doc_id makes the highest scores a draw without replacement in proportion to the weights' exponentials.

Data flow: one pass over the corpus for the histogram (summed by bucket, ``BUCKETS`` rows reach the driver), one for the
weights; then the rows of a few longs are ranked by range partitions, so no task sorts them all. Chunks of ``CHUNK``
bytes bound memory: they end between words, and what is carried over is the last word's register.

Defined results: null and texts without words have no features and weight 0; a null doc_id is hashed as no digits, ranks
before others of its score and has a row as any; repeated rows each count and each have a row; an empty corpus gives no rows; an
empty target has T = 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, discard, running, staged, table, trimmed, where

BUCKETS = 10_000
#: Documents with fewer words are never drawn; percentage drawn of the others; salt of the noise.
LEAST_WORDS, PERCENT, SALT = 20, 25, 7
#: Bytes that are worked on together, and bytes of a word that go on in step; a longer word's end is left to zlib.
CHUNK, STEPS = 1 << 20, 48

_byte = np.arange(256)
#: Bytes of words: digits, letters and everything beyond ASCII.
WORD = (_byte >= 48) & (_byte <= 57) | (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122) | (_byte >= 128)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


CRC = _crc_table()


def advance(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, register: np.ndarray) -> np.ndarray:
    """CRC registers after the words at ``starts`` (of ``sizes`` bytes) of ``low``, from ``register`` on."""
    order = np.argsort(-sizes, kind="stable")
    at, left, out = starts[order], sizes[order], register[order]
    longer = len(left) - np.searchsorted(left[::-1], np.arange(STEPS + 1), side="right")
    for k in range(STEPS):
        n = longer[k]
        if not n:
            break
        r = out[:n]
        out[:n] = CRC[(r ^ low[at[:n] + k]) & 255] ^ (r >> np.uint32(8))
    for i in range(longer[STEPS]):
        rest = low[at[i] + STEPS : at[i] + left[i]]
        out[i] = zlib.crc32(rest, int(out[i] ^ ONES)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(raw: np.ndarray, begins: np.ndarray, chunk: int = CHUNK):
    """(documents of words, documents of features, buckets of features) of the texts that lie side by side in ``raw``
    and begin at ``begins``, chunk by chunk. A document is the place of its text."""
    at, size = 0, chunk
    register, last = np.zeros(1, dtype=np.uint32), np.array([-1])
    while at < len(raw):
        end = min(len(raw), at + size)
        inside = WORD[raw[at:end]]
        cuts = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at
        if end < len(raw) and inside[-1] and WORD[raw[end]]:  # a word may go on: end where one ends
            gap = np.flatnonzero(~inside)
            stop = max(gap[-1] + 1 if len(gap) else 0, cuts[-1] if len(cuts) else 0)
            if not stop:
                size *= 2
                continue
            end, inside, cuts = at + stop, inside[:stop], cuts[cuts < stop]
        before = np.concatenate(([False], inside[:-1]))
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False]))
        after[cuts[cuts > 0] - 1] = False
        sizes = np.flatnonzero(inside & ~after) + 1 - starts
        if len(starts):
            low = LOWER[raw[at:end]]
            doc = np.searchsorted(begins, starts + at, side="right") - 1
            own = advance(low, starts, sizes, np.full(len(starts), ONES))
            previous, of = np.concatenate((register, own[:-1])), np.concatenate((last, doc[:-1]))
            pairs = np.flatnonzero(of == doc)
            blank = previous[pairs]
            blank = CRC[(blank ^ np.uint32(32)) & 255] ^ (blank >> np.uint32(8))
            both = advance(low, starts[pairs], sizes[pairs], blank)
            register, last = own[-1:], doc[-1:]
            yield doc, np.concatenate((doc, doc[pairs])), (np.concatenate((own, both)) ^ ONES) % np.uint32(BUCKETS)
        at, size = end, chunk


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins; null texts are empty."""
    x = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = x.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds[:-1] - bounds[0]


def _histogram(batches):
    n = np.zeros(BUCKETS, dtype=np.int64)
    for whole in batches:
        for b in by_bytes(whole):
            for _, _, buckets in features(*_buffer(b.column("text"))):
                n += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])


def histogram(texts: DataFrame) -> list[int]:
    """How often each bucket occurs in ``texts`` (text)."""
    each = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_histogram), "bucket long, n long")
    out = [0] * BUCKETS
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """The gain of every bucket in thousandths."""
    s, t = sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + BUCKETS) / (float(a + 1) * float(t + BUCKETS)))) for a, b in zip(corpus, target, strict=True)], dtype=np.int64)


def noise(doc_id: int | None, salt: int) -> int:
    """Gumbel noise in thousandths from a hash of the id."""
    h = int(hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, salt: int):
    def run(batches):
        for whole in batches:
            for b in by_bytes(whole):
                words, n, total = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
                for doc, of, buckets in features(*_buffer(b.column("text"))):
                    words += np.bincount(doc, minlength=b.num_rows)
                    n += np.bincount(of, minlength=b.num_rows)
                    np.add.at(total, of, gain[buckets])
                weight = total // np.maximum(n, 1)
                ids = b.column("doc_id")
                score = weight + np.fromiter((noise(i, salt) for i in ids.to_pylist()), np.int64, b.num_rows)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (words, n, weight, score)]], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, salt: int = SALT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); rank is null where not
    drawn. ``target`` (text) is what the draw shall resemble."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(histogram(base), histogram(target))
    scored = staged(base.mapInArrow(trimmed(_weigh(gain, salt)), "doc_id long, n_words long, n_features long, weight long, score long"), "weights")
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = percent * scored.where(fit).count() // 100
    asked = scored.where(fit).withColumn("falling", -F.col("score")).withColumn("one", F.lit(1))
    ranked = running(asked, ["falling", "doc_id", "n_features"], {"before": "one"}).withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).union(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(columns))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ``docs`` must not hold a doc_id twice."""
    own = resampled(docs, target, percent).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def op12_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_sql() -> str:
    """The same rows in DuckDB: CRCs by a fold over the bytes of each distinct feature."""
    step = "xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END)"
    eight = "acc"
    for _ in range(8):
        eight = step.replace("acc", f"({eight})") if eight != "acc" else step
    return f"""
WITH crc_table AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda acc, x: {step}) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS MATERIALIZED (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
each AS MATERIALIZED (
  SELECT side, doc_id, unnest(w) AS f FROM words
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda acc, x: xor(acc >> 8, t[xor(acc & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM each), crc_table),
placed AS MATERIALIZED (SELECT side, doc_id, bucket FROM each JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g FROM counts, sums),
weights AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SALT}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n_fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * n_fit // 100 THEN r END AS rank FROM ranked"""
