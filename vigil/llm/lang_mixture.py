"""Operator 3: language identification as inference of a multilingual mixture.

Each learned language has a likelihood of byte trigrams (hashed into a fixed table). A text is cut into
segments of ``SEGMENT`` bytes; each segment's likelihood under each language is the sum of its trigrams'
logarithms. Expectation-maximisation estimates in which proportions languages made the segments. Languages
join a document's set one by one, as long as the log-likelihood of the mixture gains more than ``PENALTY``
for each; the prediction is the language of the largest proportion.

Learning reads the language column of the training fold only, from about ``SAMPLE`` documents a language,
picked by a hash of their id (all of them where there are fewer). Prediction reads the text alone.

Defined results: null text and text without a letter give ``und`` and score 0; with no training documents
every prediction is ``und``; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, crc_mod, filtered, table, trimmed

#: Learn about so many documents of each language.
SAMPLE = 2_000
BUCKETS = 1 << 14
SEGMENT = 64
#: What one more language must add to the log-likelihood (natural logarithm).
PENALTY = 12.0
ROUNDS = 25
#: Weight of a trigram's evidence: neighbouring trigrams overlap, so each counts for a part.
EVIDENCE = 0.5
FOLDS, HELD_OUT = 4, 2

_LETTER = re.compile(rb"[A-Za-z]").search
_ANY_LETTER = re.compile(r"[^\W\d_]").search


def has_letter(raw: bytes | None) -> bool:
    return bool(raw) and (_LETTER(raw) is not None or _ANY_LETTER(raw.decode("utf-8", "replace")) is not None)


def hashed(padded: bytes) -> np.ndarray:
    """Hashed trigrams, one for each byte but the last two."""
    b = np.frombuffer(padded, dtype=np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int64)


def buckets(raw: bytes) -> np.ndarray:
    """Hashed trigrams of one padded text, one for each of its bytes."""
    return hashed(b" " + raw.lower() + b" ")


#: Bytes of a text that are hashed at a time; a multiple of SEGMENT.
PIECE = 1 << 20


def counted(raw: bytes, piece: int = PIECE) -> np.ndarray:
    """How often each bucket occurs in a text."""
    padded, out = b" " + raw.lower() + b" ", np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), piece):
        out += np.bincount(hashed(padded[at : at + piece + 2]), minlength=BUCKETS)
    return out


def segments(raw: bytes, model: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Log-likelihoods of a long text's segments, hashed piece by piece."""
    padded, out = b" " + raw.lower() + b" ", []
    for at in range(0, len(raw), piece):
        h = hashed(padded[at : at + piece + 2])
        out.append(np.add.reduceat(model[h], np.arange(0, len(h), SEGMENT), axis=0))
    return np.concatenate(out)


def _count(batches):
    """Trigram counts of this task's sample, by language."""
    sums: dict[str, np.ndarray] = {}
    for b in (part for whole in batches for part in by_bytes(whole)):
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if raw:
                got = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                got += counted(raw)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods by (bucket, language)."""
    train = docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    picked = train.where(draw < share[F.col("lang")]).select("lang", "text")
    rows = picked.mapInArrow(trimmed(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    n = np.zeros((BUCKETS, len(langs)))
    if rows.num_rows:
        n[rows.column("bucket").to_numpy(), np.searchsorted(langs, rows.column("lang").to_numpy(zero_copy_only=False).astype(str))] = rows.column("n").to_numpy()
    p = (n + 0.5) / (n.sum(axis=0) + 0.5 * BUCKETS)
    return langs, (EVIDENCE * np.log(p)).astype(np.float32)


def mixture(ll: np.ndarray, some: list[int]) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions of a mixture of the languages ``some`` over segments (rows)."""
    x = ll[:, some]
    top = x.max(axis=1, keepdims=True)
    like = np.exp(x - top)
    pi = np.full(len(some), 1 / len(some))
    for _ in range(ROUNDS):
        joint = like * pi
        pi = np.maximum((joint / joint.sum(axis=1, keepdims=True)).mean(axis=0), 1e-9)
        pi /= pi.sum()
    return float((np.log((like * pi).sum(axis=1)) + top[:, 0]).sum()), pi


def infer(ll: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, float]:
    """Language set, proportions, and certainty of the leading language, for one document's segments."""
    total = ll.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    certain = float(1 / np.exp(np.minimum(total - total[best], 0)).sum())
    some, pi, value = [best], np.ones(1), float(total[best])
    # no mixture beats the best language of each segment
    while len(some) < ll.shape[1] and float(ll.max(axis=1).sum(dtype=np.float64)) - value > penalty:
        tries = [(mixture(ll, [*some, k]), k) for k in range(ll.shape[1]) if k not in some]
        (gain, got), k = max(tries, key=lambda t: t[0][0])
        if gain - value <= penalty:
            break
        some, pi, value = [*some, k], got, gain
    return some, pi, certain


def predict(langs: list[str], model: np.ndarray, raws: list[bytes | None], step: int = 1 << 20) -> list[tuple[str, float, list[str]]]:
    """(language, score, set) of each text."""
    out: list[tuple[str, float, list[str]]] = []
    at = 0
    while at < len(raws):
        size, end = 0, at
        while end < len(raws) and (end == at or size < step):
            size += len(raws[end] or b"")
            end += 1
        known = [r if langs and has_letter(r) else b"" for r in raws[at:end]]
        at = end
        hashes = [buckets(r) if 0 < len(r) <= PIECE else np.empty(0, dtype=np.int64) for r in known]
        starts, first, place = [], [0], 0
        for h in hashes:
            starts.append(np.arange(place, place + len(h), SEGMENT))
            first.append(first[-1] + len(starts[-1]))
            place += len(h)
        if place:
            ll = np.add.reduceat(model[np.concatenate(hashes)], np.concatenate(starts), axis=0)
        for i, r in enumerate(known):
            if not r:
                out.append(("und", 0.0, []))
                continue
            some, pi, certain = infer(ll[first[i] : first[i + 1]] if len(r) <= PIECE else segments(r, model))
            lead = int(pi.argmax())
            out.append((langs[some[lead]], float(min(1.0, pi[lead] * (certain if len(some) == 1 else 1.0))), [langs[k] for k in some]))
    return out


def _predict(langs: list[str], model: np.ndarray):
    def run(batches):
        for b in (part for whole in batches for part in by_bytes(whole)):
            got = predict(langs, model, b.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string()))], ["doc_id", "held_out", "lang_pred", "score", "langs"])

    return run


def keep_certain(docs: DataFrame, least: float, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that have a language with a score of ``least`` or more, with all their columns."""
    langs, model = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample)
    return filtered(docs, lambda: lambda raws: [name != "und" and score >= least for name, score, _ in predict(langs, model, raws)])


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs (the selected set) of each row of ``docs`` (doc_id, text, lang)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, model = learn(base, sample)
    asked = base.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return asked.mapInArrow(trimmed(_predict(langs, model)), "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>")


def op3_lang_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
