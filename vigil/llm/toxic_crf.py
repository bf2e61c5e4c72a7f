"""Operator 10: toxicity by a linear-chain conditional random field.

Tokens are tagged 0 or 1. A token's features are its word and its leading bytes, hashed; those of the training
windows have weights; a 2 x 2 table of transitions joins neighbours. Labels mark documents only, so tokens get theirs first:
a feature whose presence singles out toxic documents of the training sample marks its tokens there, and
all tokens of documents that are not toxic are 0. The field is trained on windows of such tokens by gradient
ascent on the exact log-likelihood (forward-backward). A whole text is scored by forward-backward over all its
tokens; the marginals of tag 1 give the offending offsets, and their strongest and total evidence give
the document's score through a logistic curve fitted on the sample.

Learning uses about ``SAMPLE`` toxic documents and ``CLEAN`` times as many others, picked by a hash of their id, from the training fold
(``crc32(doc_id) % 4 <> 2``). Of each it takes whole texts for the marks and for the curve, and at most ``WINDOWS_PER_DOC`` windows of
``WINDOW`` tokens for the field itself, so that training fits the driver.

Defined results: null and empty texts, and all texts if no training label is 1, get the score of a text
without tokens; documents with several label rows count with the largest; labels of unknown documents and
null labels are ignored; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, crc_mod, filtered, staged, table, trimmed

SAMPLE = 4_000
#: Documents without toxicity for each toxic one's share of the sample.
CLEAN = 3
FEATURES = 1 << 31
PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT = 4, 2
#: A feature marks tokens if its documents are toxic in so large a share, and if the log-likelihood ratio
#: against the sample's own share is so high that chance hardly gives it to any feature of the sample.
PRECISION, RATIO = 0.9, 20.0
WINDOW = 24
WINDOWS_PER_DOC = 4
EPOCHS = 60
LIMIT = 0.3
SPAN = 0.5

_EDGE = b".,;:!?\"'()[]{}<>%$&*#@-_/\\|~`+=^"
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def features(token: bytes) -> tuple[int, ...]:
    """Hashed features of a lower-cased token."""
    w = token.strip(_EDGE) or token
    h = xxhash.xxh32_intdigest
    return (h(w, 1) % FEATURES, *[h(w[:n], 2 + n) % FEATURES for n in PREFIXES if len(w) >= n])


class Emission(dict):
    """Token -> score of tag 1 against tag 0, with a bound on what is remembered."""

    def __init__(self, weights: tuple[dict[int, float], float]):
        super().__init__()
        self.weights, self.bias = weights

    def __missing__(self, token: bytes) -> float:
        if len(self) >= 200_000:
            self.clear()
        get = self.weights.get
        v = self.bias + sum([get(f, 0.0) for f in features(token)])
        if len(token) <= 32:
            self[token] = v
        return v


def _through(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the next tag from log-odds of this one, through the transitions."""
    return np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])


def marginals(emissions: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
    """Exact log-odds of tag 1 for each token of each text, all texts side by side."""
    n = len(emissions)
    order = sorted(range(n), key=lambda i: -len(emissions[i]))
    size = np.array([len(emissions[i]) for i in order])
    longest = int(size[0]) if n else 0
    if not longest:
        return [np.zeros(0) for _ in range(n)]
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than step
    start = np.concatenate(([0], np.cumsum(alive)))
    flat = np.empty(start[-1])
    for r, i in enumerate(order):
        flat[start[: len(emissions[i])] + r] = emissions[i]
    ahead = np.empty_like(flat)
    x = flat[: alive[0]]
    ahead[: alive[0]] = x
    for s in range(1, longest):
        x = flat[start[s] : start[s + 1]] + _through(x[: alive[s]], t)
        ahead[start[s] : start[s + 1]] = x
    back = np.zeros(alive[0])
    out = ahead.copy()
    u = t.T
    for s in range(longest - 2, -1, -1):
        m = alive[s + 1]
        back[:m] = _through(flat[start[s + 1] : start[s + 1] + m] + back[:m], u)
        out[start[s] : start[s] + m] += back[:m]
    res: list = [None] * n
    for r, i in enumerate(order):
        res[i] = out[start[: len(emissions[i])] + r]
    return res


def evidence(logits: np.ndarray) -> tuple[float, float]:
    """Strongest log-odds, and log of the expected number of tagged tokens."""
    if not len(logits):
        return -12.0, -12.0
    top = float(logits.max())
    total = float((1 / (1 + np.exp(-np.clip(logits, -30, 30)))).sum())
    return max(-12.0, min(12.0, top)), max(-12.0, math.log(total + 1e-12))


def _doc_features(batches):
    for b in (part for whole in batches for part in by_bytes(whole)):
        for tox, raw in zip(b.column("toxic").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            seen = {f for w in set((raw or b"").lower().split()) for f in features(w)}
            if seen:
                k = np.fromiter(seen, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), tox, dtype=np.int64)), pa.array(np.full(len(k), 1 - tox, dtype=np.int64))], ["f", "one", "zero"])


def _windows(marks: frozenset):
    """Features and tags of windows: up to WINDOWS_PER_DOC around marked tokens of a toxic text, as many dealt over any other."""

    k = 1 + len(PREFIXES)

    def run(batches):
        for b in (part for whole in batches for part in by_bytes(whole)):
            f, y = [], []
            for tox, raw in zip(b.column("toxic").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ws = (raw or b"").lower().split()
                if not ws:
                    continue
                if tox:
                    tags = [any(x in marks for x in features(w)) for w in ws]
                    hits = [i for i, t in enumerate(tags) if t]
                    starts = [max(0, i - WINDOW // 2) for i in hits[:: max(1, len(hits) // WINDOWS_PER_DOC)][:WINDOWS_PER_DOC]]
                else:
                    n = min(WINDOWS_PER_DOC, -(-len(ws) // WINDOW))
                    step = len(ws) / n
                    starts = [int(k * step + xxhash.xxh32_intdigest(raw, k) % max(1, int(step - WINDOW) + 1)) for k in range(n)]
                for s in starts:
                    part = [features(w) for w in ws[s : s + WINDOW]]
                    f.append([v for x in part for v in [*x, *[-1] * (k - len(x))]] + [-1] * (k * (WINDOW - len(part))))
                    y.append([int(bool(tox) and any(v in marks for v in x)) for x in part] + [-1] * (WINDOW - len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))], ["f", "y"])

    return run


def train(f: np.ndarray, tag: np.ndarray) -> tuple[tuple[dict[int, float], float], np.ndarray]:
    """(Weights of features, bias) and transitions, by Adam on the log-likelihood.

    ``f`` (window, token, feature): -1 stands for no feature; ``tag`` (window, token): -1 after a window's end.
    """
    n, _, k = f.shape
    on = (tag >= 0).astype(float)
    tag = np.maximum(tag, 0)
    names, f = np.unique(f, return_inverse=True)
    f = f.reshape(n, WINDOW, k)
    blank = int(names[0] == -1)  # the slot of no feature is the first
    w = np.zeros(len(names) + 1)
    w[-1] = -2.0
    t = np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for epoch in range(1, EPOCHS + 1):
        e = w[f].sum(axis=2) + w[-1]
        em = np.stack([np.zeros_like(e), e], axis=2)
        a = np.empty_like(em)
        a[:, 0] = em[:, 0]
        for s in range(1, WINDOW):
            nxt = em[:, s] + np.logaddexp(a[:, s - 1, :1] + t[0], a[:, s - 1, 1:] + t[1])
            a[:, s] = np.where(on[:, s, None] > 0, nxt, a[:, s - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        bwd = np.zeros_like(em)
        gt = np.zeros_like(t)
        for s in range(WINDOW - 2, -1, -1):
            v = em[:, s + 1] + bwd[:, s + 1]
            prev = np.logaddexp(t[:, 0][None, :] + v[:, :1], t[:, 1][None, :] + v[:, 1:])
            live = on[:, s + 1, None] > 0
            bwd[:, s] = np.where(live, prev, bwd[:, s + 1])
            pair = np.exp(a[:, s, :, None] + t + v[:, None, :] - z[:, None, None]) * on[:, s + 1, None, None]
            gt -= pair.sum(axis=0)
        np.add.at(gt, (tag[:, :-1][on[:, 1:] > 0], tag[:, 1:][on[:, 1:] > 0]), 1.0)
        p = np.exp(a[:, :, 1] + bwd[:, :, 1] - z[:, None])
        d = (tag - p) * on
        gw = np.bincount(f.ravel(), weights=np.repeat(d.ravel(), k), minlength=len(w))
        gw[-1] = d.sum()
        gw[:-1] -= 0.05 * w[:-1]
        gt -= 0.05 * t
        for v, g, m, s2 in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            s2 += 0.01 * (g * g - s2)
            v += 0.2 * (m / (1 - 0.9**epoch)) / (np.sqrt(s2 / (1 - 0.99**epoch)) + 1e-8)
        w[:blank] = 0.0
    return (dict(zip(names[blank:].tolist(), w[blank:-1].tolist(), strict=True)), float(w[-1])), t


def curve(points: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression on the two figures of ``evidence`` by Newton steps; slopes are never negative."""
    x = np.concatenate([points, np.ones((len(points), 1))], axis=1)
    b = np.array([0.5, 0.5, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.5 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        b = b + np.linalg.solve(h, g)
        b[:2] = np.maximum(b[:2], 0.0)
    return b


class Model:
    def __init__(self, weights: tuple, transitions: np.ndarray, line: np.ndarray):
        self.weights, self.transitions, self.line = weights, transitions, line

    def score(self, points: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(points @ self.line[:2] + self.line[2], -30, 30)))


def _logits(raws: list, emission: Emission, t: np.ndarray) -> list[np.ndarray]:
    get = emission.__getitem__
    return marginals([np.fromiter(map(get, (r or b"").lower().split()), dtype=np.float64) for r in raws], t)


def _points(weights: tuple, t: np.ndarray):
    def run(batches):
        emission = Emission(weights)
        for b in (part for whole in batches for part in by_bytes(whole)):
            pts = [evidence(x) for x in _logits(b.column("text").cast(pa.binary()).to_pylist(), emission, t)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([p for p, _ in pts], pa.float64()), pa.array([q for _, q in pts], pa.float64())], ["toxic", "top", "total"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the training fold; None if one of the labels does not occur there."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    marked = marked.where(crc_mod("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30))
    keep = F.when(F.col("toxic") == 1, F.lit(int(min(1.0, sample / sizes[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, CLEAN * sample / sizes[0]) * (1 << 30))))
    picked = F.broadcast(marked.where(draw < keep))  # about (1 + CLEAN) x sample rows
    fit = staged(docs.where("text is not null").join(picked, "doc_id").select("toxic", "text"), "toxic_sample")
    n = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    base = n[1] / (n[0] + n[1])
    stats = fit.mapInArrow(trimmed(_doc_features), "f long, one long, zero long").groupBy("f").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    share = F.col("one") / (F.col("one") + F.col("zero"))
    ratio = F.col("one") * F.log(share / base) + F.when(F.col("zero") > 0, F.col("zero") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    true_share = F.col("one") * sizes[1] / n[1] / (F.col("one") * sizes[1] / n[1] + F.col("zero") * sizes[0] / n[0])
    marks = frozenset(r["f"] for r in stats.where((F.col("one") > 0) & (true_share >= PRECISION) & (ratio >= RATIO)).select("f").collect())  # bounded by the sample
    rows = fit.mapInArrow(trimmed(_windows(marks)), "f array<int>, y array<int>").toArrow()
    if not rows.num_rows:
        return None
    flat = lambda c, *shape: rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, WINDOW, *shape)
    w, t = train(flat("f", 1 + len(PREFIXES)), flat("y"))
    got = fit.mapInArrow(trimmed(_points(w, t)), "toxic int, top double, total double").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    return Model(w, t, curve(np.stack([got.column("top").to_numpy(), got.column("total").to_numpy()], axis=1), y, weight / weight.mean()))


def offsets(raw: bytes, logits: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Character offsets of tokens tagged 1, neighbours joined."""
    hits = np.flatnonzero(logits >= least)
    if not len(hits):
        return []
    wanted, out, last = set(hits.tolist()), [], -2
    place = chars = 0
    for i, m in enumerate(_TOKEN.finditer(raw)):
        if i in wanted:
            chars += len(raw[place : m.start()].decode("utf-8", "replace"))
            end = chars + len(m[0].decode("utf-8", "replace"))
            place = m.start()
            if last == i - 1:
                out[-1] = (out[-1][0], end)
            else:
                out.append((chars, end))
            last = i
    return out


def _score(model: Model | None):
    def run(batches):
        emission = Emission(model.weights) if model else None
        least = math.log(SPAN / (1 - SPAN))
        for b in (part for whole in batches for part in by_bytes(whole)):
            raws = b.column("text").cast(pa.binary()).to_pylist()
            if model:
                logits = _logits(raws, emission, model.transitions)
                score = model.score(np.array([evidence(x) for x in logits])).tolist()
                spans = [offsets(r or b"", x, least) for r, x in zip(raws, logits, strict=True)]
            else:
                score, spans = [0.0] * len(raws), [[] for _ in raws]
            flat = pa.array([[{"start": a, "end": z} for a, z in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array([int(x >= LIMIT) for x in score], pa.int32()), flat], ["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def tag(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (offending character offsets) of each row of ``docs`` (doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(base, labels, sample)
    asked = base.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return asked.mapInArrow(trimmed(_score(model)), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int>>")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, sample)
    if model is None:
        return docs

    def make():
        emission = Emission(model.weights)

        return lambda raws: (model.score(np.array([evidence(x) for x in _logits(raws, emission, model.transitions)])) < LIMIT).tolist()

    return filtered(docs, make)


def op10_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
