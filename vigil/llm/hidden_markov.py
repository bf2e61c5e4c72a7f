"""Operator 8: a hidden Markov language model over words.

Every word has a class: the ``TOP`` most frequent words have one each, all others share ``HASHED`` classes by
crc32, and the end of a document is a class. States emit classes; a class gives a word by its (plus-one) share
of the class in the whole training corpus, in which all unknown words are one more word. Baum-Welch trains start, transition and emission
probabilities: in each round every partition adds up expected counts over all its training documents, the
counts are summed in two steps, and the driver normalises them. A text's score is the exact log10 probability
of its words and its end, by scaled forward recursion over the whole text.

Data flow: tasks cut documents into blocks of about ``BLOCK`` bytes and stage each as its distinct words, their training
counts and the documents as word numbers. Counts are summed by word over all blocks; where a block's own count
is not the sum, the sum is joined back to it (the most frequent words' counts are sent along instead), so no task
needs the whole vocabulary. Training runs over stretches of ``STRETCH``
tokens (stretches inside a document have their own start distribution); scoring does not.

Defined results: null and empty texts are their end alone; with no training documents N = V = 0, and the
score is the base score; repeated rows each count and each give a row; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import by_bytes, crc_mod, discard, staged, table, trimmed, where

STATES, TOP, HASHED = 8, 1_023, 1_024
END = TOP + HASHED
CLASSES = END + 1
ROUNDS = 5
STRETCH = 64
BLOCK = 6 << 20
FOLDS, HELD_OUT = 7, 2
ZSTD = pa.Codec("zstd", compression_level=1)
#: Bytes of classes (two for each token) of the documents that are worked on together.
HELD_CLASSES = 2 << 20
#: Added to every expected count.
PRIOR = 0.01


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, lowest first, as many as the largest needs, compressed; the first byte is their number."""
    wide = numbers.astype("<u4").view("u1").reshape(-1, 4)
    k = next((k for k in (4, 3, 2) if len(wide) and wide[:, k - 1].any()), 1)
    return bytes([k]) + ZSTD.compress(np.ascontiguousarray(wide[:, :k].T), asbytes=True)


def from_planes(raw: bytes, n: int) -> np.ndarray:
    k, wide = raw[0], np.zeros((n, 4), dtype="u1")
    wide[:, :k] = np.frombuffer(ZSTD.decompress(raw[1:], k * n), "u1").reshape(k, n).T
    return wide.view("<u4").ravel()


def _blocks(batches):
    """Rows come with doc_id, train, text; one row for each block."""
    held: list = []
    size = made = 0
    part = TaskContext.get().partitionId() << 32  # blocks are staged, so a number once given stays
    fields = ["block", "words", "counts", "docs", "train", "lengths", "tokens"]

    def emit():
        words: list[bytes] = []
        lengths = []
        for _, _, t in held:
            own = (t or b"").lower().split()
            words += own
            lengths.append(len(own))
        coded = pa.array(words, pa.binary()).dictionary_encode()
        flat, names = coded.indices.to_numpy(), coded.dictionary
        trained = np.repeat(np.array([bool(t) for _, t, _ in held], dtype=bool), lengths)
        n = np.bincount(flat[trained], minlength=len(names))
        order = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([part + made], pa.int64()), one(names.take(pa.array(order))), one(pa.array(n[order], pa.int64())), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([[t for _, t, _ in held]], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([planes(rank[flat])], pa.binary())],
            fields,
        )

    for b in batches:
        for row in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.append(row)
            size += len(row[2] or b"") + 64
            if size >= BLOCK:
                yield emit()
                held, size, made = [], 0, made + 1
    if held:
        yield emit()


BLOCK_SCHEMA = "block long, words array<binary>, counts array<long>, docs array<long>, train array<boolean>, lengths array<int>, tokens binary"


class Vocabulary:
    """Classes, and totals of the training corpus."""

    def __init__(self, top: list[bytes], tokens: np.ndarray, distinct: np.ndarray):
        self.top = {w: i for i, w in enumerate(top)}
        self.tokens, self.distinct = tokens, distinct
        self.n, self.v = int(tokens.sum()), int(distinct.sum())

    def classes(self, words: list[bytes]) -> np.ndarray:
        get = self.top.get
        crc = zlib.crc32
        return np.fromiter((c if (c := get(w)) is not None else TOP + crc(w) % HASHED for w in words), dtype=np.int64, count=len(words))

    def within(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class."""
        share = np.log10((c + 1) / (self.tokens[cls] + self.distinct[cls] + 1))
        return np.where((cls < TOP) | (cls == END), 0.0, share)

    def base(self, c) -> np.ndarray:
        return np.log10((np.asarray(c) + 1) / (self.n + self.v + 1))


#: Words that may come to the driver at once while the most frequent are sought.
ASKED = 100_000


def frequent(counts: DataFrame, most: int = TOP, asked: int = ASKED) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words with their counts, ties by word.

    A histogram of counts (by ratio, so it has a few hundred rows) says from which count on words can matter. If
    ties leave too many, 64 groups by hash rank their own first.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    hist = sorted(((r["k"], r["n"]) for r in counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    have, low = 0, None
    for low, n in hist:
        have += n
        if have >= most:
            break
    some = counts if low is None else counts.where(step >= low)
    if have > asked:
        group = F.pmod(F.xxhash64("word"), F.lit(64))
        rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), "word"))
        some = some.withColumn("_rank", rank).where(F.col("_rank") <= most)
    rows = [(bytes(r["word"]), r["c"]) for r in some.select("word", "c").collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0]))[:most]


def vocabulary(counts: DataFrame, documents: int, most: int = TOP) -> Vocabulary:
    """``counts`` (word, c): words of the training corpus with c > 0; ``documents``: its ends."""
    top = frequent(counts, most)
    cls = F.lit(TOP) + F.pmod(F.crc32("word"), F.lit(HASHED))
    tokens, distinct = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("t"), F.count("*").alias("d")).collect():  # HASHED rows at most
        tokens[r["k"]], distinct[r["k"]] = r["t"], r["d"]
    for i, (word, c) in enumerate(top):
        own = TOP + zlib.crc32(word) % HASHED
        tokens[own] -= c
        distinct[own] -= 1
        tokens[i], distinct[i] = c, 1
    if documents:
        tokens[END], distinct[END] = documents, 1
    return Vocabulary([w for w, _ in top], tokens, distinct)


def _documents(vocab: Vocabulary):
    def run(batches):
        end_c = int(vocab.tokens[END])
        for b in batches:
            for i in range(b.num_rows):
                words = b.column("words")[i].values
                words = words.to_pylist() if words is not None else []
                own = b.column("counts")[i].values  # a word of no other block has its count from here
                c = own.to_numpy().copy() if own is not None else np.zeros(0, dtype=np.int64)
                at, sums = b.column("at")[i].values, b.column("sums")[i].values
                if at is not None and len(at):
                    c[at.to_numpy()] = sums.to_numpy()
                cls = vocab.classes(words)
                c = np.where(cls < TOP, vocab.tokens[np.minimum(cls, TOP - 1)], c)
                base, within, known = vocab.base(c), vocab.within(cls, c), c > 0
                lengths = b.column("lengths")[i].values.to_numpy()
                tokens = from_planes(b.column("tokens")[i].as_py(), int(lengths.sum()))
                stops = np.cumsum(lengths)
                running = lambda x: np.concatenate(([0], np.cumsum(x[tokens])))
                sums = [running(x) for x in (base, within, known.astype(np.int64))]
                part = [s[stops] - s[stops - lengths] for s in sums]
                u2 = cls.astype("<u2")[tokens]
                raw = [u2[s - n : s].tobytes() + END.to_bytes(2, "little") for s, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("docs")[i].values, b.column("train")[i].values, pa.array(lengths + 1, pa.int64()), pa.array(part[2] + int(end_c > 0), pa.int64()), pa.array(part[0] + float(vocab.base(end_c)), pa.float64()), pa.array(part[1], pa.float64()), pa.array(raw, pa.binary())],
                    ["doc_id", "train", "n_tokens", "n_known", "base_score", "within", "classes"],
                )

    return run


class Model:
    def __init__(self, first, inner, move, emit):
        self.first, self.inner, self.move, self.emit = first, inner, move, emit

    @classmethod
    def start(cls, tokens: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emit = (tokens + PRIOR) * rng.gamma(2.0, 0.5, (STATES, CLASSES))
        move = np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)
        even = np.full(STATES, 1 / STATES)
        return cls(even, even.copy(), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def of_counts(cls, flat: np.ndarray) -> Model:
        k = STATES
        first, inner, move, emit = flat[:k], flat[k : 2 * k], flat[2 * k : 2 * k + k * k].reshape(k, k), flat[2 * k + k * k :].reshape(k, CLASSES)
        norm = lambda x: (x + PRIOR) / (x + PRIOR).sum(axis=-1, keepdims=True)
        return cls(norm(first), norm(inner), norm(move), norm(emit))


WIDTH = 2 * STATES + STATES * STATES + STATES * CLASSES


def expected(model: Model, obs: np.ndarray, is_first: np.ndarray, out: np.ndarray) -> float:
    """Add the expected counts of stretches (rows; -1 after their end) to ``out``; returns the log-likelihood.

    Rows are put in order of length, so those that still go on at a step are the last ones, and states are rows of
    every array: sums over states and products with the transitions then run along memory.
    """
    k, size = STATES, (obs >= 0).sum(axis=1)
    order = np.argsort(size, kind="stable")
    obs, is_first, size = np.ascontiguousarray(obs[order].T), is_first[order], size[order]
    t, n = obs.shape
    dead = np.searchsorted(size, np.arange(t), side="right").tolist()  # rows that end before a step
    emit, forward, back = model.emit, np.ascontiguousarray(model.move.T), model.move
    alpha, weight, scale, ll = [], [], [], 0.0
    x = np.where(is_first, model.first[:, None], model.inner[:, None])[:, dead[0] :]
    for s in range(t):
        if s:
            x = forward @ alpha[-1][:, dead[s] - dead[s - 1] :]
        e = np.take(emit, obs[s, dead[s] :], axis=1, mode="clip")
        x = x * e
        z = x.sum(axis=0)
        ll += float(np.log(z).sum())
        alpha.append(x / z)
        weight.append(e)
        scale.append(z)
    pairs, gamma = np.zeros((k, k)), [None] * t
    beta = np.ones((k, n - dead[t - 1]))
    gamma[t - 1] = alpha[t - 1]
    for s in range(t - 2, -1, -1):
        live = dead[s + 1] - dead[s]
        x = weight[s + 1] * beta / scale[s + 1]
        pairs += alpha[s][:, live:] @ x.T
        beta = np.ones((k, n - dead[s]))
        beta[:, live:] = back @ x
        gamma[s] = alpha[s] * beta
    first = is_first[dead[0] :]
    out[:k] += gamma[0][:, first].sum(axis=1)
    out[k : 2 * k] += gamma[0][:, ~first].sum(axis=1)
    out[2 * k : 2 * k + k * k] += (pairs * model.move).ravel()
    flat, g = np.concatenate([obs[s, dead[s] :] for s in range(t)]), np.concatenate(gamma, axis=1)
    for j in range(k):
        at = 2 * k + k * k + j * CLASSES
        out[at : at + CLASSES] += np.bincount(flat, weights=g[j], minlength=CLASSES)
    return ll


def stretches(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of STRETCH classes of all documents, and which start a document."""
    parts, first = [], []
    for raw in rows:
        x = np.frombuffer(raw, "<u2").astype(np.int32)
        n = -(-len(x) // STRETCH)
        padded = np.full(n * STRETCH, -1, dtype=np.int32)
        padded[: len(x)] = x
        parts.append(padded.reshape(n, STRETCH))
        first += [True] + [False] * (n - 1)
    return np.concatenate(parts), np.array(first)


def _expect(model: Model, step: int = 2_048):
    def run(batches):
        out = np.zeros(WIDTH)
        ll = 0.0
        for b in batches:
            for part in by_bytes(b, "classes", HELD_CLASSES):
                obs, first = stretches(part.column("classes").to_pylist())
                short = (obs >= 0).sum(axis=1)
                order = np.argsort(short, kind="stable")
                for s in range(0, len(order), step):
                    some = order[s : s + step]
                    ll += expected(model, obs[some, : int(short[some].max())], first[some], out)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([out.astype("<f8").tobytes()], pa.binary()), "ll": [ll]})

    return run


def _sum(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, "<f8") for x in t.column("sums").to_pylist()], axis=0)
    return pa.table({"sums": pa.array([total.astype("<f8").tobytes()], pa.binary()), "ll": [sum(t.column("ll").to_pylist())]})


def baum_welch(docs: DataFrame, tokens: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Train on ``docs`` (classes binary); also the log-likelihoods before each round."""
    model, lls = Model.start(tokens), []
    for _ in range(rounds):
        sums = docs.select("classes").mapInArrow(trimmed(_expect(model)), "sums binary, ll double")
        met = sums.withColumn("g", F.spark_partition_id() % 16).groupBy("g").applyInArrow(_sum, "sums binary, ll double").collect()
        model = Model.of_counts(np.sum([np.frombuffer(r["sums"], "<f8") for r in met], axis=0))
        lls.append(sum(r["ll"] for r in met))
    return model, lls


def forward(model: Model, rows: list[bytes]) -> np.ndarray:
    """log10 probability of each class sequence, all side by side."""
    n = len(rows)
    seqs = [np.frombuffer(r, "<u2") for r in rows]
    order = sorted(range(n), key=lambda i: -len(seqs[i]))
    size = np.array([len(seqs[i]) for i in order])
    longest = int(size[0]) if n else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    start = np.concatenate(([0], np.cumsum(alive))).astype(np.int64)
    flat = np.empty(start[-1], dtype=np.uint16)
    for r, i in enumerate(order):
        flat[start[: len(seqs[i])] + r] = seqs[i]
    emit = model.emit.T.copy()
    logs, x = np.zeros(n), None
    for s in range(longest):
        prior = np.broadcast_to(model.first, (n, STATES)) if s == 0 else x[: alive[s]] @ model.move
        x = prior * emit[flat[start[s] : start[s + 1]]]
        z = x.sum(axis=1)
        x /= z[:, None]
        logs[: alive[s]] += np.log10(z)
    total = np.empty(n)
    total[order] = logs
    return total


def _score(model: Model, tokens: int):
    def run(batches):
        for b in (part for whole in batches for part in by_bytes(whole, "classes", HELD_CLASSES)):
            ll = forward(model, b.column("classes").to_pylist())
            cols = [b.column("doc_id"), b.column("held"), b.column("n_tokens"), b.column("n_known"), pa.array([tokens] * b.num_rows, pa.int64()), b.column("base_score")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ll + b.column("within").to_numpy(), pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    train = F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(True))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("string").alias("text"))
    blocks = staged(base.mapInArrow(trimmed(_blocks), BLOCK_SCHEMA), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = staged(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0))).first()[0]
    vocab = vocabulary(counts, ends)
    top = spark.createDataFrame([(bytearray(w),) for w in vocab.top], "word binary")  # TOP rows at most
    rare = words.join(F.broadcast(top), "word", "left_anti")  # the counts of frequent words are in the vocabulary
    found = rare.join(counts, "word").where("c <> n").groupBy("block").agg(F.collect_list("pos").alias("at"), F.collect_list("c").alias("sums"))
    per_doc = staged(blocks.join(found, "block", "left").mapInArrow(trimmed(_documents(vocab)), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, within double, classes binary"), "classes")
    discard(spark, where(blocks))
    discard(spark, where(counts))
    if not ends:
        return per_doc.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", F.col("base_score").alias("score"))
    model, _ = baum_welch(per_doc.where("train"), vocab.tokens, rounds)
    asked = per_doc.select("doc_id", (~F.col("train")).alias("held"), "n_tokens", "n_known", "base_score", "within", "classes")
    return asked.mapInArrow(trimmed(_score(model, vocab.n)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
