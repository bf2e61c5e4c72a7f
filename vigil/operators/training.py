"""Training of the two-head scorer: a linear model over packed token ids, by gradients summed over partitions.

One head tells two classes apart, the positive one with a weight of its own, the other the categories. A round is one pass: every
partition adds up the gradient of its rows, sums are added in two steps, and the driver takes one step on a vector of
a fixed size. Rows of the validation split are judged in the same pass, by the weights that the round began with; the weights
of the best round stay. They are written and read as files, and score whole batches of rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import normalize
from vigil.operators.scoring import WIDTH, signal, token_ids
from vigil.plans.staging import ensure_checkpoint_dir
from vigil.sources import rules

# Fixed value: what a mistake on a positive row weighs
POSITIVE_WEIGHT = 1.5
#: Hashed ids; rounds; step; pull towards 0.
IDS, ROUNDS, STEP, DECAY = 8_192, 24, 0.2, 1e-5
BINARY, CATEGORIES = 2, len(rules.CATEGORIES)
OUT = BINARY + CATEGORIES


def packed(rows: DataFrame, ids: int = IDS) -> DataFrame:
    """ids (the first WIDTH), y, category (its place), is_val of ``rows`` (text, label, category, is_val)."""
    names = F.array(*map(F.lit, rules.CATEGORIES))
    tokens = token_ids(normalize(F.col("text")), ids, WIDTH)
    place = F.array_position(names, F.col("category")) - 1
    out = rows.where("label IN (0, 1) AND text IS NOT NULL").select(tokens.cast("array<int>").alias("ids"), F.col("label").cast("int").alias("y"), place.cast("int").alias("category"), F.col("is_val").cast("boolean").alias("is_val"))
    return out.where("category >= 0 AND size(ids) > 0")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(w: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, category: np.ndarray, positive: float) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(gradient, loss, weight, binary logits) of rows whose ids lie side by side in ``flat``.

    ``w`` (id, output); id 0 is the constant. A row's features are its ids' counts over the root of their number.
    """
    scale = 1 / np.sqrt(sizes)
    starts = np.cumsum(sizes) - sizes
    z = np.add.reduceat(w[flat], starts, axis=0) * scale[:, None] + w[0]
    weight = np.where(y == 1, positive, 1.0)
    d, rows = np.zeros_like(z), np.arange(len(y))
    p, q = _softmax(z[:, :BINARY]), _softmax(z[:, BINARY:])
    loss = float((-weight * np.log(p[rows, y] + 1e-12)).sum() - np.log(q[rows, category] + 1e-12).sum())
    p[rows, y] -= 1
    q[rows, category] -= 1
    d[:, :BINARY], d[:, BINARY:] = p * weight[:, None], q
    g = np.zeros_like(w)
    spread = np.repeat(d * scale[:, None], sizes, axis=0)
    for k in range(OUT):
        g[:, k] = np.bincount(flat, weights=spread[:, k], minlength=len(w))
    g[0] += d.sum(axis=0)
    return g, loss, float(len(y)), z[:, :BINARY]


def _round(w: np.ndarray, positive: float, step: int = 4_096):
    def run(batches):
        g, loss, n, table = np.zeros_like(w), 0.0, 0.0, np.zeros((2, 2))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                ids, val = b.column("ids"), b.column("is_val").to_numpy(zero_copy_only=False)
                sizes, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy().astype(np.int64)
                y, category = b.column("y").to_numpy(), b.column("category").to_numpy()
                for some in (~val, val):
                    if some.any():
                        got = gradient(w, flat[np.repeat(some, sizes)], sizes[some], y[some], category[some], positive)
                        if some is val:
                            np.add.at(table, (y[some], got[3].argmax(axis=1)), 1)
                        else:
                            g, loss, n = g + got[0], loss + got[1], n + got[2]
        yield pa.RecordBatch.from_pydict({"g": pa.array([g.tobytes()], pa.binary()), "figures": pa.array([[loss, n, *table.ravel()]], pa.list_(pa.float64()))})

    return run


def _sum(t: pa.Table) -> pa.Table:
    g = np.sum([np.frombuffer(x) for x in t.column("g").to_pylist()], axis=0)
    return pa.table({"g": pa.array([g.tobytes()], pa.binary()), "figures": pa.array([np.sum(t.column("figures").to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))})


def macro_f1(table: np.ndarray) -> float:
    """Of a 2 x 2 table (actual, predicted); a class without rows and predictions has 0."""
    f = [2 * table[k, k] / s if (s := table[k].sum() + table[:, k].sum()) else 0.0 for k in (0, 1)]
    return float(np.mean(f))


def train(rows: DataFrame, rounds: int = ROUNDS, ids: int = IDS, positive: float = POSITIVE_WEIGHT) -> tuple[np.ndarray, list[dict]]:
    """(weights of the best round by macro-F1 on the validation split, the first of equals; history of all rounds) of ``rows`` (text, label,
    category, is_val)."""
    ensure_checkpoint_dir(rows.sparkSession)
    data = packed(rows, ids).checkpoint()
    w = np.zeros((ids + 1, OUT))
    m, v, best, history = np.zeros_like(w), np.zeros_like(w), (-1.0, w), []
    for k in range(1, rounds + 2):
        sums = data.mapInArrow(_round(w, positive), "g binary, figures array<double>").withColumn("part", F.spark_partition_id() % 16)
        met = sums.groupBy("part").applyInArrow(_sum, "g binary, figures array<double>").collect()  # 16 rows at most
        if not met:
            break
        g = np.sum([np.frombuffer(r["g"]) for r in met], axis=0).reshape(w.shape)
        loss, n, *table = np.sum([r["figures"] for r in met], axis=0)
        score = macro_f1(np.array(table).reshape(2, 2))
        if k > 1:
            history.append({"round": k - 1, "train_loss": loss / max(n, 1), "val_macro_f1": score})
            if score > best[0]:
                best = (score, w)
        g = g / max(n, 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w * (1 - DECAY) - STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return best[1], history


def write_model(spark: SparkSession, folder: str, weights: np.ndarray, temperature: float, history: list[dict]) -> None:
    """Weights as a table of rows (id, values), what goes with them as JSON."""
    from vigil.sources.pack import put

    rows = [(i, [float(x) for x in r]) for i, r in enumerate(weights)]
    spark.createDataFrame(rows, "id int, values array<double>").repartition(1).write.mode("overwrite").parquet(f"{folder}/weights")
    put(spark, f"{folder}/meta.json", json.dumps({"temperature": temperature, "ids": len(weights) - 1, "outputs": OUT, "history": history}, sort_keys=True).encode())


def read_model(spark: SparkSession, folder: str) -> tuple[np.ndarray, float, int]:
    """(weights (id, output), temperature, ids). Missing or unfitting files fail. The table's size is the model's."""
    from vigil.sources.pack import read_calibration

    temperature = read_calibration(spark, f"{folder}/meta.json")
    rows = spark.read.parquet(f"{folder}/weights").orderBy("id").collect()
    if len(rows) < 2:
        raise ValueError(f"{folder}: no weights")
    return np.array([r["values"] for r in rows], dtype=np.float64), temperature, len(rows) - 1


#: Rows whose weights are gathered together.
SCORED = 1_024


def logits(weights: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """(row, output): logits of rows whose ids lie side by side in ``flat``; a row without ids has the constant's."""
    total, some = np.zeros((len(sizes), weights.shape[1])), sizes > 0
    if some.any():
        starts = np.cumsum(sizes) - sizes
        total[some] = np.add.reduceat(weights[flat], starts[some], axis=0)
    return total / np.sqrt(np.maximum(sizes, 1))[:, None] + weights[0]


def trained_logits(ids: Column, weights: np.ndarray) -> Column:
    """array<double>: a logit for each output over the packed ``ids``; null for null. The weights go to each task once, not to each row."""

    @F.arrow_udf("array<double>")
    def score(batch: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.float64()))]
        for at in range(0, len(batch), SCORED):
            b = batch.slice(at, SCORED)
            sizes = b.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            z = logits(weights, sizes, b.flatten().to_numpy())
            places = np.arange(len(b) + 1, dtype=np.int32) * OUT
            out.append(pa.ListArray.from_arrays(pa.array(places), pa.array(z[:, :OUT].ravel()), mask=b.is_null()))
        return pa.concat_arrays(out)

    return score(ids)


def _with_logits(messages: DataFrame, folder: str) -> tuple[DataFrame, float]:
    """(``messages`` with _z, a logit for each output; the fitted temperature)."""
    weights, fitted, ids = read_model(messages.sparkSession, folder)
    return messages.withColumn("_z", trained_logits(token_ids(F.col("normalized"), ids, WIDTH), weights)), fitted


def binary_logits(rows: DataFrame, folder: str) -> DataFrame:
    """y, z0, z1 of ``rows`` (normalized, label), to fit a temperature by. The logits themselves: a sure probability is 0 or 1 in doubles
    and has no finite logit. They are written once, since a fit passes over them several times."""
    ensure_checkpoint_dir(rows.sparkSession)
    on = _with_logits(rows, folder)[0]
    return on.select(F.col("label").alias("y"), F.get("_z", F.lit(0)).alias("z0"), F.get("_z", F.lit(1)).alias("z1")).checkpoint()


def scored_by(folder: str):
    """``scored`` of the stand-in with trained weights from ``folder``: for the model plug-in, or on its own."""

    def score(messages: DataFrame, temperature: float | None = None) -> DataFrame:
        on, fitted = _with_logits(messages, folder)
        model = signal(F.slice("_z", 1, BINARY), F.slice("_z", BINARY + 1, CATEGORIES), temperature or fitted)
        return on.withColumn("model", model).drop("_z")

    return score
