"""Quality classifier: random Fourier features over document statistics, ridge from summed normal equations, isotonic calibration.

Every labelled training row counts: partitions sum Z'Z and Z'y of their rows, the sums are added across partitions
row by row of the matrix, and only the D x D total (D is a parameter) comes to the driver. A part of the training
rows is set aside for the calibration, which pools adjacent violators over at most 4,096 score bins.

Defined cases: a null or empty text has zero statistics and a score; a null id is not held out and has no label; an
empty table gives no rows; with one class only or no labels at all the score is the share of label 1 (0.5 without
labels). Labels, lang, source and ids are no inputs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import stored
from priorlake.llm.stats import COUNTS, FEATURES, MORE, features, with_text_counts

BINS = 4096
PREDICT_FROM = 0.3
HELD_OUT_OF = 5


def fold_of(doc_id: Column, n: int = HELD_OUT_OF) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return features({n: rows[n].to_numpy(dtype=float) for n in COUNTS + MORE})


@dataclass
class FourierMap:
    """z(x) = sqrt(2/D) cos(Wx + b) of standardised x: inner products approach a Gaussian kernel of the given width."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(len(mean), size - 1)) / width, rng.uniform(0, 2 * np.pi, size - 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.weights + self.phase)
        return np.column_stack([np.ones(len(x)), z])


@dataclass
class Classifier:
    fourier: FourierMap
    beta: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1)


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to values in weighted squares: adjacent violators are pooled."""
    stack: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            stack.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in stack]) if stack else np.zeros(0)


def moments(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature over all documents; partitions send sums only."""
    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        for rows in it:
            x = _matrix(rows)
            n, s, q = n + len(x), s + x.sum(0), q + (x**2).sum(0)
        yield pd.DataFrame({"f": np.arange(len(FEATURES)), "n": n, "s": s, "q": q})

    rows = counted.mapInPandas(sums, "f int, n long, s double, q double").groupBy("f").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("f").toPandas()
    n, s, q = (rows.iloc[:, k].to_numpy(dtype=float) for k in (1, 2, 3)) if len(rows) else (np.ones(len(FEATURES)), np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    n = np.maximum(n, 1)
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-12))


def normal_equations(train: DataFrame, fourier: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows of train (counts and quality), summed by matrix row across partitions."""
    size = len(fourier.phase) + 1

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for rows in it:
            z = fourier(_matrix(rows))
            total += z.T @ np.column_stack([z, rows["quality"].to_numpy(dtype=float)])
        if total.any():
            yield pd.DataFrame({"i": np.arange(size), "sums": total.tolist()})

    def added(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for rows in it:
            for i, v in zip(rows["i"], rows["sums"], strict=True):
                sums[i] = sums[i] + v if i in sums else np.array(v)
        if sums:
            yield pd.DataFrame({"i": list(sums), "sums": [v.tolist() for v in sums.values()]})

    parts = train.mapInPandas(partial, "i int, sums array<double>")
    rows = parts.repartition("i").mapInPandas(added, "i int, sums array<double>").toPandas()
    total = np.zeros((size, size + 1))
    for i, v in zip(rows["i"], rows["sums"], strict=True):
        total[i] = v
    return total[:, :-1], total[:, -1]


def fit_classifier(counted: DataFrame, labels: DataFrame, size: int = 256, width: float = 3.0, ridge: float = 1e-3, seed: int = 7) -> Classifier:
    """Fitted on labelled rows outside the held-out fold; a fifth of them calibrates."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = counted.where(fold_of(F.col("doc_id")) != 0).join(marks, "doc_id")
    usable = stored(usable.withColumn("_side", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(5)) == 0), "labelled")
    fourier = FourierMap.drawn(*moments(counted), size, width, seed)
    gram, right = normal_equations(usable.where("not _side"), fourier)
    n = max(gram[0, 0], 1.0)
    beta = np.linalg.solve(gram + ridge * n * np.eye(size), right)

    def binned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            raw = fourier(_matrix(rows)) @ beta
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int), "y": rows["quality"].astype(float)})

    bins = usable.where("_side").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").toPandas()
    if not len(bins):
        share = right[0] / n if gram[0, 0] else 0.5
        return Classifier(fourier, beta, np.array([0.0, 1.0]), np.array([share, share]))
    levels = pooled(bins["y"].to_numpy() / bins["n"].to_numpy(), bins["n"].to_numpy(dtype=float))
    # A touch of the raw score keeps order inside a pooled level.
    edges = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    return Classifier(fourier, beta, edges, 0.98 * levels + 0.01 + 0.01 * np.clip(edges, 0, 1) - 0.005)


def quality_classifier(docs: DataFrame, labels: DataFrame, size: int = 256, width: float = 3.0, ridge: float = 1e-3, predict_from: float = PREDICT_FROM, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Texts are read once."""
    counted = stored(with_text_counts(docs), "text-counts")
    model = fit_classifier(counted, labels, size, width, ridge, seed)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            x = features({n: rows.column(n).to_numpy() for n in COUNTS + MORE})
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = counted.mapInArrow(batches, "doc_id long, score double")
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= predict_from, 1).otherwise(0).alias("predicted"))
