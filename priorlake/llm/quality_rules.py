"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

The trees are fitted on at most MAX_LABELLED labelled rows (the documented bound, taken in an order of hashed
ids); the counts and the scores cover every text. A fixed base rule rejects first, the trees judge the rest.

Defined cases: a null or empty text has zero counts and fails the base rule; a null id is kept as null; repeated
rows are judged one by one; an empty table gives no rows; without labelled rows the trees accept everything.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import release, stored
from priorlake.llm.stats import COUNTS, FEATURES, MORE, features, with_text_counts

MAX_LABELLED = 20_000
# More of these never makes a text look better.
FALLING = ["symbols_per_word", "dup_lines", "repeat_words", "bars_per_word", "shouts_per_word"]
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays; roots has each tree's first node, a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds half-way between neighbouring values, at the quantiles of the sample."""
    distinct = np.unique(values)
    at = np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]), side="right")
    at = np.unique(at[at < len(distinct)])
    return (distinct[at - 1] + distinct[at]) / 2


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15,
    bins: int = 64, ridge: float = 2.0, least: int = 10,
) -> Trees:
    """Logistic boosting on binned features; signs has +1 or -1 for features that may only raise or lower the margin.

    A split of such a feature must order its sides; both sides inherit their midpoint as a bound, so no later split
    below them can undo the order.
    """
    lists: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.999
    start = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [cuts(x[:, f], bins) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        margin = np.full(len(y), start)

        def add(value: float) -> int:
            for name, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", value)):
                lists[name].append(v)
            return len(lists["value"]) - 1

        def grow(node: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
            best = (1e-6, -1, 0, 0.0, 0.0)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = total_g**2 / (total_h + ridge)
            for f, e in enumerate(edges if level < depth and len(rows) >= 2 * least else []):
                if not len(e):
                    continue
                at = binned[rows, f]
                n = np.cumsum(np.bincount(at, minlength=len(e) + 1))[:-1]
                lg = np.cumsum(np.bincount(at, weights=g[rows], minlength=len(e) + 1))[:-1]
                lh = np.cumsum(np.bincount(at, weights=h[rows], minlength=len(e) + 1))[:-1]
                rg, rh = total_g - lg, total_h - lh
                lv, rv = np.clip(-lg / (lh + ridge), low, high), np.clip(-rg / (rh + ridge), low, high)
                gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - own
                gain[(n < least) | (len(rows) - n < least) | (signs[f] * (rv - lv) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
            _, f, k, lv, rv = best
            if f < 0:
                return
            lists["feature"][node], lists["threshold"][node] = f, float(edges[f][k])
            lists["left"][node], lists["right"][node] = add(rate * lv), add(rate * rv)
            middle, goes_left = (lv + rv) / 2, binned[rows, f] <= k
            for side, child, mask in ((-1, lists["left"][node], goes_left), (1, lists["right"][node], ~goes_left)):
                bound = signs[f] * side
                grow(child, rows[mask], g, h, level + 1, middle if bound > 0 else low, middle if bound < 0 else high)

        everyone = np.arange(len(y))
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            root = add(0.0)
            roots.append(root)
            grow(root, everyone, g, h, 0, -np.inf, np.inf)
            one = Trees(np.array([root]), *(np.array(lists[k]) for k in ("feature", "threshold", "left", "right", "value")), 0.0, depth)
            margin += one.margin(x)
    arrays = [np.array(lists[k], dtype=float if k in ("threshold", "value") else int) for k in ("feature", "threshold", "left", "right", "value")]
    return Trees(np.array(roots, dtype=int), *arrays, start, depth)


def fit_quality(counted: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees for labels.quality from at most max_labelled rows of counted documents, in an order of hashed ids."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = counted.join(marks, "doc_id").select(*COUNTS, *MORE, "quality", F.xxhash64("doc_id").alias("_o"))
    rows = known.orderBy("_o", *COUNTS).limit(max_labelled).toPandas()
    x = features({n: rows[n].to_numpy(dtype=float) for n in COUNTS + MORE})
    signs = np.array([-1 if name in FALLING else 0 for name in FEATURES])
    return fit_trees(x, rows["quality"].to_numpy(dtype=float), signs)


def judged(counted: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counted documents with base_failed, quality_score and kept."""
    names = counted.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in it:
            score = trees.score(features({n: rows.column(n).to_numpy() for n in COUNTS + MORE}))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], [*names, "quality_score"])

    few, repeats = F.col("n_words") < MIN_WORDS, 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema) + ", quality_score double"
    scored = counted.mapInArrow(batches, schema).withColumn("base_failed", few | repeats)
    return scored.select(*names, "quality_score", "base_failed", (~F.col("base_failed") & (F.col("quality_score") >= keep_from)).alias("kept"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep_from: float = KEEP_FROM, carry: list[str] | None = None
) -> DataFrame:
    """One row per document: doc_id, all counts, carried columns, quality_score, base_failed, kept. Texts are read once."""
    counted = stored(with_text_counts(docs, carry=carry), "text-counts")
    return judged(counted, fit_quality(counted, labels, max_labelled), keep_from)
