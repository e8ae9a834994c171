"""Boosted trees and forests for every fold at once, grown from histograms of sums.

A fold trains on the rows before its cutoff. Rows are cut into parts of at most PART_ROWS by their place in time, and fits
(fold, side, and for forests tree) into blocks; one task handles one part for one block. It bins the features, finds
every row's node in every fit and sums gradient, weight and count by (fit, node, feature, bin). Parts' sums are added by fit, and each
node's best split follows from the sums, so a level of all trees of all folds is one pass. Where one part holds
all rows nothing is left to be added, and the task goes on to the next level and the next tree by itself.

Feature bins are cut at quantiles of a sample of rows before the season's first fold; all rows enter the sums. Row and
column samples are hashes of (seed, tree, row or column), so a fit is the same on every run and in every partitioning.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.operators.folds import pin
from priorlake.operators.gram import SIDES
from priorlake.operators.prefix import position
from priorlake.operators.rules import DRIFT_ROWS

PART_ROWS = 1 << 16
SAMPLE_ROWS = 20_000  # rows whose quantiles cut the bins; a bound for the driver, documented above
CELLS = 1 << 22  # numbers in a task's histogram, and rows x fits looked at together
SAVED_ROUNDS = 10  # boosting over several parts writes the scores down that often
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Trees:
    """How trees are grown.

    boosted   each tree fits the gradient left by those before it; else trees are independent and averaged
    rows      share of rows per tree, or 0 for a bootstrap in which each row counts Poisson(1) times
    columns   share of features per tree
    l1, l2    penalties on leaf values;  least_weight, least_rows: what a child must hold
    impute    missing features take the fold's training mean; else each split sends them to the better side
    """

    count: int
    depth: int
    rate: float = 1.0
    boosted: bool = False
    rows: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    least_weight: float = 0.0
    least_rows: int = 1
    impute: bool = False
    bins: int = 32
    seed: int = 42


BOOSTED = Trees(count=100, depth=3, rate=0.03, boosted=True, rows=0.8, columns=0.8, l1=1.0, l2=1.0, least_weight=1.0, bins=64)
FOREST = Trees(count=300, depth=4, rows=0.0, least_rows=15, impute=True)


def mixed(x: np.ndarray | int) -> np.ndarray:
    """64 bits in which all input bits count (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys.astype(np.uint64) ^ mixed(np.array([seed * 1_000_003 + tree], np.uint64))) >> np.uint64(11)) / float(1 << 53)


def row_counts(keys: np.ndarray, how: Trees, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    u = uniform(keys, how.seed, tree)
    if how.rows:
        return (u < how.rows).astype(float)
    p = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(12.0), 1)))
    return np.searchsorted(p, u, side="right").astype(float)


def tree_columns(p: int, how: Trees, tree: int) -> np.ndarray:
    """Features a tree may split on."""
    order = np.argsort(uniform(np.arange(p), how.seed + 1, tree), kind="stable")
    return np.sort(order[: max(1, int(how.columns * p))])


@dataclass(frozen=True)
class Fits:
    """What is known of each fit: its fold, side and first tree, where its training ends, its start and imputation bins."""

    fold: np.ndarray
    side: np.ndarray
    tree: np.ndarray
    end: np.ndarray
    group: np.ndarray  # whose bins it uses
    start: np.ndarray
    mean_bin: np.ndarray  # (fit, feature)

    def __getitem__(self, which) -> Fits:
        return Fits(*(getattr(self, f)[which] for f in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.fold)


@dataclass
class Grown:
    """Complete binary trees of fits: (fit, tree, node) split feature (-1: all go left), last bin that goes left, where missing goes; (fit, tree, leaf) value."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(fits: int, trees: int, depth: int) -> Grown:
        nodes = (1 << depth) - 1
        return Grown(np.full((fits, trees, nodes), -1, np.int16), np.zeros((fits, trees, nodes), np.int16), np.zeros((fits, trees, nodes), bool), np.zeros((fits, trees, nodes + 1)))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(feature, row) bins: how many edges lie below the value; missing has the last number."""
    out = np.empty(x.shape[::-1], np.int16)
    for j in range(x.shape[1]):
        out[j] = np.searchsorted(edges[j], x[:, j], side="left")
        out[j][np.isnan(x[:, j])] = edges.shape[1] + 1
    return out


class Part:
    """Rows of one part in order of place: bins by group of folds, both scores, weights and hash keys."""

    def __init__(self, table: pa.Table, edges: np.ndarray) -> None:
        table = table.sort_by("place")
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        self.bins = [binned(x, e) for e in edges]  # (feature, row) for each group
        self.y = np.stack([table[s].to_numpy() for s in SIDES])
        self.w, self.place, self.key = table["w"].to_numpy(), table["place"].to_numpy(), table["key"].to_numpy()
        self.missing = edges.shape[2] + 1


class Drawn:
    """The rows of a part that count in one tree. A fit's training rows are the first ones, so it reads slices."""

    def __init__(self, part: Part, how: Trees, tree: int | None) -> None:
        counts = np.ones(len(part.w)) if tree is None else row_counts(part.key, how, tree)
        self.rows = np.flatnonzero(counts > 0)
        self.w, self.y = (part.w * counts)[self.rows], part.y[:, self.rows]
        self.place, self.part, self.missing = part.place[self.rows], part, part.missing
        self._bins: dict[int, np.ndarray] = {}

    def bins(self, group: int) -> np.ndarray:
        if group not in self._bins:
            self._bins[group] = self.part.bins[group][:, self.rows].astype(np.intp)
        return self._bins[group]

    def before(self, end: int) -> int:
        return int(np.searchsorted(self.place, end))


def next_nodes(node: np.ndarray, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, missing_left: np.ndarray, missing: int) -> np.ndarray:
    """Children's numbers within their level, from the splits of a level's nodes; bins (feature, row) of the nodes' rows."""
    of = feature[node]
    at = bins[np.maximum(of, 0), np.arange(len(node))]
    left = (of < 0) | np.where(at == missing, missing_left[node], at <= cut[node])
    return 2 * node + ~left


def leaves_of(grown: Grown, fit: int, tree: int, bins: np.ndarray, levels: int, missing: int) -> np.ndarray:
    """Nodes of rows after so many levels of a fit's tree."""
    node = np.zeros(bins.shape[1], np.intp)
    for level in range(levels):
        at = slice((1 << level) - 1, (2 << level) - 1)
        node = next_nodes(node, bins, grown.feature[fit, tree, at], grown.bin[fit, tree, at], grown.missing_left[fit, tree, at], missing)
    return node


def level_sums(bins: np.ndarray, node: np.ndarray, slope: np.ndarray, weight: np.ndarray, nodes: int, columns: np.ndarray, width: int, counted: bool) -> np.ndarray:
    """(node, feature of columns, bin, [slope, weight, count]) over one fit's rows; counts are left 1 where nothing asks for them."""
    out = np.ones((nodes, len(columns), width, 3))
    base = node * width
    size = nodes * width
    for k, j in enumerate(columns):
        at = base + bins[j, : len(node)]
        out[:, k, :, 0] = np.bincount(at, slope, size).reshape(nodes, width)
        out[:, k, :, 1] = np.bincount(at, weight, size).reshape(nodes, width)
        if counted:
            out[:, k, :, 2] = np.bincount(at, minlength=size).reshape(nodes, width)
    return out


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def strength(sums: np.ndarray, how: Trees) -> np.ndarray:
    """What a node takes off the objective by its best value."""
    weight = sums[..., 1] + how.l2
    return np.where(weight > 0, soft(sums[..., 0], how.l1) ** 2 / np.where(weight > 0, weight, 1.0), 0.0)


def best_splits(sums: np.ndarray, how: Trees, columns: np.ndarray, mean_bin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (fit, node): feature, last bin that goes left, missing_left, and the children's sums (fit, node, 2, 3)."""
    sums = sums.copy()
    missing = sums[..., -1, :].copy()
    if how.impute:
        at = np.broadcast_to(mean_bin[:, None, columns], sums.shape[:3])
        f, n, k = np.indices(at.shape)
        sums[f, n, k, at] += missing
        missing[:] = 0.0
    left = np.cumsum(sums[..., :-1, :], axis=3)[..., :-1, :]
    total = sums[..., :-1, :].sum(axis=3) + missing
    options = [left] if how.impute else [left, left + missing[..., None, :]]
    left = np.stack(options, axis=3)  # (fit, node, column, missing side, bin, sum)
    right = total[..., None, None, :] - left
    gain = strength(left, how) + strength(right, how) - strength(total, how)[..., None, None]
    able = lambda s: (s[..., 1] >= max(how.least_weight, 1e-12)) & (s[..., 2] >= how.least_rows)
    gain = np.where(able(left) & able(right), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    # The first of the options that are best but for rounding, so that the order of sums does not choose.
    top = flat.max(axis=2, keepdims=True)
    best = np.argmax(flat >= top - 1e-9 * np.maximum(1.0, np.abs(top)), axis=2)
    gone = ~(top[..., 0] > LEAST_GAIN)
    k, side, b = np.unravel_index(best, gain.shape[2:])
    fit, node = np.indices(best.shape)
    children = np.stack([left[fit, node, k, side, b], right[fit, node, k, side, b]], axis=2)
    children[gone] = np.stack([total[:, :, 0], np.zeros_like(total[:, :, 0])], axis=2)[gone]
    feature = np.where(gone, -1, columns[k])
    missing_left = (np.take_along_axis(mean_bin, np.maximum(feature, 0), axis=1) <= b) if how.impute else side == 1
    return feature, b, missing_left, children


def put_level(grown: Grown, fits: np.ndarray, tree: int, level: int, found: tuple[np.ndarray, ...], how: Trees) -> None:
    """Write a level's splits of these fits into grown; the last level also gives the leaves."""
    feature, b, missing_left, children = found
    nodes = slice((1 << level) - 1, (2 << level) - 1)
    grown.feature[fits, tree, nodes], grown.bin[fits, tree, nodes], grown.missing_left[fits, tree, nodes] = feature, b, missing_left
    if level == how.depth - 1:
        flat = children.reshape(len(feature), -1, 3)
        weight = flat[..., 1] + how.l2
        grown.value[fits, tree] = -how.rate * np.where(weight > 0, soft(flat[..., 0], how.l1) / np.where(weight > 0, weight, 1.0), 0.0)


def grow_whole(part: Part, fits: Fits, how: Trees) -> Grown:
    """All levels of all trees of the fits, from a part that holds every training row."""
    grown = Grown.empty(len(fits), how.count if how.boosted else 1, how.depth)
    every, n_features = np.arange(len(fits)), part.bins[0].shape[0]
    everything = Drawn(part, how, None)
    score = np.repeat(fits.start[:, None], len(part.w), axis=1)
    for tree in range(grown.feature.shape[1]):
        for some in ([every] if how.boosted else [np.flatnonzero(fits.tree == t) for t in np.unique(fits.tree)]):
            number = tree if how.boosted else int(fits.tree[some[0]])
            drawn, columns = Drawn(part, how, number), tree_columns(n_features, how, number)
            ends = [drawn.before(fits.end[k]) for k in some]
            node = [np.zeros(m, np.intp) for m in ends]
            slope = [(score[k, drawn.rows[:m]] - drawn.y[fits.side[k], :m]) * drawn.w[:m] for k, m in zip(some, ends)]
            for level in range(how.depth):
                sums = np.stack([
                    level_sums(drawn.bins(fits.group[k]), node[i], slope[i], drawn.w[:m], 1 << level, columns, part.missing + 1, how.least_rows > 1)
                    for i, (k, m) in enumerate(zip(some, ends))
                ])
                found = best_splits(sums, how, columns, fits.mean_bin[some])
                put_level(grown, some, tree, level, found, how)
                if level < how.depth - 1:
                    for i, (k, m) in enumerate(zip(some, ends)):
                        node[i] = next_nodes(node[i], drawn.bins(fits.group[k])[:, :m], found[0][i], found[1][i], found[2][i], part.missing)
            if how.boosted:
                for k in every:
                    m = everything.before(fits.end[k])
                    score[k, :m] += grown.value[k, tree, leaves_of(grown, k, tree, everything.bins(fits.group[k])[:, :m], how.depth, part.missing)]
    return grown


def _blocks(n_fits: int, tasks: int) -> list[np.ndarray]:
    return np.array_split(np.arange(n_fits), max(1, min(n_fits, tasks)))


def _within(fits: Fits, some: np.ndarray, how: Trees, n_features: int, rows: int) -> list[np.ndarray]:
    """Fits of a block in stretches whose histograms and elements stay below CELLS numbers, whole trees of forests apart."""
    most = max(1, min(CELLS // ((1 << (how.depth - 1)) * n_features * (how.bins + 1) * 3), CELLS // max(1, rows)))
    return [some[k : k + most] for k in range(0, len(some), most)]


_FIELDS = (("feature", np.int16), ("bin", np.int16), ("missing_left", bool), ("value", np.float64))


def _packed(grown: Grown, fits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(fits, pa.int64()), *[pa.array([np.ascontiguousarray(a).tobytes() for a in getattr(grown, f)], pa.binary()) for f, _ in _FIELDS]], ["fit", *[f for f, _ in _FIELDS]]
    )


def _unpack(grown: Grown, row) -> None:
    for f, kind in _FIELDS:
        target = getattr(grown, f)
        target[row["fit"]] = np.frombuffer(row[f], kind).reshape(target.shape[1:])


def grow(rows: DataFrame, n_rows: int, fits: Fits, edges: np.ndarray, how: Trees, part_rows: int | None = None) -> Grown:
    """Trees of all fits from rows (part, place, x, home, away, w, key)."""
    spark, n_features = rows.sparkSession, edges.shape[1]
    shared = spark.sparkContext.broadcast((fits, edges))  # a few numbers for each fold, tree and side
    tasks = 4 * spark.sparkContext.defaultParallelism
    if n_rows <= (part_rows or PART_ROWS):
        blocks = _blocks(len(fits), tasks)
        spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1)))).repartition(len(blocks), "block")

        def whole(key: tuple, table: pa.Table) -> pa.Table:
            all_fits, cuts = shared.value
            part, out = Part(table, cuts), []
            for some in _within(all_fits, blocks[key[0].as_py()], how, n_features, len(table)):
                out.append(_packed(grow_whole(part, all_fits[some], how), some))
            return pa.Table.from_batches(out)

        found = spread.groupBy("block").applyInArrow(whole, "fit long, feature binary, bin binary, missing_left binary, value binary")
        grown = Grown.empty(len(fits), how.count if how.boosted else 1, how.depth)
        for r in found.toArrow().to_pylist():  # a few hundred bytes for each tree
            _unpack(grown, r)
        return grown
    return _grow_in_passes(rows, fits, edges, how, shared)


def _grow_in_passes(rows: DataFrame, fits: Fits, edges: np.ndarray, how: Trees, shared) -> Grown:
    """One pass over all parts for each level: sums by part, added by fit, splits from the added sums."""
    grown = Grown.empty(len(fits), how.count if how.boosted else 1, how.depth)
    every = np.arange(len(fits))
    state, first = rows, 0
    for tree in range(grown.feature.shape[1]):
        if how.boosted and tree and tree % SAVED_ROUNDS == 0:
            state, first = _with_scores(state, grown, how, shared, first, tree), tree
        # Trees of a forest go in stretches, so that one pass's sums stay small.
        for some in ([every] if how.boosted else [np.flatnonzero((fits.tree >= t) & (fits.tree < t + 8)) for t in range(0, int(fits.tree.max()) + 1, 8)]):
            for level in range(how.depth):
                for r in _level_splits(state, grown, how, shared, some, tree, level, first).collect():  # one row for each fit
                    k = [r["fit"]]
                    arrays = [np.frombuffer(r[f], t) for f, t in (("feature", np.int64), ("bin", np.int64), ("missing_left", bool), ("children", np.float64))]
                    put_level(grown, np.array(k), tree, level, (*[a[None, :] for a in arrays[:3]], arrays[3].reshape(1, 1 << level, 2, 3)), how)
    return grown


def _scores(part: Part, table: pa.Table, fits: Fits, grown: Grown, how: Trees, first: int, tree: int) -> np.ndarray:
    """(fit, row in order of place) predictions after the trees up to `tree`: those written down, and the trees since."""
    if "score" in table.column_names:
        score = np.stack([np.frombuffer(b, np.float64) for b in table.sort_by("place")["score"].to_pylist()], axis=1).copy()
    else:
        score = np.repeat(fits.start[:, None], len(part.w), axis=1)
    everything = Drawn(part, how, None)
    for k in range(len(fits)):
        m = everything.before(fits.end[k])
        bins = everything.bins(fits.group[k])[:, :m]
        for t in range(first, tree):
            score[k, :m] += grown.value[k, t, leaves_of(grown, k, t, bins, how.depth, part.missing)]
    return score


def _with_scores(state: DataFrame, grown: Grown, how: Trees, shared, first: int, tree: int) -> DataFrame:
    spark = state.sparkSession
    trees = spark.sparkContext.broadcast(grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, edges = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("place")
            if not len(table):
                continue
            score = _scores(Part(table, edges), table, fits, trees.value, how, first, tree)
            table = table.drop_columns(["score"]) if "score" in table.column_names else table
            out = table.append_column("score", pa.array([row.tobytes() for row in np.ascontiguousarray(score.T)], pa.binary()))
            yield from out.combine_chunks().to_batches()

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields if f.name != "score")
    out = state.mapInArrow(run, f"{columns}, score binary")
    return out.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else pin(out)


def _level_splits(state: DataFrame, grown: Grown, how: Trees, shared, some: np.ndarray, tree: int, level: int, first: int) -> DataFrame:
    trees = state.sparkSession.sparkContext.broadcast(grown)
    nodes = 1 << level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, edges = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            part = Part(table, edges)
            score = _scores(part, table, fits, trees.value, how, first, tree) if how.boosted else None
            groups = [some] if how.boosted else [some[fits.tree[some] == t] for t in np.unique(fits.tree[some])]
            for group in groups:
                number = tree if how.boosted else int(fits.tree[group[0]])
                drawn, columns = Drawn(part, how, number), tree_columns(edges.shape[1], how, number)
                for k in group:
                    m = drawn.before(fits.end[k])
                    bins = drawn.bins(fits.group[k])[:, :m]
                    before = score[k, drawn.rows[:m]] if score is not None else fits.start[k]
                    slope = (before - drawn.y[fits.side[k], :m]) * drawn.w[:m]
                    node = leaves_of(trees.value, k, tree, bins, level, part.missing)
                    found = level_sums(bins, node, slope, drawn.w[:m], nodes, columns, part.missing + 1, True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["fit", "sums"])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, edges = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fit, blob in zip(batch["fit"].to_pylist(), batch["sums"].to_pylist()):
                values = np.frombuffer(blob, np.float64)
                total[fit] = total[fit] + values if fit in total else values
        for fit, values in total.items():
            number = tree if how.boosted else int(fits.tree[fit])
            columns = tree_columns(edges.shape[1], how, number)
            feature, b, left, children = best_splits(values.reshape(1, nodes, len(columns), -1, 3), how, columns, fits.mean_bin[[fit]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([fit], pa.int64()), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (feature.astype(np.int64), b.astype(np.int64), left, children)]],
                ["fit", "feature", "bin", "missing_left", "children"],
            )

    added = state.mapInArrow(sums, "fit long, sums binary").repartition("fit")
    return added.mapInArrow(splits, "fit long, feature binary, bin binary, missing_left binary, children binary")


# ------------------------------------------------------------------ folds


def numbered_rows(table: DataFrame, features: list[str], weight: Column) -> DataFrame:
    played = table.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    rows = played.select(
        "t", "game_id", _values(features), F.col("home_score").cast("double").alias("home"), F.col("away_score").cast("double").alias("away"),
        weight.cast("double").alias("w"), F.xxhash64("game_id").alias("key"),
    )
    return position(rows, [], "t", ["game_id"], "place").select("place", "x", "home", "away", "w", "key")


def _values(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]).alias("x")


def bin_edges(sample: pd.DataFrame, firsts: np.ndarray, bins: int, n_features: int) -> np.ndarray:
    """(group, feature, edge): quantiles of the sampled rows before each group's first fold; unused edges are infinite."""
    out = np.full((len(firsts), n_features, bins - 1), np.inf)
    x = np.stack(sample["x"]) if len(sample) else np.zeros((0, n_features))
    place = sample["place"].to_numpy()
    for g, first in enumerate(firsts):
        for j in range(n_features):
            values = x[place < first, j]
            values = values[~np.isnan(values)]
            if len(values):
                edges = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
                out[g, j, : len(edges)] = edges
    return out


def _fold_sums(rows: DataFrame, ends: np.ndarray, n_features: int) -> np.ndarray:
    """(fold, ...): weight, weighted scores, and sums and counts of known features of the rows before each fold; one pass."""
    width = 3 + 2 * n_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ends), width))
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            known, w = ~np.isnan(x), batch["w"].to_numpy()
            parts = np.hstack([w[:, None], (w * batch["home"].to_numpy())[:, None], (w * batch["away"].to_numpy())[:, None], np.where(known, x, 0.0), known])
            total += (batch["place"].to_numpy()[None, :] < ends[:, None]).astype(float) @ parts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ends))), *[pa.array(total[:, k]) for k in range(width)]], ["fold", *[f"v{k}" for k in range(width)]])

    names = [f"v{k}" for k in range(width)]
    out = np.zeros((len(ends), width))
    for r in rows.mapInArrow(run, "fold long, " + ", ".join(f"{v} double" for v in names)).groupBy("fold").agg(*[F.sum(v).alias(v) for v in names]).collect():
        out[r["fold"]] = [r[v] for v in names]  # one row for each fold
    return out


def _predicted(x: np.ndarray, grown: Grown, fits: Fits, some: np.ndarray, edges: np.ndarray, how: Trees) -> np.ndarray:
    """Forecasts of rows by the trees of some fits of one fold and side."""
    bins = binned(x, edges[fits.group[some[0]]]).astype(np.intp)
    total = np.zeros(len(x))
    for fit in some:
        for tree in range(grown.feature.shape[1]):
            total += grown.value[fit, tree, leaves_of(grown, fit, tree, bins, how.depth, edges.shape[2] + 1)]
    return fits.start[some[0]] + total if how.boosted else total / len(some)


def walk_forward_trees(table: DataFrame, folds: DataFrame, features: list[str], keep: list[str], weight: Column, how: Trees, drift: int = DRIFT_ROWS, part_rows: int | None = None) -> DataFrame:
    """`keep` with home_pred and away_pred for the rows of every fold, from trees refit for each fold on the rows before it."""
    spark = table.sparkSession
    plan = folds.select("season", "week", "cutoff", "n_train").orderBy("cutoff", "season", "week").collect()  # one row for each fold
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema.fields) + ", home_pred double, away_pred double"
    if not plan:
        return spark.createDataFrame([], schema)
    size = part_rows or PART_ROWS
    rows = numbered_rows(table, features, weight)
    rows = pin(rows.withColumn("part", F.floor(F.col("place") / size)).repartition("part"))
    n_rows, p = rows.count(), len(features)
    ends = np.array([f["n_train"] for f in plan])
    seasons = sorted({f["season"] for f in plan})
    firsts = np.array([min(f["n_train"] for f in plan if f["season"] == s) for s in seasons])
    sample = rows.orderBy("key", "place").limit(SAMPLE_ROWS).select("place", "x").toPandas()
    edges = bin_edges(sample, firsts, how.bins, p)
    sums = _fold_sums(rows, ends, p)
    mean = np.where(sums[:, 3 + p :] > 0, sums[:, 3 : 3 + p] / np.maximum(sums[:, 3 + p :], 1), 0.0)
    group = np.array([seasons.index(f["season"]) for f in plan])
    mean_bin = np.stack([binned(mean[[k]], edges[g])[:, 0] for k, g in enumerate(group)]).astype(np.int64)
    trees = 1 if how.boosted else how.count
    fold, side, tree = (a.reshape(-1) for a in np.meshgrid(np.arange(len(plan)), np.arange(2), np.arange(trees), indexing="ij"))
    order = np.lexsort((side, fold, tree))
    fold, side, tree = fold[order], side[order], tree[order]
    start = sums[fold, 1 + side] / sums[fold, 0] if how.boosted else np.zeros(len(fold))
    fits = Fits(fold, side, tree, ends[fold], group[fold], start, mean_bin[fold])
    grown = grow(rows, n_rows, fits, edges, how, part_rows)
    shared = spark.sparkContext.broadcast((grown, fits, edges))
    of = {(f, s): np.flatnonzero((fold == f) & (side == s)) for f in range(len(plan)) for s in (0, 1)}

    def recent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_trees, all_fits, cuts = shared.value
        for batch in batches:
            place = batch["place"].to_numpy()
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for f, end in enumerate(ends):
                some = np.flatnonzero((place >= max(end - drift, 0)) & (place < end))
                if len(some):
                    err = [(_predicted(x[some], all_trees, all_fits, of[f, s], cuts, how) - batch[side_].to_numpy()[some]).sum() for s, side_ in enumerate(SIDES)]
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([err[0]]), pa.array([err[1]]), pa.array([float(len(some))])], ["fold", "home", "away", "n"])

    offset = np.zeros((len(plan), 2))
    if drift:
        sums_ = rows.mapInArrow(recent, "fold long, home double, away double, n double").groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("home", "away", "n")])
        for r in sums_.collect():  # one row for each fold
            offset[r["fold"]] = [r["home"] / r["n"], r["away"] / r["n"]]
    rows.unpersist()

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_trees, all_fits, cuts = shared.value
        for batch in batches:
            number = batch["_fold"].to_numpy()
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            pred = np.zeros((2, batch.num_rows))
            for f in np.unique(number):
                some = np.flatnonzero(number == f)
                for s in (0, 1):
                    pred[s, some] = _predicted(x[some], all_trees, all_fits, of[f, s], cuts, how) - offset[f, s]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(pred[0]), pa.array(pred[1])], [*keep, "home_pred", "away_pred"])

    numbers = spark.createDataFrame([(f["season"], f["week"], k) for k, f in enumerate(plan)], "season int, week int, _fold int")
    test = table.select(*keep, _values(features)).join(numbers, ["season", "week"])
    return test.select(*keep, "x", "_fold").mapInArrow(forecast, schema)
