"""Embedding near-duplicates by a join in a subspace of rotated coordinates.

Unit vectors at cosine >= t lie within squared distance 2 - 2t, and so do their images in any subspace. After one random
rotation the leading coordinates and the length of the rest make such an image of few numbers (`fronts`): tiles of images are
multiplied in single precision, and every candidate is verified by its cosine in double precision. Blocks with a proportional
share of the distance each would let through more pairs for more products: of random vectors of 64 components 8 blocks on a grid
leave a fifth of all pairs to compare, and each row is then needed in dozens of cells.

Equal vectors fold to one class first. Classes are cut into chunks that meet in pairs, each pair of rows in one task, so the
work is the square of the number of classes (of one length). It is done in rounds, in each of which a chunk meets one other: no
more than two copies of the vectors are shuffled at a time, and Spark removes them when the round is written. A chunk's
size is bounded by rows and by components. Tasks send link counts and spanning links, never pairs; when these pile up,
they are folded to one link a vector.

Vectors of different lengths never link; those of one length are joined among themselves, all lengths in the same rounds.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; ids may be null
or repeated (rows of one id are vectors of their own, a null id is never a component's id unless all are); other columns are
not read; an empty table gives no rows.
"""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.groups import per_group
from priorlake.llm.shared import components, dropped, local_components
from priorlake.llm.shared import stored_alone as stored

COSINE = 0.9
# A chunk holds at most so many vectors and so many components.
CHUNK, CHUNK_NUMBERS = 32_768, 1 << 23
# Distances in single precision choose the candidates, those up to ROUGH too far among them; double precision decides.
TILE, ROUGH = 512, 1e-5
# Of the pairs of a tile: if more are candidates, all cosines of the tile are computed at once.
DENSE = 1 / 32
# Spanning links are folded when there are more than so many a class, or so many tables of them.
PILE, PILED_TABLES = 4, 16


@functools.lru_cache
def rotation(dimensions: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def leading(dimensions: int, cosine: float) -> int:
    """How many coordinates tell random vectors from near ones but for a few in ten thousand.

    Of the cosine, k leading coordinates and the lengths of the rest allow 1 - k / d more than the k give, which spread by sqrt(k) / d.
    """
    return min(dimensions, math.ceil((1.8 + math.sqrt(3.24 + max(0.0, 1 - cosine) * dimensions)) ** 2))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(1))[:, None]


def fronts(units: np.ndarray, cosine: float) -> np.ndarray:
    """Images that are no farther apart than the unit vectors: leading rotated coordinates and the length of the others."""
    k = leading(units.shape[1], cosine)
    lead = units @ rotation(units.shape[1])[:, :k]
    return np.column_stack([lead, np.sqrt(np.maximum(0, 1 - (lead**2).sum(1)))])


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dimensions)


def sides_of_distance(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product holds all squared distances of the rows of x and y (of length 1 at most), to ROUGH."""
    nx, ny = (x**2).sum(1), (y**2).sum(1)
    one = np.ones(max(len(x), len(y)))
    return np.column_stack([-2 * x, nx, one[: len(x)]]).astype(np.float32), np.column_stack([y, one[: len(y)], ny]).astype(np.float32)


def near_pairs(units: np.ndarray, images: np.ndarray, own: range, other: range, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of own and other at the cosine or above, tile by tile; where own is other, each pair once."""
    x, y = sides_of_distance(images[own.start : own.stop], images[other.start : other.stop])
    most = 2 - 2 * cosine + ROUGH
    for a in range(0, len(x), TILE):
        for b in range(a if own == other else 0, len(y), TILE):
            some = x[a : a + TILE] @ y[b : b + TILE].T
            rows = np.flatnonzero(some.min(axis=1) <= most)
            if not len(rows):
                continue
            p, q = np.nonzero(some[rows] <= most)
            p, u, v = rows[p], own.start + a, other.start + b
            if len(p) > DENSE * some.size:
                p, q = np.nonzero(units[u : u + some.shape[0]] @ units[v : v + some.shape[1]].T >= cosine)
                p, q = p + u, q + v
            else:
                p, q = p + u, q + v
                close = np.einsum("nd,nd->n", units[p], units[q]) >= cosine
                p, q = p[close], q[close]
            if own == other and a == b:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield p, q


def _linked(cosine: float, alone: bool):
    """Of every group, the links of its home rows with its other ones and, where asked, among the home rows alone."""

    def of_group(group: pa.Table) -> pa.RecordBatch | None:
        home = group["home"].combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(~home, kind="stable")
        ids, size = group["rid"].to_numpy()[order], group["size"].to_numpy()[order]
        units = unit(_matrix(group["vector"], group["d"][0].as_py()))[order]
        images, cut = fronts(units, cosine), int(home.sum())
        own, other = range(cut), range(cut, len(ids))
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        left, right, held = [], [], 0
        for side in ([own] if alone else []) + [other]:
            for p, q in near_pairs(units, images, own, side, cosine):
                np.add.at(links, p, size[q])
                np.add.at(links, q, size[p])
                p, q = label[p], label[q]
                new = p != q
                if new.any():
                    left.append(p[new])
                    right.append(q[new])
                    held += len(left[-1])
                if held > 1 << 20:
                    label = local_components(len(ids), np.concatenate(left), np.concatenate(right))[label]
                    left, right, held = [], [], 0
        some = np.flatnonzero(links)
        if not len(some):
            return None
        if held:
            label = local_components(len(ids), np.concatenate(left), np.concatenate(right))[label]
        return pa.RecordBatch.from_arrays([pa.array(ids[label[some]]), pa.array(ids[some]), pa.array(links[some])], ["a", "b", "links"])

    def join(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if found := of_group(table.slice(a, b - a)):
                yield found

    return join


def met(classes: DataFrame, lengths: DataFrame, shift: int, parts: int) -> DataFrame:
    """Rows at home in their chunk's task, and as guests in that of the chunk `shift` before; dealt to parts by task.

    Of k chunks, shifts 1 to k / 2 bring every two together once; in the first one a chunk also stays alone with itself.
    """

    def meets(task: Column) -> Column:
        return (2 * shift < F.col("_k")) | ((2 * shift == F.col("_k")) & (task < shift))

    def place(task: Column, home: bool, where: Column) -> Column:
        return F.when(where, F.struct(task.alias("task"), F.lit(home).alias("home")))

    own = F.pmod(F.xxhash64("rid", F.lit(11)), F.col("_k")).cast("int")
    before = F.pmod(F.col("_chunk") - shift, F.col("_k"))
    places = F.array_compact(F.array(place(F.col("_chunk"), True, F.lit(shift == 1) | meets(F.col("_chunk"))), place(before, False, meets(before))))
    rows = classes.select("rid", "size", "vector", F.size("vector").alias("d")).join(lengths, "d").withColumn("_chunk", own)
    rows = rows.select("rid", "size", "vector", "d", F.explode(places).alias("_at")).select("rid", "size", "vector", "d", "_at.task", "_at.home")
    return rows.repartitionById(parts, (F.pmod(F.xxhash64("d"), F.lit(parts)) + F.col("task")).cast("int"))


def folded(found: DataFrame, name: str) -> DataFrame:
    """Link counts by vector, and one link to the smallest vector reached."""
    counts = found.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    tops = components(found.select("a", "b"), "tops")
    return stored(counts.join(tops, "node").select(F.col("component").alias("a"), F.col("node").alias("b"), "links"), name)


def links_of(classes: DataFrame, total: int, cosine: float, most: int) -> DataFrame:
    """For every class that links: a (the smallest rid it reaches), b (its rid), links (the rows it links with)."""
    spark = classes.sparkSession
    chunk = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(CHUNK_NUMBERS) / F.col("d"))))
    lengths = classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("_n")).where("_n > 1")
    lengths = stored(lengths.select("d", F.ceil(F.col("_n") / chunk).cast("int").alias("_k")), "lengths")
    chunks, tasks = lengths.agg(F.max("_k"), F.sum("_k")).first()
    piled, held = [], 0
    parts = min(tasks or 1, max(chunks or 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for shift in range(1, max(1, (chunks or 1) // 2) + 1):
        dealt = met(classes, lengths, shift, parts)
        piled.append(stored(per_group(dealt, ["d", "task"], _linked(cosine, shift == 1), "a long, b long, links long", 8192, dealt=True), "links"))
        held += piled[-1].count()
        if held > PILE * total or len(piled) > PILED_TABLES:
            found = folded(functools.reduce(DataFrame.unionByName, piled), "links")
            dropped(*piled)
            piled, held = [found], 0
    return folded(functools.reduce(DataFrame.unionByName, piled), "links")


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links (others at the cosine or above), component_id (smallest id it reaches), kept.

    cell_rows: vectors of a chunk at most (and never more than CHUNK).
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0)
    key = F.when(F.coalesce(usable, F.lit(False)), F.unhex(F.md5(F.to_csv(F.struct(F.array_join(F.col("vector").cast("array<string>"), " ").alias("v"))))))
    whole = stored(plain.select("vec_id", "vector", key.alias("key")), "vectors")
    classes = whole.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    rows = stored(whole.select("vec_id", "key"), "rows")
    dropped(whole)
    found = links_of(classes, classes.count(), cosine, min(CHUNK, cell_rows))
    known = classes.select("key", "rid", "least", "size").join(found.select(F.col("b").alias("rid"), F.col("a").alias("component"), "links"), "rid", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "rid")), "known")
    dropped(classes)
    heads = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(heads, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = rows.where("key is not null").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """with recursive usable as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as materialized (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
tops as (select a as vec_id, min(b) as component_id from reach group by a),
counts as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join tops using (vec_id) left join counts using (vec_id)"""
