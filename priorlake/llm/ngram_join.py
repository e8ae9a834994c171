"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification of whole shingle sets.

Texts are sets of word 5-grams. Each distinct text gets a signature of TREES x DEPTH minima; a tree is the trie of its
DEPTH values, kept as one table of prefixes per level, and two texts are candidates if they share a prefix in some tree.
Matching starts at the full depth; candidates are linked to components by their sketches (linear output). Then prefixes are
shortened by one value at a time, until a pair at the threshold is found with the target probability: a prefix whose rows
already are of one component has all it can give and is not opened again, and in the others only rows of different
components are compared. Within a component every pair is verified on its whole shingle sets.

Scale: copies fold to one class before anything else; a bucket or component of any size is cut into chunks that meet in
pairs, so no task gathers a group; tasks send counts and spanning links, never pairs. Only texts with a candidate are read
again; a fixed-size table of hash buckets (at most 2^18 rows) is broadcast to leave out the others before the shuffle.

Defined cases: words are runs of non-blank characters (blank: space, tab to carriage return); a text of one to four
words has one shingle of all its words; null texts and texts without words link with nothing, copies of them neither; ids may be
null (such a row never is a component's id unless all are) and rows with one id share their fate, unless a row key is
given: then one row of each component is kept, the first by id (nulls last) and key; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.groups import chunk_pairs, per_group
from priorlake.llm.shared import components, local_components, release, small_batches, stored, text_bytes

WINDOW, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 5, 0.9999
SLICE_BYTES = 1 << 20
BUCKET_CHUNK, GROUP_CHUNK = 512, 256
SKETCH_FROM = 0.5  # estimated similarity below which a pair surely is below SIMILARITY (over 6 deviations)
FILTER_BUCKETS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True
_POWERS: list[np.ndarray] = []


def forest_levels(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """Prefix lengths to match, the full depth first; the last is the longest that finds a pair at the similarity surely enough."""
    levels = [depth]
    while levels[-1] > 1 and 1 - (1 - similarity ** levels[-1]) ** trees < recall:
        levels.append(levels[-1] - 1)
    return levels


def open_prefixes(labels: DataFrame, level: int, trees: int, depth: int) -> DataFrame:
    """(bucket, rid, component) of the rows under each prefix of the level that rows of several components share.

    labels: rid, signature, component. Least and largest component are partial before the shuffle.
    """
    keys = [F.xxhash64(F.lit(t), F.substring("signature", 4 * depth * t + 1, 4 * level)) for t in range(trees)]
    members = labels.select("rid", "component", F.explode(F.array(*keys)).alias("bucket"))
    ends = members.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return members.join(ends.where("_low < _high").select("bucket"), "bucket")


def forest_components(classes: DataFrame, levels: list[int], trees: int, depth: int) -> DataFrame:
    """(rid, group) of every row that some candidate links to another; classes: rid, signature."""
    low = F.concat(*[F.substring("signature", 4 * k + 1, 1) for k in range(trees * depth)])
    labels, found, groups = classes.select("rid", "signature", F.col("rid").alias("component")), None, None
    for level in levels:
        members = stored(open_prefixes(labels, level, trees, depth), "prefixes")
        short = classes.join(members.select("rid").distinct(), "rid").select("rid", low.alias("sketch"))
        dealt = chunk_pairs(members.join(short, "rid"), "bucket", "rid", BUCKET_CHUNK)
        near = stored(per_group(dealt, ["bucket", "_i", "_j"], _sketch_links, "a long, b long"), "near")
        found = near if found is None else found.unionByName(near)
        groups = components(found, "groups").select(F.col("node").alias("rid"), F.col("component").alias("group"))
        labels = classes.join(groups, "rid", "left").select("rid", "signature", F.coalesce("group", "rid").alias("component"))
    return groups


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (BASE, BASE_INVERSE)]
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted, and the words of each row. One slice of rows."""
    rows = len(starts) - 1
    data = data[starts[0] : starts[-1]]
    starts = starts - starts[0]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    if not len(data):
        return none
    word = ~BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[:-1][starts[:-1] < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    closing = starts[1:][starts[1:] > 0] - 1
    last[closing] = word[closing]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return none
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    hashes = mixed((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    row = np.searchsorted(starts, begin, side="right") - 1
    n_words = np.bincount(row, minlength=rows)
    window = max(len(hashes) - WINDOW + 1, 0)
    grams = np.zeros(window, np.uint64)
    for k in range(WINDOW):
        grams = mixed(grams * BASE + hashes[k : k + window])
    whole = row[:window] == row[WINDOW - 1 :] if window else np.zeros(0, bool)
    out_row, out_hash = [row[:window][whole]], [grams[whole]]
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    for r in np.flatnonzero((n_words > 0) & (n_words < WINDOW)):
        total = np.zeros(1, np.uint64)
        for h in hashes[bounds[r] : bounds[r + 1]]:
            total = mixed(total * BASE + h)
        out_row.append(np.array([r]))
        out_hash.append(total)
    r, h = np.concatenate(out_row), np.concatenate(out_hash)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new], n_words


def slices(starts: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes, a longer row alone."""
    most = most or SLICE_BYTES
    at = 0
    while at < len(starts) - 1:
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        yield at, upto
        at = upto


def signatures(column: pa.Array, size: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(rows x size) minima of hashed shingles as 32-bit integers, and the words of each row."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    data, starts = text_bytes(column)
    out, words = np.zeros((len(starts) - 1, size), np.uint32), np.zeros(len(starts) - 1, np.int64)
    for a, b in slices(starts):
        row, grams, n = shingles(data, starts[a : b + 1])
        words[a:b] = n
        if not len(row):
            continue
        firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        minima = np.empty((len(firsts), size), np.uint32)
        for k in range(size):
            minima[:, k] = np.minimum.reduceat(((grams ^ (grams >> np.uint64(32))) * factors[k]) >> np.uint64(32), firsts)
        out[a + row[firsts]] = minima
    return out, words


def sketched(docs: DataFrame, trees: int, depth: int, row: str | None = None) -> DataFrame:
    """(doc_id, digest, n_words, signature) of every row, and its key _row if named; the digest is that of the whole text."""
    small_batches(docs.sparkSession, 2000)
    size = trees * depth

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            minima, words = signatures(batch.column(2), size)
            packed = pa.array([m.tobytes() if n else None for m, n in zip(minima.astype("<u4"), words, strict=True)], pa.binary())
            arrays = [batch.column(0), batch.column(1), pa.array(words), packed, *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_words", "signature", *batch.schema.names[3:]])

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.col(row).cast("long").alias("_row")] if row else []),
    )
    return slim.mapInArrow(batches, "doc_id long, digest binary, n_words long, signature binary" + (", _row long" if row else ""))


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _sketch_links(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spanning links among rows of each task that are of different components and whose sketches are close."""
    ids, own, chunk, i, j = (table[c].to_numpy() for c in ("rid", "component", "_chunk", "_i", "_j"))
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
    width = sketches.shape[1]
    least = SKETCH_FROM * 255 / 256 * width + width / 256
    left, right = [], []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        x = np.flatnonzero(chunk[a:b] == i[a]) + a
        y = x if i[a] == j[a] else np.flatnonzero(chunk[a:b] == j[a]) + a
        x = x[np.argsort(own[x], kind="stable")]
        for at in range(0, len(x), 64):
            some = x[at : at + 64]
            others = y[own[y] != own[some[0]]] if own[some[0]] == own[some[-1]] else y
            same = np.zeros((len(some), len(others)), np.int16)
            for k in range(width):
                same += sketches[some, k][:, None] == sketches[others, k][None, :]
            p, q = np.nonzero((same >= least) & (own[some][:, None] != own[others][None, :]))
            left.append(some[p])
            right.append(others[q])
    if not left:
        return
    label = local_components(len(ids), np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[label[linked]]), pa.array(ids[linked])], ["a", "b"])


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|sets[x] & sets[y]| for all pairs, by products of 0/1 matrices over blocks of shared shingles."""
    members = np.concatenate([sets[k] for k in np.union1d(x, y)])
    values, counts = np.unique(members, return_counts=True)
    values = values[counts > 1]
    out = np.zeros((len(x), len(y)), np.float32)
    same = x is y
    for at in range(0, len(values), 4096):
        block = values[at : at + 4096]

        def matrix(which: np.ndarray) -> np.ndarray:
            m = np.zeros((len(which), len(block)), np.float32)
            for k, s in enumerate(which):
                own = sets[s][np.searchsorted(sets[s], block[0]) : np.searchsorted(sets[s], block[-1], side="right")]
                place = np.searchsorted(block, own)
                m[k, place[block[place] == own]] = 1
            return m

        left = matrix(x)
        out += left @ (left if same else matrix(y)).T
    return out


def _verified(similarity: float):
    def verify(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Per task: for each row the documents linked with it, and spanning links; pairs of one task only."""
        ids, chunk, i, j, weight = (table[c].to_numpy() for c in ("rid", "_chunk", "_i", "_j", "size"))
        data, offsets = text_bytes(table["text"].combine_chunks())
        sets: list[np.ndarray] = []
        for a, b in slices(offsets):
            row, grams, _ = shingles(data, offsets[a : b + 1])
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            sets += [grams[cuts[k] : cuts[k + 1]] for k in range(b - a)]
        sizes = np.array([len(s) for s in sets])
        links = np.zeros(len(ids), np.int64)
        left, right = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x = np.flatnonzero(chunk[a:b] == i[a]) + a
            y = x if i[a] == j[a] else np.flatnonzero(chunk[a:b] == j[a]) + a
            if not len(x) or not len(y):
                continue
            both = intersections(sets, x, y)
            close = both >= similarity * (sizes[x][:, None] + sizes[y][None, :] - both) - 1e-6
            if x is y:
                np.fill_diagonal(close, False)
            links[x] += close @ weight[y]
            if x is not y:
                links[y] += close.T @ weight[x]
            p, q = np.nonzero(close)
            left.append(x[p])
            right.append(y[q])
        some = np.flatnonzero(links)
        if not len(some):
            return
        label = local_components(len(ids), np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[some]]), pa.array(ids[some]), pa.array(links[some])], ["a", "b", "links"])

    return verify


def ngram_join(
    docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, row: str | None = None
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its copies), n_links (other documents at the similarity
    or above, copies included), component_id (smallest id it reaches by links), kept (doc_id = component_id).

    row: a column of unique longs; it comes first in the result, and kept is true for one row of each component.
    """
    sketches = stored(sketched(docs, trees, depth, row), "signatures")
    place = [F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")).alias("place")] if row else []
    own, at, head = (["_row"], ["place"], [F.min("place").alias("head")]) if row else ([], [], [])
    classes = sketches.where("n_words > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"), F.first("signature").alias("signature"), *place)
    classes = stored(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    groups = forest_components(classes.select("rid", "signature"), forest_levels(similarity, trees, depth, recall), trees, depth)
    wanted = stored(groups.join(classes.select("rid", "digest", "size"), "rid"), "wanted")
    slot = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BUCKETS))
    slots = wanted.select(slot.cast("int").alias("slot")).distinct()  # at most FILTER_BUCKETS rows
    texts = docs.select(digest_of(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text")).withColumn("slot", slot.cast("int"))
    texts = texts.join(F.broadcast(slots), "slot", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    dealt = chunk_pairs(wanted.join(texts, "digest").select("rid", "group", "size", "text"), "group", "rid", GROUP_CHUNK)
    found = stored(per_group(dealt, ["group", "_i", "_j"], _verified(similarity), "a long, b long, links long", 2000), "links")
    tops = components(found.select("a", "b"), "tops")
    counts = found.groupBy(F.col("b").alias("rid")).agg(F.sum("links").alias("links"))
    known = classes.select("digest", "rid", "class_id", "size", *at).join(counts, "rid", "left").join(tops.withColumnRenamed("node", "rid"), "rid", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "rid")), "known")
    heads = known.groupBy("component").agg(F.min("class_id").alias("component_id"), *head)
    first = [F.col("head._row").alias("_first")] if row else []
    known = known.join(heads, "component").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id", *first)
    wordy = sketches.where("n_words > 0").select(*own, "doc_id", "digest").join(known, "digest")
    bare = sketches.where("n_words = 0").select(
        *own, "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"),
        *([F.col("_row").alias("_first")] if row else []),
    )
    out = wordy.select(*bare.columns).unionByName(bare)
    if row:
        return out.select(F.col("_row").alias(row), "doc_id", "class_id", "n_links", "component_id", (F.col("_row") == F.col("_first")).alias("kept"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
