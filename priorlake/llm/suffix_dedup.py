"""Removal of repeated byte strings by sorted suffixes.

Every byte covered by a string of `length` bytes that also starts anywhere else is removed. Text positions fall into runs of
windows with one content-defined anchor; only runs whose anchor occurs elsewhere too can repeat. Their suffixes are sorted
by a distributed merge sort with front-coded runs and loser trees (suffix_merge), and a suffix's longest common prefix
with its neighbours tells which of its windows repeat. Windows that are decided by no run as a whole are grouped with equal
windows of the same anchor and go through the same sort as ranges of their own. Hashes only choose what is sorted; the
sort compares bytes.

Scale: one row per run is shuffled to find anchors that occur twice; what repeats within a slice of texts needs none. Texts
are shuffled twice by their digest. Equal strings fold inside partitions before they travel, so a passage in a third of
all texts is a few rows; anchors with more than HOT_STRINGS distinct surroundings spread by window.

Defined cases: null and empty texts, and those shorter than `length`, keep everything; matches never cross rows; ids may be null or
repeated (equal rows are copies of each other); an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.anchors import window_runs
from priorlake.llm.groups import per_group
from priorlake.llm.ngram_join import _powers, digest_of, mixed, slices
from priorlake.llm.shared import dropped, small_batches, text_bytes
from priorlake.llm.shared import stored_alone as stored
from priorlake.llm.suffix_merge import longest_matches

LENGTH, HOT_STRINGS = 200, 4096
SLICE_BYTES = 4 << 20  # what repeats within a slice is known without a shuffle


def anchor_keys(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc, again): the anchors of every text, by a hash of the text (equal hashes only add candidates); again: the key repeats in this slice of texts."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, starts = text_bytes(batch.column(1))
            docs_ = batch.column(0).to_numpy()
            for a, b in slices(starts, SLICE_BYTES):
                row, _, _, key = window_runs(data, starts[a : b + 1], length)
                if not len(key):
                    continue
                values, back, counts = np.unique(key, return_inverse=True, return_counts=True)
                again = counts > 1
                # A row for each key and text; the first of each key goes to meet other slices' rows.
                pair = np.unique(np.stack([back, row]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[pair[0]].view(np.int64)), pa.array(docs_[a + pair[1]]), pa.array(again[pair[0]]), pa.array(np.append(True, pair[0][1:] != pair[0][:-1]))],
                    ["key", "doc", "again", "first"],
                )

    return docs.select("doc", "text").mapInArrow(batches, "key long, doc long, again boolean, first boolean")


def _crowded(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of keys that two slices, or one slice twice, have met."""
    again = table["again"].combine_chunks().to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    crowd = (sizes > 1) | (np.add.reduceat(again.astype(int), starts[:-1]) > 0)
    keep = np.repeat(crowd, sizes)
    yield pa.RecordBatch.from_arrays([table["key"].combine_chunks().filter(pa.array(keep)), table["doc"].combine_chunks().filter(pa.array(keep))], ["key", "doc"])


def candidate_runs(docs: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """Places (doc digest, start, string digest) of runs with a crowded anchor, and their strings, folded by partition."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: Counter = Counter()
        size = 0

        def strings() -> Iterator[pa.RecordBatch]:
            rows = list(folded.items())
            folded.clear()
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                none = [None] * len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(none, pa.binary()), pa.array(none, pa.int64()), pa.array([hashlib.md5(s).digest() for (_, s), _ in some], pa.binary()),
                     pa.array([k for (k, _), _ in some], pa.int64()), pa.array([s for (_, s), _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())],
                    ["doc", "start", "digest", "key", "string", "n"],
                )

        for batch in it:
            data, starts = text_bytes(batch.column(1))
            whole, names, wanted = data.tobytes(), batch.column(0).to_pylist(), batch.column(2)
            for a, b in slices(starts, SLICE_BYTES):
                row, first, last, key = window_runs(data, starts[a : b + 1], length)
                if not len(key):
                    continue
                sets = wanted.slice(a, b - a)
                allowed = sets.flatten().to_numpy()
                owner = np.repeat(np.arange(b - a), np.diff(sets.offsets.to_numpy()))
                known = mixed(allowed.view(np.uint64) ^ mixed(owner.astype(np.uint64)))
                fit = np.flatnonzero(np.isin(mixed(key ^ mixed(row.astype(np.uint64))), known))
                places = []
                for k in fit:
                    at = starts[a + row[k]]
                    s = whole[at + first[k] : at + last[k] + length]
                    signed = int(key[k].astype(np.int64))
                    if (signed, s) not in folded:
                        size += len(s)
                    folded[signed, s] += 1
                    places.append((names[a + row[k]], int(first[k]), hashlib.md5(s).digest()))
                none = [None] * len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in places], pa.binary()), pa.array([p[1] for p in places], pa.int64()), pa.array([p[2] for p in places], pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.int64())],
                    ["doc", "start", "digest", "key", "string", "n"],
                )
            if size > 64 << 20:
                yield from strings()
                size = 0
        yield from strings()

    rows = docs.join(keys, "doc").select("digest", "text", "keys")
    return rows.mapInArrow(batches, "doc binary, start long, digest binary, key long, string binary, n long")


def _window_hashes(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number, window start and hash of every window of strings laid end to end."""
    buffer = np.frombuffer(data, np.uint8)
    up, down = _powers(len(buffer))
    prefix = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    counts = np.diff(starts) - length + 1
    string = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[string] + place
    return string, place, mixed((prefix[at + length] - prefix[at]) * down[at])


def _open_ranges(length: int):
    def ranges(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ranges of windows that an undecided string shares with others of its anchor, with constant partners."""
        strings, digests = table["string"].to_pylist(), table["digest"].to_pylist()
        matched = np.maximum(table["match"].to_numpy() - length + 1, 0)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        string, place, value = _window_hashes(b"".join(strings), bounds, length)
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[string]
        order = np.lexsort((value, group))
        new = np.ones(len(order), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (group[order][1:] != group[order][:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(order)))
        undecided = np.add.reduceat((place >= matched[string])[order].astype(int), heads) > 0
        marks = np.add.reduceat(mixed(string[order].astype(np.uint64) + np.uint64(1)), heads)
        keep, mark = np.zeros(len(order), bool), np.zeros(len(order), np.uint64)
        keep[order] = np.repeat((sizes > 1) & undecided, sizes)
        mark[order] = np.repeat(marks, sizes)
        kept = np.flatnonzero(keep)
        if not len(kept):
            return
        cut = np.ones(len(kept), bool)
        cut[1:] = (string[kept][1:] != string[kept][:-1]) | (place[kept][1:] != place[kept][:-1] + 1) | (mark[kept][1:] != mark[kept][:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(kept)) - 1
        rows = [(string[kept[f]], int(place[kept[f]]), int(place[kept[g]])) for f, g in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([digests[s] for s, _, _ in rows], pa.binary()), pa.array([f for _, f, _ in rows], pa.int32()), pa.array([g for _, _, g in rows], pa.int32()), pa.array([strings[s][f : g + length] for s, f, g in rows], pa.binary())],
            ["digest", "first", "last", "string"],
        )

    return ranges


def _hot_ranges(strings: DataFrame, length: int) -> DataFrame:
    """As _open_ranges for anchors with very many surroundings: windows meet by their hash, one range each."""
    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            texts, digests = batch.column("string").to_pylist(), batch.column("digest").to_pylist()
            matched = np.maximum(batch.column("match").to_numpy() - length + 1, 0)
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in texts])])
            string, place, value = _window_hashes(b"".join(texts), bounds, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array([digests[s] for s in string], pa.binary()), pa.array(place.astype(np.int32)), pa.array(place >= matched[string]), pa.array([texts[s][p : p + length] for s, p in zip(string, place, strict=True)], pa.binary())],
                ["value", "digest", "first", "undecided", "string"],
            )

    rows = strings.select("digest", "string", "match").mapInArrow(windows, "value long, digest binary, first int, undecided boolean, string binary")
    crowd = rows.groupBy("value").agg(F.count("*").alias("_n"), F.max("undecided").alias("_u")).where("_n > 1 and _u").select("value")
    return rows.join(crowd, "value").select("digest", "first", F.col("first").alias("last"), "string")


def repeated_windows(runs: DataFrame, length: int) -> DataFrame:
    """(digest, first, last): windows of each string that occur elsewhere too."""
    folded = runs.where("string is not null").select("key", "digest", "string", "n")
    whole = longest_matches(folded, length)
    strings = folded.groupBy("digest").agg(F.first("key").alias("key"), F.first("string").alias("string"))
    strings = stored(strings.join(whole, "digest", "left").withColumn("match", F.coalesce("match", F.lit(0))), "strings")
    left = strings.where(F.col("match") < F.octet_length("string")).groupBy("key").agg(F.count("*").alias("_u"))
    sizes = strings.groupBy("key").agg(F.count("*").alias("_s")).join(left, "key").where("_s > 1 or _u > 0")
    open_ = stored(strings.join(sizes, "key").select("key", "digest", "string", "match", "_s"), "open")
    ranges = per_group(open_.where(F.col("_s") <= HOT_STRINGS).select("key", "digest", "string", "match"), ["key"], _open_ranges(length), "digest binary, first int, last int, string binary", 2000)
    ranges = stored(ranges.unionByName(_hot_ranges(open_.where(F.col("_s") > HOT_STRINGS), length)), "ranges")
    parts = longest_matches(ranges.select("string", F.lit(1).cast("long").alias("n")), length).withColumnRenamed("digest", "part")
    found = ranges.select("digest", "first", "last", F.unhex(F.md5("string")).alias("part")).join(parts, "part")
    found = found.select("digest", "first", F.least(F.col("last"), F.col("first") + F.col("match") - length).alias("last"))
    decided = strings.where(F.col("match") >= length).select("digest", F.lit(0).alias("first"), (F.col("match") - length).alias("last"))
    windows = stored(decided.unionByName(found), "windows")
    dropped(strings, open_, ranges)
    return windows


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary)."""
    small_batches(docs.sparkSession, 2000)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest_of(F.col("text")).alias("digest"))
    long_ = named.where(F.octet_length("text") >= length).withColumn("doc", F.xxhash64("digest"))
    anchors = stored(anchor_keys(long_, length), "anchors")
    local = anchors.where("again and not first").select("key", "doc")
    crowded = per_group(anchors.where("first").select("key", "doc", "again"), ["key"], _crowded, "key long, doc long")
    keys = stored(local.unionByName(crowded).groupBy("doc").agg(F.collect_set("key").alias("keys")), "keys")
    dropped(anchors)
    runs = stored(candidate_runs(long_, keys, length), "runs")
    dropped(keys)
    windows = repeated_windows(runs, length)
    spots = runs.where("string is null").select("doc", "start", "digest").join(windows, "digest")
    spans = spots.select("doc", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")).distinct()
    spans = spans.groupBy(F.col("doc").alias("digest")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stored(spans, "spans")
    dropped(runs, windows)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in found or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                out.append((len(raw), sum(b - a for a, b in merged), len(merged), b"".join([*kept, raw[at:]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = named.join(spans, "digest", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
