"""Importance resampling towards a target: hashed feature counts give every document a weight; the best perturbed scores are drawn.

Texts are read once: each document is written as the array of its features' buckets, two or four bytes a feature. Bucket
counts are partial sums from those arrays, gains are one array of BUCKETS numbers, and a document's weight is the sum of
its gains, taken for a whole batch of arrays at once. The draw of a share of all documents is a cutoff in
(score falling, doc_id rising, row): the numeric threshold is bisected by exact count jobs over the written scores, each of
which narrows the range by a power of two, and rows tied at the cutoff are bisected by doc_id, then by row. The drawn rows alone are
range-partitioned for their ranks. Nothing but counts by bucket and by threshold comes to the driver.

Long texts are cut into slices at word ends, so a task holds the words of one slice. A bucket, a score or an id held by a
third of all rows is a count, never a group.

Defined cases: null and empty texts have no features, weight 0 and are never drawn unless the least word count is 0; a null doc_id
is hashed as the empty string and comes last among ties; rows that repeat an id and a score take following ranks, in the order they were
written; an empty target or table is counted as zeros; an empty documents table gives no rows; other columns are not read.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import numbered, release, remembered, row_sums, small_batches, stored, text_bytes

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
# In lower-cased UTF-8 bytes: digits, letters and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLICE_BYTES = 4 << 20
CUTS = 255  # thresholds counted by one job
REMEMBERED_WORDS = 200_000


class _Buckets(dict):
    """The bucket of a word, worked out where it is not remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        out = zlib.crc32(word) % self.buckets
        if len(word) <= 64:
            self[word] = out
        return out


def slices(data: bytes, size: int) -> Iterator[bytes]:
    """data in parts of about `size` bytes, cut where no word is."""
    at = 0
    while len(data) - at > size:
        end = WORD.match(data, at + size)
        end = end.end() if end else at + size
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def feature_buckets(text: bytes, longest: int, known: _Buckets) -> np.ndarray:
    """Buckets of all runs of 1 to `longest` words of a text: all single words, then all pairs and so on."""
    out: list[list] = [[] for _ in range(longest)]
    last: list[bytes] = []
    for part in slices(text.lower(), SLICE_BYTES):
        words = WORD.findall(part)
        out[0].append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if longest == 1:
            continue
        new, words = len(words), last + words
        state = [zlib.crc32(w) for w in words]
        for n in range(2, longest + 1):
            state = [zlib.crc32(b" " + w, s) for s, w in zip(state, words[n - 1 :])]
            # Runs that ended before this part have been counted with it.
            out[n - 1].append(np.array(state[max(0, len(state) - new) :], np.int64) % known.buckets)
        last = words[len(words) - min(len(words), longest - 1) :]
    return np.concatenate([a for run in out for a in run]) if out else np.zeros(0, np.int64)


def bucketed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, name: str = "buckets") -> DataFrame:
    """Written rows _row, doc_id, n_words, features (the buckets, little-endian 16- or 32-bit integers), one for each document."""
    small_batches(docs.sparkSession)
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = remembered(("buckets", buckets), lambda: _Buckets(buckets))
            data, at = text_bytes(batch["_text"])
            data = data.tobytes()
            words, packed = [], []
            for a, b in zip(at[:-1], at[1:]):
                found = feature_buckets(data[a:b], longest, known)
                words.append(_n_words(len(found), longest))
                packed.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["doc_id"], pa.array(words, pa.int64()), pa.array(packed, pa.binary())], ["_row", "doc_id", "n_words", "features"]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text"))
    return stored(rows.mapInArrow(work, "_row long, doc_id long, n_words long, features binary"), name)


def _n_words(features: int, longest: int) -> int:
    """How many words give that many runs of 1 to `longest` words."""
    if features < longest * (longest + 1) // 2:
        return next(n for n in range(longest + 1) if n * (n + 1) // 2 == features)
    return (features + longest * (longest - 1) // 2) // longest


def bucket_counts(arrays: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends one sum for each bucket it met."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, data = _binary(batch["features"], kind)
            total += np.bincount(data, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    sums = arrays.select("features").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def _binary(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (in values) and values of a column of packed arrays without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)
    return (at - at[0]) // kind.itemsize, values


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source, in doubles."""
    k = len(source)
    all_source, all_target = float(int(source.sum()) + k), float(int(target.sum()) + k)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source, target)], np.int64)


def weighted(arrays: DataFrame, gains: np.ndarray) -> DataFrame:
    """_row, doc_id, n_words, n_features, weight: the gains of a batch's arrays are gathered and summed by row at once."""
    kind = np.dtype("<u2" if len(gains) <= 1 << 16 else "<u4")
    shared = arrays.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        gain = shared.value
        for batch in batches:
            at, data = _binary(batch["features"], kind)
            sums = row_sums(gain[data], at)
            columns = [batch["_row"], batch["doc_id"], batch["n_words"], pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "n_words", "n_features", "weight"])

    return arrays.select("_row", "doc_id", "n_words", "features").mapInArrow(work, "_row long, doc_id long, n_words long, n_features long, weight long")


def perturbation(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), a standard Gumbel draw in thousandths; u comes from a hash of (seed, doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def bisected(rows: DataFrame, column: str, most: int) -> tuple[int, int] | None:
    """(value, n): the smallest value of a long column that at least `most` rows do not exceed, and how many rows are below it.

    Each job counts the open range's rows between CUTS thresholds exactly, so it narrows the range by that factor; the filter
    on the range reaches the scan. None if there are fewer rows than `most`.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if most < 1 or n < most:
        return None
    low, high, below = int(low), int(high), 0
    while low < high:
        step = -(-(high - low + 1) // (CUTS + 1))
        wide = high - low >= 1 << 62  # such differences need not fit a long
        place = F.expr(f"cast((cast({column} as decimal(38, 0)) - {low}BD) div {step}BD as int)" if wide else f"cast(({column} - {low}L) div {step}L as int)")
        counts = rows.where(F.col(column).between(low, high)).groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["at"]):
            if below + r["n"] >= most:
                low, high = low + r["at"] * step, min(high, low + (r["at"] + 1) * step - 1)
                break
            below += r["n"]
    return low, below


def cutoff(rows: DataFrame, order: list[str], most: int) -> Column:
    """Which of rows are among the first `most` in the order of long columns, nulls last; the last column tells all rows apart."""
    inside, tied = F.lit(False), F.lit(True)
    for column in order:
        here = rows.where(tied)
        found = bisected(here, column, most)
        if found is None:  # all values that are there go in, the rest comes from the nulls
            known = here.where(F.col(column).isNotNull()).count() if most > 0 else 0
            if most <= 0:
                return F.coalesce(inside, F.lit(False))
            inside, tied, most = inside | (tied & F.col(column).isNotNull()), tied & F.col(column).isNull(), most - known
            continue
        value, below = found
        inside, tied, most = inside | (tied & (F.col(column) < value)), tied & (F.col(column) == value), most - below
    return F.coalesce(inside | tied, F.lit(False))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1, 2, ... by falling score; null: not drawn)."""
    arrays = bucketed(docs, longest, buckets)
    aims = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets, "target")
    gains = bucket_gains(bucket_counts(arrays, buckets), bucket_counts(aims, buckets))
    scores = weighted(arrays, gains).withColumn("score", F.col("weight") + perturbation(F.col("doc_id"), seed))
    scores = stored(scores.withColumn("_fall", -F.col("score")), "scores")
    able = F.col("n_words") >= least_words
    fit = scores.where(able)
    most = percent * fit.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not most:
        return scores.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = able & cutoff(fit, ["_fall", "doc_id", "_row"], most)
    first = scores.where(drawn).select(*out, "_fall", "_row")
    ranked = numbered(first, [], ["_fall", F.col("doc_id").asc_nulls_last(), "_row"], "ranks", "rank").select(*out, (F.col("rank") + 1).alias("rank"))
    return ranked.unionByName(scores.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


SQL = f"""with crc_step as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda b: 0::ubigint)),
         lambda x, b: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as step),
source as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from documents),
target as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w
  from benchmark),
runs as (select r, w, count(*) as n from (select r, unnest(words) as w from source) group by r, w),
bucket as (
  select w, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::ubigint)),
         lambda c, b: xor(step[(xor(c, b) & 255)::bigint + 1], c >> 8)), 4294967295::ubigint) % {BUCKETS} as b
  from (select w from runs union select w from target), crc_step),
s as (select b, sum(n)::double as s from runs join bucket using (w) group by b),
t as (select b, count(*)::double as t from target join bucket using (w) group by b),
gain as (
  select b, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((select sum(s) from s), 0) + {BUCKETS}) / ((coalesce(s, 0) + 1) * (coalesce((select sum(t) from t), 0) + {BUCKETS}))))::bigint as g
  from s full join t using (b)),
weights as (select r, sum(n * g)::bigint as weight from runs join bucket using (w) join gain using (b) group by r),
scored as (
  select r, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))))::bigint as score
  from source left join weights using (r)),
ranked as (
  select r, row_number() over (order by score desc, doc_id nulls last, r) as place, count(*) over () as n from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when place <= {PERCENT} * n // 100 then place end as rank
from scored left join ranked using (r)"""
