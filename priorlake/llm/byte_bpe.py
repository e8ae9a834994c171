"""Byte-level BPE by DuckDB inside each partition: recursive contraction encodes, ordered aggregation decodes.

Texts are cut by the pattern; each distinct word becomes rows (word, position, token). A recursive query joins
neighbouring rows with the merge table and contracts every word's leftmost pair of minimum rank until no pair is left.
Ids are decoded by joining the vocabulary and aggregating bytes in position order. Work is per partition, nothing is
shuffled; words met before in a worker are remembered up to a bound. A text's ids and bytes are those of its words in
order, gathered by Arrow for whole slices of texts.

Defined cases: a null or empty text has no ids and decodes to no bytes; null and repeated ids of documents are kept row by
row; an empty table gives no rows. Very long words contract all disjoint occurrences of a pair at once where no later
merge could come first, and pass through the query in rounds, so memory stays bounded.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import Recent, remembered, small_batches, trim

REMEMBERED, SLICE_CHARS = 200_000, 1_500_000
MOST_IDS = 1 << 27
# The same alternatives with the apostrophe looked at once.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d|", "'(?:[stmd]|re|ve|ll)|"
WORDS_AT_ONCE, LONG_WORD, ROUNDS = 20_000, 256, 24

# k holds word and position, x token and length (12 bits each for position and length in a short word, 27 for a token), so
# that neighbours meet by one number. Every round: the minimum of (rank, position, next position, length) per word is its
# leftmost pair of minimum rank. A word without a pair is done and leaves.
SHORT_SQL = """
with recursive step(done, k, x) as (
    select false, (w::bigint << 12) | p, (t::bigint << 12) | l from start
    union all (
        with best as (
            select s.k >> 12 as w, min((m.m::bigint << 36) | ((s.k & 4095) << 24) | ((n.k & 4095) << 12) | ((s.x & 4095) + (n.x & 4095))) as b
            from (select k, x from step where not done) s join (select k, x from step where not done) n on n.k = s.k + (s.x & 4095)
                 join merges m on m.ab = ((s.x >> 12) << 27) | (n.x >> 12)
            group by 1)
        select b is null, s.k, case when (s.k & 4095) = ((b >> 24) & 4095) then ((b >> 36) << 12) | (b & 4095) else s.x end
        from step s left join best on best.w = s.k >> 12
        where not s.done and (s.k & 4095) is distinct from ((b >> 12) & 4095)))
select (k >> 12)::int as w, (k & 4095)::int as p, (x >> 12)::int as t from step where done order by k
"""
# As above; where it is safe, all disjoint occurrences of the minimum pair at once, at most ROUNDS rounds.
LONG_SQL = """
with recursive step(i, w, p, t, l) as (
    select 0::int, w, p, t, l from start
    union all (
        with pairs as (
            select s.w, s.p, n.p as np, m.m, m.plain, m.a = m.b as same, s.l
            from step s join step n on n.w = s.w and n.p = s.p + s.l join merges m on m.a = s.t and m.b = n.t
            where s.i < {rounds}),
        least as (select *, min(m) over (partition by w) as low from pairs),
        places as (
            select *, row_number() over (partition by w order by p) as k, p - l * row_number() over (partition by w order by p) as run
            from least where m = low),
        hits as (
            select w, p, np, m from places
            qualify case when not plain then k = 1
                         when same then row_number() over (partition by w, run order by p) % 2 = 1 else true end)
        select s.i + 1, s.w, s.p, coalesce(v.t, s.t), coalesce(v.l, s.l)
        from step s join (select distinct w from hits) b on b.w = s.w
             left join hits h on h.w = s.w and h.p = s.p left join vocabulary v on v.t = h.m
             left join hits g on g.w = s.w and g.np = s.p
        where g.w is null))
select w, p, t, l, i from step qualify i = max(i) over (partition by w) order by w, p
"""
DECODE_SQL = "select w, unhex(string_agg(h, '' order by p)) as b from ids join vocabulary using (t) group by w order by w"
# One sort for all words, not one each. Aggregates keep the order of their input in one thread; what comes out is compared with the words.
SORTED_DECODE_SQL = "select w, unhex(string_agg(h, '')) as b from (select w, h from ids join vocabulary using (t) order by w, p) group by w order by w"


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class ByteBPE:
    """One vocabulary in one in-memory DuckDB of a worker."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.words_of = regex.compile(pattern.replace(*ENDINGS)).findall
        ranks = read_ranks(ranks_path)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        if max(ranks.values()) >= MOST_IDS:
            raise ValueError(f"token ids must be below {MOST_IDS}")
        merges = [
            (ranks[t[:k]], ranks[t[k:]], m) for t, m in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        a, b, m = np.array(merges, np.int32).reshape(-1, 3).T
        # A token is plain if every merge with it has a higher rank than the token itself.
        early = np.zeros(max(ranks.values()) + 1, bool)
        early[a[m < a]] = True
        early[b[m < b]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self._load("merges", a=a, b=b, ab=(a.astype(np.int64) << 27) | b, m=m, plain=~early[m])
        tokens = sorted(ranks, key=ranks.__getitem__)
        self._load("vocabulary", t=np.array([ranks[t] for t in tokens], np.int32), l=np.array([len(t) for t in tokens], np.int32), h=[t.hex() for t in tokens])
        self.words: Recent = Recent(REMEMBERED)

    def _load(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create table {name} as select * from incoming").fetchall()
        self.db.unregister("incoming")

    def _ask(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _start(self, words: list[bytes]) -> pa.Table:
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        return pa.table({"w": word, "p": place, "t": tokens, "l": np.ones(len(word), np.int32)})

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for at in range(0, len(short), WORDS_AT_ONCE):
            some = short[at : at + WORDS_AT_ONCE]
            self._place(out, some, self._ask(SHORT_SQL, "start", self._start([words[i] for i in some])))
        for i in (i for i, w in enumerate(words) if len(w) > LONG_WORD):
            state = self._start([words[i]])
            while True:
                state = self._ask(LONG_SQL.format(rounds=ROUNDS), "start", state)
                if state.num_rows == 0 or state["i"][0].as_py() < ROUNDS:
                    break
            self._place(out, [i], state)
        return out

    @staticmethod
    def _place(out: list[bytes], which: list[int], rows: pa.Table) -> None:
        word, ids = rows["w"].to_numpy(), rows["t"].to_numpy().astype("<u4")
        cuts = np.searchsorted(word, np.arange(len(which) + 1)) * 4
        data = ids.tobytes()
        for k, i in enumerate(which):
            out[i] = data[cuts[k] : cuts[k + 1]]

    def decode(self, encoded: list[bytes], sql: str = DECODE_SQL) -> list[bytes]:
        """Bytes of each list of ids."""
        lengths = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
        out = [b""] * len(encoded)
        at = 0
        while at < len(encoded):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), 1_000_000)) + at)
            n = lengths[at:upto]
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            ids = np.frombuffer(b"".join(encoded[at:upto]), "<u4").astype(np.int32)
            rows = self._ask(sql, "ids", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": place, "t": ids}))
            for w, b in zip(rows["w"].to_pylist(), rows["b"].to_pylist(), strict=True):
                out[at + w] = b
            at = upto
        return out

    def _both(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each word and the bytes they decode to."""
        ids = self.encode_words(words)
        decoded = self.decode(ids, SORTED_DECODE_SQL)
        return zip(ids, decoded if decoded == words else self.decode(ids), strict=True)

    def _slice(self, texts: list[str]) -> list[pa.Array]:
        words = [self.words_of(t) for t in texts]
        ends = np.cumsum([0, *map(len, words)])
        dealt = pa.array([w for some in words for w in some], pa.large_string()).dictionary_encode()
        distinct = dealt.dictionary.to_pylist()
        fresh = self.words.missing(distinct)
        raw = [w.encode() for w in fresh]
        # Bytes are remembered only where they are not the word's own, so that no word is held twice.
        known = self.words.learn((w, ids if b == r else (ids, b)) for w, r, (ids, b) in zip(fresh, raw, self._both(raw), strict=True))
        ids, decoded = [known[w] for w in distinct], dealt.dictionary.cast(pa.large_binary())
        if any(type(i) is tuple for i in ids):
            decoded = pa.array([i[1] if type(i) is tuple else w.encode() for i, w in zip(ids, distinct, strict=True)], pa.large_binary())
            ids = [i[0] if type(i) is tuple else i for i in ids]
        return [gathered(values, dealt.indices, ends) for values in (pa.array(ids, pa.large_binary()), decoded)]

    def round_trip(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids of every text and the bytes these ids decode to, as binary columns."""
        starts = np.cumsum([0, *map(len, texts)])
        ids, decoded, at = [pa.array([], pa.large_binary())], [pa.array([], pa.large_binary())], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_CHARS, side="right")) - 1)
            some = self._slice(texts[at:upto])
            ids.append(some[0])
            decoded.append(some[1])
            at = upto
        return pa.concat_arrays(ids), pa.concat_arrays(decoded)


def gathered(values: pa.Array, indices: pa.Array, ends: np.ndarray) -> pa.Array:
    """The values at the indices, those between consecutive ends joined to one binary value."""
    taken = values.take(indices)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends]), taken.buffers()[2] or pa.py_buffer(b"")])


def opened(ranks_path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    return remembered((ranks_path, pattern), lambda: ByteBPE(ranks_path, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, carried columns, ids (binary, little-endian 32-bit), n_tokens, decoded (binary, from the ids)."""
    carry = carry or []
    small_batches(docs.sparkSession, 1000)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(ranks_path, pattern)
        for batch in it:
            trim()
            ids, decoded = model.round_trip(batch.column(0).to_pylist())
            n = pc.divide(pc.binary_length(ids), 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids.cast(pa.binary()), n, decoded.cast(pa.binary())], [*batch.schema.names[1:], "ids", "n_tokens", "decoded"])

    slim = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[1:])
    return slim.mapInArrow(batches, f"{schema}, ids binary, n_tokens long, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes of rows (doc_id, ids); null ids decode to no bytes."""
    small_batches(encoded.sparkSession, 1000)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(ranks_path, pattern)
        for batch in it:
            decoded = model.decode([x or b"" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(batches, "doc_id long, decoded binary")
