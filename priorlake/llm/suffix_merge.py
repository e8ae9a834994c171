"""Distributed merge sort of byte strings with known common prefixes.

Partitions sort and fold their strings, front-code each sorted run and cut it at sampled splitters; runs travel front-coded
to the task of their range, which combines them with a loser tree. The tree keeps each run's common prefix with the last
string put out, so characters known to be equal are never compared again. What comes out is every string's longest
common prefix with any other.
"""
from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.groups import per_group
from priorlake.llm.shared import stored_alone as stored

RUN_STRINGS, SAMPLES, RANGE_STRINGS = 20_000, 2_000, 20_000


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, the first `known` bytes being equal."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Prefix shared with the string before, length of the rest, and all rests, of a sorted list."""
    shared, rests, before = np.zeros(len(strings), np.uint32), [], b""
    for k, s in enumerate(strings):
        shared[k] = common(before, s) if k else 0
        rests.append(s[shared[k] :])
        before = s
    return shared, np.array([len(r) for r in rests], np.uint32), b"".join(rests)


class Run:
    """Reads a front-coded run: the current string and its prefix shared with the one before it."""

    def __init__(self, shared: bytes, lengths: bytes, counts: bytes, rests: bytes) -> None:
        self.shared, self.lengths = np.frombuffer(shared, np.uint32).tolist(), np.frombuffer(lengths, np.uint32).tolist()
        self.counts, self.rests = np.frombuffer(counts, np.int64).tolist(), rests
        self.at, self.place = -1, 0
        self.string: bytes | None = b""
        self.known = 0
        self.step()

    def step(self) -> None:
        self.at += 1
        if self.at >= len(self.shared):
            self.string = None
            return
        n = self.lengths[self.at]
        self.known = self.shared[self.at]
        self.string = self.string[: self.known] + self.rests[self.place : self.place + n]
        self.place += n


class LoserTree:
    """Merges runs; known[r] is the prefix run r's string shares with the winner it last lost to."""

    def __init__(self, runs: list[Run]) -> None:
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _string(self, r: int) -> bytes | None:
        return self.runs[r].string if 0 <= r < len(self.runs) else None

    def _build(self, node: int) -> int:
        if node >= self.size:
            leaf = node - self.size
            if leaf < len(self.runs):
                self.runs[leaf].known = 0
            return leaf
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; on a tie of known prefixes only what lies behind them is compared."""
        x, y = self._string(a), self._string(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.runs[a], self.runs[b]
        if p.known != q.known:
            return (a, b) if p.known > q.known else (b, a)
        n = common(x, y, p.known)
        if x[n:] <= y[n:]:
            q.known = n
            return a, b
        p.known = n
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """Strings in order with the prefix shared with the one before, and counts."""
        while (string := self._string(self.winner)) is not None:
            run = self.runs[self.winner]
            yield string, run.known, run.counts[run.at]
            run.step()
            contender, node = self.winner, (self.winner + self.size) // 2
            while node:
                contender, self.losers[node] = self._play(contender, self.losers[node])
                node //= 2
            self.winner = contender


def _digest(s: bytes) -> bytes:
    return hashlib.md5(s).digest()


def longest_matches(strings: DataFrame, least: int) -> DataFrame:
    """(digest, match): MD5 of every distinct string whose longest common prefix with another is `least` or more.

    strings: (string binary, n long); equal strings count as others of each other. The driver sees at most a bounded
    sample of strings and the outer two of each range.
    """
    total = strings.count()
    ranges = max(1, min(total // RANGE_STRINGS + 1, 20_000))
    sample = [bytes(r[0]) for r in strings.select("string").where(F.pmod(F.xxhash64("string", F.lit(17)), F.lit(max(1, total // SAMPLES))) == 0).distinct().limit(20 * SAMPLES + ranges).collect()]
    sample.sort()
    splitters = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
            order = sorted(held)
            cuts = [0, *(bisect.bisect_left(order, s) for s in splitters), len(order)]
            rows = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for at in range(a, b, RUN_STRINGS):
                    some = order[at : min(b, at + RUN_STRINGS)]
                    shared, lengths, rests = front_coded(some)
                    counts = np.array([held[s] for s in some], np.int64)
                    rows.append((k, shared.tobytes(), lengths.tobytes(), counts.tobytes(), rests))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 5))], ["range", "shared", "lengths", "counts", "rests"])

        held: dict[bytes, int] = {}
        size = 0
        for batch in it:
            for s, n in zip(batch.column("string").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if s not in held:
                    size += len(s)
                held[s] = held.get(s, 0) + n
            if size > 32 << 20:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def merged(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [table[c] for c in ("shared", "lengths", "counts", "rests")]
        numbers = table["range"].to_numpy()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            out: list[tuple[bytes, int, bytes | None]] = []
            held, count, best = None, 0, 0
            first = True

            def close(edge: bool) -> None:
                match = max(best, len(held) if count > 1 else 0)
                if match >= least or edge:
                    out.append((_digest(held), match, held if edge else None))

            for string, known, n in LoserTree([Run(*(c[k].as_py() for c in columns)) for k in range(a, b)]):
                if held is not None and known == len(held) == len(string):
                    count += n
                    continue
                if held is not None:
                    best = max(best, known)
                    close(first)
                    first = False
                held, count, best = string, n, known if held is not None else 0
            if held is not None:
                close(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(numbers[a])] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                ["range", "digest", "match", "edge"],
            )

    runs = strings.select("string", "n").mapInArrow(coded, "range int, shared binary, lengths binary, counts binary, rests binary")
    found = stored(per_group(runs, ["range"], merged, "range int, digest binary, match int, edge binary", 1), "matches")
    edges = [(r["range"], bytes(r["edge"])) for r in found.where("edge is not null").select("range", "edge").collect()]
    edges.sort()
    # Strings at the ends of neighbouring ranges meet here.
    extra = []
    for (_, x), (_, y) in zip(edges[:-1], edges[1:], strict=True):
        if x != y and (n := common(x, y)) >= least:
            extra += [(_digest(x), n), (_digest(y), n)]
    out = found.where(F.col("match") >= least).select("digest", "match")
    if extra:
        out = out.unionByName(strings.sparkSession.createDataFrame([(bytearray(d), n) for d, n in extra], "digest binary, match int"))
    return out.groupBy("digest").agg(F.max("match").alias("match"))
