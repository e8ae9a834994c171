"""Statistics of whole texts, counted on UTF-8 buffers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import release, row_sums, small_batches, text_bytes

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_bars", "n_shouts", "n_stops", "n_wide", "longest_word", "n_short_lines"]
BLANKS = b" \t\n\x0b\x0c\r"
# Byte classes, two counters to a 64-bit table entry: high and low half.
PAIRS = [
    (BLANKS, bytes(range(0x80, 0xC0))),  # blanks, UTF-8 continuation bytes
    (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (b"0123456789", b".,;:!?'\"()-"),
    (b"|", b"!"),
    (b".", bytes(range(0xE0, 0xF8))),  # sentence ends, characters of three bytes and more
]


def _table(high: bytes, low: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint64)
    out[list(high)] += np.uint64(1 << 32)
    out[list(low)] += np.uint64(1)
    return out


TABLES = [_table(*pair) for pair in PAIRS]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words that occurs at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE for every row of a string column; null counts as empty."""
    data, starts = text_bytes(column)
    halves = []
    for table in TABLES:
        sums = row_sums(table[data], starts) if len(data) else np.zeros(len(starts) - 1, np.int64)
        halves += [sums >> 32, sums & 0xFFFFFFFF]
    blanks, tails, symbols, upper, digits, marks, bars, shouts, stops, wide = halves
    rows = len(starts) - 1
    out = {name: np.zeros(rows, np.int64) for name in COUNTS + MORE}
    out["word_chars"] = np.diff(starts) - tails - blanks
    out["n_symbols"], out["n_upper"], out["n_digits"], out["n_marks"] = symbols, upper, digits, marks
    out["n_bars"], out["n_shouts"], out["n_stops"], out["n_wide"] = bars, shouts, stops, wide
    whole = data.tobytes()
    for i in range(rows):
        text = whole[starts[i] : starts[i + 1]]
        words = text.split()
        if not words:
            continue
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        distinct = set(words)
        out["n_words"][i] = len(words)
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_short_lines"][i] = sum(len(line) < 30 for line in lines)
        out["n_distinct_words"][i] = len(distinct)
        out["longest_word"][i] = max(map(len, distinct))
        out["n_repeat_words"][i] = repeated_words(words)
    return out


def with_text_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: the id, every count of text_counts and the carried columns. Others are not carried."""
    small_batches(docs.sparkSession)
    names = COUNTS + MORE

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            counts = text_counts(batch.column(1))
            arrays = [batch.column(0), *(pa.array(counts[n], pa.int64()) for n in names), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, *batch.schema.names[2:]])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *(carry or []))
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[2:]]
    return slim.mapInArrow(batches, ", ".join(["doc_id long", *(f"{n} long" for n in names), *more]))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares and logarithms of the counts, one row per text; empty texts give zeros."""
    c = {k: v.astype(float) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words,
        c["n_bars"] / words, c["n_shouts"] / words, c["n_stops"] / words, c["n_wide"] / chars,
        np.log1p(c["longest_word"]), c["n_distinct_words"] / np.sqrt(words), np.log1p(c["n_words"] / lines), c["n_short_lines"] / lines,
    ])


FEATURES = [
    "log_words", "word_length", "symbols_per_word", "dup_lines", "repeat_words", "upper", "digits", "marks_per_word",
    "bars_per_word", "shouts_per_word", "stops_per_word", "wide", "log_longest_word", "distinct", "log_line_words", "short_lines",
]
