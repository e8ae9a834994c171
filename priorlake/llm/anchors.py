"""Content-defined anchors: equal windows of a text choose the same byte as their anchor."""
from __future__ import annotations

import numpy as np

from priorlake.llm.ngram_join import _powers, mixed

KMER = 100  # a longer key leaves fewer chance candidates, a shorter one fewer runs


def window_runs(data: np.ndarray, starts: np.ndarray, length: int, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one anchor: row, first and last window start in the row, anchor hash.

    The anchor of a window of `length` bytes is its leftmost k-mer of least hash, so it depends on the window's bytes only.
    """
    data = data[starts[0] : starts[-1]]
    starts = starts - starts[0]
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    m = len(data) - kmer + 1
    hashes = mixed((prefix[kmer:] - prefix[:m]) * down[:m])
    bits = np.uint64(max(int(m).bit_length(), 1))
    low = (hashes >> bits << bits) | np.arange(m, dtype=np.uint64)
    width, have = length - kmer + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[width - have : width - have + n])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    valid = np.arange(n) + length <= starts[1:][row]
    at = np.flatnonzero(valid)
    if not len(at):
        return empty, empty, empty, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    r = row[at[first]]
    return r, at[first] - starts[r], at[last] - starts[r], hashes[anchor[at[first]]]
