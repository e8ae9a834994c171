"""Spelling variant grouping: the edits of every word are probed against broadcast Bloom filters, only positives are joined.

Words are counted per task and summed. The vocabulary fills split-block Bloom filters, one for each word length; the single deletions
and replacements of every word are hashed without being written out (a polynomial hash changes by one term), and
the filters of two lengths, the word's own and the next shorter one, say which edits may be words. Only those become
strings and meet the vocabulary in an exact join, which removes false positives. Insertions are the deletions of the longer word,
and of two words that differ by a replacement the one with the smaller letter finds the other, so each pair is found once.

Filters take 16 bits a word. Where those of the whole vocabulary would be larger than FILTER_BYTES, words are cut
by hash into parts, and one pass for each part broadcasts filters within that bound and probes the edits that fall to it: a larger vocabulary
takes more passes, never a larger broadcast. A word has at most a few thousand near words whatever the corpus, so no join key is hot;
words held by every document are counted before the shuffle.

Defined cases: null and empty texts have no words; a null doc_id is hashed as the empty string; rows that repeat a text count
again; very long texts are cut into slices where no word is; words of any length work (edits are hashed in slices); an empty
table gives no rows; other columns are not read. Ties among forms go to the smallest word in code-point order.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import release, small_batches, stored, text_bytes

LEAST_LETTERS, LEAST_COUNT, RATIO, THINNED = 5, 3, 2, 97
# Lower-cased UTF-8: a-z, and C3 80 to C3 BF for U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
SLICE_BYTES, HELD_WORDS = 4 << 20, 200_000
LENGTHS = 64  # lengths from here on share a filter
WORD_BITS, BLOCK_WORDS = 16, 8
FILTER_BYTES = 32 << 20
EDIT_LETTERS = 1 << 17  # letters whose edits are hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: the base of the words' hash
# The published multipliers of split-block Bloom filters (Parquet format), one for each number of a block.
SALTS = [np.uint32(s) for s in (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)]


def lengths_of(letters: np.ndarray) -> np.ndarray:
    """The filter's number for words of these lengths."""
    return np.minimum(letters, LENGTHS)


def slice_counts(seed: int, text: bytes, start: int, end: int) -> Counter:
    """Counts of the runs in a slice; the runs whose checksum after the seed THINNED divides have lost the letter it names."""
    counts = Counter(RUN.findall(text, start, end))
    moved = []
    for run in [r for r in counts if not zlib.crc32(r, seed) % THINNED]:
        letters = run.decode()
        drop = zlib.crc32(run, seed) % len(letters)
        moved.append(((letters[:drop] + letters[drop + 1 :]).encode(), counts.pop(run)))
    for run, n in moved:
        counts[run] += n
    return counts


def text_slices(text: bytes) -> Iterator[tuple[int, int]]:
    """Where to cut a lower-cased text so that no run is cut."""
    at = 0
    while True:
        end = at + SLICE_BYTES
        if end >= len(text):
            yield at, len(text)
            return
        end -= text[end] & 0xC0 == 0x80
        run = RUN.match(text, end)
        end = run.end() if run else end + (text[end] >= 0x80)
        yield at, end
        at = end


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Written rows (word, n): words of at least so many code points that occur at least so often in all texts."""
    spark = docs.sparkSession
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            data, at = text_bytes(batch["_text"])
            data = data.tobytes()
            for doc_id, a, b in zip(batch["_id"].to_pylist(), at[:-1], at[1:]):
                text = data[a:b].lower()
                seed = zlib.crc32(f"{doc_id}:".encode())
                for start, end in text_slices(text):
                    for run, n in slice_counts(seed, text, start, end).items():
                        if len(run) >= least_letters:
                            total[run] += n
                    if len(total) > HELD_WORDS:
                        yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text").cast("string").alias("_text"))
    words = rows.mapInArrow(work, "word string, n long").where(F.length("word") >= least_letters)
    words = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    # Edits of few bytes of words are much work, so they are dealt out by number and not by size.
    return stored(words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"), "vocabulary")


class Edits:
    """A batch of words as letters with the sums that hash their edits."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), self.size)
        first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.letter)) - first[self.word]
        powers = np.full(max(1, int(self.size.max(initial=1))), BASE, np.uint64)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[self.place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letter * self.power, dtype=np.uint64)])
        self.before = sums[:-1] - sums[first][self.word]
        self.hash = sums[first + self.size] - sums[first]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the batch's letters) and hashes of the words without the letter there; of equal neighbours only the first goes."""
        same = np.zeros(len(self.letter), bool)
        same[1:] = (self.letter[1:] == self.letter[:-1]) & (self.word[1:] == self.word[:-1])
        at = np.flatnonzero(~same)
        rest = self.hash[self.word[at]] - self.before[at] - self.letter[at] * self.power[at]
        return at, self.before[at] + rest * INVERSE

    def replacements(self, letter: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places with a smaller letter, and the hashes of the words with the letter there instead."""
        at = at[self.letter[at] < letter]
        return at, self.hash[self.word[at]] + (np.uint64(letter) - self.letter[at]) * self.power[at]


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed_bits(hashes: np.ndarray) -> np.ndarray:
    """Hashes with all bits depending on all bits."""
    x = hashes ^ (hashes >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Filters:
    """Split-block Bloom filters, one for each length, of the words of one part of `parts`.

    A word sets one bit in each of the 8 32-bit numbers of one block. Lookups go number by number and drop what is absent.
    """

    def __init__(self, blocks: np.ndarray, first: np.ndarray, part: int, parts: int, letters: np.ndarray) -> None:
        self.blocks, self.first, self.part, self.parts, self.letters = blocks, first, part, parts, letters

    def located(self, hashes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes belong to this part and length classes with words, their blocks and the 32 bits that choose the bits."""
        x = mixed_bits(hashes)
        n = (self.first[length + 1] - self.first[length]).astype(np.uint64)
        own = n > 0
        if self.parts > 1:
            own &= (x >> np.uint64(8)) % np.uint64(self.parts) == self.part
        own = np.flatnonzero(own)
        x, length = x[own], length[own]
        block = self.first[length] + (((x >> np.uint64(32)) * n[own]) >> np.uint64(32)).astype(np.int64)
        return own, block, (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    @staticmethod
    def bit(low: np.ndarray, k: int) -> np.ndarray:
        return np.uint32(1) << ((low * SALTS[k]) >> np.uint32(27))

    def perhaps(self, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be words of this part."""
        own, block, low = self.located(hashes, length)
        for k in range(BLOCK_WORDS):
            if not len(own):
                break
            there = (self.blocks[block, k] & self.bit(low, k)) != 0
            own, block, low = own[there], block[there], low[there]
        return own


def _batches(words: list[str]) -> Iterator[list[str]]:
    """Words in groups of about EDIT_LETTERS letters."""
    held, letters = [], 0
    for word in words:
        held.append(word)
        letters += len(word)
        if letters >= EDIT_LETTERS:
            yield held
            held, letters = [], 0
    if held:
        yield held


def _shape(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words in each length class, and which of LETTERS the words of a class use: at most 65 x 91 counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((LENGTHS + 1, len(LETTERS) + 1), np.int64)
        for batch in batches:
            for words in _batches(batch["word"].to_pylist()):
                e = Edits(words)
                count[:, -1] += np.bincount(lengths_of(e.size), minlength=LENGTHS + 1)
                np.add.at(count, (lengths_of(e.size)[e.word], np.searchsorted(LETTERS, e.letter)), 1)
        length, letter = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(letter, pa.int32()), pa.array(count[length, letter], pa.int64())], ["length", "letter", "n"])

    count = np.zeros((LENGTHS + 1, len(LETTERS) + 1), np.int64)
    for r in vocab.select("word").mapInArrow(work, "length int, letter int, n long").groupBy("length", "letter").agg(F.sum("n").alias("n")).collect():
        count[r["length"], r["letter"]] = r["n"]
    return count[:, -1], count[:, :-1] > 0


def filters(vocab: DataFrame, filter_bytes: int | None = None) -> Iterator[Filters]:
    """The vocabulary's filters, part by part, each within filter_bytes; tasks set bits, the sums of bits come to the driver."""
    filter_bytes = filter_bytes or FILTER_BYTES
    words, letters = _shape(vocab)
    block_bits, block_bytes = 32 * BLOCK_WORDS, 4 * BLOCK_WORDS
    parts = max(1, -(-int(words.sum()) * WORD_BITS // 8 // max(1, filter_bytes - block_bytes * (LENGTHS + 1))))
    blocks = np.where(words > 0, -(-words * WORD_BITS // (block_bits * parts)), 0)
    first = np.concatenate([[0], np.cumsum(blocks)])
    names = [f"w{k}" for k in range(BLOCK_WORDS)]
    for part in range(parts):
        empty = Filters(np.zeros((0, BLOCK_WORDS), np.uint32), first, part, parts, letters)

        def work(batches: Iterator[pa.RecordBatch], empty: Filters = empty) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for words in _batches(batch["word"].to_pylist()):
                    e = Edits(words)
                    _, block, low = empty.located(e.hash, lengths_of(e.size))
                    order = np.argsort(block, kind="stable")
                    block, low = block[order], low[order]
                    starts = np.flatnonzero(np.diff(block, prepend=-1))
                    if len(starts):
                        bits = [np.bitwise_or.reduceat(Filters.bit(low, k), starts).view(np.int32) for k in range(BLOCK_WORDS)]
                        yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), *[pa.array(b, pa.int32()) for b in bits]], ["block", *names])

        rows = vocab.select("word").mapInArrow(work, "block long, " + ", ".join(f"{w} int" for w in names))
        table = rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]).toArrow()
        full = np.zeros((int(first[-1]), BLOCK_WORDS), np.uint32)
        at = table["block"].to_numpy()
        for k, w in enumerate(names):
            full[at, k] = table[w].to_numpy().view(np.uint32)
        yield Filters(full, first, part, parts, letters)


def edits_that_may_be_words(words: list[str], known: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(index of the word, edited word) for the deletions and replacements of words that pass the filters."""
    e = Edits(words)
    length = lengths_of(e.size)

    def edited(at: np.ndarray, new: str) -> tuple[np.ndarray, list[str]]:
        own = e.word[at]
        return own, [words[w][:k] + new + words[w][k + 1 :] for w, k in zip(own.tolist(), e.place[at].tolist())]

    at, hashes = e.deletions()
    yield edited(at[known.perhaps(hashes, lengths_of(e.size[e.word[at]] - 1))], "")
    of_letter = length[e.word]
    for k, letter in enumerate(LETTERS.tolist()):
        at = np.flatnonzero(known.letters[of_letter, k])  # places in words of a length that uses the letter
        at, hashes = e.replacements(letter, at)
        if len(at):
            yield edited(at[known.perhaps(hashes, of_letter[at])], chr(letter))


def near_words(vocab: DataFrame, filter_bytes: int | None = None) -> DataFrame:
    """Pairs (word, n, near, near_n) of words of a written vocabulary that differ by one edit; each pair in one of its two orders."""
    found = None
    for known in filters(vocab, filter_bytes):
        shared = vocab.sparkSession.sparkContext.broadcast(known)  # at most filter_bytes

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for words in _batches(batch["word"].to_pylist()):
                    n = batch["n"].slice(at, len(words)).to_numpy()
                    at += len(words)
                    for own, near in edits_that_may_be_words(words, shared.value):
                        if len(own):
                            yield pa.RecordBatch.from_arrays([pa.array([words[w] for w in own.tolist()]), pa.array(n[own]), pa.array(near, pa.string())], ["word", "n", "near"])

        passed = vocab.mapInArrow(work, "word string, n long, near string")
        found = passed if found is None else found.unionByName(passed)
    return found.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of (word, form): where forms lead to. Written rounds, each of which doubles how far they have looked."""
    up = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = stored(up.join(further, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variant_groups(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. A word's form is its most frequent near word, if that is `ratio` times as frequent."""
    vocab = vocabulary(docs, least_letters, least_count)
    pairs = stored(near_words(vocab), "near_words")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("fall"), "near")).alias("best"))
    formed = -F.col("best.fall") >= F.lit(ratio) * F.col("n")
    words = vocab.join(best, "word", "left").select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.fall")).alias("form_n")
    )
    words = stored(words, "forms")
    out = words.join(roots(words.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""with recursive crc_step as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda b: 0::ubigint)),
         lambda x, b: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as step),
runs as (
  select id, run, count(*) as n
  from (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents)
  group by id, run),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: ('0x' || h)::ubigint)),
         lambda c, b: xor(step[(xor(c, b) & 255)::bigint + 1], c >> 8)), 4294967295::ubigint)::bigint as h
  from runs, crc_step),
words as materialized (
  select word, sum(n)::bigint as n
  from (select case when h % {THINNED} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed)
  where length(word) >= {LEAST_LETTERS} group by word having sum(n) >= {LEAST_COUNT}),
holes as (
  select word, n, k, substr(word, 1, k - 1) as head, substr(word, k + 1) as tail from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
pairs as materialized (
  select a.word, b.word as near, b.n as near_n from holes a join holes b on a.k = b.k and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union
  select h.word, w.word, w.n from holes h join words w on h.head || h.tail = w.word
  union
  select w.word, h.word, h.n from holes h join words w on h.head || h.tail = w.word),
best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word),
forms as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= {RATIO} * n then near end as form, case when near_n >= {RATIO} * n then near_n end as form_n
  from words left join best using (word)),
climb as (
  select word, word as root from forms where form is null
  union all
  select f.word, c.root from climb c join forms f on f.form = c.word)
select word, form, root, n, n_near, form_n from forms join climb using (word)"""
