"""Token counts with a digest cache: only distinct contents the cache lacks are encoded, then appended to it.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens). The content digest is SHA-256 of the
normalised text: null becomes empty, nothing else changes, since any other change could change the count. The tokenizer
digest is SHA-256 of its file, so another version never reads old counts.

Defined cases: a null text counts as empty (0 tokens); ids may be null or repeated, each row is answered; an empty table
gives no rows; concurrent runs may append a digest twice, readers take one. Rows pass through no single task: equal
texts meet after a partial aggregate, and the join back is split by Spark where one digest is hot.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorlake.llm.pieces import pieces
from priorlake.llm.shared import new_path, remembered, small_batches

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
REMEMBERED = 400_000


def version_of(tokenizer: str) -> str:
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


class Counter:
    """Counts of whole texts by one tokenizer file; parts between safe cuts are counted once and remembered.

    Texts that hold a special token, and those without safe cuts, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.known: dict[str, int] = {}
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.special: list[str] = []
            self.library = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        parts = json.loads(Path(path).read_text())
        steps = parts.get("pre_tokenizer") or {}
        self.cuts = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and not parts.get("normalizer")
        self.special = [x["content"] for x in parts.get("added_tokens", [])]
        self.library = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            parts = pieces(text) if self.cuts and not any(s in text for s in self.special) else None
            if parts is None:
                whole.append(i)
            else:
                cut.append((i, parts))
        for i, n in zip(whole, self.library([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = n
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new: set[str] = set()
        for _, parts in cut:
            new.update(parts[1:])
        fresh = [p for p in new if p not in self.known]
        self.known.update(zip(fresh, self.library([f" {p}" for p in fresh]), strict=True))
        for (i, parts), n in zip(cut, self.library([parts[0] for _, parts in cut]), strict=True):
            out[i] = n + sum(map(self.known.__getitem__, parts[1:]))
        return out


def counter(path: str) -> Counter:
    """One per worker process."""
    return remembered(path, lambda: Counter(path))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts of one tokenizer version, one row per digest; none if the table isn't there yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache: the table's path; None starts a new one in the shared folder. Misses are encoded and appended before this
    returns; the result is a join of the documents' digests with the cache.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)
    version = version_of(tokenizer)
    path = cache or new_path(spark, "token-counts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digested = docs.select(F.col("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in it:
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    wanted = digested.select("digest", "text")
    if cache:
        wanted = wanted.join(read_cache(spark, path, version), "digest", "left_anti")
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(batches, CACHE_SCHEMA).write.mode("append").parquet(path)
    counts = read_cache(spark, path, version)
    found = digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
