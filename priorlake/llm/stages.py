"""The pipeline's stages: (spark, docs, sf_dir) to the documents that stay; the last one returns encoded documents.

Each stage works on all its predecessor kept and carries documents of any columns through, whatever their names.
Nulls in any column, repeated rows and empty tables are those of the operator called; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorlake.llm.byte_bpe import encode
from priorlake.llm.mixing import cell_probabilities, drawn, labelled
from priorlake.llm.ngram_join import ngram_join
from priorlake.llm.quality_rules import quality_rules
from priorlake.llm.queries import table
from priorlake.llm.secret_scan import redacted
from priorlake.llm.shared import stored

ROW = "_row_key"


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written with a key of its own for every row, so that all that read it see the same keys, and the key's name."""
    taken = {c.lower() for c in docs.columns}
    key = ROW
    while key in taken:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """rows but those that the verdicts (row key, kept) drop, each by its own key; the key is taken off."""
    dropped = stored(verdicts.where("not kept").select(key), "dropped")
    return rows.join(dropped, key, "left_anti").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep; each row is judged by its own text, whatever its id."""
    rows, key = keyed(docs)
    return without(rows, quality_rules(rows, table(spark, sf_dir, "labels"), carry=[key]), key)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the one with the group's smallest id, nulls last; of equal ids one."""
    rows, key = keyed(docs)
    return without(rows, ngram_join(rows, row=key), key)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks; n_chars follows the text."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the calibrated probability of their source, language and topic, each by its id and text."""
    rates = cell_probabilities(stored(labelled(docs), "labelled"))
    named = docs.select("doc_id", "text", "source", "lang", F.struct(*docs.columns).alias("_row"))
    cells = labelled(named, "_row").join(rates.select("source", "lang", "topic", "probability"), ["source", "lang", "topic"])
    return cells.where(drawn(F.col("doc_id"), F.col("digest"), F.col("probability"))).select("_c__row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (32-bit little-endian) and the SHA-256 of the bytes the ids decode to."""
    import public_tokenizers

    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["source", "lang"])
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
