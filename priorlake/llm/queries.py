"""Registered queries of the training-data operators: thin digests over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorlake.llm import chat_quotes, embedding_dedup, importance, mixing, sharding, spelling
from priorlake.llm.stats import COUNTS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, folder, "embeddings"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from priorlake.llm.secret_scan import KINDS, joined, secret_spans

    found = secret_spans(table(spark, folder, "documents")).withColumn("base", F.filter("spans", lambda s: s["layer"] == 0))
    n = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_unopened")


def op4_chat_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return chat_quotes.reply_ordered(table(spark, folder, "conversations"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from priorlake.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from priorlake.llm.ngram_join import ngram_join

    return ngram_join(table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from priorlake.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _is(value: str):
    return lambda x: x == value


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from priorlake.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from priorlake.llm.byte_bpe import encode

    out = encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from priorlake.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from priorlake.llm.mixing import mixing

    out = mixing(table(spark, folder, "documents"))
    return out.select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


_ALL = (
    op1_token_counts, op2_embedding_dedup, op3_secret_scan, op4_chat_quotes, op5_quality_rules, op6_byte_bpe, op7_ngram_join, op8_quality_classifier,
    op9_suffix_dedup, op10_mixing, op11_sharding, op12_spelling_variants, op13_importance_resampling,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL, "op4_chat_quotes": chat_quotes.SQL, "op10_mixing": mixing.SQL,
    "op11_sharding": sharding.SQL, "op12_spelling_variants": spelling.SQL, "op13_importance_resampling": importance.SQL,
}
