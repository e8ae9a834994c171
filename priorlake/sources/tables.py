"""Readers and writers: one Parquet table per name, plus CSV, JSON and the ledger layout."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, projected to `columns` so only those are read."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def parts_of(spark: SparkSession, folder: str, name: str, bytes_each: int = 4 << 20) -> int:
    """In how many parts a table's rows are dealt so that a part doesn't grow with the table; never fewer than the session's."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"{name}.parquet"))
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table; only partitions present in `df` when partitioned."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every stored forecast; partitions written at different times may differ in columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_ledger(df: DataFrame, path: str) -> None:
    """Replace only the (season, week) partitions present in `df`."""
    write_table(df, path, ["season", "week"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per row, dates in ISO form."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Unknown is null everywhere inside: NaN is turned into null at the edge."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )
