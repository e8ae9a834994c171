"""Comparing all members of a group in bounded tasks: chunks of the group meet in pairs."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import release


def chunk_pairs(rows: DataFrame, group: str, by: str, most: int) -> DataFrame:
    """rows of groups of two and more, once for every chunk pair they belong to: columns _g, _i, _j, _chunk added.

    A group of n rows is cut by the hash of `by` into ceil(n / most) chunks; task (i, j) holds chunks i <= j. A pair of
    rows meets in exactly one task: in (i, i) if both are in chunk i, else in the task of their two chunks. No task
    gathers more than about two chunks, however large a group is.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1")
    k = F.ceil(F.col("_n") / most)
    cut = rows.join(sizes, group).withColumn("_k", k.cast("int")).withColumn("_chunk", F.pmod(F.xxhash64(F.col(by), F.lit(11)), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other")
    dealt = cut.select(*rows.columns, "_chunk", other)
    return dealt.select(*rows.columns, "_chunk", F.least("_chunk", "_other").alias("_i"), F.greatest("_chunk", "_other").alias("_j"))


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, batch_rows: int = 50_000, dealt: bool = False) -> DataFrame:
    """fn over tables of whole groups: rows are dealt (unless they are) and sorted by keys, fn gets many groups and their start offsets at once."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        count = 0

        def starts_of(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for key in keys:
                values = table[key].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            return np.flatnonzero(new)

        for batch in it:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < batch_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = starts_of(table)
            if len(starts) > 1:
                yield from fn(table.slice(0, starts[-1]), np.append(starts[:-1], starts[-1]))
                table = table.slice(starts[-1])
                held, count = table.combine_chunks().to_batches(), table.num_rows
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from fn(table, np.append(starts_of(table), table.num_rows))

    return (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys).mapInArrow(batches, schema)
