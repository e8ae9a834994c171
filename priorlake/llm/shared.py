"""What the training-data operators share: stage tables, Arrow text access, links to components."""
from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a new one under /tmp where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: lineage ends here, lost executors cost nothing that came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """As stored, and Spark removes the shuffle files of the write when it ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        return stored(df, name)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def dropped(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, group: list[str], order: list, name: str, number: str) -> DataFrame:
    """rows with their place (long, from 0) inside their group in the given order, which must tell all rows apart.

    Rows are range-partitioned by group and order, sorted there and written with their place in the partition; only the
    counts by (partition, group) meet in windows, so that neither a group nor a tie of any size comes to one task.
    """
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = stored(dealt.select(*rows.columns, place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"), F.shiftright(place, 33).alias("_part")), name)
    sizes = dealt.groupBy("_part", *group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("_part", *group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start")), name)
    return dealt.join(starts, ["_part", *group]).select(*rows.columns, (F.col("_place") + F.col("_start")).alias(number))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches that hold whole texts are kept short, so that long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_REMEMBERED: dict[Hashable, object] = {}


def remembered(key: Hashable, make: Callable[[], object]):
    """What a worker process keeps between tasks, such as an opened vocabulary; one thing at a time."""
    if key not in _REMEMBERED:
        release()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def release() -> None:
    """Give back what another operator's or an earlier stage's tasks left in this worker process."""
    if _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give back what this worker process has freed; what is remembered stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


class Recent:
    """A bounded memory of two generations: what neither the last `size` new keys nor those before have used is forgotten."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: Iterable) -> list:
        """The unknown ones of the keys; known ones are held until the next call."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys:
            if key in young:
                continue
            if key in old:
                young[key] = old[key]
            else:
                out.append(key)
        return out

    def learn(self, pairs: Iterable[tuple]) -> dict:
        """The memory with the pairs, for lookups until the next call of missing."""
        self.young.update(pairs)
        return self.young


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of UTF-8 bytes and the rows' offsets in it; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset or len(column) == 0:
        column = pa.concat_arrays([column, pa.array([], pa.large_string())])
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), starts


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts; 0 for empty rows."""
    out = np.zeros(len(starts) - 1, np.int64)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: starts[-1]], starts[some], dtype=np.int64)
    return out


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes reaches over the links (left, right); vectorised hooking and jumping."""
    label = np.arange(n)
    while len(left):
        low, high = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
        differ = low != high
        if not differ.any():
            break
        left, right = left[differ], right[differ]
        np.minimum.at(label, high[differ], low[differ])
        while (label[label] != label).any():
            label = label[label]
    return label


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node it reaches.

    Each round sends a node to its smallest neighbour, jumps once more, contracts the links and drops loops, so
    links shrink by a factor at least; every round is a written table. Sums and minima are partial before the
    shuffle, so a hub with a third of all links is no hot key. Nulls and loops are ignored; no links give no rows.
    """
    links = stored(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), name)
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        up = stored(up, name)
        once = up.select(F.col("node").alias("to"), F.col("to").alias("top"))
        up = stored(up.join(once, "to", "left").select("node", F.coalesce("top", "to").alias("to")), name)
        rounds.append(up)
        a, b = up.select(F.col("node").alias("a"), F.col("to").alias("a2")), up.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        links = links.join(a, "a").join(b, "b").where("a2 <> b2")
        links = stored(links.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), name)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = rounds[-1].select("node", F.col("to").alias("component"))
    for up in reversed(rounds[:-1]):
        # A node that was contracted earlier follows what it was contracted to.
        later = out.select(F.col("node").alias("to"), "component")
        out = stored(up.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")), name)
    return out
