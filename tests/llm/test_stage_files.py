"""Stages give their disk back: shuffle files with the write that needed them, tables with their last reader."""
import os

from pyspark.sql import functions as F

from priorlake.llm import shared, suffix_dedup


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_a_stage_leaves_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(shared.FREED)
    rows = shared.stored_alone(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert shuffle_files(spark) <= before and rows.count() == 7 and spark.conf.get(shared.FREED) == was


def test_suffix_dedup_drops_the_stages_that_its_result_does_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda session: str(tmp_path))
    passage = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(300))
    docs = spark.createDataFrame([(i, f"{i} begins {passage} and ends {i * 3}") for i in range(6)], "doc_id long, text string")
    out = suffix_dedup.suffix_dedup(docs)
    left = {name.split("-")[0] for name in os.listdir(tmp_path)}
    assert "spans" in left and not left & {"anchors", "keys", "runs", "strings", "open", "ranges", "windows"}
    assert [r["n_removed"] >= 300 for r in out.collect()] == [True] * 6
