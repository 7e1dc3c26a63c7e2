import os

import pytest
from pyspark.sql import functions as F

from tagloom import workspace
from tagloom.operators import wordpiece as wp


@pytest.mark.parametrize("text, size", [("128m", 128 << 20), ("134217728b", 134217728), ("1g", 1 << 30), ("16MB", 16 << 20), ("77", 77)])
def test_sizes(text, size):
    assert workspace._bytes(text) == size


def test_small_means_rows_and_bytes(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert workspace.is_small(wide) and not workspace.is_small(wide, 99) and not workspace.is_small(wide, size=50_000)
    assert workspace.is_small(spark.range(100), size=800) and not workspace.is_small(spark.range(101), size=800)


def test_planning_runs_no_job(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").cast("string").alias("word")).coalesce(1).write.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    rows = workspace.spread(spark.read.schema("word string").parquet(path))
    wp.basic_dictionary(wp.word_counts(rows))
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert rows.count() == 1000


def test_built_once_until_the_input_changes(spark, tmp_path):
    path = str(tmp_path / "in")
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for n in (5, 5, 6):
        if n == 6 or not os.path.exists(path):
            spark.range(n).write.mode("overwrite").parquet(path)
        workspace.once(spark, [path], "three", build)
    assert len(built) == 2


def test_clear_deletes_what_was_stored(spark):
    kept = dict(workspace._STORED), dict(workspace._BUILT)
    workspace._STORED.clear()
    workspace._BUILT.clear()
    frame = workspace.store(spark.range(3), "three")
    path = workspace._STORED[spark.sparkContext.applicationId][0]
    assert frame.count() == 3 and workspace.exists(spark, path)
    assert workspace.clear(spark) == 1 and not workspace.exists(spark, path) and workspace.clear(spark) == 0
    workspace._STORED.update(kept[0])
    workspace._BUILT.update(kept[1])


def test_settle_keeps_only_the_last_table(spark):
    held = []

    def build():
        held.append(workspace.store(spark.range(5), "step"))
        return held[0].where("id > 2")

    made = workspace.settle(spark, "made", build)
    assert sorted(r.id for r in made.collect()) == [3, 4]
    path = held[0].inputFiles()[0].rsplit("/", 1)[0]
    assert not workspace.exists(spark, path) and workspace.exists(spark, made.inputFiles()[0])
