"""What a cut leaves behind."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from gridscribe.session import cut, shuffles_released

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for d in blocks.localDirs() for p in Path(d.getPath()).glob("*/shuffle_*")}


def left_by(spark, run) -> set[str]:
    """Shuffle files that are there some time after the run and were not before; removal runs beside it."""
    before = shuffle_files(spark)
    run()
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_cut_leaves_no_shuffle_files_and_keeps_rows_and_settings(spark):
    df = spark.range(1000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
    kept = []
    was = spark.conf.get(KEY, None)
    assert not left_by(spark, lambda: kept.append(cut(df)))
    assert spark.conf.get(KEY, None) == was
    again = kept[0]
    assert again.count() == 97 and sorted(again.collect()) == sorted(df.collect())


def test_a_frame_that_is_cut_twice_or_used_after_its_cut_gives_its_rows(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    first, second = cut(df), cut(df)
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(df.collect())
    assert first.join(df.withColumnRenamed("s", "t"), "k").where("s = t").count() == 7


def test_an_aggregate_within_leaves_none_either(spark):
    def run():
        with shuffles_released(spark):
            assert spark.range(1000).agg(F.sum("id")).first()[0] == 499500

    assert not left_by(spark, run)
