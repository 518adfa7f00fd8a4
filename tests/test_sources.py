from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridscribe.sources import files
from gridscribe.streaming.incremental import append_stream

SCHEMA = StructType([StructField("id", LongType()), StructField("t", StringType())])


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n{"id": 2}\n')
    path = str(tmp_path / "a.jsonl")
    rows = files.read_jsonl(spark, path, SCHEMA).cache()
    assert rows.where("_corrupt_record is not null").count() == 1 and rows.count() == 3
    assert files.read_jsonl(spark, path, SCHEMA, "skip").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, SCHEMA, "strict").collect()


def test_results(spark, tmp_path):
    (tmp_path / "results_tier1_ml_20260101.csv").write_text("nar\n0.5\n")
    row = files.read_results(spark, f"{tmp_path}/results_*.csv").first()
    assert (row["file_tier"], row["file_model"], row["profile_name"]) == ("tier1", "ml", "full_system")
    with pytest.raises(ValueError):
        files.require(spark.range(1), "id", "x")


def test_append_twice_adds_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    for _ in range(2):
        files.append_new(df, f"{tmp_path}/out", "id")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_append_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_stream(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/cp", "id")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
