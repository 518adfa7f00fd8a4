"""Scan and sink queries: JSON lines in all three ways, named results, and an append that is run twice. Files go to a folder of the session's checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import shared_folder
from ..sources import files

ITEM = StructType([StructField("id", LongType()), StructField("kind", StringType())])


def _lines(spark, sf_dir):
    """Events as JSON lines, of which every seventh is cut short and every eleventh blank."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    line = F.when(F.col("event_id") % 11 == 0, F.lit("  ")).when(F.col("event_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line)
    return e.select(F.col("event_id").alias("number"), line.alias("line"))


def jsonl_tolerant(spark, sf_dir):
    rows = files.parse_jsonl(_lines(spark, sf_dir), ITEM)
    return rows.select("number", "id", "kind", F.col(files.CORRUPT).alias("bad"))


def jsonl_skip(spark, sf_dir):
    return files.parse_jsonl(_lines(spark, sf_dir), ITEM, "skip")


def jsonl_strict(spark, sf_dir):
    """The same lines without the broken ones, none of which fails."""
    return files.parse_jsonl(_lines(spark, sf_dir).where("number % 7 <> 0 or number % 11 = 0"), ITEM, "strict")


def _folder(spark) -> str:
    """A new folder beside the session's checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/scans-{uuid.uuid4().hex}"


def append_resume(spark, sf_dir):
    """Documents appended in two overlapping turns: each is there once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    path = _folder(spark)
    files.append_new(docs.where("doc_id % 3 <> 0"), path, "doc_id")
    return files.append_new(docs, path, "doc_id")


def append_filtered(spark, sf_dir):
    """Documents appended in two overlapping turns to a target that keeps a filter of the keys of each part: each is there once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    path = _folder(spark)
    files.append_filtered(docs.where("lang <> 'en'"), path, "doc_id")
    return files.append_filtered(docs, path, "doc_id")[0]


def json_array(spark, sf_dir):
    """Nations written as one JSON array and read back."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("kind"))
    one = nations.agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "kind")))).alias("value"))
    path = _folder(spark)
    one.write.text(path)
    return files.read_json_array(spark, path, ITEM)


def result_files(spark, sf_dir):
    """Result files found by their names, with the model, tier and time that these say."""
    path = _folder(spark)
    base = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("row"))
    for name in ("results_tier1_dl_base_20260318_231619.csv", "results_tier2_ml_20260319_114452.csv"):
        files.write(base, f"{path}/{name}", "csv")
    schema = StructType([StructField("row", LongType())])
    rows = None
    for name in ("results_tier1_dl_base_20260318_231619.csv", "results_tier2_ml_20260319_114452.csv"):
        one = spark.read.csv(f"{path}/{name}", header=True, schema=schema).select("row", *files.named(F.lit(name)), F.lit("full_system").alias("profile_name"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("file_tier", "file_model", "profile_name", F.date_format("file_time", "yyyy-MM-dd HH:mm:ss").alias("file_time")).agg(F.count("*").alias("n"))


_GOOD = "event_id % 11 <> 0 AND event_id % 7 <> 0"
QUERIES = {
    "jsonl_tolerant": (jsonl_tolerant, "SELECT event_id AS number, CASE WHEN event_id % 7 <> 0 THEN event_id END AS id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 7 = 0 THEN substr('{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}', 1, 9) END AS bad FROM events WHERE event_id % 11 <> 0"),
    "jsonl_skip": (jsonl_skip, f"SELECT event_id AS number, event_id AS id, event_type AS kind FROM events WHERE {_GOOD}"),
    "jsonl_strict": (jsonl_strict, f"SELECT event_id AS number, event_id AS id, event_type AS kind FROM events WHERE {_GOOD}"),
    "append_resume": (append_resume, "SELECT doc_id, lang FROM documents"),
    "append_filtered": (append_filtered, "SELECT doc_id, lang FROM documents"),
    "json_array": (json_array, "SELECT n_nationkey AS id, n_name AS kind FROM nation"),
    "result_files": (result_files, "SELECT t AS file_tier, m AS file_model, 'full_system' AS profile_name, f AS file_time, (SELECT count(*) FROM region) AS n FROM (VALUES ('tier1', 'dl_base', '2026-03-18 23:16:19'), ('tier2', 'ml', '2026-03-19 11:44:52')) v(t, m, f)"),
}
