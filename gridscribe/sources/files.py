"""File sources and sinks: tolerant and strict JSON lines, JSON arrays, tagged CSV globs, resumable appends."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut

CORRUPT = "_corrupt_record"


def parse_jsonl(lines: DataFrame, schema: StructType, mode: str = "tolerant", line_col: str = "line") -> DataFrame:
    """Rows of a column of JSON lines, further columns first. Blank lines never count.

    `tolerant` keeps a bad line in _corrupt_record with null fields, `skip` drops it, `strict` fails on it and names it; further
    columns, such as a line number, are in that message. Null lines are blank. Each line by itself: no shuffle.
    """
    text = F.trim(F.col(line_col), F.lit(" \t\r"))
    rest = [c for c in lines.columns if c != line_col]
    rows = lines.where(F.col(line_col).isNotNull() & (text != ""))
    rows = rows.withColumn("_v", F.from_json(line_col, StructType([*schema.fields, StructField(CORRUPT, StringType())]), {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_v.{CORRUPT}")
    if mode == "skip":
        rows = rows.where(bad.isNull())
    if mode == "strict":
        where = F.to_json(F.struct(*rest)) if rest else F.lit("")
        rows = rows.where(bad.isNull() | F.raise_error(F.concat(F.lit("bad JSON line "), where, F.lit(": "), bad)).isNotNull())
    fields = [F.col(f"_v.{f.name}").alias(f.name) for f in schema.fields]
    return rows.select(*rest, *fields, *([bad.alias(CORRUPT)] if mode == "tolerant" else []))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, mode: str = "tolerant", n_max: int | None = None) -> DataFrame:
    """JSON lines, as in parse_jsonl. `n_max` takes the first physical lines, blank ones included: in the order of files, their splits, and lines within these."""
    if mode == "tolerant" and n_max is None:
        return spark.read.schema(StructType([*schema.fields, StructField(CORRUPT, StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    if n_max is None:
        return spark.read.schema(schema).json(path, mode={"skip": "DROPMALFORMED", "strict": "FAILFAST"}[mode])
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")]
    first = spark.read.text(path).select(F.col("value").alias("line"), *at).orderBy("_file", "_start", "_at").limit(n_max)
    return parse_jsonl(first.select("line"), schema, mode)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_results(spark: SparkSession, glob: str, defaults: dict[str, str] | None = None, schema: StructType | None = None) -> DataFrame:
    """CSV files of one glob with the model, tier and time of their names; columns that older files lack get a default.

    With a schema, files are read once; without, all columns are text, so that no pass over the data is needed to guess types.
    """
    df = spark.read.csv(glob, header=True, schema=schema) if schema else spark.read.csv(glob, header=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    df = df.select("*", name.alias("source_file"), *named(name))
    for c, v in (defaults or {"profile_name": "full_system"}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def named(name: Column) -> list[Column]:
    """(file_tier, file_model, file_time) of a file name such as results_tier1_dl_base_20260318_231619.csv; empty or null where it says none."""
    stamp = F.regexp_extract(name, r"_(\d{8}_\d{6})(?:\.|$)", 1)
    return [
        F.regexp_extract(name, r"_(tier\d)(?:_|\.|$)", 1).alias("file_tier"), F.regexp_extract(name, r"_tier\d_([a-z_]+?)_\d", 1).alias("file_model"),
        F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).alias("file_time")]


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.csv(p, header=True)}[kind](path)


def summary(df: DataFrame, path: str, keys: tuple[str, ...], metrics: tuple[str, ...], run_id: str) -> None:
    """A run's sinks: rows as CSV, means of each key as CSV, and one JSON line that names the run, its rows and its outputs."""
    write(df, f"{path}/results", "csv")
    means = df.groupBy(*keys).agg(F.count("*").alias("n_examples"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
    write(means, f"{path}/summary", "csv")
    manifest = means.agg(F.lit(run_id).alias("run_id"), F.sum("n_examples").alias("n_examples"), F.count("*").alias("n_groups"), F.lit(f"{path}/results").alias("results"), F.lit(f"{path}/summary").alias("summary"))
    write(manifest, f"{path}/manifest", "json")


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the first by all columns."""
    order = [c for c in df.columns if c != key]
    if not order:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("_row")).select(key, *[F.col("_row").getField(c).alias(c) for c in order]).select(*df.columns)


def there_is(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds files that Spark can read."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the target lacks, and returns the target: running twice adds nothing. A missing target is an empty one.

    What is returned reads the target after the append, so no plan runs over a folder that it has changed. Of rows with one key the
    first by all columns is taken. Only keys of the target are read.
    """
    spark, new = df.sparkSession, first_rows(df, key)
    if there_is(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of a part, bits of its filter and hashes of a key: at 20 bits a key and 7 hashes one key in 5,000 that a full part lacks seems to be there.
PART_KEYS, FILTER_BITS, HASHES = 100_000, 1 << 21, 7
#: Names of parts that are broadcast at most.
MOST_NAMES = 100_000


def _bits(key: str):
    """An array of (word, mask), the distinct bits of a key."""
    at = F.array_distinct(F.array(*[F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(HASHES)]))
    return F.transform(at, lambda p: F.struct(F.floor(p / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")).alias("mask")))


def matching_parts(keys: DataFrame, filters: DataFrame, key: str) -> DataFrame:
    """(part) of the filters (part, word, bits) that may hold one of the keys: all bits of the key are set. A key meets a part's words by an equi-join, so only words that keys ask for are compared."""
    asked = keys.select(key, _bits(key).alias("b")).select(key, F.size("b").alias("k"), F.explode("b").alias("b")).select(key, "k", "b.word", "b.mask")
    hits = asked.join(filters, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return hits.groupBy("part", key).agg(F.count("*").alias("n"), F.max("k").alias("k")).where("n = k").select("part").distinct()


def append_filtered(df: DataFrame, path: str, key: str) -> tuple[DataFrame, int, int]:
    """append_new() for targets whose keys are too many to read: (the target, its parts before, how many of them were read).

    The target is made of parts with the keys of a range each, PART_KEYS of them or so, in `rows`, and a Bloom filter of each part in `filters`. Keys of the batch are looked up in
    the filters, and the anti-join reads the keys of the parts only that match any: for keys that go on where the target ends, hardly one. A batch writes its rows first and then its filters; rows without
    a filter, which a run that died in between leaves, are not part of the target, and a repeated batch writes them anew. One writer at a time. Rows with a null key are left out.
    """
    spark, rows_path, filters_path = df.sparkSession, f"{path}/rows", f"{path}/filters"
    new = first_rows(df.where(F.col(key).isNotNull()), key)
    parts = read = 0
    if there_is(spark, filters_path):
        filters = spark.read.parquet(filters_path)
        parts = filters.select("part").distinct().count()
        match = cut(matching_parts(new.select(key), filters, key))
        read = match.count()
        if read:
            # broadcast, the names of the parts prune the scan
            match = F.broadcast(match) if read <= MOST_NAMES else match
            new = new.join(spark.read.parquet(rows_path).join(match, "part").select(key), key, "left_anti")
    new = cut(new)
    n = new.count()
    if n:
        run = uuid.uuid4().hex
        name = F.concat(F.lit(f"{run}-"), F.spark_partition_id().cast("string"))
        added = new.repartitionByRange(-(-n // PART_KEYS), key).withColumn("part", name)
        added.write.mode("append").partitionBy("part").parquet(rows_path)
        written = spark.read.parquet(rows_path).where(F.col("part").startswith(run))
        bits = written.select("part", F.explode(_bits(key)).alias("b")).groupBy("part", "b.word").agg(F.bit_or("b.mask").alias("bits"))
        bits.repartition(1 + n // (8 * PART_KEYS), "part").write.mode("append").parquet(filters_path)
    return filtered_target(spark, path, df.schema), parts, read


def filtered_target(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a target of append_filtered: those of parts that have a filter. A missing target is an empty one."""
    if not there_is(spark, f"{path}/filters"):
        return spark.createDataFrame([], schema)
    whole = spark.read.parquet(f"{path}/filters").select("part").distinct()
    return spark.read.parquet(f"{path}/rows").join(whole, "part").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
