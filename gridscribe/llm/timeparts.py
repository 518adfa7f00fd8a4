"""Adaptive time partitions: years, months, days and hours in runs of siblings that stay within a limit of rows, one Parquet file each."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, in_arrow, partitions, shared_folder, table

YEAR, MONTH, DAY, HOUR = range(4)
#: The table of files is broadcast up to so many; larger ones are joined by a shuffle.
MOST_FILES = 50_000
#: monotonically_increasing_id() has the place within the partition in its low bits.
PLACE_BITS = 33
NULL_LEAF = "null"
FAMILY = ["level", "parent"]


# ---- siblings and their runs -------------------------------------------------------------------------------------------------------------------------------


def hour_counts(moments: DataFrame, moment_col: str) -> DataFrame:
    """(y, ym, d, h, n): rows of each hour that has any. ym counts months, d days since 1970, h hours since 1970. Null moments are left out."""
    day = F.col(moment_col).cast("date")
    rows = moments.where(F.col(moment_col).isNotNull()).groupBy(F.unix_date(day).cast("long").alias("d"), F.hour(moment_col).alias("hr")).agg(F.count("*").alias("n"))
    day = F.date_from_unix_date(F.col("d").cast("int"))
    return rows.select(F.year(day).cast("long").alias("y"), (F.year(day) * 12 + F.month(day) - 1).cast("long").alias("ym"), "d", (F.col("d") * 24 + F.col("hr")).alias("h"), "n")


def first_of(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def _days(month: Column) -> Column:
    return F.sequence(F.unix_date(first_of(month)).cast("long"), F.unix_date(F.last_day(first_of(month))).cast("long"))


def siblings(hours: DataFrame, limit: int) -> DataFrame:
    """(level, parent, key, n): all years from the first to the last that have rows, and all months, days or hours of each node above the limit, empty ones too."""
    level = lambda *by: hours.groupBy(*by).agg(F.sum("n").alias("n"))
    years = hours.agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("key"))
    of = years.join(level("y").withColumnRenamed("y", "key"), "key", "left").select(F.lit(YEAR).alias("level"), F.lit(0).cast("long").alias("parent"), "key", F.coalesce("n", F.lit(0)).alias("n"))
    out = of
    for k, up, key, children in (
        (MONTH, "y", "ym", lambda p: F.sequence(p * 12, p * 12 + 11)), (DAY, "ym", "d", _days), (HOUR, "d", "h", lambda p: F.sequence(p * 24, p * 24 + 23)),
    ):
        split = level(up).where(F.col("n") > limit).select(F.col(up).alias("parent"))
        every = split.select("parent", F.explode(children(F.col("parent"))).alias("key"))
        counts = level(key).withColumnRenamed(key, "key")
        out = out.unionByName(every.join(counts, "key", "left").select(F.lit(k).alias("level"), "parent", "key", F.coalesce("n", F.lit(0)).alias("n")))
    return out


def next_starts(nodes: DataFrame, limit: int) -> DataFrame:
    """nodes with ptr: where the run after that which begins at a sibling begins; null if there is none.

    With C the count up to and with a sibling, a run from i on ends before the first j whose C is above the limit plus the count before i. Counts and these bounds of a
    family stand in one descending order, where the least key so far answers each bound. A sibling above the limit is a run by itself, and the next one begins a run.
    """
    running = Window.partitionBy(*FAMILY).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumn("upto", F.sum("n").over(running))
    points = nodes.select(*FAMILY, "key", "n", F.col("upto").alias("value"), F.lit(False).alias("asks")).unionByName(
        nodes.select(*FAMILY, "key", "n", (F.col("upto") - F.col("n") + limit).alias("value"), F.lit(True).alias("asks")))
    above = Window.partitionBy(*FAMILY).orderBy(F.desc("value"), F.desc("asks"), F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("ptr", F.min(F.when(~F.col("asks"), F.col("key"))).over(above)).where("asks")
    last = Window.partitionBy(*FAMILY)
    ptr = F.when(F.col("n") > limit, F.col("key") + 1).otherwise(F.col("ptr"))
    return points.select(*FAMILY, "key", "n", ptr.alias("ptr"), F.max("key").over(last).alias("end")).select(*FAMILY, "key", "n", F.when(F.col("ptr") <= F.col("end"), F.col("ptr")).alias("ptr"))


def marked_starts(nodes: DataFrame) -> DataFrame:
    """nodes (with ptr) with start: whether a run begins there. The first sibling of each family begins one, and so does what its pointers reach.

    Pointer doubling: in each round all that is reached marks what its pointer shows, and each pointer takes that of the node it shows; so a family of m siblings takes
    log2(m) rounds, all families together, each in two self-joins and a checkpoint.
    """
    first = F.min("key").over(Window.partitionBy(*FAMILY))
    nodes = cut(nodes.withColumn("start", F.col("key") == first))
    while not nodes.where("ptr is not null").isEmpty():
        shown = nodes.where("start and ptr is not null").select(*FAMILY, F.col("ptr").alias("key"), F.lit(True).alias("hit")).distinct()
        onward = nodes.select(*FAMILY, F.col("key").alias("ptr"), F.col("ptr").alias("then"))
        nodes = nodes.join(shown, [*FAMILY, "key"], "left").join(onward, [*FAMILY, "ptr"], "left")
        nodes = cut(nodes.select(*FAMILY, "key", "n", F.col("then").alias("ptr"), (F.col("start") | F.coalesce("hit", F.lit(False))).alias("start")))
    return nodes


def two(x: Column, digits: int = 2) -> Column:
    return F.lpad(x.cast("string"), digits, "0")


def leaves(hours: DataFrame, limit: int) -> DataFrame:
    """(leaf, year, begin, n): runs of siblings with rows, and hours above the limit. leaf names parents and the first and last member; begin is its first hour."""
    nodes = marked_starts(next_starts(siblings(hours, limit), limit))
    last_start = F.max(F.when(F.col("start"), F.col("key"))).over(Window.partitionBy(*FAMILY).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    runs = nodes.withColumn("run", last_start).groupBy(*FAMILY, "run").agg(F.max("key").alias("last"), F.sum("n").alias("n"))
    runs = runs.where((F.col("n") > 0) & ((F.col("n") <= limit) | (F.col("level") == HOUR)))
    level, run, last = F.col("level"), F.col("run"), F.col("last")
    by_level = lambda *x: F.when(level == YEAR, x[0]).when(level == MONTH, x[1]).when(level == DAY, x[2]).otherwise(x[3])
    day = F.date_from_unix_date(F.floor(run / 24).cast("int"))
    first_day = by_level(F.make_date(run.cast("int"), F.lit(1), F.lit(1)), first_of(run), F.date_from_unix_date(run.cast("int")), day)
    member = lambda k: by_level(
        two(k, 4), two(F.pmod(k, F.lit(12)) + 1), two(F.dayofmonth(F.date_from_unix_date(k.cast("int")))), two(F.pmod(k, F.lit(24))))
    year, month, of_day = two(F.year("first_day"), 4), two(F.month("first_day")), two(F.dayofmonth("first_day"))
    above = by_level(F.lit(""), F.concat(year, F.lit("/")), F.concat(year, F.lit("/"), month, F.lit("/")), F.concat(year, F.lit("/"), month, F.lit("/"), of_day, F.lit("/")))
    runs = runs.withColumn("first_day", first_day)
    return runs.select(
        F.concat(above, member(run), F.lit("-"), member(last)).alias("leaf"), F.year("first_day").cast("long").alias("year"),
        F.when(level == HOUR, run).otherwise(F.unix_date("first_day").cast("long") * 24).alias("begin"), "n")


# ---- rows in order, files and their places -----------------------------------------------------------------------------------------------------------------


def sorted_rows(rows: DataFrame, moment: Column, order_by: list[str], folder: str) -> DataFrame:
    """(_row, _m, _at) of all rows, written to `folder` in ranges of (moment, null last; the columns of order_by; all others), and read again.

    _at tells the range and the place within it. Equal rows may be dealt over several ranges, so that no range is one key.
    """
    plain = {f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")}
    others = [c for c in rows.columns if c not in order_by and c in plain]
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), moment.cast("timestamp_ntz").alias("_m")).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("_m").asc_nulls_last(), *[F.col("_row").getField(c).asc() for c in [*order_by, *others]], F.col("_tie").asc()]
    placed = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed.select("_row", "_m", F.monotonically_increasing_id().alias("_at")).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def ranked(placed: DataFrame) -> DataFrame:
    """placed with _rank, the place of a row in the order of all: rows of the ranges before its own (one row a range, as many as shuffle partitions) and its place in it."""
    bit = F.lit((1 << PLACE_BITS) - 1)
    ranges = placed.groupBy(F.shiftright("_at", PLACE_BITS).alias("range")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(ranges.select("range", ahead.alias("ahead")))
    return placed.join(F.broadcast(offsets), F.shiftright("_at", PLACE_BITS) == F.col("range")).withColumn("_rank", F.col("ahead") + F.col("_at").bitwiseAND(bit))


def planned_files(placed: DataFrame, limit: int) -> DataFrame:
    """(leaf, part, lo, hi): each file and the ranks of its rows. Leaves stand in the order of time, null moments last, and fill parts of `limit` rows."""
    found = leaves(cut(hour_counts(placed, "_m")), limit)
    nulls = placed.where("_m is null").agg(F.count("*").alias("n")).where("n > 0")
    found = cut(found.unionByName(nulls.select(F.lit(NULL_LEAF).alias("leaf"), F.lit(1 << 40).alias("year"), F.lit(0).cast("long").alias("begin"), "n")))
    ahead = Window.unboundedPreceding, -1
    years = found.groupBy("year").agg(F.sum("n").alias("in_year")).select("year", F.coalesce(F.sum("in_year").over(Window.orderBy("year").rowsBetween(*ahead)), F.lit(0)).alias("before"))
    lo = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("year").orderBy("begin").rowsBetween(*ahead)), F.lit(0))
    found = found.join(years, "year").withColumn("at", lo)
    parts = found.select("leaf", "at", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / limit))).alias("part"))
    first = F.col("at") + (F.col("part") - 1) * limit
    return cut(parts.select("leaf", "part", first.alias("lo"), F.least(first + limit, F.col("at") + F.col("n")).alias("hi")))


def sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= MOST_FILES else small


def in_files(rows: DataFrame, files: DataFrame, n_files: int, limit: int) -> DataFrame:
    """Ranked rows of the given files with leaf, part and _i, the place in the file. A block of `limit` ranks meets the few files that reach into it."""
    blocks = files.select("leaf", "part", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / limit), F.floor((F.col("hi") - 1) / limit))).alias("block"))
    inside = (F.floor(F.col("_rank") / limit) == F.col("block")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    return rows.join(sized(blocks, n_files), inside).select("_row", "leaf", "part", (F.col("_rank") - F.col("lo")).alias("_i"))


def contents(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, and two digests of 64 bits of (_row, _i): what each file holds, in order. Sums are combined before they are shuffled."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("_row", "_i")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "_i", "_row")).alias("y"))


def _directory(columns: list[str]) -> tuple[str, str]:
    """Names of the two partition folders, none of them a column of the table."""
    used, names = {c.lower() for c in columns}, []
    for name in ("leaf", "part"):
        while name in used:
            name = "_" + name
        names.append(name)
    return names[0], names[1]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(_row, _i, file) of all data files below the folder, which must hold one: the row, its place, and the file from the leaf's folder on."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col("_metadata.row_index").alias("_i"), F.substring_index("_metadata.file_path", "/", -3).alias("file"))


def with_names(files: DataFrame) -> DataFrame:
    """files (file) with leaf and part, from the names of its two folders."""
    value = lambda i: F.substring_index(F.get(F.split("file", "/"), F.lit(i)), "=", -1)
    return files.withColumns({"leaf": F.replace(value(0), F.lit("."), F.lit("/")), "part": value(1).cast("long")})


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def write_partitions(rows: DataFrame, moment: Column, order_by: list[str], limit: int, folder: str, has_files: bool) -> None:
    """Writes the rows in the layout of their moments to `folder`: one Parquet file for each leaf and part, rows in the order of (moment, order_by, all other columns).

    Years from the first moment to the last are siblings; nodes above `limit` rows are split into all their months, days or hours. In time order, a sibling within the
    limit, even empty, joins the run of the sibling before it if the run stays within the limit, else it begins one. Leaves are the runs with rows, hours above the limit,
    and all null moments; each fills parts of `limit` rows. With has_files, what the folder holds is rewritten: files whose leaf, part and rows recur stay as they are,
    the others go once the new ones are written. A run that dies in between leaves files of both layouts, so a folder is to be rewritten by one writer at a time.

    Rows are range-partitioned once by their order and written as a table beside the folder, which goes at the end; its ranges number all rows. So an hour or the null
    leaf may hold any share of the rows: only the rows of one file ever meet in one task. Counts are combined by hour before a shuffle; siblings are at most 31 (years: the calendar's)
    times the nodes above the limit, and pass as tables from checkpoint to checkpoint.

    No rows: no files. Null moments: leaf "null". Null columns of order_by stand first. Repeated rows are all written; which of two equal rows comes first plays no part.
    Moments with a zone are taken at their local time in the session. All columns of rows are written, whatever their names; moment is not, unless it is one of them.
    """
    spark = rows.sparkSession
    scratch = f"{folder}-sorted-{uuid.uuid4().hex}"
    placed = ranked(sorted_rows(rows, moment, order_by, scratch))
    files = planned_files(placed, limit)
    n_files = files.count()
    stay = None
    if has_files:
        old = cut(contents(read_files(spark, folder), ["file"]))
        like = files.join(with_names(old).select("leaf", "part", F.col("n").alias("rows")), ["leaf", "part"]).where("hi - lo = rows").select("leaf", "part", "lo", "hi")
        again = contents(in_files(placed, like, n_files, limit), ["leaf", "part"])
        stay = cut(with_names(old).join(again, ["leaf", "part", "n", "x", "y"]).select("leaf", "part", "file"))
        files = files.join(stay, ["leaf", "part"], "left_anti")
    leaf, part = _directory(rows.columns)
    # the writer asks for rows in the order of its folders: sorted by just these columns first, they keep the order of _i, otherwise Spark sorts anew by the folders alone
    names = F.coalesce(F.replace("leaf", F.lit("/"), F.lit(".")), F.lit("")).alias(leaf)
    out = in_files(placed, files, n_files, limit).select("_row", names, F.col("part").alias(part), "_i")
    out = out.repartition(partitions(spark), leaf, part).sortWithinPartitions(leaf, part, "_i")
    own = [F.col("_row").getField(c).alias(c) for c in rows.columns]
    out.select(*own, leaf, part).write.mode("append").partitionBy(leaf, part).parquet(folder)
    path, fs = _file_system(spark, folder)
    if stay is not None:
        for r in old.join(stay, "file", "left_anti").select("file").toLocalIterator():
            fs.delete(path(f"{folder}/{r[0]}"), False)
    fs.delete(path(scratch), True)


def file_report(rows: DataFrame, id_col: str, new: Column) -> DataFrame:
    """(file, n_rows, n_new, ids_sha256) of read_files(): rows, rows that are new, and the digest of the ids in file order, comma-joined (null: empty).

    The rows of a file go through one task one after another; only its digest is kept.
    """
    narrow = rows.select("file", "_i", F.coalesce(F.col("_row").getField(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(new, F.lit(False)).alias("new"))
    narrow = narrow.repartition(partitions(rows.sparkSession), "file").sortWithinPartitions("file", "_i")

    def run(batches):
        def row():
            return pa.RecordBatch.from_pydict({"file": [now], "n_rows": [n], "n_new": [fresh], "ids_sha256": [digest.hexdigest()]})

        now, n, fresh, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            files, ids = batch.column("file").dictionary_encode(), batch.column("id").to_pylist()
            marks, names, at = batch.column("new").to_pylist(), files.dictionary.to_pylist(), 0
            codes = files.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(names):  # in order of appearance, and sorted
                to = at + int((codes == code).sum())
                if name != now:
                    if now is not None:
                        yield row()
                    now, n, fresh, digest = name, 0, 0, hashlib.sha256()
                digest.update(("," * (n > 0) + ",".join(ids[at:to])).encode())
                n, fresh, at = n + to - at, fresh + sum(marks[at:to]), to
        if now is not None:
            yield row()

    return in_arrow(narrow, run, "file string, n_rows bigint, n_new bigint, ids_sha256 string")


# ---- the query ---------------------------------------------------------------------------------------------------------------------------------------------

SHARE, BEFORE = 650, "2024-03-01 00:00:00"


def click_moment(ts: Column, click_id: Column) -> Column:
    """ts; for one click in eight some years earlier, for another one at the Monday before."""
    k = F.crc32(click_id.cast("string").cast("binary")) % 128
    at = ts.cast("timestamp_ntz")
    monday = F.date_sub(at.cast("date"), F.weekday(at.cast("date"))).cast("timestamp_ntz")
    return F.when(k < 16, at - F.make_dt_interval(((k + 6) * (k + 6) * (k + 6)).cast("int"))).when(k > 111, monday).otherwise(at)


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    moment, limit = click_moment(F.col("ts"), F.col("click_id")), 1 + clicks.count() // SHARE
    folder = f"{shared_folder(spark)}/clicks-{uuid.uuid4().hex}"
    early = F.coalesce(F.col("arrived_at") < F.lit(BEFORE).cast("timestamp_ntz"), F.lit(False))
    began = clicks.where(early)
    some = not began.isEmpty()
    order = ["arrived_at", "click_id"]
    shape = "leaf string, columns string, ids_sha256 string, path string, part bigint, n_rows bigint, n_new bigint, rewritten boolean"
    if some:
        write_partitions(began, moment, order, limit, folder, False)
        start = cut(read_files(spark, folder).select("file").distinct())
    elif clicks.isEmpty():
        return spark.createDataFrame([], shape)
    else:
        start = spark.createDataFrame([], "file string")
    write_partitions(clicks, moment, order, limit, folder, some)
    rows = read_files(spark, folder)
    new = ~F.coalesce(F.col("_row.arrived_at") < F.lit(BEFORE).cast("timestamp_ntz"), F.lit(False))
    report = with_names(file_report(rows, "click_id", new)).join(start.withColumn("stayed", F.lit(True)), "file", "left")
    columns = ",".join(f.name for f in rows.schema["_row"].dataType.fields)
    return report.select(
        "leaf", F.lit(columns).alias("columns"), "ids_sha256", F.concat(F.lit(f"{folder}/"), "file").alias("path"), "part", "n_rows", "n_new", F.col("stayed").isNull().alias("rewritten"))
