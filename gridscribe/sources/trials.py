"""Two-arm result tables and texts about them, made from line items: a deterministic fixture in Spark and in SQL.

A table is a supplier; line status F is the control arm, O the experimental one; line numbers 1 to 7 are its rows; a count is the number
of distinct orders and a percent is of the arm's, in integer tenths, so that both engines print the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ARMS = ("Placebo", "Drug A")
LABELS = ("Any TEAE", "SAE", "Grade 3-4 AE", "Discontinuation due to AE", "Fatal", "Nausea", "Headache")
MODES = ("ml", "dl_base", "finetuned")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over all cores: what follows costs far more than its bytes say, by which partitions would be put together again.

    A later groupBy on the key needs no shuffle of its own. The number of partitions is never that of spark.sql.shuffle.partitions: a groupBy would take the shuffle for its own then, and
    adaptive execution would put its small partitions together, into one task.
    """
    spark = df.sparkSession
    return df.repartition(2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, row_index, label, n_a, n_b, big_a, big_b): subjects of each row and arm.

    Items are shuffled once, by table and order: what an order has in a table is one number, with a bit for each row, row and arm, and arm. Tables then count the orders with a bit.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_linestatus", "l_orderkey").where("l_suppkey is not null")
    n = len(LABELS)
    arm = F.when(F.col("l_orderkey").isNull(), 0).when(F.col("l_linestatus") == "F", 1).when(F.col("l_linestatus") == "O", 2).otherwise(0)
    items = items.withColumns({"arm": arm, "row": F.when(F.col("l_linenumber").between(1, n), 3 * F.col("l_linenumber")).otherwise(0).cast("int")})
    # bit 3 * line: the row is there; one or two bits above it: the order is in the row's arm; bits 1 and 2: in the table's
    own = F.expr("if(row > 0, shiftleft(1L, row) | if(arm > 0, shiftleft(1L, row + arm), 0L), 0L) | if(arm > 0, shiftleft(1L, arm), 0L)")
    orders = items.groupBy("l_suppkey", "l_orderkey").agg(F.bit_or(own).alias("has"))
    has = lambda at: F.count_if(F.col("has").bitwiseAND(F.lit(1 << at)) != 0)
    tables = orders.groupBy("l_suppkey").agg(
        has(1).alias("big_a"), has(2).alias("big_b"),
        F.array(*[F.struct(F.lit(i).cast(dict(items.dtypes)["l_linenumber"]).alias("i"), has(3 * i).alias("n"), has(3 * i + 1).alias("n_a"), has(3 * i + 2).alias("n_b")) for i in range(1, n + 1)]).alias("r"))
    rows = tables.select("l_suppkey", "big_a", "big_b", F.inline("r")).where("n > 0")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("i").cast("int"))
    return rows.select(F.col("l_suppkey").alias("table_id"), F.col("i").alias("row_index"), label.alias("label"), "n_a", "n_b", "big_a", "big_b")


def tenths(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.floor((2000 * n + of) / (2 * of))).otherwise(F.lit(0)).cast("long")


def shown(t: Column) -> Column:
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def trials(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """(table_id, table_text, reference, ml, dl_base, finetuned): a linearized table and three texts about each.

    `ml` restates all; `dl_base` adds 1.2 points to the first percent of every third table and leaves the fatal row out of every fourth;
    `finetuned` swaps the arms of every fifth. The reference holds the first four rows. `counted` are the rows of counts() where they are at hand.
    """
    rows = (counts(spark, sf_dir) if counted is None else counted).withColumns({"t_a": tenths(F.col("n_a"), F.col("big_a")), "t_b": tenths(F.col("n_b"), F.col("big_b"))})
    cell = lambda n, t: F.concat(F.col(n).cast("string"), F.lit(" ("), shown(F.col(t)), F.lit("%)"))
    drift = F.when((F.col("table_id") % 3 == 0) & (F.col("row_index") == 1), F.lit(12)).otherwise(F.lit(0))
    said = lambda a, b, ta, tb: F.concat(F.col("label"), F.lit(" was reported in "), F.col("n_a").cast("string"), F.lit(" ("), shown(ta), F.lit(f"%) subjects in the {a} arm and "), F.col("n_b").cast("string"), F.lit(" ("), shown(tb), F.lit(f"%) subjects in the {b} arm."))
    a, b = ARMS
    ta, tb = F.col("t_a"), F.col("t_b")
    rows = rows.select(
        "table_id", "row_index", "big_a", "big_b", F.concat_ws(" | ", "label", cell("n_a", "t_a"), cell("n_b", "t_b")).alias("row"), said(a, b, ta, tb).alias("ml"),
        F.when(~((F.col("table_id") % 4 == 0) & (F.col("row_index") == 5)), said(a, b, ta + drift, tb)).alias("dl_base"),
        F.when(F.col("table_id") % 5 == 0, said(b, a, ta, tb)).otherwise(said(a, b, ta, tb)).alias("finetuned"))
    tables = spread(rows, "table_id").groupBy("table_id").agg(
        F.max("big_a").alias("big_a"), F.max("big_b").alias("big_b"), F.sort_array(F.collect_list(F.struct("row_index", "row", "ml", "dl_base", "finetuned"))).alias("r"))
    head = F.concat(F.lit(f"start_table [HEADERS: | Event | {a} (N="), F.col("big_a").cast("string"), F.lit(f") | {b} (N="), F.col("big_b").cast("string"), F.lit(")] [ROW] "))
    text = lambda c: F.array_join(F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull()), " ")
    return tables.select(
        "table_id", F.concat(head, F.array_join(F.col("r.row"), " [ROW] "), F.lit(" end_table")).alias("table_text"),
        F.array_join(F.slice(F.col("r.ml"), 1, 4), " ").alias("reference"), text("ml").alias("ml"), text("dl_base").alias("dl_base"), text("finetuned").alias("finetuned"))


def candidates(trials_df: DataFrame) -> DataFrame:
    """(table_id, mode, generated, reference, table_text) and the columns that begin with an underscore: one row for each text of a table."""
    more = [c for c in trials_df.columns if c.startswith("_")]
    long = trials_df.unpivot(["table_id", "table_text", "reference", *more], list(MODES), "mode", "generated")
    return long.select("table_id", "mode", "generated", "reference", "table_text", *more)


def _said(a: str, b: str, ta: str, tb: str) -> str:
    show = lambda t: f"cast(({t}) // 10 AS varchar) || '.' || cast(({t}) % 10 AS varchar)"
    return f"label || ' was reported in ' || n_a || ' (' || {show(ta)} || '%) subjects in the {a} arm and ' || n_b || ' (' || {show(tb)} || '%) subjects in the {b} arm.'"


def _sql() -> str:
    a, b = ARMS
    labels = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
    show = lambda t: f"cast(({t}) // 10 AS varchar) || '.' || cast(({t}) % 10 AS varchar)"
    cell = lambda n, t: f"{n} || ' (' || {show(t)} || '%)'"
    drift = "t_a + CASE WHEN table_id % 3 = 0 AND row_index = 1 THEN 12 ELSE 0 END"
    return f"""
arm_rows AS (
  SELECT l_suppkey, l_linenumber, count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'F') AS n_a,
    count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'O') AS n_b FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL),
arm_sizes AS (
  SELECT l_suppkey, count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'F') AS big_a,
    count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'O') AS big_b FROM lineitem GROUP BY ALL),
counted AS (
  SELECT l_suppkey AS table_id, l_linenumber AS row_index, {labels}[l_linenumber] AS label, n_a, n_b, big_a, big_b,
    CASE WHEN big_a > 0 THEN (2000 * n_a + big_a) // (2 * big_a) ELSE 0 END AS t_a,
    CASE WHEN big_b > 0 THEN (2000 * n_b + big_b) // (2 * big_b) ELSE 0 END AS t_b
  FROM arm_rows JOIN arm_sizes USING (l_suppkey)),
worded AS (
  SELECT *, label || ' | ' || {cell('n_a', 't_a')} || ' | ' || {cell('n_b', 't_b')} AS row_text, {_said(a, b, 't_a', 't_b')} AS ml,
    CASE WHEN NOT (table_id % 4 = 0 AND row_index = 5) THEN {_said(a, b, drift, 't_b')} END AS dl_base,
    CASE WHEN table_id % 5 = 0 THEN {_said(b, a, 't_a', 't_b')} ELSE {_said(a, b, 't_a', 't_b')} END AS finetuned FROM counted),
trials AS (
  SELECT table_id, 'start_table [HEADERS: | Event | {a} (N=' || max(big_a) || ') | {b} (N=' || max(big_b) || ')] [ROW] '
      || string_agg(row_text, ' [ROW] ' ORDER BY row_index) || ' end_table' AS table_text,
    string_agg(ml, ' ' ORDER BY row_index) FILTER (WHERE row_index <= 4) AS reference,
    string_agg(ml, ' ' ORDER BY row_index) AS ml, string_agg(dl_base, ' ' ORDER BY row_index) FILTER (WHERE dl_base IS NOT NULL) AS dl_base,
    string_agg(finetuned, ' ' ORDER BY row_index) AS finetuned
  FROM worded GROUP BY table_id),
candidates AS (
  SELECT table_id, mode, generated, reference, table_text FROM trials UNPIVOT (generated FOR mode IN (ml, dl_base, finetuned)))
"""


#: Common table expressions up to trials and candidates, to be followed by a SELECT.
TRIALS_SQL = _sql()
