"""Result tables of eight shapes, made from the rows of the trials: titles, swapped columns, one arm, two phases, three arms, drug-related
rows, single events only, no header, and values in cells of their own; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .trials import TRIALS_SQL, counts, shown, spread, tenths

SHAPES = 8
_STANDARD = ("Any TEAE", "SAE", "Grade 3-4 AE", "Discontinuation due to AE", "Fatal", "Nausea", "Headache")
#: Row labels of each shape; the shape of a table is its id modulo SHAPES.
LABELS = (
    _STANDARD,
    ("Subjects with TEAE", "Serious adverse event", "Severe AE", "TEAE leading to discontinuation", "Deaths", "Grade 3/4 neutropenia", "Fatigue"),
    ("Total TEAEs", "SAEs", "Rash", "Any drug-related TEAE", "Cough", "Nausea", "Headache"),
    _STANDARD,
    ("Any TEAE", "Drug-related SAE", "Drug-related TEAE", "Drug-related permanent discontinuation", "Drug-related Grade 3-4 event", "Grade 3-4 SAE", "Nausea"),
    ("Nausea", "Headache", "Fatigue", "Rash", "Cough", "Dizziness", "Back pain"),
    _STANDARD,
    ("Any TEAE", "SAE", "Grade 3-4 AE", "Discontinuation", "Mortality", "Nausea", "Headache"),
)
#: What stands between start_table and the first row of each shape; {a} and {b} are the sizes of the arms.
HEADS = (
    "[TABLE_TITLE: Table 3: Overview of adverse events] [HEADERS: | Event | Placebo (N={a}) | Drug A (N={b})] ",
    "[HEADERS: | Category | Drug A N={b} | Placebo N={a}] ",
    "[HEADERS: | Drug A (N={b})] ",
    "[HEADERS: | Event | Placebo double-blind (N={a}) | Drug A open-label (N={b})] ",
    "[HEADERS: | Event | Placebo (N={a}) | Drug A (N={b}) | Standard of care (N={a})] ",
    "[HEADERS: | Placebo (N={a}) | Drug A (N={b})] ",
    "",
    "[HEADERS: | Event | Placebo (N={a}) | Drug A (N={b})] ",
)
#: Cells of a row in each shape, from counts and percents of both arms.
CELLS = ("{na} ({pa}%) | {nb} ({pb}%)", "{nb} ({pb}) | {na} ({pa})", "{nb} ({pb}%)", "{na} ({pa}%) | {nb} ({pb}%)", "{na} ({pa}%) | {nb} ({pb}%)", "{na} ({pa}%) | {nb} ({pb}%)", "{pa}% | {pb}%", "{na} | {pa}% | {nb} | {pb}%")
#: Tables with this id modulo 16 have three rows at most.
SHORT = 13


def _chosen(at, texts: tuple[str, ...], values: dict):
    out = F.element_at(F.array(*[F.lit(t) for t in texts]), (at + 1).cast("int"))
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def shaped_rows(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """(table_id, shape, row_index, label, cells, n_a, n_b, t_a, t_b, big_a, big_b)."""
    rows = (counts(spark, sf_dir) if counted is None else counted).withColumns({"t_a": tenths(F.col("n_a"), F.col("big_a")), "t_b": tenths(F.col("n_b"), F.col("big_b")), "shape": F.col("table_id") % SHAPES})
    rows = rows.where((F.col("table_id") % 16 != SHORT) | (F.col("row_index") <= 3))
    label = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(x) for x in ls]) for ls in LABELS]), (F.col("shape") + 1).cast("int")), F.col("row_index").cast("int"))
    values = {"na": F.col("n_a"), "nb": F.col("n_b"), "pa": shown(F.col("t_a")), "pb": shown(F.col("t_b"))}
    return rows.withColumns({"label": label, "cells": _chosen(F.col("shape"), CELLS, values)})


def shapes(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """(table_id, shape, table_text). `counted` are the rows of counts() where they are at hand."""
    rows = shaped_rows(spark, sf_dir, counted).withColumn("row", F.concat_ws(" | ", "label", "cells"))
    tables = spread(rows, "table_id").groupBy("table_id").agg(F.max("big_a").alias("a"), F.max("big_b").alias("b"), F.sort_array(F.collect_list(F.struct("row_index", "row"))).alias("r"))
    head = _chosen(F.col("table_id") % SHAPES, HEADS, {"a": F.col("a"), "b": F.col("b")})
    text = F.concat(F.lit("start_table "), head, F.lit("[ROW] "), F.array_join(F.col("r.row"), " [ROW] "), F.lit(" end_table"))
    return tables.select("table_id", (F.col("table_id") % SHAPES).alias("shape"), text.alias("table_text"))


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    show = lambda t: f"cast({t} // 10 AS varchar) || '.' || cast({t} % 10 AS varchar)"

    def filled(texts, values):
        out = f"{quoted(texts)}[shape + 1]"
        for k, v in values.items():
            out = f"replace({out}, '{{{k}}}', cast({v} AS varchar))"
        return out

    cells = filled(CELLS, {"na": "n_a", "nb": "n_b", "pa": show("t_a"), "pb": show("t_b")})
    return f"""
shaped AS (SELECT * EXCLUDE (label), table_id % {SHAPES} AS shape, [{', '.join(quoted(x) for x in LABELS)}][table_id % {SHAPES} + 1][row_index] AS label
  FROM counted WHERE table_id % 16 <> {SHORT} OR row_index <= 3),
shaped_rows AS (SELECT *, {cells} AS cells FROM shaped),
shapes AS (SELECT table_id, shape, 'start_table ' || {filled(HEADS, {'a': 'max(big_a)', 'b': 'max(big_b)'})} || '[ROW] ' || string_agg(label || ' | ' || cells, ' [ROW] ' ORDER BY row_index) || ' end_table' AS table_text
  FROM shaped_rows GROUP BY table_id, shape)
"""


#: Common table expressions up to shaped_rows and shapes, to be followed by a SELECT.
SHAPES_SQL = f"{TRIALS_SQL}, {_sql()}"
