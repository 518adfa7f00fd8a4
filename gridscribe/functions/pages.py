"""Texts around tables: captions, titles, write-ups, JSON in model output, rows of boxes on a page."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

#: Fixed: a caption, a title within a row, and how a write-up begins, in the order in which they are tried.
CAPTION = r"(?i)(?:Table|Figure)\s+\d+[\.:][^\n]{5,80}"
NAMES_TABLE = r"(?i)Table\s+\d+"
STARTERS = (r"overall[,\s]", r"treatment[- ]emergent", r"a total of", r"adverse events were", r"subjects in the", r"the (?:most|incidence)")


def caption(page: Column, index: Column) -> Column:
    """The caption of the table with this position (from 0) on a page; empty without one."""
    return F.trim(F.coalesce(F.get(F.regexp_extract_all(page, F.lit(f"({CAPTION})"), 1), index), F.lit("")))


def inferred_title(first_row: Column, file_name: Column, index: Column) -> Column:
    """The first row (array of cells) if it names a table, else a title from the file's name."""
    row = F.trim(F.array_join(first_row, " "))
    clean = F.initcap(F.regexp_replace(file_name, r"[_\-]+", " "))
    return F.when(row.rlike(NAMES_TABLE), row).otherwise(F.concat(F.lit("Table "), (index + 1).cast("string"), F.lit(": "), clean))


def writeup(page: Column) -> Column:
    """From the first kind of beginning that the page has: 50 to 800 more characters, up to a blank line or the end, with a digit; empty without one."""
    tries = [F.regexp_extract(page, rf"(?is)({s}.{{50,800}}?(?=\n\n|\z))", 1) for s in STARTERS]
    return F.coalesce(*[F.when(t.rlike(r"\d"), F.trim(t)) for t in tries], F.lit(""))


def arrays_in(text: str) -> list[tuple[int, list]]:
    """(length, value) of each JSON array that begins somewhere in the text, outermost ones only: what the decoder reads from a square bracket on."""
    decoder, found, at = json.JSONDecoder(), [], text.find("[")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            found.append((end - at, value))
        at = text.find("[", end)
    return found


def json_array(text: str | None) -> list[dict]:
    """The objects of the array that a model was asked for: the text if it is one, else the first code fence that is one, else the longest that the text holds."""
    text = (text or "").strip()
    for whole in (text, *(x.strip() for x in re.findall(r"(?is)```(?:json)?(.*?)```", text))):
        got = arrays_in(whole) if whole.startswith("[") else []
        if got and got[0][0] == len(whole):
            return [r for r in got[0][1] if isinstance(r, dict)]
    _, longest = max(arrays_in(text), key=lambda x: x[0], default=(0, []))
    return [r for r in longest if isinstance(r, dict)]


@F.pandas_udf(StringType())
def recovered_json(text: pd.Series) -> pd.Series:
    """json_array as JSON text, to be read with from_json under the schema that is wanted."""
    return pd.Series([json.dumps(json_array(t), ensure_ascii=False, sort_keys=True) for t in text], dtype="object")


def box_rows(boxes: DataFrame, page: tuple[str, ...], order: str, x: str, y: str, text: str, gap: float = 15.0) -> DataFrame:
    """(page, row, cells) of boxes on pages: read in `order`, a box more than `gap` below or above the one before it begins a row; cells stand by x."""
    by = Window.partitionBy(*page).orderBy(order)
    new = F.coalesce((F.abs(F.col(y) - F.lag(y).over(by)) > gap).cast("int"), F.lit(0))
    rows = boxes.withColumn("_new", new).withColumn("row", F.sum("_new").over(by))
    cells = F.transform(F.sort_array(F.collect_list(F.struct(x, order, text))), lambda b: b[text])
    return rows.groupBy(*page, "row").agg(cells.alias("cells"))


def zipped(left: DataFrame, right: DataFrame, order_left: str, order_right: str, buckets: int = 256) -> DataFrame:
    """Rows of both sides by position, as many as the shorter has. Positions are counted per range of the order first, so no task holds a side."""

    def placed(df: DataFrame, order: str) -> DataFrame:
        spread = df.repartitionByRange(buckets, order).sortWithinPartitions(order)
        rows = spread.withColumn("_b", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33))
        sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
        ahead = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_ahead"))
        return rows.join(F.broadcast(ahead), "_b").withColumn("_pos", F.col("_ahead") + F.col("_i")).drop("_b", "_i", "_ahead")

    return placed(left, order_left).join(placed(right, order_right), "_pos").withColumnRenamed("_pos", "position")
