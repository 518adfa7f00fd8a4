"""Joins by nearness: the nearest value of a key, and places within a radius; both as sorts and equi-joins that follow the rows, not the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut


def nearest_values(asks: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """asks (by, tag, g) with below and above: structs (s, place) of the known values (by, place, s) of the same key next to g, the first not above it; null where there is none.

    An as-of join from both sides. Values of both tables stand in one order and are dealt in ranges of (key, value), so a key with most of the rows is many tasks. Within a range,
    the last known value before an ask and the first after it answer it; what lies beyond a range comes from a row for each key and range, whose least and largest known values are
    carried over. Equal known values count at their least place. Rows with a null key or value have no answer and are left out of the known ones.
    """
    null = lambda df, c: F.lit(None).cast(dict(df.dtypes)[c]).alias(c)
    first = known.where("s is not null").groupBy(*by, "s").agg(F.min("place").alias("place"))
    points = first.select(*by, F.col("s").alias("value"), F.struct("s", "place").alias("at"), F.lit(False).alias("asks"), null(asks, "tag")).unionByName(
        asks.select(*by, F.col("g").alias("value"), F.lit(None).cast(f"struct<s: {dict(known.dtypes)['s']}, place: {dict(known.dtypes)['place']}>").alias("at"), F.lit(True).alias("asks"), "tag"))
    points = points.withColumn("_deal", F.xxhash64("tag"))
    n = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of the range is a column of its own from here on, so the ranges are written once
    ranged = cut(points.repartitionByRange(n, *by, "value", "asks", "_deal").withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy(*by, "range").agg(F.max("at").alias("top"), F.min("at").alias("bottom"))
    before = Window.unboundedPreceding, -1
    ends = ends.withColumns({
        "carried_below": F.last("top", True).over(Window.partitionBy(*by).orderBy("range").rowsBetween(*before)),
        "carried_above": F.last("bottom", True).over(Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(*before))}).drop("top", "bottom")
    here = Window.partitionBy(*by, "range")
    upto = Window.unboundedPreceding, 0
    ranged = ranged.withColumns({
        "below": F.last("at", True).over(here.orderBy("value", "asks").rowsBetween(*upto)), "above": F.last("at", True).over(here.orderBy(F.desc("value"), F.desc("asks")).rowsBetween(*upto))}).where("asks")
    out = ranged.join(ends, [*by, "range"], "left")
    return out.select(*by, "tag", F.col("value").alias("g"), F.coalesce("below", "carried_below").alias("below"), F.coalesce("above", "carried_above").alias("above"))


def nearest_one(below, above, g):
    """(s, place) of the nearer one; of two as near the one with the smaller place."""
    down, up = g - below["s"], above["s"] - g
    return F.when(below.isNull() | (up < down) | ((up == down) & (above["place"] < below["place"])), above).otherwise(below)


def within_radius(left: DataFrame, right: DataFrame, by: list[str], radius: int) -> DataFrame:
    """All columns of left (by, i, ...) and right (by, j, ...) for places at most `radius` apart.

    Places fall into buckets of the radius; each of left goes to its own and the two beside it, and meets there those of right. A bucket holds at most as many places as it is wide, so
    a key with most of the rows is many buckets, and the rows that are compared are three times those of the bands.
    """
    width = max(1, radius)
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("_bucket", F.explode(F.array(bucket("i") - 1, bucket("i"), bucket("i") + 1)))
    b = right.withColumn("_bucket", bucket("j"))
    return a.join(b, [*by, "_bucket"]).where(F.abs(F.col("i") - F.col("j")) <= radius).drop("_bucket")
