"""Quantiles of groups of any size from mergeable sketches (KLL): one sketch a run, merged over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Items that a sketch holds at its largest level. Ranks are wrong by about 2.3 / SIZE ** 0.97 of all values, with 99 % certainty; up to SIZE values are kept as they are.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """Share of all values by which the rank of a quantile may be off (published bound of the sketch for single quantiles)."""
    return 2.296 / size**0.9723


def sketches(rows: DataFrame, by: list[str], value: str = "value", size: int = SIZE) -> DataFrame:
    """(by, sketch, low, high, n): one partial for each group. Nulls are left out. Sketches are combined before the shuffle, so a group of most of the rows is as many small rows as tasks."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"))


def merged(partials: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Partials of further keys as one for each group, as if all rows had been sketched together."""
    return partials.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def report(partials: DataFrame, by: list[str], shares: dict[str, float], size: int = SIZE) -> DataFrame:
    """(by, n, min, the named quantiles, max, rank_error): the least value that so large a share of all is not above. rank_error is 0 where a sketch still holds every value."""
    q = {k: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for k, p in shares.items()}
    error = F.when(F.col("n") <= size, F.lit(0.0)).otherwise(F.lit(rank_error(size)))
    return partials.select(*by, "n", F.col("low").alias("min"), *[c.alias(k) for k, c in q.items()], F.col("high").alias("max"), error.alias("rank_error"))
