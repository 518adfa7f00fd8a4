"""Reports whose groups, and metrics whose texts, may be of any size: quantile sketches, and drift and arm confusion by joins instead of arrays within a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.meteor import THESAURUS, meteor_by
from ..operators import joins, quantiles
from ..sources.trials import ARMS
from .scoring import METRICS, SCORES_SQL, rounded, scored, texts

SHARES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def percentile_sketches(spark, sf_dir):
    """Percentiles of each metric and mode from one sketch for each run (tables by their id modulo 4), merged over runs."""
    long = scored(spark, sf_dir).withColumn("run", F.col("table_id") % 4).unpivot(["mode", "run"], list(METRICS), "metric", "value")
    parts = quantiles.sketches(long, ["mode", "metric", "run"])
    rows = quantiles.report(quantiles.merged(parts, ["mode", "metric"]), ["mode", "metric"], SHARES)
    return rounded(rows, "min", *SHARES, "max", "rank_error")


def drift(texts: DataFrame, key: list[str], of: str, text: str, source: str) -> DataFrame:
    """(key, ndi): the mean relative distance of each text's numbers to the nearest of its table, by a join. texts (key, of, text, source); of is the table's key.

    1 without source numbers, 0 without numbers, as in a row. A text is read once; its numbers are rows, whatever their number.
    """
    read = texts.select(*key, F.posexplode_outer(T.extract_numbers(F.col(text))).alias("i", "g"))
    known = texts.groupBy(of).agg(F.first(source).alias("s")).select(of, F.posexplode(T.extract_numbers(F.col("s"))).alias("place", "s"))
    asks = read.where("g is not null").select(of, F.struct(*[c for c in key]).alias("tag"), "g")
    found = joins.nearest_values(asks, known, [of])
    near = joins.nearest_one(F.col("below"), F.col("above"), F.col("g"))["s"]
    means = found.groupBy("tag").agg(F.avg(F.abs(F.col("g") - near) / F.greatest(F.abs(near), F.lit(0.01))).alias("ndi"), F.count("*").alias("n")).select("tag.*", "ndi", "n")
    rows = texts.select(*key).join(means, key, "left")
    return rows.select(*key, F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.coalesce("ndi", F.lit(1.0))).alias("ndi"))


def drift_by_join(spark, sf_dir):
    return rounded(drift(texts(spark, sf_dir), ["table_id", "mode"], "table_id", "generated", "table_text"), "ndi")


def _near_arms(texts: DataFrame, key: list[str], text: str, arms: tuple[str, ...], radius: int) -> DataFrame:
    """(key, arm, v): numbers at most `radius` tokens from an arm's name, once per occurrence; arm is its place in the list."""
    read = texts.select(*key, T.token_numbers(F.col(text)).alias("read"))
    named = F.map_from_arrays(F.array(*[F.lit(k) for k in range(len(arms))]), F.array(*[T.arm_starts(F.col("read.toks"), a) for a in arms]))
    left = read.select(*key, F.explode(named).alias("arm", "at")).select(*key, "arm", F.explode("at").alias("i"))
    right = read.select(*key, F.explode("read.nums").alias("n")).select(*key, F.col("n.i").alias("j"), "n.v")
    return joins.within_radius(left, right, key, radius).select(*key, "arm", "v")


def arm_confusion(texts: DataFrame, key: list[str], of: str, text: str, source: str, arms: tuple[str, ...], radius: int = 30, tolerance: float = 0.01) -> DataFrame:
    """(key, confused, evaluated): values near an arm in the text that the source has first near another arm, repeats counted, by joins alone.

    The bands of names and numbers are an equi-join on buckets of tokens. A value has an owner if the next source value of an arm to either side is within the tolerance: no other value
    of that arm is nearer.
    """
    said = _near_arms(texts, key, text, arms, radius).groupBy(*key, "arm", "v").agg(F.count("*").alias("n"))
    tables = texts.groupBy(of).agg(F.first(source).alias(source))
    known = _near_arms(tables, [of], source, arms, radius).select(of, F.col("arm").alias("owner"), F.lit(0).alias("place"), F.col("v").alias("s"))
    every = F.explode(F.array(*[F.lit(k) for k in range(len(arms))])).alias("owner")
    asks = said.select(of, every, F.struct(*key, "arm", "n").alias("tag"), F.col("v").alias("g"))
    found = joins.nearest_values(asks, known, [of, "owner"])
    near = lambda c: F.coalesce(T.near(F.col("g"), F.col(f"{c}.s"), tolerance), F.lit(False))
    owners = found.where(near("below") | near("above")).groupBy("tag", "g").agg(F.min("owner").alias("owner"))
    sums = owners.groupBy(*[F.col(f"tag.{c}").alias(c) for c in key]).agg(
        F.sum(F.when(F.col("owner") != F.col("tag.arm"), F.col("tag.n")).otherwise(0)).alias("confused"), F.sum("tag.n").alias("evaluated"))
    rows = texts.select(*key).join(sums, key, "left")
    return rows.select(*key, F.coalesce("confused", F.lit(0)).alias("confused"), F.coalesce("evaluated", F.lit(0)).alias("evaluated"))


def confusion_by_join(spark, sf_dir):
    rows = arm_confusion(texts(spark, sf_dir), ["table_id", "mode"], "table_id", "generated", "table_text", ARMS)
    return rounded(rows.select("table_id", "mode", F.when(F.col("evaluated") > 0, F.col("confused") / F.col("evaluated")).otherwise(F.lit(0.0)).alias("acr")), "acr")


def meteor(spark, sf_dir):
    """METEOR of each text against its reference, by forms and stems."""
    return rounded(texts(spark, sf_dir).select("table_id", "mode", meteor_by(spark.conf.get(THESAURUS, None))("generated", "reference").alias("meteor")), "meteor")


QUERIES = {
    "percentile_sketches": (percentile_sketches, f"""{SCORES_SQL}, long AS (SELECT mode, metric, value FROM scores UNPIVOT (value FOR metric IN ({', '.join(METRICS)})))
      SELECT mode, metric, count(*) AS n, round(min(value), 6) AS min, {', '.join(f'round(quantile_disc(value, {p}), 6) AS {k}' for k, p in SHARES.items())}, round(max(value), 6) AS max,
        CASE WHEN count(*) <= {quantiles.SIZE} THEN 0.0 ELSE {round(quantiles.rank_error(), 6)} END::double AS rank_error FROM long GROUP BY mode, metric"""),
    "drift_by_join": (drift_by_join, f"{SCORES_SQL} SELECT table_id, mode, round(ndi, 6) AS ndi FROM scores"),
    "confusion_by_join": (confusion_by_join, f"{SCORES_SQL} SELECT table_id, mode, round(acr, 6) AS acr FROM scores"),
    "meteor": (meteor, None),
}
