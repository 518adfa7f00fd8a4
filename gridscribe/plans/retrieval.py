"""Retrieval queries: scaling, nearest neighbours, leave-one-out evaluation, summaries adapted from a neighbour's write-up."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metrics as M, tables as T
from ..functions.rouge import rouge_f1
from ..functions.tables import FEATURES, table_features
from ..operators import adapt as D, generation as G
from ..operators.neighbours import nearest_by_pivots, nearest_in_task, nearest_left_out
from ..session import cut
from ..sources.shapes import shapes
from ..sources.trials import TRIALS_SQL, counts, trials
from .composing import listings_of, with_cluster
from .curation import scrubbed
from .parsing import FEATURES_SQL
from .scoring import rounded

#: Features that the scaler's SQL states as well.
SHORT = ("num_count", "max_number", "mean_number", "max_pct", "mean_pct", "total_patients")


def features(spark, sf_dir, names=FEATURES) -> DataFrame:
    cols = table_features(F.col("table_text"))
    return trials(spark, sf_dir).select("table_id", *[cols[k].alias(k) for k in names])


def scaled(df: DataFrame, names, fit_on: DataFrame | None = None) -> DataFrame:
    """Features less the mean over the population deviation of fit_on (df itself if left out); a constant feature is only centred. Means are one row, broadcast."""
    stats = (df if fit_on is None else fit_on).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"s_{c}") for c in names])
    rows = df.join(F.broadcast(stats))
    one = lambda c: F.when(F.col(f"s_{c}.s") > 1e-12, F.col(f"s_{c}.s")).otherwise(1.0)
    return rows.select(F.col("table_id").alias("id"), F.array(*[(F.col(c) - F.col(f"s_{c}.m")) / one(c) for c in names]).alias("v"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True, block: int = 1024, part: int = 16_384, metric: str = "cosine") -> DataFrame:
    """(q, id, rank, distance) of the k nearest by cosine (or "euclidean") of (id, v), exactly, ties by id; by cosine a zero vector is at distance 1.

    A stated query set against all rows, in blocks: a task multiplies one block of queries with one part of the corpus and keeps its own k
    best of each query, so what is shuffled after it grows with queries x parts x k, not with pairs. Both sides are sent once for each block of the
    other; the numbers of blocks and parts follow the counts, so that no task holds more than a block and a part.
    """
    blocks, parts = (max(1, math.ceil(df.count() / n)) for df, n in ((queries, block), (corpus, part)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, is_query: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)
        return df.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(is_query).alias("is_query"), at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    rows = dealt(queries, "b", blocks, "p", parts, True).unionByName(dealt(corpus, "p", parts, "b", blocks, False))

    def best(task: pa.Table) -> pa.Table:
        return nearest_in_task(task, k, metric, exclude_self)

    kind = dict(queries.dtypes)["id"]
    local = rows.groupBy("b", "p").applyInArrow(best, f"q {kind}, id {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")).cast("long")
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "distance")


def six_digits(distance: Column) -> Column:
    """A distance of nine digits to six, as the SQL rounds it: the number times a million, whose half may come out just below a half, while round() goes by the digits that are printed."""
    times = distance * 1e6
    return (F.floor(times) + F.when(times - F.floor(times) >= 0.5, 1).otherwise(0)) / F.lit(1e6)


def scaler(spark, sf_dir):
    df = features(spark, sf_dir, SHORT)
    rows = df.unpivot(["table_id"], list(SHORT), "feature", "value").groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return rounded(rows.withColumn("std", F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)), "mean", "std")


def table_neighbours(spark, sf_dir):
    """The three nearest tables of each table on all 32 scaled features, by pivots."""
    v = cut(scaled(features(spark, sf_dir), FEATURES))
    return nearest_by_pivots(v, v, 3)[0].select("q", "rank", "id", six_digits(F.col("distance")).alias("distance"))


def embedding_neighbours(spark, sf_dir):
    """Every embedding whose id is divisible by 20 against all, the five nearest."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = nearest(e.where("id % 20 = 0"), e, 5)
    return rows.select("q", "rank", "id", six_digits(F.col("distance")).alias("distance"))


def leave_one_out(spark, sf_dir):
    """Per table and feature the scaler's mean and deviation without that table, from the sums less its own share: one pass, no rebuilds."""
    df = features(spark, sf_dir, SHORT).unpivot(["table_id"], list(SHORT), "feature", "value")
    total = df.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    rows = df.join(F.broadcast(total), "feature")
    mean = (F.col("s") - F.col("value")) / F.greatest(F.col("n") - 1, F.lit(1))
    rows = rows.withColumn("mean", mean).withColumn("var", (F.col("q") - F.col("value") * F.col("value")) / F.greatest(F.col("n") - 1, F.lit(1)) - F.col("mean") * F.col("mean"))
    rows = rows.select("table_id", "feature", F.round("mean", 4).alias("mean"), F.round(F.when(F.col("var") > 1e-9, F.sqrt("var")).otherwise(1.0), 4).alias("std"))
    return rows


def loo_neighbours(spark, sf_dir):
    """The nearest other table of each table, with features scaled by the other tables alone."""
    return nearest_left_out(features(spark, sf_dir).withColumnRenamed("table_id", "id"), 1, list(FEATURES)).select("q", "id", six_digits(F.col("distance")).alias("distance"))


def told_by(pairs: DataFrame, tables: DataFrame, corpus: DataFrame) -> DataFrame:
    """(table_id, adapted): each table (table_id, table_text) told with the write-up of the corpus table (table_id, table_text, writeup) that it is paired with (q, id); null where
    too few of the write-up's slots are known. Tables without a pair stay, with null."""
    text = F.col("table_text")
    old = corpus.select(F.col("table_id").alias("id"), "writeup", T.arms(text).alias("a"), D.last_slots(text).alias("old_slots"), D.plainly_delexicalized(F.col("writeup"), text).alias("plain"))
    pairs = pairs.join(old, "id").select(F.col("q").alias("table_id"), "writeup", "a", "old_slots", "plain")
    rows = tables.select("table_id", G.slots_of(text).alias("slots")).join(pairs, "table_id", "left")
    rows = rows.withColumn("template", D.delexicalized("writeup", F.col("a.control"), F.col("a.experimental"), "old_slots"))
    rows = rows.withColumn("template", F.coalesce("template", "plain"))
    return rows.select("table_id", G.polish(D.adapted(F.col("template"), F.col("slots"))).alias("adapted"))


def loo_scores(spark, sf_dir) -> DataFrame:
    """(table_id, origin, rouge_1, rouge_2, rouge_l, numeric_accuracy, hallucination_rate): each table told with the write-up of its nearest other table, scored against its own."""
    corpus = trials(spark, sf_dir).select("table_id", "table_text", F.col("reference").alias("writeup"))
    near = nearest_left_out(features(spark, sf_dir).withColumnRenamed("table_id", "id"), 1, list(FEATURES)).select("q", "id")
    told = told_by(near, corpus, corpus)
    tables = with_cluster(corpus).join(told, "table_id")
    rows = G.composed(tables, listings_of(corpus)).join(corpus, "table_id")
    gen, ref = F.coalesce("summary", F.lit("")), scrubbed(F.col("writeup"))
    rows = rows.select(
        "table_id", "origin", rouge_f1(gen, ref).alias("r"), M.accuracy_vs_reference(gen, ref).alias("numeric_accuracy"),
        M.value_hallucination(gen, F.col("table_text"), 0.01, (0.0, 1.0, 2.0)).alias("hallucination_rate"))
    return rows.select("table_id", "origin", "r.rouge_1", "r.rouge_2", "r.rouge_l", "numeric_accuracy", "hallucination_rate")


LOO_METRICS = ("rouge_1", "rouge_2", "rouge_l", "numeric_accuracy", "hallucination_rate")
#: Fixed: which statistic of which metric is to be above or below what.
LOO_GOALS = (("rouge_1", "p10", ">", 0.75), ("rouge_1", "mean", ">", 0.85), ("numeric_accuracy", "mean", ">", 0.96), ("hallucination_rate", "mean", "<", 0.04))


def loo_report(scores: DataFrame) -> DataFrame:
    """(metric, n, mean, std, p10, p50, p90, min, max, goals) to four places: goals is a map of statistic to whether it is met. Nulls of a metric are left out of it."""
    long = scores.unpivot(["table_id"], list(LOO_METRICS), "metric", "value").where("value is not null")
    rows = long.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), *[F.percentile("value", p).alias(k) for k, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))],
        F.min("value").alias("min"), F.max("value").alias("max"))
    rows = rows.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p10", "p50", "p90", "min", "max")})
    met = lambda stat, sign, goal: F.col(stat) > goal if sign == ">" else F.col(stat) < goal
    goals = F.map_from_entries(F.filter(F.array(*[
        F.when(F.col("metric") == m, F.struct(F.lit(f"{stat} {sign} {goal}").alias("k"), met(stat, sign, goal).alias("v"))) for m, stat, sign, goal in LOO_GOALS]), lambda e: e.isNotNull()))
    return rows.withColumn("goals", goals)


def loo_evaluation(spark, sf_dir):
    rows = loo_report(loo_scores(spark, sf_dir))
    return rows.withColumn("goals", F.array_join(F.transform(F.map_entries("goals"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), "; "))


def shape_pairs(tables: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, id): for each table (table_id, table_text) the nearest other table of the corpus with write-ups, scaled by the corpus."""
    own, known = (cut(df.select("table_id", *[v.alias(k) for k, v in table_features(F.col("table_text")).items()])) for df in (tables, corpus))
    return nearest_by_pivots(cut(scaled(own, FEATURES, known)), cut(scaled(known, FEATURES)), 1)[0].select("q", "id")


def shapes_and_corpus(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tables of all shapes and the corpus with write-ups (table_id, table_text, writeup), made and written once: each of the steps that read them would make them anew from all items."""
    counted = cut(counts(spark, sf_dir))
    return cut(shapes(spark, sf_dir, counted)), cut(trials(spark, sf_dir, counted).select("table_id", "table_text", F.col("ml").alias("writeup")))


def adapted_writeups(spark, sf_dir):
    """Each table told with the write-up of its nearest other table, its names and numbers exchanged."""
    tables, corpus = shapes_and_corpus(spark, sf_dir)
    return told_by(shape_pairs(tables, corpus), tables, corpus).select("table_id", F.col("adapted").alias("summary"))


def neighbour_summaries(spark, sf_dir):
    """The cascade with the neighbour's write-up first: adapted, else realized, else by template."""
    tables, corpus = shapes_and_corpus(spark, sf_dir)
    told = cut(told_by(shape_pairs(tables, corpus), tables, corpus))
    return G.composed(with_cluster(tables).join(told, "table_id"), listings_of(tables))


_F = f"""WITH {TRIALS_SQL}, f AS (SELECT table_id, list_transform(regexp_extract_all(table_text, '\\b\\d+\\.?\\d*\\b'), lambda x: cast(x AS double)) AS n,
  list_transform(regexp_extract_all(table_text, '(\\d+\\.?\\d*)\\s*\\)', 1), lambda x: cast(x AS double)) AS p, list_transform(regexp_extract_all(table_text, 'N\\s*=\\s*(\\d+)', 1), lambda x: cast(x AS double)) AS z FROM trials),
  w AS (SELECT table_id, len(n)::double AS num_count, list_max(n) AS max_number, list_avg(n) AS mean_number, list_max(p) AS max_pct, list_avg(p) AS mean_pct, list_sum(z) AS total_patients FROM f),
  long AS (SELECT table_id, feature, value FROM w UNPIVOT (value FOR feature IN ({', '.join(SHORT)})))"""

#: All 32 features in long form.
_ALL = f"WITH {TRIALS_SQL}, shapes AS (SELECT table_id, table_text FROM trials), {FEATURES_SQL}, x AS (SELECT table_id, k, x FROM feature_values UNPIVOT (x FOR k IN ({', '.join(FEATURES)})))"

QUERIES = {
    "scaler": (scaler, f"{_F} SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1 END, 6) AS std FROM long GROUP BY feature"),
    "table_neighbours": (table_neighbours, f"""{_ALL}, st AS (SELECT k, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END AS s FROM x GROUP BY k), z AS (SELECT table_id, k, (x - m) / s AS z FROM x JOIN st USING (k)),
      p AS (SELECT a.table_id AS q, b.table_id AS id, sum(a.z * b.z) AS d, sqrt(sum(a.z * a.z)) * sqrt(sum(b.z * b.z)) AS n FROM z a JOIN z b USING (k) WHERE a.table_id <> b.table_id GROUP BY ALL),
      c AS (SELECT q, id, round(CASE WHEN n > 0 THEN 1 - d / n ELSE 1 END, 9) AS distance FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM c)
      SELECT q, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 3"""),
    "loo_neighbours": (loo_neighbours, f"""{_ALL}, st AS (SELECT a.table_id AS q, b.k, avg(b.x) AS m, CASE WHEN min(b.x) < max(b.x) THEN stddev_pop(b.x) ELSE 1 END AS s FROM (SELECT DISTINCT table_id FROM x) a JOIN x b ON a.table_id <> b.table_id GROUP BY ALL),
      z AS (SELECT st.q, x.table_id AS id, st.k, (x.x - m) / s AS z FROM st JOIN x USING (k)), p AS (SELECT b.q, b.id, sum(a.z * b.z) AS d, sqrt(sum(a.z * a.z)) * sqrt(sum(b.z * b.z)) AS n FROM z a JOIN z b ON a.q = b.q AND a.k = b.k AND a.id = a.q AND b.id <> b.q GROUP BY ALL),
      c AS (SELECT q, id, round(CASE WHEN n > 1e-12 THEN 1 - d / n ELSE 1 END, 9) AS distance FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM c)
      SELECT q, id, round(distance, 6) AS distance FROM r WHERE rank = 1"""),
    "loo_evaluation": (loo_evaluation, None),
    "adapted_writeups": (adapted_writeups, None),
    "neighbour_summaries": (neighbour_summaries, None),
    "embedding_neighbours": (embedding_neighbours, """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, round(1 - list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[])), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM p) SELECT q, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5"""),
    "leave_one_out": (leave_one_out, f"{_F}, t AS (SELECT feature, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM long GROUP BY feature), m AS (SELECT table_id, feature, (s - value) / (n - 1) AS mean, (q - value * value) / (n - 1) AS sq FROM long JOIN t USING (feature)) SELECT table_id, feature, round(mean, 4) AS mean, round(CASE WHEN sq - mean * mean > 1e-9 THEN sqrt(sq - mean * mean) ELSE 1 END, 4) AS std FROM m"),
}
