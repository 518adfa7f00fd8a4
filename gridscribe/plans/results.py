"""Result statistics over events: variants, matrices, error taxonomy, significance. event_type is the variant, k of the JSON the topic."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

from ..functions.exact import fisher_exact
from .scoring import rounded


def items(spark, sf_dir):
    """events as result rows: correct below a value of 60, off target where the user is a multiple of 7, switches and shares of both languages from the id, as long as their properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(
        "event_id", F.col("event_type").alias("variant"), (F.coalesce(k, F.lit(0)) % 5).alias("topic"), (F.col("event_id") % 3).alias("difficulty"), (F.coalesce("value", F.lit(0.0)) < 60).alias("is_correct"),
        (F.col("user_id") % 7 == 0).alias("off_target"), (F.col("event_id") % 9).alias("switches"), (F.col("user_id") % 4).alias("language"), F.concat(F.lit("trap"), (F.col("user_id") % 40).cast("string")).alias("trap"),
        F.length("props").cast("long").alias("response_length"), ((F.col("event_id") % 11) / 10).alias("english"), ((10 - F.col("event_id") % 11) / 10).alias("hindi"))


def variant_statistics(spark, sf_dir):
    """Accuracy, off-target rate, switches, length and shares of languages of each variant, and the drop against the base variant (a row per variant, so no skew)."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    rows = items(spark, sf_dir).groupBy("variant").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"), rate("is_correct").alias("accuracy"), rate("off_target").alias("off_target_rate"), F.avg("switches").alias("avg_switches"),
        F.avg("response_length").alias("avg_response_len"), F.avg("english").alias("avg_en_fraction"), F.avg("hindi").alias("avg_hi_fraction"))
    base = rows.where("variant = 'view'").select(F.col("accuracy").alias("base"))
    rows = rows.join(F.broadcast(base)).withColumn("accuracy_drop", F.col("base") - F.col("accuracy")).withColumn("relative_drop_pct", F.when(F.col("base") > 0, 100 * F.col("accuracy_drop") / F.col("base")).otherwise(0.0))
    return rounded(rows.drop("base"), "accuracy", "off_target_rate", "avg_switches", "avg_response_len", "avg_en_fraction", "avg_hi_fraction", "accuracy_drop", "relative_drop_pct")


def topic_matrix(spark, sf_dir):
    """Accuracy by topic and variant, one column for each variant, and the largest drop of a topic in points."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = items(spark, sf_dir).groupBy("topic").pivot("variant", kinds).agg(F.avg(F.col("is_correct").cast("int")))
    each = [F.col(k) for k in kinds]
    return rounded(rows.withColumn("max_drop_pp", 100 * (F.greatest(*each) - F.least(*each))), *kinds, "max_drop_pp")


def difficulty_matrix(spark, sf_dir):
    rows = items(spark, sf_dir).groupBy("difficulty", "variant").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))
    return rounded(rows.withColumn("accuracy", F.col("correct") / F.col("n")), "accuracy")


def error_taxonomy(spark, sf_dir):
    """Overlapping kinds of wrong answers of one variant; what is left never falls below 0."""
    wrong = items(spark, sf_dir).where("variant = 'error' and not is_correct")
    rows = wrong.agg(F.count("*").alias("n"), F.count_if("off_target").alias("off_target"), F.count_if(F.col("switches") > 5).alias("high_switches"), F.count_if(F.col("language") == 3).alias("hedged"))
    return rows.withColumn("other", F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("off_target") - F.col("high_switches") - F.col("hedged")))


def language_counts(spark, sf_dir):
    """Counts of each language per variant as one map in text form."""
    rows = items(spark, sf_dir).groupBy("variant", "language").count()
    rows = rows.groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("language", "count"))).alias("c"))
    return rows.select("variant", F.array_join(F.transform("c", lambda x: F.concat(x["language"].cast("string"), F.lit("="), x["count"].cast("string"))), ",").alias("counts"))


def first_groups(spark, sf_dir):
    """Accuracy of the fifteen traps that come first, by their first row and not by size."""
    rows = items(spark, sf_dir).where("variant = 'error'").groupBy("trap").agg(F.min("event_id").alias("first"), F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))
    return rounded(rows.orderBy("first").limit(15).select("trap", "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy")), "accuracy")


# The published coefficients of the polynomial.
def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution by the five-term polynomial."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-z * z / 2) * poly / math.sqrt(2 * math.pi)


def significance(spark, sf_dir):
    """Two variants compared by the pooled normal approximation of the exact 2 x 2 test."""
    rows = items(spark, sf_dir).where("variant in ('view', 'error')").agg(
        *[f(c).alias(n) for v in ("view", "error") for f, c, n in ((F.count_if, F.col("variant") == v, f"n_{v}"), (F.count_if, (F.col("variant") == v) & F.col("is_correct"), f"c_{v}"))])
    pool = (F.col("c_view") + F.col("c_error")) / (F.col("n_view") + F.col("n_error"))
    spread = F.sqrt(pool * (1 - pool) * (1 / F.col("n_view") + 1 / F.col("n_error")))
    z = (F.col("c_view") / F.col("n_view") - F.col("c_error") / F.col("n_error")) / F.nullif(spread, F.lit(0.0))
    p = F.coalesce(normal_tail(z), F.lit(1.0))
    return rounded(rows.select("*", p.alias("p_value"), (p < 0.05).alias("significant")), "p_value")


def exact_tests(spark, sf_dir):
    """Fisher's exact test of each variant's correct and wrong answers against those of the base variant."""
    rows = items(spark, sf_dir).groupBy("variant").agg(F.count_if("is_correct").alias("c"), F.count_if(~F.col("is_correct")).alias("d"))
    base = rows.where("variant = 'view'").select(F.col("c").alias("a"), F.col("d").alias("b"))
    rows = rows.where("variant <> 'view'").join(F.broadcast(base))
    return rounded(rows.select("variant", fisher_exact("a", "b", "c", "d").alias("p_value")), "p_value")


def hypothesis_verdict(spark, sf_dir):
    v = variant_statistics(spark, sf_dir).where("variant in ('view', 'error')").groupBy().pivot("variant", ["view", "error"]).agg(F.max("accuracy").alias("a"), F.max("avg_switches").alias("s"), F.max("off_target_rate").alias("o"))
    return v.select((F.col("view_a") - F.col("error_a") >= 0.15).alias("h1"), (F.col("error_s") >= 2 * F.col("view_s")).alias("h2"), (F.col("error_o") - F.col("view_o") >= 0.10).alias("h3"), F.round(100 * (F.col("view_a") - F.col("error_a")), 2).alias("drop_pp"))


def latest_runs(spark, sf_dir):
    """The last row of each (user, type) by time, the highest id of equal times: an aggregate with map-side maxima, no sort."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def latency_gate(spark, sf_dir):
    """Median and 95th percentile of values, and the rate of a disjunction, by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", "user_id")
    rows = e.groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.avg(((F.col("value") > 80) | (F.col("user_id") % 5 == 0)).cast("int")).alias("gate_rate"))
    return rounded(rows, "p50", "p95", "gate_rate")


def islands(spark, sf_dir):
    """Runs of events of a user with gaps of at most a day: a running count of larger gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by))
    rows = e.withColumn("new", F.when(gap > 86_400_000_000, 1).otherwise(0)).withColumn("run", F.sum("new").over(by))
    return rows.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_I = """WITH items AS (SELECT event_id, event_type AS variant, coalesce(try_cast(json_extract_string(props, '$.k') AS bigint), 0) % 5 AS topic, event_id % 3 AS difficulty, coalesce(value, 0) < 60 AS is_correct,
  user_id % 7 = 0 AS off_target, event_id % 9 AS switches, user_id % 4 AS language, 'trap' || (user_id % 40) AS trap, length(props) AS response_length, (event_id % 11) / 10 AS english, (10 - event_id % 11) / 10 AS hindi FROM events)"""
_S = f"""{_I}, s AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE is_correct) AS n_correct, avg(is_correct::int) AS accuracy, avg(off_target::int) AS off_target_rate, avg(switches) AS avg_switches, avg(response_length) AS avg_response_len, avg(english) AS avg_en_fraction, avg(hindi) AS avg_hi_fraction FROM items GROUP BY variant),
  b AS (SELECT accuracy AS base FROM s WHERE variant = 'view')"""
_P = "t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"

QUERIES = {
    "variant_statistics": (variant_statistics, f"{_S} SELECT variant, n, n_correct, round(accuracy, 6) AS accuracy, round(off_target_rate, 6) AS off_target_rate, round(avg_switches, 6) AS avg_switches, round(avg_response_len, 6) AS avg_response_len, round(avg_en_fraction, 6) AS avg_en_fraction, round(avg_hi_fraction, 6) AS avg_hi_fraction, round(base - accuracy, 6) AS accuracy_drop, round(CASE WHEN base > 0 THEN 100 * (base - accuracy) / base ELSE 0 END, 6) AS relative_drop_pct FROM s, b"),
    "topic_matrix": (topic_matrix, f"""{_I}, m AS (SELECT topic, {', '.join(f"avg(is_correct::int) FILTER (WHERE variant = '{k}') AS {k}" for k in ('click', 'error', 'purchase', 'signup', 'view'))} FROM items GROUP BY topic)
      SELECT topic, round(click, 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup, round(view, 6) AS view, round(100 * (greatest(click, error, purchase, signup, view) - least(click, error, purchase, signup, view)), 6) AS max_drop_pp FROM m"""),
    "difficulty_matrix": (difficulty_matrix, f"{_I} SELECT difficulty, variant, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, round(avg(is_correct::int), 6) AS accuracy FROM items GROUP BY ALL"),
    "error_taxonomy": (error_taxonomy, f"{_I}, w AS (SELECT count(*) AS n, count(*) FILTER (WHERE off_target) AS off_target, count(*) FILTER (WHERE switches > 5) AS high_switches, count(*) FILTER (WHERE language = 3) AS hedged FROM items WHERE variant = 'error' AND NOT is_correct) SELECT *, greatest(0, n - off_target - high_switches - hedged) AS other FROM w"),
    "language_counts": (language_counts, f"{_I}, c AS (SELECT variant, language, count(*) AS c FROM items GROUP BY ALL) SELECT variant, string_agg(language || '=' || c, ',' ORDER BY language) AS counts FROM c GROUP BY variant"),
    "first_groups": (first_groups, f"{_I} SELECT trap, n, correct, round(correct / n, 6) AS accuracy FROM (SELECT trap, min(event_id) AS first, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct FROM items WHERE variant = 'error' GROUP BY trap ORDER BY first LIMIT 15)"),
    "significance": (significance, f"""{_I}, c AS (SELECT count(*) FILTER (WHERE variant = 'view') AS n_view, count(*) FILTER (WHERE variant = 'view' AND is_correct) AS c_view, count(*) FILTER (WHERE variant = 'error') AS n_error, count(*) FILTER (WHERE variant = 'error' AND is_correct) AS c_error FROM items),
      p AS (SELECT *, (c_view + c_error) / (n_view + n_error) AS pool FROM c), z AS (SELECT *, (c_view / n_view - c_error / n_error) / sqrt(pool * (1 - pool) * (1 / n_view + 1 / n_error)) AS z FROM p), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
      v AS (SELECT *, 2 * exp(-z * z / 2) * ({_P}) / sqrt(2 * pi()) AS p FROM t) SELECT n_view, c_view, n_error, c_error, round(p, 6) AS p_value, p < 0.05 AS significant FROM v"""),
    "exact_tests": (exact_tests, f"""{_I}, c AS (SELECT variant, count(*) FILTER (WHERE is_correct) AS c, count(*) FILTER (WHERE NOT is_correct) AS d FROM items GROUP BY variant), t AS (SELECT x.variant, v.c AS a, v.d AS b, x.c, x.d FROM c x, c v WHERE v.variant = 'view' AND x.variant <> 'view'),
      s AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM t), l AS (SELECT variant, a, x, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS p FROM s),
      o AS (SELECT *, max(p) FILTER (WHERE x = a) OVER (PARTITION BY variant) AS here FROM l) SELECT variant, round(least(1, sum(exp(p)) FILTER (WHERE p <= here + 1e-7)), 6) AS p_value FROM o GROUP BY variant"""),
    "hypothesis_verdict": (hypothesis_verdict, f"{_S}, r AS (SELECT variant, round(accuracy, 6) AS a, round(off_target_rate, 6) AS o, round(avg_switches, 6) AS s FROM s) SELECT x.a - y.a >= 0.15 AS h1, y.s >= 2 * x.s AS h2, y.o - x.o >= 0.10 AS h3, round(100 * (x.a - y.a), 2) AS drop_pp FROM r x, r y WHERE x.variant = 'view' AND y.variant = 'error'"),
    "latest_runs": (latest_runs, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
    "latency_gate": (latency_gate, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((value > 80 OR user_id % 5 = 0)::int), 6) AS gate_rate FROM events GROUP BY event_type"),
    "event_islands": (islands, "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS run FROM g) SELECT user_id, run, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL"),
}
