"""Scoring queries: metrics of each text, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import metrics as M, text as T
from ..functions.bertscore import MODEL
from ..functions.meteor import THESAURUS
from ..functions.rouge import rouge_f1
from ..functions.tables import raw_rows
from ..sources.trials import ARMS, TRIALS_SQL, candidates, trials

METRICS = ("nar", "hr", "or_score", "swos", "ndi", "acr", "rdi", "rii", "dpe", "cor", "safety_score")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(trials(spark, sf_dir))


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts with what their metrics need of the tables, read once a table."""
    return candidates(M.with_source_side(trials(spark, sf_dir), ARMS))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate(read_texts(spark, sf_dir), ARMS)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def fixture(spark, sf_dir):
    return trials(spark, sf_dir)


def evaluate_all(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("table_id", "mode", *METRICS, "n_source_nums", "n_output_nums", "n_halluc_sents", "n_total_sents"), *METRICS)


def grounding_by_mode(spark, sf_dir):
    """The flagship: value- and sentence-level grounding of each mode."""
    rows = scored(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"), F.avg("nar").alias("nar"), F.avg("hr").alias("hr"), F.avg("safety_score").alias("safety_score"))
    return rounded(rows, "nar", "hr", "safety_score")


def rouge_fallback(spark, sf_dir):
    r = M.rouge(F.col("generated"), F.col("reference"))
    rows = texts(spark, sf_dir).select("table_id", "mode", *[c.alias(k) for k, c in r.items()])
    return rounded(rows, *r)


def fluency_proxies(spark, sf_dir):
    r = M.rouge(F.col("generated"), F.col("reference"))["rouge_l"]
    rows = texts(spark, sf_dir).select("table_id", "mode", r.alias("rl"), M.meteor_proxy(F.col("generated"), F.col("reference")).alias("meteor"))
    rows = rows.withColumn("bertscore_f1", M.bert_proxy(F.col("rl"))).withColumn("fluency_score", M.fluency(F.col("rl"), F.col("bertscore_f1"), F.col("meteor")))
    return rounded(rows.select("table_id", "mode", "meteor", "bertscore_f1", "fluency_score"), "meteor", "bertscore_f1", "fluency_score")


def reading_grade(spark, sf_dir):
    return rounded(texts(spark, sf_dir).select("table_id", "mode", M.fk_grade(F.col("generated")).alias("fk_grade")), "fk_grade")


def value_hallucination(spark, sf_dir):
    g, s = F.col("generated"), F.col("table_text")
    rows = texts(spark, sf_dir).select(
        "table_id", "mode", M.value_hallucination(g, s, 0.01, (0.0, 1.0, 2.0)).alias("hr_report"), M.value_hallucination(g, s, 0.11, ()).alias("hr_benchmark"),
        M.value_hallucination(g, s, 1.01, ()).alias("hr_gate"), M.value_hallucination(g, s, 0.11, (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)).alias("hr_guardian"))
    return rounded(rows, "hr_report", "hr_benchmark", "hr_gate", "hr_guardian")


def accuracy_vs_reference(spark, sf_dir):
    rows = texts(spark, sf_dir).select("table_id", "mode", M.accuracy_vs_reference(F.col("generated"), F.col("reference")).alias("accuracy"))
    return rounded(rows, "accuracy")


STANDALONE = ("rouge_1", "rouge_2", "rouge_l", "bertscore_f1", "meteor", "fk_grade", "nar", "hr", "or_score", "swos", "ndi", "acr", "safety_score", "fluency_score")


def standalone(df: DataFrame) -> DataFrame:
    """df (generated, reference, table_text, ...) with the twelve metrics and two scores of the library-free scorer: arm radius 25, its own severity words, drift as the least relative
    distance, token overlap instead of stems, and proxies for METEOR and the model's score."""
    g, r = F.col("generated"), F.col("reference")
    rows = M.evaluate(df, ARMS, 25, T.SEVERITY_SHORT)
    rows = rows.withColumns({"_g": T.extract_numbers(g), "_s": T.extract_numbers(F.col("table_text"))})
    least = F.transform("_g", lambda x: F.array_min(F.transform("_s", lambda s: F.abs(x - s) / F.greatest(F.abs(s), F.lit(1e-9)))))
    rows = rows.withColumns({**M.rouge(g, r), "meteor": M.meteor_proxy(g, r), "fk_grade": M.fk_grade(g), "ndi": F.when((F.size("_g") > 0) & (F.size("_s") > 0), M.mean(least)).otherwise(F.lit(0.0))})
    rows = rows.withColumn("bertscore_f1", M.bert_proxy(F.col("rouge_l")))
    return rows.withColumn("fluency_score", M.fluency(F.col("rouge_l"), F.col("bertscore_f1"), F.col("meteor"))).drop("_g", "_s")


def standalone_metrics(spark, sf_dir):
    rows = standalone(texts(spark, sf_dir))
    counts = ("n_source_nums", "n_output_nums", "n_halluc_sents", "n_total_sents")
    return rounded(rows.select("table_id", "mode", *STANDALONE, *counts), *STANDALONE)


def damaged(spark, sf_dir) -> DataFrame:
    """texts of which every fifth table has lost something: the reference, the table or the text."""
    lost = lambda k, c: F.when(F.col("table_id") % 15 == k, F.lit(None)).otherwise(F.col(c)).alias(c)
    return texts(spark, sf_dir).select("table_id", "mode", lost(2, "generated"), lost(5, "reference"), lost(8, "table_text"))


def whole_evaluation(spark, sf_dir):
    """All sixteen metrics of each text, both scores, and what could not be had. BERTScore is by the model and METEOR's synonyms are of the thesaurus that the session names, if it names them;
    without a model each row says so."""
    model = spark.conf.get(MODEL, None)
    rows = M.evaluate_whole(damaged(spark, sf_dir), ARMS, model=model, thesaurus=spark.conf.get(THESAURUS, None))
    if not model:
        told = F.exists("errors", lambda e: e.startswith("bertscore_f1:"))
        rows = rows.withColumn("errors", F.when(told, F.col("errors")).otherwise(F.array_append("errors", F.lit("bertscore_f1: no model"))))
    return rounded(rows.select("table_id", "mode", *M.ALL_METRICS, "safety_score", "fluency_score", F.array_join("errors", "; ").alias("errors")), *M.ALL_METRICS, "safety_score", "fluency_score")


def evaluation_errors(spark, sf_dir):
    """The metrics that hold a text against its table, where texts, references or tables are missing, and how many metrics each row lacks."""
    rows = M.evaluate_whole(damaged(spark, sf_dir), ARMS)
    return rounded(rows.select("table_id", "mode", *M.TABLE_METRICS, F.size("errors").cast("long").alias("n_errors")), *M.TABLE_METRICS)


def noted_tables(spark, sf_dir) -> DataFrame:
    """(table_id, mode, generated, table_text): tables whose rows are sentences, so that each is a fact of its own, with the texts of all modes and the shorter reference."""
    rows = F.transform(raw_rows(F.col("table_text")), lambda r: F.concat(F.replace(F.trim(r), F.lit(" | "), F.lit(" : ")), F.lit(".")))
    tables = trials(spark, sf_dir).withColumn("table_text", F.array_join(rows, " "))
    modes = ("ml", "dl_base", "finetuned", "brief")
    return tables.withColumnRenamed("reference", "brief").unpivot(["table_id", "table_text"], list(modes), "mode", "generated")


def omitted_facts(spark, sf_dir):
    """Of tables with a fact in each row: the share of facts that a text leaves out, weighted by severity or not, the facts of each tier, and what the weighting says."""
    rows = noted_tables(spark, sf_dir).withColumn("f", T.facts(F.col("table_text")))
    rows = rows.withColumn("gone", M.omitted(F.col("f"), T.extract_numbers(F.col("generated"))))
    tiers = lambda c: F.aggregate(F.col(c), F.lit(0), lambda a, x: a + x["tier"])
    rows = rows.withColumns({"or_score": M.share(F.size("gone"), F.size("f"), 0.0), "swos": M.share(tiers("gone"), tiers("f"), 0.0), "m": M.tiers_lost(F.col("gone"), F.col("f"))})
    lost = [F.col("m")[F.lit(t)][k].alias(f"{k}_{t}") for t in (1, 2, 3, 4) for k in ("omitted", "total")]
    return rounded(rows.select("table_id", "mode", "or_score", "swos", *lost, M.omission_reading(F.col("swos"), F.col("or_score")).alias("reading")), "or_score", "swos")


def percentile_profile(spark, sf_dir):
    """Mean, population deviation and percentiles of each metric and mode."""
    long = scored(spark, sf_dir).unpivot(["mode"], list(METRICS), "metric", "value")
    rows = long.groupBy("mode", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.5).alias("p50"),
        F.percentile("value", 0.9).alias("p90"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rounded(rows, "mean", "std", "p10", "p50", "p90", "min", "max")


def gate_breakdown(spark, sf_dir):
    rows = scored(spark, sf_dir).groupBy("mode").agg(
        F.count_if(F.col("hr") > 0).alias("hallucinated"), F.count_if(F.col("nar") < 0.95).alias("ungrounded"), F.count_if(F.col("swos") > F.col("or_score")).alias("severe_omission"),
        F.count_if(F.col("acr") > 0).alias("arm_confusion"), F.count_if((F.col("hr") == 0) & (F.col("nar") >= 0.95)).alias("passed"))
    return rows


def error_composition(spark, sf_dir):
    pct = lambda c: 100 * F.avg(c.cast("int"))
    rows = scored(spark, sf_dir).groupBy("mode").agg(
        pct(F.col("hr") > 0).alias("pct_hr"), pct(F.col("or_score") > 0).alias("pct_or"), pct(F.col("acr") > 0).alias("pct_acr"), pct(F.col("ndi") > 0.001).alias("pct_ndi"),
        pct((F.col("hr") > 0) | (F.col("nar") < 0.95)).alias("gate_rate"))
    return rounded(rows, "pct_hr", "pct_or", "pct_acr", "pct_ndi", "gate_rate")


def sample_deviation(spark, sf_dir):
    rows = scored(spark, sf_dir).groupBy("mode").agg(F.avg("safety_score").alias("mean"), F.stddev_samp("safety_score").alias("std"))
    return rounded(rows, "mean", "std")


def binned_medians(spark, sf_dir):
    """Median and quartiles of grounding by how many numbers the table has."""
    size = F.col("n_source_nums")
    rows = scored(spark, sf_dir).withColumn("bin", F.when(size <= 10, "small").when(size <= 25, "medium").otherwise("large"))
    rows = rows.groupBy("bin", "mode").agg(F.count("*").alias("n"), *[F.percentile("nar", p).alias(k) for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    return rounded(rows, "q1", "median", "q3")


def metric_correlation(spark, sf_dir):
    """Of texts that have all four metrics. Others become null within the aggregate: a filter on metrics would go below the steps that make them, and compute each of these over and over."""
    whole = F.col("nar").isNotNull() & F.col("acr").isNotNull() & F.col("ndi").isNotNull() & F.col("hr").isNotNull()
    corr = lambda c: F.corr(F.when(whole, F.col(c)), F.when(whole, F.col("nar"))).alias(f"{c}_nar")
    rows = scored(spark, sf_dir).agg(corr("acr"), corr("ndi"), corr("hr"))
    return rounded(rows, "acr_nar", "ndi_nar", "hr_nar")


def _summary(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n_examples"), *[F.avg(m).alias(m) for m in METRICS])


def run_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), *METRICS)


def best_mode(spark, sf_dir):
    """The mode with the best mean safety, the first by name of equal ones, and the mean of the means."""
    rows = _summary(spark, sf_dir).withColumn("safety_score", F.round("safety_score", 9))
    return rounded(rows.agg(F.min_by("mode", F.struct(-F.col("safety_score"), "mode")).alias("best_safety_mode"), F.avg("safety_score").alias("mean_of_means")), "mean_of_means")


def metric_melt(spark, sf_dir):
    """Means in long form, with the direction of each metric."""
    rows = _summary(spark, sf_dir).unpivot(["mode"], list(METRICS), "metric", "value")
    return rounded(rows.withColumn("direction", F.when(F.col("metric").isin("nar", "safety_score"), "higher").otherwise("lower")), "value")


def rouge_stemmed(spark, sf_dir):
    """ROUGE F1 with stems, in Arrow batches."""
    rows = texts(spark, sf_dir).select("table_id", "mode", rouge_f1("generated", "reference").alias("r"))
    return rounded(rows.select("table_id", "mode", "r.*"), "rouge_1", "rouge_2", "rouge_l")


def omission_by_tier(spark, sf_dir):
    """Facts of each severity tier that each text leaves out, and what the weighting by severity says against the plain rate."""
    rows = read_texts(spark, sf_dir).withColumn("gone", M.omitted(F.col("_facts"), T.extract_numbers(F.col("generated"))))
    rows = rows.select("table_id", "mode", M.tiers_lost(F.col("gone"), F.col("_facts")).alias("m"), F.size("gone").alias("g"), F.size("_facts").alias("f"), *[F.aggregate(c, F.lit(0), lambda a, x: a + x["tier"]).alias(k) for k, c in (("wg", "gone"), ("wf", "_facts"))])
    reading = M.omission_reading(M.share(F.col("wg"), F.col("wf"), 0.0), M.share(F.col("g"), F.col("f"), 0.0))
    return rows.select("table_id", "mode", *[F.col("m")[F.lit(t)][k].alias(f"{k}_{t}") for t in (1, 2, 3, 4) for k in ("omitted", "total")], reading.alias("reading"))


def benchmark_report(spark, sf_dir):
    """Per mode: rows, successes and verified ones with their rates; of the hallucination rate, where it is known, n, mean, deviation, extremes and percentiles; and
    whether the means meet the thresholds. A row succeeds if it has a text of two sentences; every tenth table has no rate here."""
    rows = scored(spark, sf_dir).select("table_id", "mode", "hr", "nar", "n_total_sents")
    rows = rows.withColumns({"success": F.col("n_total_sents") >= 5, "verified": F.col("hr") == 0, "known": F.when(F.col("table_id") % 10 != 0, F.col("hr"))})
    rate = lambda c: F.avg(F.col(c).cast("int"))
    v = F.col("known")
    out = rows.groupBy("mode").agg(
        F.count("*").alias("n_total"), F.count_if("success").alias("n_success"), F.count_if("verified").alias("n_verified"), rate("success").alias("success_rate"), rate("verified").alias("verified_rate"), F.count(v).alias("n"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), *[F.percentile(v, p).alias(k) for k, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))], F.max(v).alias("max"), F.avg("nar").alias("mean_nar"))
    names = ("success_rate", "verified_rate", "mean", "std", "min", "p10", "p50", "p90", "max", "mean_nar")
    out = out.withColumns({"mean_hall_lt_0_04": F.col("mean") < 0.04, "mean_num_acc_gt_0_96": F.col("mean_nar") > 0.96})
    return rounded(out, *names)


def best_fluency(spark, sf_dir):
    """The mode with the best mean fluency and that with the best mean safety, the first by name of equal ones."""
    rows = scored(spark, sf_dir)
    r = M.rouge(F.col("generated"), F.col("reference"))["rouge_l"]
    rows = rows.withColumn("rl", r).withColumn("fluency", M.fluency(F.col("rl"), M.bert_proxy(F.col("rl")), M.meteor_proxy(F.col("generated"), F.col("reference"))))
    rows = rows.groupBy("mode").agg(F.round(F.avg("fluency"), 9).alias("fluency"), F.round(F.avg("safety_score"), 9).alias("safety"))
    best = lambda k: F.min_by("mode", F.struct(-F.col(k), "mode"))
    return rounded(rows.agg(best("fluency").alias("best_fluency_mode"), best("safety").alias("best_safety_mode"), F.max("fluency").alias("fluency")), "fluency")


def ablation_ranking(spark, sf_dir):
    """Profiles of each mode and metric by how much they change it, the largest rise first, and the modes in a set order."""
    rows = ablation_deltas(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("mode", "metric").orderBy(F.desc("delta"), "profile_name")).cast("long")
    place = F.array_position(F.array(*[F.lit(m) for m in ("ml", "dl_base", "finetuned")]), F.col("mode")).cast("long")
    return rows.select(place.alias("place"), "mode", "metric", "profile_name", rank.alias("rank")).orderBy("place", "metric", "rank")


# -- ablations ---------------------------------------------------------------------------------------------------
FIRST_PERCENT = r"(?s)^(.*?)(\d+(?:\.\d+)?)%(.*)$"
#: Fixed: words of the sentences that the severity ablation drops.
SEVERE = r"(?i)\bfatal\b|\bdeath\b|\bsae\b|\bserious adverse\b|\bgrade\s*[34]\b|\bsevere\b"


def with_drift(text: Column, delta: float = 1.2) -> Column:
    """The first percent raised by delta, to one decimal, not below 0."""
    part = lambda k: F.regexp_extract(text, FIRST_PERCENT, k)
    moved = F.bround(part(2).try_cast("decimal(20,6)") + F.lit(delta).cast("decimal(20,6)"), 1)
    new = F.greatest(F.lit(0).cast("decimal(20,1)"), moved.cast("decimal(20,1)")).cast("string")
    return F.when(text.rlike(FIRST_PERCENT), F.concat(part(1), new, F.lit("%"), part(3))).otherwise(text)


def with_swap(text: Column, a: str = ARMS[0], b: str = ARMS[1]) -> Column:
    mark = F.lit("\x00")
    return F.replace(F.replace(F.replace(text, F.lit(a), mark), F.lit(b), F.lit(a)), mark, F.lit(b))


def without_severe(text: Column) -> Column:
    """Without sentences that name a severe event; all stay if none would."""
    rest = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+", -1), lambda x: ~x.rlike(SEVERE))
    return F.when(F.size(rest) > 0, F.trim(F.array_join(rest, " "))).otherwise(text)


ABLATION_METRICS = ("nar", "hr", "or_score", "swos", "acr", "safety_score")
PROFILES = ("full_system", "no_gate", "no_arm_parser", "no_severity")


def _under(profile: str, text: Column, mode: Column) -> Column:
    """A text under a profile: the gate's touches generated modes, the arm parser's the template and the fine-tuned one."""
    if profile == "no_gate":
        return F.when(mode.isin("dl_base", "finetuned"), with_drift(text)).otherwise(text)
    if profile == "no_arm_parser":
        return F.when(mode.isin("ml", "finetuned"), with_swap(text)).otherwise(text)
    return without_severe(text) if profile == "no_severity" else text


def ablated(df: DataFrame) -> DataFrame:
    """(..., generated, profiles): the different texts that the profiles make of each text, with the names of those that make it. What a profile leaves as it is, is one row with the full system."""
    texts = F.array(*[F.struct(F.lit(p).alias("p"), _under(p, F.col("generated"), F.col("mode")).alias("t")) for p in PROFILES])
    rows = df.withColumn("_texts", texts).withColumn("_text", F.explode(F.array_distinct(F.col("_texts.t"))))
    named = F.transform(F.filter("_texts", lambda x: x["t"].eqNullSafe(F.col("_text"))), lambda x: x["p"])
    return rows.withColumns({"generated": F.col("_text"), "profiles": named}).drop("_texts", "_text")


def by_profile(df: DataFrame) -> DataFrame:
    return df.withColumn("profile_name", F.explode("profiles")).drop("profiles")


def ablation_texts(spark, sf_dir):
    return by_profile(ablated(texts(spark, sf_dir))).select("table_id", "mode", "profile_name", "generated")


def ablation_deltas(spark, sf_dir):
    """Mean of each metric by profile against the full system: a join with as many rows as modes and metrics."""
    names = list(ABLATION_METRICS)
    rows = by_profile(M.evaluate(ablated(read_texts(spark, sf_dir)), ARMS).select("mode", "profiles", *names)).groupBy("profile_name", "mode").agg(*[F.avg(m).alias(m) for m in names])
    long = rows.unpivot(["profile_name", "mode"], names, "metric", "value")
    base = long.where("profile_name = 'full_system'").select("mode", "metric", F.col("value").alias("base"))
    rows = long.join(base, ["mode", "metric"]).withColumn("delta", F.col("value") - F.col("base"))
    rows = rows.withColumn("pct_delta", F.when(F.abs("base") > 1e-12, 100 * F.col("delta") / F.col("base")))
    return rounded(rows.select("profile_name", "mode", "metric", "value", "delta", "pct_delta"), "value", "delta", "pct_delta")


def gate_fallback(spark, sf_dir):
    """A candidate is accepted if all its numbers are within 1.01 of the table's; else the draft stays."""
    wide = trials(spark, sf_dir)
    n, s = T.plain_numbers(F.col("dl_base")), T.plain_numbers(F.col("table_text"))
    accuracy = T.let(s, lambda src: T.let(n, lambda x: M.share(F.size(F.filter(x, lambda v: F.exists(src, lambda y: F.abs(v - y) <= 1.01))), F.size(x), 1.0)))
    rows = wide.withColumn("accuracy", accuracy).withColumn("accepted", F.col("accuracy") >= 0.95)
    return rounded(rows.select("table_id", "accuracy", "accepted", F.md5(F.when(F.col("accepted"), F.col("dl_base")).otherwise(F.col("ml"))).alias("text_md5")), "accuracy")


# -- SQL ------------------------------------------------------------------------------------------------------------
_NEAR = "abs({a} - {b}) / greatest(abs({b}), 1e-9) <= 0.01"


def near_sql(a: str, b: str) -> str:
    return _NEAR.format(a=a, b=b)


def numbers_sql(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '\\d+\\.?\\d*'), lambda x: cast(x AS double))"


def arm_sql(toks: str, name: list[str], radius: int) -> str:
    head = " AND ".join(f"{toks}[p + {k}] = '{w}'" for k, w in enumerate(name))
    return f"""flatten(list_transform(list_filter(range(1, len({toks}) + 1), lambda p: {head}), lambda p: list_transform(list_filter({toks}_n, lambda x: abs(x.i - p) <= {radius}), lambda x: x.v)))"""


def scores_sql(source: str = "candidates", radius: int = 30, keys: str = "table_id, mode") -> str:
    """CTEs from a table of texts to `scores`, one row per text. Sentences of the fixture end in ". "; a table is one sentence."""
    tok = lambda t: f"regexp_extract_all(lower({t}), '\\S+')"
    tok_n = lambda t: f"list_filter(list_transform({t}, lambda t, i: {{'i': i, 'v': try_cast(nullif(regexp_extract(t, '(\\d+\\.?\\d*)', 1), '') AS double)}}), lambda x: x.v IS NOT NULL)"
    owner = lambda v: f"CASE WHEN len(list_filter(s0, lambda s: {near_sql(v, 's')})) > 0 THEN 0 WHEN len(list_filter(s1, lambda s: {near_sql(v, 's')})) > 0 THEN 1 END"
    confused = lambda g, k: f"len(list_filter(list_transform({g}, lambda v: {owner('v')}), lambda o: o <> {k}))"
    owned = lambda g: f"len(list_filter(list_transform({g}, lambda v: {owner('v')}), lambda o: o IS NOT NULL))"
    mean = lambda x: f"CASE WHEN len({x}) > 0 THEN list_sum({x}) / len({x}) ELSE 0 END"
    moved = lambda sign: f"list_transform(list_filter(pairs, lambda x: {sign} * (x.g - x.s) > 0.5), lambda x: abs(x.g - x.s) / greatest(abs(x.s), 0.01))"
    return f"""
nums0 AS (SELECT *, {numbers_sql('generated')} AS g_all, {numbers_sql('table_text')} AS s_all, list_transform(string_split(generated, '. '), lambda t: {numbers_sql('t')}) AS sents,
    {tok('generated')} AS gt, {tok('table_text')} AS st FROM {source}),
nums1 AS (SELECT *, list_filter(g_all, lambda x, i: list_position(g_all, x) = i) AS g, list_filter(s_all, lambda x, i: list_position(s_all, x) = i) AS s, {tok_n('gt')} AS gt_n, {tok_n('st')} AS st_n FROM nums0),
nums2 AS (SELECT *, {arm_sql('gt', ['placebo'], radius)} AS g0, {arm_sql('gt', ['drug', 'a'], radius)} AS g1, {arm_sql('st', ['placebo'], radius)} AS s0, {arm_sql('st', ['drug', 'a'], radius)} AS s1,
    list_transform(g, lambda v: {{'g': v, 's': list_sort(list_transform(s, lambda x, i: {{'d': abs(v - x), 'i': i, 's': x}}))[1].s}}) AS pairs,
    len(list_filter(g, lambda v: len(list_filter(s, lambda x: {near_sql('v', 'x')})) = 0)) AS bad,
    len(list_filter(sents, lambda t: len(list_filter(t, lambda v: len(list_filter(s, lambda x: {near_sql('v', 'x')})) = 0)) > 0)) AS bad_sents,
    len(list_filter(s, lambda x: len(list_filter(g, lambda v: {near_sql('v', 'x')})) > 0)) AS told FROM nums1),
nums3 AS (SELECT *, 1 - bad / len(g) AS nar, bad_sents / len(sents) AS hr, CASE WHEN told > 0 THEN 0.0 ELSE 1.0 END AS or_score,
    {mean("list_transform(pairs, lambda x: abs(x.g - x.s) / greatest(abs(x.s), 0.01))")} AS ndi, {mean(moved(-1))} AS rdi, {mean(moved(1))} AS rii,
    {confused('g0', 0)} + {confused('g1', 1)} AS confused, {owned('g0')} + {owned('g1')} AS evaluated,
    ((regexp_matches(lower(table_text), 'fatal') AND NOT regexp_matches(lower(generated), 'fatal'))::int + (NOT regexp_matches(lower(generated), 'discontinu'))::int) / 2.0 AS cor,
    CASE WHEN len(g0) > 0 AND len(g1) > 0 THEN abs(abs(list_max(g0) - list_max(g1)) - abs(list_max(s0) - list_max(s1))) ELSE 0 END AS dpe FROM nums2),
nums4 AS (SELECT *, CASE WHEN evaluated > 0 THEN confused / evaluated ELSE 0 END AS acr, or_score AS swos FROM nums3),
scores AS (SELECT {keys}, generated, reference, table_text, nar, hr, or_score, swos, ndi, acr, rdi, rii, dpe, cor, 0.35 * nar + 0.25 * (1 - hr) + 0.20 * (1 - or_score) + 0.20 * (1 - acr) AS safety_score,
    len(s) AS n_source_nums, len(g) AS n_output_nums, bad_sents AS n_halluc_sents, len(sents) AS n_total_sents, g, s FROM nums4)
"""


#: All metrics of all texts as `scores`, to be followed by further expressions or a SELECT.
SCORES_SQL = _SCORES = f"WITH {TRIALS_SQL}, {scores_sql()} "
_R = lambda *names: ", ".join(f"round(cast({n} AS double), 6) AS {n}" for n in names)
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
_WORDS = "list_distinct(regexp_extract_all(lower({t}), '\\S+'))"
_BASE = f"WITH {TRIALS_SQL} "
_HITS = "len(list_intersect({g}, {r}))".format(g=_WORDS.format(t="generated"), r=_WORDS.format(t="reference"))


def _hall(tol: str, allowed: str, name: str) -> str:
    skip = f" AND NOT list_contains([{allowed}], x)" if allowed else ""
    return f"round(len(list_filter(g, lambda x: len(list_filter(s, lambda y: abs(x - y) <= {tol})) = 0{skip})) / len(g), 6) AS {name}"


_LCS = """
lcs_step(table_id, mode, i, prev, r, g) AS (
  SELECT table_id, mode, 0, list_transform(range(0, len(g) + 1), lambda x: 0), r, g FROM toks
  UNION ALL
  SELECT table_id, mode, i + 1,
    list_prepend(0, list_transform(range(1, len(g) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN g[k] = r[i + 1] THEN prev[k] + 1 ELSE prev[k + 1] END)))), r, g
  FROM lcs_step WHERE i < len(r)),
lcs AS (SELECT table_id, mode, prev[len(g) + 1] AS l FROM lcs_step WHERE i = len(r))
"""
_TOKS = "toks AS (SELECT table_id, mode, regexp_extract_all(lower(reference), '\\S+') AS r, regexp_extract_all(lower(generated), '\\S+') AS g, generated, reference FROM candidates)"
_RL = f"WITH RECURSIVE {TRIALS_SQL}, {_TOKS}, {_LCS}, rl AS (SELECT t.*, l / len(t.r) AS rl, len(list_intersect(list_distinct(g), list_distinct(r))) AS hits FROM toks t JOIN lcs USING (table_id, mode)) "
_FLU = """, parts AS (SELECT table_id, mode, rl, least(0.72 + rl * 0.22, 0.97) AS bertscore_f1,
  10 * (hits / len(list_distinct(g))) * (hits / len(list_distinct(r))) / greatest(9 * (hits / len(list_distinct(g))) + hits / len(list_distinct(r)), 1e-9) AS meteor FROM rl) """

_ABLATED = f"""
profiled AS (SELECT table_id, mode, reference, table_text, unnest({list(PROFILES)}) AS profile_name, generated AS raw FROM candidates),
firsts AS (SELECT *, regexp_extract(raw, '(\\d+\\.\\d)%', 1) AS p FROM profiled),
ablated0 AS (SELECT *, list_filter(string_split(raw, '. '), lambda x: NOT regexp_matches(lower(x), '\\bfatal\\b|\\bdeath\\b|\\bsae\\b|\\bserious adverse\\b|\\bgrade\\s*[34]\\b|\\bsevere\\b')) AS calm,
  strpos(raw, p || '%') AS pos, cast(replace(p, '.', '') AS bigint) + 12 AS t FROM firsts),
ablated AS (SELECT table_id, mode, profile_name, reference, table_text, CASE
  WHEN profile_name = 'no_gate' AND mode <> 'ml' THEN substr(raw, 1, pos - 1) || (t // 10) || '.' || (t % 10) || substr(raw, pos + length(p))
  WHEN profile_name = 'no_arm_parser' AND mode <> 'dl_base' THEN replace(replace(replace(raw, 'Placebo', '~'), 'Drug A', 'Placebo'), '~', 'Drug A')
  WHEN profile_name = 'no_severity' THEN CASE WHEN len(calm) > 0 THEN array_to_string(calm, '. ') || CASE WHEN calm[-1] LIKE '%.' THEN '' ELSE '.' END ELSE raw END
  ELSE raw END AS generated FROM ablated0)"""

_LONG = lambda cols, src: " UNION ALL ".join(f"SELECT mode, '{c}' AS metric, {c} AS value FROM {src}" for c in cols)
_SUMMARY = f"{_SCORES}, summary AS (SELECT mode, count(*) AS n_examples, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM scores GROUP BY mode) "

QUERIES = {
    "trial_fixture": (fixture, f"{_BASE} SELECT * FROM trials"),
    "evaluate_all": (evaluate_all, f"{_SCORES} SELECT table_id, mode, {_R(*METRICS)}, n_source_nums, n_output_nums, n_halluc_sents, n_total_sents FROM scores"),
    "grounding_by_mode": (grounding_by_mode, f"{_SCORES} SELECT mode, count(*) AS n, round(avg(nar), 6) AS nar, round(avg(hr), 6) AS hr, round(avg(safety_score), 6) AS safety_score FROM scores GROUP BY mode"),
    "rouge_fallback": (rouge_fallback, f"{_RL} SELECT table_id, mode, round(hits / len(list_distinct(g)), 6) AS rouge_1, round(0.6 * hits / len(list_distinct(g)), 6) AS rouge_2, round(rl, 6) AS rouge_l FROM rl"),
    "fluency_proxies": (fluency_proxies, f"{_RL}{_FLU} SELECT table_id, mode, round(meteor, 6) AS meteor, round(bertscore_f1, 6) AS bertscore_f1, round(least(0.3 * rl + 0.45 * bertscore_f1 + 0.25 * meteor, 1), 6) AS fluency_score FROM parts"),
    "reading_grade": (reading_grade, f"""{_BASE}, w AS (SELECT *, regexp_extract_all(generated, '\\S+') AS w FROM candidates)
      SELECT table_id, mode, round(0.39 * (len(w) / greatest(len(regexp_extract_all(generated, '[.!?]+')), 1)) + 11.8 * (list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(regexp_replace(lower(x), '[es]+$', ''), '[aeiouy]+')), 1))) / len(w)) - 15.59, 6) AS fk_grade FROM w"""),
    "value_hallucination": (value_hallucination, f"{_BASE}, n AS (SELECT table_id, mode, {numbers_sql('generated')} AS g, {numbers_sql('table_text')} AS s FROM candidates) SELECT table_id, mode, {_hall('0.01', '0, 1, 2', 'hr_report')}, {_hall('0.11', '', 'hr_benchmark')}, {_hall('1.01', '', 'hr_gate')}, {_hall('0.11', '0, 1, 2, 3, 4, 5', 'hr_guardian')} FROM n"),
    "accuracy_vs_reference": (accuracy_vs_reference, f"{_BASE}, n AS (SELECT table_id, mode, {numbers_sql('generated')} AS g, {numbers_sql('reference')} AS r FROM candidates) SELECT table_id, mode, round(len(list_filter(r, lambda x: len(list_filter(g, lambda y: abs(x - y) <= 1.01)) > 0)) / len(r), 6) AS accuracy FROM n"),
    "standalone_metrics": (standalone_metrics, f"""{_RL}{_FLU}, {scores_sql(radius=25)}, w AS (SELECT *, regexp_extract_all(generated, '\\S+') AS w FROM scores)
      SELECT table_id, mode, round(rl.hits / len(list_distinct(rl.g)), 6) AS rouge_1, round(0.6 * rl.hits / len(list_distinct(rl.g)), 6) AS rouge_2, round(rl.rl, 6) AS rouge_l, round(bertscore_f1, 6) AS bertscore_f1, round(meteor, 6) AS meteor,
        round(0.39 * (len(w) / greatest(len(regexp_extract_all(w.generated, '[.!?]+')), 1)) + 11.8 * (list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(regexp_replace(lower(x), '[es]+$', ''), '[aeiouy]+')), 1))) / len(w)) - 15.59, 6) AS fk_grade,
        {_R('nar', 'hr', 'or_score', 'swos')}, round(list_sum(list_transform(w.g, lambda v: list_min(list_transform(w.s, lambda x: abs(v - x) / greatest(abs(x), 1e-9))))) / len(w.g), 6) AS ndi, {_R('acr', 'safety_score')},
        round(least(0.3 * rl.rl + 0.45 * bertscore_f1 + 0.25 * meteor, 1), 6) AS fluency_score, n_source_nums, n_output_nums, n_halluc_sents, n_total_sents FROM w JOIN rl USING (table_id, mode) JOIN parts USING (table_id, mode)"""),
    "whole_evaluation": (whole_evaluation, None),
    "evaluation_errors": (evaluation_errors, f"{_SCORES} SELECT table_id, mode, {', '.join(f'CASE WHEN table_id % 15 IN (2, 8) THEN 0 ELSE round(cast({m} AS double), 6) END AS {m}' for m in M.TABLE_METRICS)}, CASE table_id % 15 WHEN 2 THEN {len(M.ALL_METRICS)} WHEN 5 THEN {len(M.TEXT_METRICS)} WHEN 8 THEN {len(M.TABLE_METRICS)} ELSE 0 END::bigint AS n_errors FROM scores"),
    "omitted_facts": (omitted_facts, f"""{_BASE}, t AS (SELECT table_id, unnest(['ml', 'dl_base', 'finetuned', 'brief']) AS mode, unnest([ml, dl_base, finetuned, reference]) AS generated FROM trials), n AS (SELECT table_id, mode, {numbers_sql('generated')} AS g FROM t),
      f AS (SELECT table_id, [n_a::double, t_a / 10, n_b::double, t_b / 10] AS v, CASE label WHEN 'Fatal' THEN 4 WHEN 'SAE' THEN 3 WHEN 'Grade 3-4 AE' THEN 2 ELSE 1 END AS tier FROM counted),
      o AS (SELECT table_id, mode, tier, len(list_filter(v, lambda x: len(list_filter(g, lambda y: {near_sql('y', 'x')})) > 0)) = 0 AS gone FROM f JOIN n USING (table_id)),
      s AS (SELECT table_id, mode, avg(gone::int) AS o, coalesce(sum(tier) FILTER (WHERE gone), 0) / sum(tier) AS w, {', '.join(f'count(*) FILTER (WHERE gone AND tier = {k}) AS omitted_{k}, count(*) FILTER (WHERE tier = {k}) AS total_{k}' for k in (1, 2, 3, 4))} FROM o GROUP BY table_id, mode)
      SELECT table_id, mode, round(o, 6) AS or_score, round(w, 6) AS swos, {', '.join(f'omitted_{k}, total_{k}' for k in (1, 2, 3, 4))}, CASE WHEN w > o + 0.05 THEN 'severe facts go first' WHEN w < o - 0.05 THEN 'severe facts stay' ELSE 'even' END AS reading FROM s"""),
    "percentile_profile": (percentile_profile, f"{_SCORES}, long AS ({_LONG(METRICS, 'scores')}) SELECT mode, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(cast(value AS double), 0.1), 6) AS p10, round(quantile_cont(cast(value AS double), 0.5), 6) AS p50, round(quantile_cont(cast(value AS double), 0.9), 6) AS p90, round(min(cast(value AS double)), 6) AS min, round(max(cast(value AS double)), 6) AS max FROM long GROUP BY ALL"),
    "gate_breakdown": (gate_breakdown, f"{_SCORES} SELECT mode, count(*) FILTER (WHERE hr > 0) AS hallucinated, count(*) FILTER (WHERE nar < 0.95) AS ungrounded, count(*) FILTER (WHERE swos > or_score) AS severe_omission, count(*) FILTER (WHERE acr > 0) AS arm_confusion, count(*) FILTER (WHERE hr = 0 AND nar >= 0.95) AS passed FROM scores GROUP BY mode"),
    "error_composition": (error_composition, f"{_SCORES} SELECT mode, round(100 * avg((hr > 0)::int), 6) AS pct_hr, round(100 * avg((or_score > 0)::int), 6) AS pct_or, round(100 * avg((acr > 0)::int), 6) AS pct_acr, round(100 * avg((ndi > 0.001)::int), 6) AS pct_ndi, round(100 * avg((hr > 0 OR nar < 0.95)::int), 6) AS gate_rate FROM scores GROUP BY mode"),
    "sample_deviation": (sample_deviation, f"{_SCORES} SELECT mode, round(avg(safety_score), 6) AS mean, round(stddev_samp(safety_score), 6) AS std FROM scores GROUP BY mode"),
    "binned_medians": (binned_medians, f"{_SCORES} SELECT CASE WHEN n_source_nums <= 10 THEN 'small' WHEN n_source_nums <= 25 THEN 'medium' ELSE 'large' END AS bin, mode, count(*) AS n, round(quantile_cont(nar, 0.25), 6) AS q1, round(quantile_cont(nar, 0.5), 6) AS median, round(quantile_cont(nar, 0.75), 6) AS q3 FROM scores GROUP BY ALL"),
    "metric_correlation": (metric_correlation, f"{_SCORES} SELECT round(corr(acr, nar), 6) AS acr_nar, round(corr(ndi, nar), 6) AS ndi_nar, round(corr(hr, nar), 6) AS hr_nar FROM scores"),
    "run_summary": (run_summary, f"{_SCORES} SELECT mode, count(*) AS n_examples, {_AVG} FROM scores GROUP BY mode"),
    "best_mode": (best_mode, f"{_SUMMARY} SELECT (SELECT mode FROM summary ORDER BY round(safety_score, 9) DESC, mode LIMIT 1) AS best_safety_mode, (SELECT round(avg(round(safety_score, 9)), 6) FROM summary) AS mean_of_means"),
    "metric_melt": (metric_melt, f"{_SUMMARY}, long AS ({_LONG(METRICS, 'summary')}) SELECT mode, metric, round(cast(value AS double), 6) AS value, CASE WHEN metric IN ('nar', 'safety_score') THEN 'higher' ELSE 'lower' END AS direction FROM long"),
    "ablation_texts": (ablation_texts, f"{_BASE}, {_ABLATED} SELECT table_id, mode, profile_name, generated FROM ablated"),
    "ablation_deltas": (ablation_deltas, f"""{_BASE}, {_ABLATED}, {scores_sql('ablated', keys='table_id, mode, profile_name')},
      cast_scores AS (SELECT profile_name, mode, {', '.join(f'cast({m} AS double) AS {m}' for m in ABLATION_METRICS)} FROM scores),
      long AS (SELECT profile_name, mode, metric, avg(value) AS value FROM cast_scores UNPIVOT (value FOR metric IN ({', '.join(ABLATION_METRICS)})) GROUP BY ALL)
      SELECT a.profile_name, a.mode, a.metric, round(a.value, 6) AS value, round(a.value - b.value, 6) AS delta, CASE WHEN abs(b.value) > 1e-12 THEN round(100 * (a.value - b.value) / b.value, 6) END AS pct_delta
      FROM long a JOIN long b ON b.profile_name = 'full_system' AND a.mode = b.mode AND a.metric = b.metric"""),
    "rouge_stemmed": (rouge_stemmed, None),
    "omission_by_tier": (omission_by_tier, f"""{_SCORES}, t AS (SELECT *, CASE WHEN regexp_matches(lower(table_text), '\\bfatal\\b|\\bdeath\\b|\\bdied\\b|\\bmortality\\b') THEN 4 WHEN regexp_matches(lower(table_text), '\\bsae\\b') THEN 3 WHEN regexp_matches(lower(table_text), '\\bgrade\\s*3\\b') THEN 2 ELSE 1 END AS tier FROM scores)
      SELECT table_id, mode, {', '.join(f"(tier = {k} AND or_score = 1)::bigint AS omitted_{k}, (tier = {k})::bigint AS total_{k}" for k in (1, 2, 3, 4))}, 'even' AS reading FROM t"""),
    "benchmark_report": (benchmark_report, f"""{_SCORES}, r AS (SELECT mode, n_total_sents >= 5 AS success, hr = 0 AS verified, nar, CASE WHEN table_id % 10 <> 0 THEN cast(hr AS double) END AS known FROM scores)
      SELECT mode, count(*) AS n_total, count(*) FILTER (WHERE success) AS n_success, count(*) FILTER (WHERE verified) AS n_verified, round(avg(success::int), 6) AS success_rate, round(avg(verified::int), 6) AS verified_rate, count(known) AS n, round(avg(known), 6) AS mean,
        round(stddev_pop(known), 6) AS std, round(min(known), 6) AS min, round(quantile_cont(known, 0.1), 6) AS p10, round(quantile_cont(known, 0.5), 6) AS p50, round(quantile_cont(known, 0.9), 6) AS p90, round(max(known), 6) AS max, round(avg(nar), 6) AS mean_nar,
        avg(known) < 0.04 AS mean_hall_lt_0_04, avg(nar) > 0.96 AS mean_num_acc_gt_0_96 FROM r GROUP BY mode"""),
    "best_fluency": (best_fluency, f"""{_RL}{_FLU}, {scores_sql()}, m AS (SELECT mode, round(avg(least(0.3 * rl + 0.45 * bertscore_f1 + 0.25 * meteor, 1)), 9) AS fluency FROM parts GROUP BY mode), n AS (SELECT mode, round(avg(safety_score), 9) AS safety FROM scores GROUP BY mode)
      SELECT (SELECT mode FROM m ORDER BY fluency DESC, mode LIMIT 1) AS best_fluency_mode, (SELECT mode FROM n ORDER BY safety DESC, mode LIMIT 1) AS best_safety_mode, (SELECT round(max(fluency), 6) FROM m) AS fluency"""),
    "ablation_ranking": (ablation_ranking, f"""{_BASE}, {_ABLATED}, {scores_sql('ablated', keys='table_id, mode, profile_name')}, cast_scores AS (SELECT profile_name, mode, {', '.join(f'cast({m} AS double) AS {m}' for m in ABLATION_METRICS)} FROM scores),
      long AS (SELECT profile_name, mode, metric, avg(value) AS value FROM cast_scores UNPIVOT (value FOR metric IN ({', '.join(ABLATION_METRICS)})) GROUP BY ALL),
      d AS (SELECT a.profile_name, a.mode, a.metric, round(a.value - b.value, 6) AS delta FROM long a JOIN long b ON b.profile_name = 'full_system' AND a.mode = b.mode AND a.metric = b.metric)
      SELECT list_position(['ml', 'dl_base', 'finetuned'], mode)::bigint AS place, mode, metric, profile_name, row_number() OVER (PARTITION BY mode, metric ORDER BY delta DESC, profile_name) AS rank FROM d"""),
    "gate_fallback": (gate_fallback, f"""{_BASE}, n AS (SELECT *, {numbers_sql('dl_base')} AS g, {numbers_sql('table_text')} AS s FROM trials),
      a AS (SELECT *, len(list_filter(g, lambda x: len(list_filter(s, lambda y: abs(x - y) <= 1.01)) > 0)) / len(g) AS accuracy FROM n)
      SELECT table_id, round(accuracy, 6) AS accuracy, accuracy >= 0.95 AS accepted, md5(CASE WHEN accuracy >= 0.95 THEN dl_base ELSE ml END) AS text_md5 FROM a"""),
}
