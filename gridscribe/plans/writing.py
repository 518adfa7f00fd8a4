"""Writing queries: narratives, verification, arm attribution, composed summaries, a trained row selector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import cell_value, long_rows, parsed_rows, row_features, selected
from ..operators import voting as V
from ..operators.narratives import PARTS, attribution, narratives, verify
from ..session import cut
from ..sources.trials import TRIALS_SQL, trials
from .scoring import rounded, texts


def written(spark, sf_dir):
    return narratives(trials(spark, sf_dir))


def verified(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumn("v", verify(F.col("generated"), F.col("table_text")))
    return rounded(rows.select("table_id", "mode", F.col("v.accuracy").alias("accuracy"), F.col("v.verified").alias("verified")), "accuracy")


def arm_attribution(spark, sf_dir):
    """Percents of each text that its table has in the other arm's column only, within 0.15."""
    table = long_rows(trials(spark, sf_dir)).groupBy("table_id").agg(F.collect_list(cell_value(F.element_at("cells", 2))["pct"]).alias("a"), F.collect_list(cell_value(F.element_at("cells", 3))["pct"]).alias("b"))
    rows = texts(spark, sf_dir).withColumn("said", attribution(F.col("generated"))).select("table_id", "mode", "said").join(table, "table_id")
    near = lambda col, p: F.exists(col, lambda x: F.abs(x - p) <= 0.15)
    wrong = F.filter("said", lambda s: F.when(s["arm"] == "Placebo", ~near("a", s["pct"]) & near("b", s["pct"])).otherwise(~near("b", s["pct"]) & near("a", s["pct"])))
    return rows.select("table_id", "mode", F.size("said").cast("long").alias("n_said"), F.size(wrong).cast("long").alias("n_wrong"))


def summary_compare(spark, sf_dir):
    """Length and sentences of the three candidates side by side."""
    return texts(spark, sf_dir).groupBy("table_id").pivot("mode", ["dl_base", "finetuned", "ml"]).agg(F.max(F.length("generated").cast("long")))


SELECTOR_FEATURES = ("drug_pct", "ctrl_pct", "abs_risk_diff", "risk_dir", "relative_risk", "drug_pct_rank", "abs_diff_rank", "sae", "severe", "drug_above_5pct", "drug_above_10pct", "diff_above_5pp")


def selector(spark, sf_dir):
    """(model, held-out rows): gradient-boosted trees on the twelve row features against weak labels, with class weights, fitted on four of five tables."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from .curation import mentioned

    rows = row_features(parsed_rows(trials(spark, sf_dir))).withColumns({"sae": F.col("is_sae").cast("int"), "severe": F.col("is_severe").cast("int")})
    rows = rows.withColumn("label_", mentioned(F.col("label"), F.col("reference")).cast("double")).select("table_id", "label", "label_", *SELECTOR_FEATURES)
    rows = cut(rows)  # the fit reads them many times
    data = VectorAssembler(inputCols=list(SELECTOR_FEATURES), outputCol="features").transform(rows)
    fit_on, rest = data.where("table_id % 5 <> 0"), data.where("table_id % 5 = 0")
    share = F.broadcast(fit_on.agg(F.avg("label_").alias("share")))
    fit_on = fit_on.join(share).withColumn("weight", F.when(F.col("label_") > 0, 1 - F.col("share")).otherwise(F.col("share")))
    return GBTClassifier(labelCol="label_", weightCol="weight", maxIter=10, maxDepth=4, seed=42).fit(fit_on), rest


def trained_selector(spark, sf_dir):
    """Scores of the rows that the trees were not fitted on."""
    model, rest = selector(spark, sf_dir)
    return model.transform(rest).select("table_id", "label", F.col("label_").alias("target"), F.element_at(_array("probability"), 2).alias("score"))


def selector_report(spark, sf_dir):
    """Accuracy, precision, recall and F1 of the selector on held-out rows."""
    rows = trained_selector(spark, sf_dir).select((F.col("score") > 0.5).alias("told"), (F.col("target") > 0).alias("wanted"))
    count = lambda c: F.count_if(c).cast("double")
    t, w = F.col("told"), F.col("wanted")
    rows = rows.agg(F.count("*").alias("n"), F.avg((t == w).cast("int")).alias("accuracy"), count(t & w).alias("hit"), count(t).alias("t"), count(w).alias("w"))
    p, r = F.try_divide("hit", "t"), F.try_divide("hit", "w")
    return rows.select("n", "accuracy", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def rule_sweep(spark, sf_dir):
    """The rule score against the weak labels at every threshold."""
    from .curation import mentioned

    rows = selected(row_features(parsed_rows(trials(spark, sf_dir))))
    rows = rows.select("score", mentioned(F.col("label"), F.col("reference")).cast("long").alias("label"))
    return rounded(V.sweep(rows.withColumn("score", F.round("score", 6)), THRESHOLDS), "precision", "recall", "f1")


def rule_precision(spark, sf_dir):
    """Average precision of the rule score against the weak labels."""
    from .curation import mentioned

    rows = selected(row_features(parsed_rows(trials(spark, sf_dir))))
    rows = rows.select(F.lit("rule").alias("model"), F.round("score", 6).alias("score"), mentioned(F.col("label"), F.col("reference")).cast("long").alias("label"))
    return rounded(V.average_precision(rows).select("average_precision"), "average_precision")


def selector_sweep(spark, sf_dir):
    """The trained selector on rows that it was not fitted on, at every threshold."""
    rows = cut(trained_selector(spark, sf_dir).select("score", F.col("target").cast("long").alias("label")))
    return rounded(V.sweep(rows, THRESHOLDS), "precision", "recall", "f1")


def feature_importances(spark, sf_dir):
    """The selector's features, the most important first."""
    model, _ = selector(spark, sf_dir)
    rows = spark.createDataFrame(list(zip(SELECTOR_FEATURES, model.featureImportances.toArray().tolist())), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def _array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))


def selector_auc(spark, sf_dir):
    """Area under the curve of a score, by the rank sum over its distinct values."""
    rows = parsed_rows(trials(spark, sf_dir)).select(F.lit("drug_pct").alias("model"), (F.length("label") > 8).cast("int").alias("label"), F.round(F.col("drug_pct") / 100, 3).alias("score"))
    return rounded(V.areas(rows).select("auc"), "auc")


_W = f"WITH {TRIALS_SQL} "
_ROWS = {"TEAE": 1, "SAE": 2, "G34": 3, "DISC": 4, "FATAL": 5}


def _narrative_sql() -> str:
    parts = []
    for p, wordings in PARTS:
        row = f"r[{_ROWS[p]}]"
        filled = []
        for w in wordings:
            out = "'" + w + "'"
            for k, v in enumerate(("'Placebo'", "'Drug A'", f"{row}.n_a::varchar", f"nullif({row}.p_a, 0)::varchar", f"{row}.n_b::varchar", f"nullif({row}.p_b, 0)::varchar")):
                out = f"replace({out}, '{{{k}}}', {v})"
            filled.append(out)
        parts.append(f"CASE WHEN v = 0 THEN {filled[0]} ELSE {filled[1]} END")
    return f"""{_W}, s AS (SELECT table_id, list({{'n_a': n_a, 'p_a': cast(t_a / 10 AS double), 'n_b': n_b, 'p_b': cast(t_b / 10 AS double)}} ORDER BY row_index) AS r FROM counted GROUP BY table_id),
      n AS (SELECT table_id, r, cast('0x' || substr(md5(table_text), 32, 1) AS int) % 2 AS v FROM s JOIN trials USING (table_id))
      SELECT table_id, array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ' ') AS narrative FROM n"""


_NUM = "list_transform(regexp_extract_all({t}, '\\d+\\.?\\d*'), lambda x: cast(x AS double))"
_SAID = "list_zip(regexp_extract_all(generated, '(\\d+\\.?\\d*)%\\)? (?:of )?subjects in the ([A-Za-z ]+?) arm', 2), list_transform(regexp_extract_all(generated, '(\\d+\\.?\\d*)%\\)? (?:of )?subjects in the ([A-Za-z ]+?) arm', 1), lambda x: cast(x AS double)))"
_NEAR = "len(list_filter({c}, lambda x: abs(x - s[2]) <= 0.15)) > 0"
#: Rule scores and weak labels of the rows of single events.
_RULED = f"""{_W}, ruled AS (SELECT round(CASE WHEN regexp_matches(label, 'SAE|Fatal|Grade 3-4') OR diff >= 5 THEN 1 ELSE least(least(b / 30, 0.4) + least(diff / 20, 0.4) + CASE WHEN (CASE WHEN a > 0 THEN b / a WHEN b > 0 THEN 20 ELSE 1 END) > 2 THEN 0.05 ELSE 0 END, 1) END::double, 6) AS score,
    ((length(label) > 3 AND contains(lower(reference), lower(label))) OR list_contains(regexp_split_to_array(lower(reference), '\\s+'), lower(label)))::bigint AS y
  FROM (SELECT *, t_a / 10 AS a, t_b / 10 AS b, abs(t_b / 10 - t_a / 10) AS diff FROM counted) JOIN trials USING (table_id) WHERE row_index > 1 AND NOT (t_a = 0 AND t_b = 0))"""
QUERIES = {
    "narratives": (written, _narrative_sql()),
    "guardian_verify": (verified, f"{_W}, n AS (SELECT table_id, mode, {_NUM.format(t='generated')} AS g, {_NUM.format(t='table_text')} AS s FROM candidates), a AS (SELECT table_id, mode, len(list_filter(g, lambda x: list_contains([0, 1, 2, 3, 4, 5], x) OR len(list_filter(s, lambda y: abs(x - y) <= 0.11)) > 0)) / len(g) AS accuracy FROM n) SELECT table_id, mode, round(accuracy, 6) AS accuracy, accuracy >= 1 AS verified FROM a"),
    "arm_attribution": (arm_attribution, f"""{_W}, t AS (SELECT table_id, list(cast(t_a / 10 AS double)) AS a, list(cast(t_b / 10 AS double)) AS b FROM counted GROUP BY table_id), s AS (SELECT table_id, mode, {_SAID} AS said FROM candidates)
      SELECT table_id, mode, len(said) AS n_said, len(list_filter(said, lambda s: CASE WHEN s[1] = 'Placebo' THEN NOT ({_NEAR.format(c='a')}) AND {_NEAR.format(c='b')} ELSE NOT ({_NEAR.format(c='b')}) AND {_NEAR.format(c='a')} END)) AS n_wrong FROM s JOIN t USING (table_id)"""),
    "summary_compare": (summary_compare, f"{_W} SELECT table_id, length(dl_base) AS dl_base, length(finetuned) AS finetuned, length(ml) AS ml FROM trials"),
    "selector_auc": (selector_auc, f"""{_W}, r AS (SELECT (length(label) > 8)::int AS y, t_b / 10 AS score FROM counted WHERE row_index > 1 AND NOT (t_a = 0 AND t_b = 0))
      SELECT round(sum(CASE WHEN n.score < p.score THEN 1.0 WHEN n.score = p.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM r p, r n WHERE p.y = 1 AND n.y = 0"""),
    "trained_selector": (trained_selector, None),
    "selector_sweep": (selector_sweep, None),
    "rule_sweep": (rule_sweep, f"""{_RULED}, c AS (SELECT t, count(*) FILTER (WHERE score > t) AS n_told, count(*) FILTER (WHERE score > t AND y = 1) AS hit, sum(y) AS wanted FROM ruled, (SELECT unnest({list(THRESHOLDS)})::double AS t) GROUP BY t)
      SELECT t AS threshold, n_told, round(hit / nullif(n_told, 0), 6) AS precision, round(hit / nullif(wanted, 0), 6) AS recall, round(2 * (hit / nullif(n_told, 0)) * (hit / nullif(wanted, 0)) / nullif(hit / nullif(n_told, 0) + hit / nullif(wanted, 0), 0), 6) AS f1 FROM c"""),
    "rule_precision": (rule_precision, f"""{_RULED}, s AS (SELECT score, sum(y) AS p, count(*) AS n FROM ruled GROUP BY score), u AS (SELECT p, sum(p) OVER w / sum(n) OVER w AS pr FROM s WINDOW w AS (ORDER BY score DESC))
      SELECT round(sum(p * pr) / nullif(sum(p), 0), 6) AS average_precision FROM u"""),
    "selector_report": (selector_report, None),
    "feature_importances": (feature_importances, None),
}
