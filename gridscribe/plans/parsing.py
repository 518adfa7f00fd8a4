"""Parsing queries: rows, cells, arms, types, features, slots, selection and routing of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..sources.shapes import SHAPES_SQL, shapes
from ..sources.trials import TRIALS_SQL, trials
from .scoring import rounded


def table_rows(spark, sf_dir):
    rows = T.long_rows(trials(spark, sf_dir))
    return rows.select("table_id", F.col("row_index").cast("long").alias("row_index"), "label", F.size("cells").cast("long").alias("n_cells"), F.element_at("cells", 2).alias("cell_a"), F.element_at("cells", 3).alias("cell_b"))


def cell_values(spark, sf_dir):
    """Second and last cells by the anchored rules, and all cells of a row together by the searching ones."""
    rows = T.long_rows(shapes(spark, sf_dir)).withColumns({"a": T.cell_value(F.element_at("cells", 2)), "b": T.cell_value(F.element_at("cells", -1)), "m": T.multi_value(F.array_join(F.slice("cells", 2, 2), " "))})
    return rows.select("table_id", "label", *[F.col(f"{c}.n").cast("long").alias(f"n_{c}") for c in "abm"], *[F.col(f"{c}.pct").alias(f"pct_{c}") for c in "abm"])


def arm_parse(spark, sf_dir):
    rows = shapes(spark, sf_dir).withColumn("a", T.arms(F.col("table_text")))
    return rows.select("table_id", F.col("a.control").alias("control"), F.col("a.experimental").alias("experimental"), F.col("a.n_control").cast("long").alias("n_control"), F.col("a.n_experimental").cast("long").alias("n_experimental"), F.col("a.exp_idx").cast("long").alias("exp_idx"))


def row_types(spark, sf_dir):
    rows = T.long_rows(shapes(spark, sf_dir))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.first(T.row_type(F.col("label")), True).alias("kind"), F.bool_and(F.col("label").rlike(T.SAE_PATTERN)).alias("is_sae"), F.bool_and(F.col("label").rlike(T.SEVERE_PATTERN)).alias("is_severe"), F.bool_and(F.col("label").rlike(T.OVERVIEW_PATTERN)).alias("is_overview"))


def table_types(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", T.typed(F.col("text")).alias("kind"), T.typed(F.col("text"), T.SPLIT_TYPES).alias("split_kind"))


def table_feature_rows(spark, sf_dir):
    rows = shapes(spark, sf_dir)
    return rounded(rows.select("table_id", *[v.alias(k) for k, v in T.table_features(F.col("table_text")).items()]), *T.FEATURES)


def row_feature_rows(spark, sf_dir):
    rows = T.row_features(T.parsed_rows(trials(spark, sf_dir)))
    names = ("drug_pct", "ctrl_pct", "abs_risk_diff", "relative_risk", "drug_pct_rank", "abs_diff_rank")
    flags = [F.col(c).cast("long").alias(c) for c in ("risk_dir", "is_sae", "is_severe", "drug_above_5pct", "drug_above_10pct", "diff_above_5pp")]
    return rounded(rows.select("table_id", "label", *names, *flags), *names)


def row_selection(spark, sf_dir):
    rows = T.selected(T.row_features(T.parsed_rows(trials(spark, sf_dir))))
    return rounded(rows.select("table_id", "label", "selected", "is_override", "reason", "score"), "score")


def slots(spark, sf_dir):
    rows = T.overview_slots(shapes(spark, sf_dir))
    return rows.select("table_id", "prefix", *[F.col(c).cast(t).alias(c) for c, t in (("n_a", "long"), ("pct_a", "double"), ("n_b", "long"), ("pct_b", "double"))])


def cluster_routing(spark, sf_dir):
    rows = shapes(spark, sf_dir)
    rows = rows.select("table_id", *[v.alias(k) for k, v in T.table_features(F.col("table_text")).items()])
    return rows.select("table_id", T.cluster().alias("cluster"))


def linearize(spark, sf_dir):
    """Grids of cells put together as table texts: the first row is the header, empty rows go, and of merged cells, which repeat their left
    neighbour, one stays.

    The grids are the parsed tables with an empty row after the second and the first cell of every third row twice.
    """
    rows = T.long_rows(shapes(spark, sf_dir))
    grid = F.when(F.col("row_index") % 3 == 2, F.concat(F.array("label"), F.col("cells"))).otherwise(F.col("cells"))
    rows = rows.select("table_id", "table_text", F.struct(F.col("row_index").alias("i"), grid.alias("cells")).alias("row"))
    grids = rows.groupBy("table_id").agg(F.max("table_text").alias("t"), F.sort_array(F.collect_list("row")).alias("r"))
    head = F.transform(F.split(F.regexp_extract("t", r"\[HEADERS: \|(.*?)\]", 1), r"\|", -1), lambda c: F.trim(c))
    blank = F.array(F.array(F.lit(""), F.lit(" ")))
    cells = F.concat(F.array(head), F.slice(F.col("r.cells"), 1, 2), blank, F.slice(F.col("r.cells"), 3, 1 << 30))
    title = F.nullif(F.trim(F.regexp_extract("t", r"\[TABLE_TITLE:(.*?)\]", 1)), F.lit(""))
    return grids.withColumns({"g": cells, "title": title}).select("table_id", F.md5(T.linearized(F.col("g"), F.col("title"))).alias("text_md5"))


def variant_choice(spark, sf_dir):
    """md5 of the table modulo the variants of a family, digit by digit, so that 128 bits fit a long."""
    digits = F.split(F.md5("table_text"), "")
    return trials(spark, sf_dir).select("table_id", *[_mod(digits, m).alias(f"v{m}") for m in (5, 7)])


def _mod(digits, m: int):
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("long")) % m)


_B = f"WITH {TRIALS_SQL} "
_V = f"""{_B}, v AS (SELECT table_id, row_index, label, n_a, n_b, t_a / 10 AS pct_a, t_b / 10 AS pct_b, big_a, big_b FROM counted)"""
_EV = f"""{_V}, kept AS (SELECT *, CASE WHEN pct_a > 0 THEN pct_b / pct_a WHEN pct_b > 0 THEN 20 ELSE 1 END AS rr, regexp_matches(label, 'SAE|Fatal') AS sae, regexp_matches(label, 'Grade 3-4') AS severe, abs(pct_b - pct_a) AS diff
    FROM v WHERE row_index > 1 AND NOT (pct_a = 0 AND pct_b = 0)),
  ranked AS (SELECT *, max(pct_b) OVER (PARTITION BY table_id) AS max_b, max(diff) OVER (PARTITION BY table_id) AS max_diff FROM kept)"""
_KIND = "CASE label WHEN 'Any TEAE' THEN 'teae' WHEN 'SAE' THEN 'sae' WHEN 'Grade 3-4 AE' THEN 'grade34' WHEN 'Discontinuation due to AE' THEN 'disc' WHEN 'Fatal' THEN 'fatal' END"
_ROWS = "list_transform(string_split(string_split(table_text, 'end_table')[1], '[ROW]')[2:], lambda r: r)"
_PCTS = lambda r: f"list_transform(regexp_extract_all({r}, '(\\d+\\.?\\d*)\\s*\\)', 1), lambda x: cast(x AS double))"
_FEATURES = f"""WITH {SHAPES_SQL}, f0 AS (SELECT *, lower(table_text) AS low, list_transform(regexp_extract_all(table_text, '\\b\\d+\\.?\\d*\\b'), lambda x: cast(x AS double)) AS n, {_PCTS('table_text')} AS p,
    list_transform(regexp_extract_all(table_text, 'N\\s*=\\s*(\\d+)', 1), lambda x: cast(x AS double)) AS z, {_ROWS} AS r, regexp_extract(table_text, '\\[HEADERS:(.*?)\\]', 1) AS head FROM shapes),
  f1 AS (SELECT *, list_transform(r, lambda x: {_PCTS('x')}) AS rp, CASE WHEN contains(table_text, '[HEADERS:') THEN len(string_split(head, '|')) ELSE 0 END AS cols,
    list_filter(r, lambda x: contains(lower(x), 'discontinu'))[1] AS disc, list_filter(r, lambda x: contains(lower(x), 'grade 3') AND contains(lower(x), 'teae'))[1] AS g34,
    list_filter(r, lambda x: regexp_matches(lower(x), '\\bteae\\b') AND NOT contains(lower(x), 'grade'))[1] AS teae, list_filter(r, lambda x: contains(lower(x), 'drug-related') AND contains(lower(x), 'sae')) AS related FROM f0),
  f AS (SELECT *, {_PCTS('disc')} AS dp, {_PCTS('g34')} AS gp, {_PCTS('teae')} AS tp FROM f1)"""
_RATIO = "CASE WHEN len(z) >= 2 AND list_min(z) > 0 THEN list_max(z) / list_min(z) ELSE 1 END"
_BARS = "len(string_split(r[1], '|')) - 1"
_FCOLS = {
    "num_count": "len(n)", "max_number": "list_max(n)", "min_number": "list_min(n)", "mean_number": "list_avg(n)", "std_number": "list_stddev_pop(n)", "pct_count": "len(p)", "max_pct": "list_max(p)", "min_pct": "list_min(p)",
    "mean_pct": "list_avg(p)", "num_arms": "len(z)", "total_patients": "list_sum(z)", "arm_size_ratio": _RATIO, "has_high_teae": "(len(list_filter(p, lambda x: x > 50)) > 0)::int",
    "has_sae": "(contains(table_text, 'SAE') OR contains(low, 'serious adverse'))::int", "has_grade34": "(contains(table_text, 'Grade 3') OR contains(table_text, 'Grade 4'))::int",
    "has_discontinuation": "contains(low, 'discontinu')::int", "has_death": "(contains(low, 'death') OR contains(low, 'fatal'))::int",
    "arm_pct_difference": "list_max(list_transform(rp, lambda x: CASE WHEN len(x) >= 2 THEN abs(x[1] - x[2]) ELSE 0 END))", "num_comparative_rows": "len(r)", "has_title": "contains(table_text, 'TABLE_TITLE')::int",
    "has_headers": "contains(table_text, 'HEADERS')::int", "table_length_chars": "length(table_text)", "num_rows": "len(r)", "num_columns": "cols", "arm_count": f"CASE WHEN len(z) > 0 THEN len(z) ELSE greatest(1, {_BARS}) END",
    "has_dual_phase": "(contains(low, 'double-blind') AND contains(low, 'open-label'))::int", "discontinuation_delta": "CASE WHEN len(dp) >= 2 THEN abs(dp[1] - dp[2]) ELSE 0 END",
    "grade_3_4_ratio": "CASE WHEN len(gp) > 0 AND tp[1] > 0 THEN gp[1] / tp[1] ELSE 0 END", "sae_drug_related_flag": f"(len(list_filter(related, lambda x: len(list_filter({_PCTS('x')}, lambda v: v > 5)) > 0)) > 0)::int",
    "data_completeness_score": "list_sum(list_transform(r, lambda x: len(list_filter(string_split(x, '|'), lambda c: trim(c) <> '')))) / (len(r) * CASE WHEN cols > 0 THEN cols ELSE 2 END)",
    "footnote_count": "len(regexp_extract_all(table_text, '\\b[a-d]\\b'))", "n_subjects_imbalance": _RATIO,
}
_FVALUES = ", ".join(f"coalesce(cast({_FCOLS[k]} AS double), 0) AS {k}" for k in T.FEATURES)
#: CTEs f0, f1, f and feature_values over shapes, to follow SHAPES_SQL.
FEATURES_SQL = _FEATURES.split(SHAPES_SQL + ", ", 1)[1] + f", feature_values AS (SELECT table_id, {_FVALUES} FROM f)"
CLUSTER_SQL = """CASE WHEN num_arms = 1 THEN 'C13_single_arm' WHEN has_dual_phase > 0 THEN 'C06_open_label_summary' WHEN has_death > 0 AND has_sae > 0 THEN 'C04_sae_fatal_emphasis'
  WHEN sae_drug_related_flag > 0 AND has_discontinuation > 0 THEN 'C08_drug_related_full' WHEN sae_drug_related_flag > 0 THEN 'C02_drug_related_emphasis'
  WHEN has_grade34 > 0 AND has_sae > 0 AND has_discontinuation > 0 THEN CASE WHEN has_high_teae > 0 THEN 'C03_high_incidence_both_arms' ELSE 'C01_standard_two_arm_overall' END
  WHEN has_grade34 > 0 AND has_sae > 0 THEN 'C11_grade34_no_disc' WHEN has_sae > 0 AND has_discontinuation > 0 THEN 'C05_no_grade34_sae_only' WHEN has_discontinuation > 0 AND discontinuation_delta > 10 THEN 'C12_high_discontinuation'
  WHEN has_discontinuation > 0 AND has_sae = 0 AND has_grade34 = 0 THEN 'C07_minimal_teae_disc' WHEN has_sae = 0 AND has_grade34 = 0 AND has_discontinuation = 0 THEN CASE WHEN num_rows >= 4 THEN 'C14_individual_ae_listing' ELSE 'C10_teae_only' END
  ELSE 'C09_safety_population_note' END"""
_ARM = "[{'c': 'Placebo', 'e': 'Drug A', 'i': 1}, {'c': 'Placebo', 'e': 'Drug A', 'i': 0}, {'c': 'Control', 'e': 'Experimental', 'i': 1}, {'c': 'Placebo double-blind', 'e': 'Drug A open-label', 'i': 1}, {'c': 'Placebo', 'e': 'Drug A', 'i': 1}, {'c': 'Placebo', 'e': 'Drug A', 'i': 1}, {'c': 'Control', 'e': 'Experimental', 'i': 1}, {'c': 'Placebo', 'e': 'Drug A', 'i': 1}][shape + 1]"
KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{p}') THEN '{k}'" for k, p in T.ROW_TYPES) + " END"
PREFIX_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SLOT_PREFIX.items()) + " END"
#: (table_id, prefix, n_a, pct_a, n_b, pct_b) of the shapes, by what their rows were made of.
SLOTS_SQL = f"""WITH {SHAPES_SQL}, kinds AS (SELECT *, {KIND_SQL} AS kind, CASE WHEN shape <> 6 THEN n_a END AS na, CASE WHEN shape <> 6 THEN n_b END AS nb, nullif(t_a / 10, 0) AS pa, nullif(t_b / 10, 0) AS pb FROM shaped_rows WHERE shape <> 2),
  slots AS (SELECT table_id, {PREFIX_SQL} AS prefix, arg_min(na, row_index) FILTER (WHERE na IS NOT NULL) AS n_a, cast(arg_min(pa, row_index) FILTER (WHERE pa IS NOT NULL) AS double) AS pct_a,
    arg_min(nb, row_index) FILTER (WHERE nb IS NOT NULL) AS n_b, cast(arg_min(pb, row_index) FILTER (WHERE pb IS NOT NULL) AS double) AS pct_b FROM kinds WHERE kind IS NOT NULL GROUP BY ALL)"""
_MODSQL = lambda m: f"list_reduce(list_prepend(0::bigint, list_transform(string_split(md5(table_text), ''), lambda c: cast('0x' || c AS bigint))), lambda a, d: (a * 16 + d) % {m})"

_TYPES = lambda table: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in table) + " ELSE 'other' END"

QUERIES = {
    "table_rows": (table_rows, f"{_B} SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY row_index) - 1 AS row_index, label, cast(3 AS bigint) AS n_cells, n_a || ' (' || (t_a // 10) || '.' || (t_a % 10) || '%)' AS cell_a, n_b || ' (' || (t_b // 10) || '.' || (t_b % 10) || '%)' AS cell_b FROM counted"),
    "cell_values": (cell_values, f"""WITH {SHAPES_SQL}, c AS (SELECT *, string_split(cells, ' | ') AS c FROM shaped_rows), n AS (SELECT table_id, label, c[1] AS a, c[-1] AS b, array_to_string(c[1:2], ' ') AS m FROM c)
      SELECT table_id, label, {', '.join(f"try_cast(coalesce(nullif(regexp_extract({x}, '^(\\d+)\\s*\\(', 1), ''), nullif(regexp_extract({x}, '^(\\d+)$', 1), '')) AS bigint) AS n_{x}" for x in 'ab')},
        try_cast(coalesce(nullif(regexp_extract(m, '^(\\d+)\\s*\\(\\d', 1), ''), nullif(regexp_extract(m, '^(\\d+)\\s+\\d+\\.?\\d*\\s*%', 1), ''), CASE WHEN NOT contains(m, '%') THEN nullif(regexp_extract(m, '^(\\d+)$', 1), '') END) AS bigint) AS n_m,
        {', '.join(f"cast(coalesce(try_cast(coalesce(nullif(regexp_extract({x}, '^\\d+\\s*\\((\\d+\\.?\\d*)', 1), ''), nullif(regexp_extract({x}, '^(\\d+\\.?\\d*)\\s*%', 1), '')) AS double), 0) AS double) AS pct_{x}" for x in 'ab')},
        coalesce(try_cast(coalesce(nullif(regexp_extract(m, '^\\d+\\s*\\((\\d+\\.?\\d*)', 1), ''), nullif(regexp_extract(m, '(\\d+\\.?\\d*)\\s*%', 1), '')) AS double), 0) AS pct_m FROM n"""),
    "arm_parse": (arm_parse, f"""WITH {SHAPES_SQL}, a AS (SELECT table_id, {_ARM} AS arm, shape, max(big_a) AS a, max(big_b) AS b FROM shaped_rows GROUP BY table_id, shape)
      SELECT table_id, arm.c AS control, arm.e AS experimental, CASE shape WHEN 2 THEN b WHEN 6 THEN NULL ELSE a END AS n_control, CASE WHEN shape NOT IN (2, 6) THEN b END AS n_experimental, cast(arm.i AS bigint) AS exp_idx FROM a"""),
    "row_types": (row_types, f"WITH {SHAPES_SQL} SELECT label, count(*) AS n, {KIND_SQL} AS kind, regexp_matches(label, '{T.SAE_PATTERN}') AS is_sae, regexp_matches(label, '{T.SEVERE_PATTERN}') AS is_severe, regexp_matches(label, '{T.OVERVIEW_PATTERN}') AS is_overview FROM shaped_rows GROUP BY label"),
    "table_types": (table_types, f"SELECT doc_id, {_TYPES(T.TABLE_TYPES)} AS kind, {_TYPES(T.SPLIT_TYPES)} AS split_kind FROM (SELECT doc_id, lower(text) AS low FROM documents)"),
    "table_features": (table_feature_rows, f"{_FEATURES}, v AS (SELECT table_id, {_FVALUES} FROM f) SELECT table_id, {', '.join(f'round({k}, 6) AS {k}' for k in T.FEATURES)} FROM v"),
    "row_features": (row_feature_rows, f"""{_EV} SELECT table_id, label, round(pct_b, 6) AS drug_pct, round(pct_a, 6) AS ctrl_pct, round(diff, 6) AS abs_risk_diff, round(least(rr, 20), 6) AS relative_risk,
      round(CASE WHEN max_b > 0 THEN pct_b / max_b ELSE 0 END, 6) AS drug_pct_rank, round(CASE WHEN max_diff > 0 THEN diff / max_diff ELSE 0 END, 6) AS abs_diff_rank, sign(pct_b - pct_a)::bigint AS risk_dir, sae::bigint AS is_sae, severe::bigint AS is_severe,
      (pct_b > 5)::bigint AS drug_above_5pct, (pct_b > 10)::bigint AS drug_above_10pct, (diff > 5)::bigint AS diff_above_5pp FROM ranked"""),
    "row_selection": (row_selection, f"""{_EV} SELECT table_id, label, sae OR severe OR diff >= 5 OR pct_b >= 5 OR diff >= 3 AS selected, sae OR severe OR diff >= 5 AS is_override,
      CASE WHEN sae THEN 'serious' WHEN severe THEN 'severe' WHEN diff >= 5 THEN 'difference' ELSE 'rule' END AS reason,
      round(CASE WHEN sae OR severe OR diff >= 5 THEN 1 ELSE least(least(pct_b / 30, 0.4) + least(diff / 20, 0.4) + CASE WHEN least(rr, 20) > 2 THEN 0.05 ELSE 0 END, 1) END::double, 6) AS score FROM ranked"""),
    "overview_slots": (slots, f"{SLOTS_SQL} SELECT * FROM slots"),
    "cluster_routing": (cluster_routing, f"{_FEATURES}, v AS (SELECT table_id, {_FVALUES} FROM f) SELECT table_id, {CLUSTER_SQL} AS cluster FROM v"),
    "linearize": (linearize, f"""WITH {SHAPES_SQL}, l AS (SELECT *, list_prepend(label, string_split(cells, ' | ')) AS c FROM shaped_rows),
      h AS (SELECT table_id, shape, string_agg(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), ' | '), ' [ROW] ' ORDER BY row_index) AS body,
        regexp_extract(any_value(table_text), '\\[HEADERS: \\|(.*?)\\]', 1) AS head FROM l JOIN shapes USING (table_id, shape) GROUP BY table_id, shape)
      SELECT table_id, md5('start_table ' || CASE WHEN shape = 0 THEN '[TABLE_TITLE: Table 3: Overview of adverse events] ' ELSE '' END || '[HEADERS: |' || CASE WHEN head = '' THEN ' ' ELSE head END || '] [ROW] ' || body || ' end_table') AS text_md5 FROM h"""),
    "variant_choice": (variant_choice, f"{_B} SELECT table_id, {_MODSQL(5)} AS v5, {_MODSQL(7)} AS v7 FROM trials"),
}
