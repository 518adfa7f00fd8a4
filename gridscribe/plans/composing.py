"""Composing queries: facts, wordings, realized and composed summaries, polish and legacy fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import tables as T
from ..operators import generation as G
from ..sources.shapes import SHAPES_SQL, shapes
from .parsing import FEATURES_SQL, CLUSTER_SQL, SLOTS_SQL


def facts(spark, sf_dir) -> DataFrame:
    rows = shapes(spark, sf_dir).withColumn("slots", G.slots_of(F.col("table_text")))
    return rows.withColumn("profile", G.profile_of(F.col("slots")))


def fact_sheet(spark, sf_dir):
    """Every slot of every table."""
    return facts(spark, sf_dir).select("table_id", F.explode("slots").alias("slot", "value"))


def data_profile(spark, sf_dir):
    return facts(spark, sf_dir).select("table_id", "profile.*")


def wordings(spark, sf_dir):
    """The wording of each family for each table, by its md5."""
    rows = facts(spark, sf_dir)
    return rows.select("table_id", *[F.md5(G.choose(f, F.col("slots"), F.col("profile"), F.col("table_text"), more)).alias(f) for f, more in CHOICES])


CHOICES = (("opener", 0), ("teae", 0), ("grade34", 0), ("sae", 0), ("drug_sae", 0), ("drug_teae", 0), ("fatal", 0), ("drug_disc", 0), ("disc", 0), ("counting", 1), ("similar", 2))


def realize(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("s", G.realized(F.col("slots"), F.col("profile"), F.col("table_text")))
    return rows.select("table_id", F.size("s").cast("long").alias("n"), F.array_join("s", " ").alias("narrative"))


def legacy(spark, sf_dir):
    """Each table's cluster template, sentence by sentence."""
    rows = clustered(spark, sf_dir).withColumn("slots", G.slots_of(F.col("table_text")))
    got = G.legacy_fill(F.try_element_at(G.cluster_templates(), F.col("cluster")), F.col("slots"))
    return rows.select("table_id", got["text"].alias("text"), F.array_join(got["unfilled"], ",").alias("unfilled"))


def with_cluster(tables: DataFrame) -> DataFrame:
    """tables (table_id, table_text, ...) with cluster."""
    more = [c for c in tables.columns if c not in ("table_id", "table_text")]
    rows = tables.select("table_id", *more, "table_text", *[v.alias(k) for k, v in T.table_features(F.col("table_text")).items()])
    return rows.select("table_id", *more, "table_text", T.cluster().alias("cluster"))


def clustered(spark, sf_dir) -> DataFrame:
    return with_cluster(shapes(spark, sf_dir))


def listings_of(tables: DataFrame) -> DataFrame:
    """(table_id, listing): a sentence for each selected row of single events, in the order of the table."""
    rows = tables.withColumn("_a", T.arms(F.col("table_text")))
    rows = T.selected(T.parsed_rows(rows)).where("selected").select("table_id", F.struct("row_index", G.event_sentence().alias("s")).alias("x"))
    return rows.groupBy("table_id").agg(F.array_join(F.sort_array(F.collect_list("x"))["s"], " ").alias("listing"))


def listings(spark, sf_dir) -> DataFrame:
    return listings_of(shapes(spark, sf_dir))


def event_listing(spark, sf_dir):
    return listings(spark, sf_dir)


def summaries(spark, sf_dir):
    """The whole cascade, and what it did."""
    return G.composed(clustered(spark, sf_dir), listings(spark, sf_dir))


def text_polish(spark, sf_dir):
    """Polish of texts with every flaw that it mends: whole tables with flaws within and at the end."""
    t = F.col("table_text")
    flaws = " ( ) a , , b . . c  d ; e 5 % versus in the "
    rough = F.concat(F.substring(t, 1, 40), F.lit(flaws), F.substring(t, F.lit(41), F.length(t)), F.lit(" !"))
    return shapes(spark, sf_dir).select("table_id", F.md5(G.polish(rough)).alias("text_md5"))


def clusters(spark, sf_dir):
    """The clusters as a dimension."""
    return spark.createDataFrame([(k, d, t) for k, (d, t) in G.CLUSTERS.items()], "cluster string, description string, template string")


def feature_names(spark, sf_dir):
    """The names of the table features in their order, as a dimension."""
    return spark.createDataFrame(list(enumerate(T.FEATURES)), "position bigint, name string")


# -- SQL ------------------------------------------------------------------------------------------------------------
_q = lambda x: "'" + x.replace("'", "''") + "'"
_num = lambda x: "NULL::double" if x is None else repr(x)
_VARIANTS = ", ".join(
    f"({_q(f)}, {i}, {_q(t)}, {'[]::varchar[]' if c.get('free') else str(G.needed(t)) + '::varchar[]'}, {_num(c.get('min_teae'))}, {_num(c.get('max_pct'))}, {_num(c.get('min_pct'))})"
    for f, vs in G.FAMILIES.items() for i, (t, c) in enumerate(vs))
_PARTS = (("n_a", "N_A"), ("pct_a", "PCT_A"), ("n_b", "N_B"), ("pct_b", "PCT_B"))
_KV = f"""{SLOTS_SQL}, arm AS (SELECT table_id, any_value(shape) AS shape, max(big_a) AS a, max(big_b) AS b FROM shaped_rows GROUP BY table_id),
kv AS ({' UNION ALL '.join(f"SELECT table_id, prefix || '_{k}' AS slot, cast({c} AS varchar) AS value FROM slots WHERE {c} IS NOT NULL" for c, k in _PARTS)}
  UNION ALL SELECT table_id, 'ARM_A', CASE shape WHEN 2 THEN 'Control' WHEN 6 THEN 'Control' WHEN 3 THEN 'Placebo double-blind' ELSE 'Placebo' END FROM arm
  UNION ALL SELECT table_id, 'ARM_B', CASE shape WHEN 2 THEN 'Experimental' WHEN 6 THEN 'Experimental' WHEN 3 THEN 'Drug A open-label' ELSE 'Drug A' END FROM arm
  UNION ALL SELECT table_id, 'N_A', cast(CASE shape WHEN 2 THEN b ELSE a END AS varchar) FROM arm WHERE shape <> 6 UNION ALL SELECT table_id, 'N_B', cast(b AS varchar) FROM arm WHERE shape NOT IN (2, 6))"""
_WIDE = ", ".join(f"max(value) FILTER (WHERE slot = '{k}') AS \"{k}\"" for k in G.KEYS)
_PCT = lambda k: f"coalesce(cast(\"{k}\" AS double), 0)"
_SHARES = [(p, s) for p in ("TEAE", "G34", "SAE", "DISC") for s in ("B", "A")]
_PROFILE = ", ".join(f"{_PCT(f'{p}_PCT_{s}')} AS {p.lower()}_pct_{s.lower()}" for p, s in _SHARES)
#: Under other names beside the slots, as names do not differ by case.
_PROFILED = ", ".join(f"{_PCT(f'{p}_PCT_{s}')} AS {p.lower()}_{s.lower()}" for p, s in _SHARES)
_WIDENED = f"wide AS (SELECT table_id, list(slot) AS keys, {_WIDE} FROM kv GROUP BY table_id)"
_MOD = "list_reduce(list_prepend(0::bigint, list_transform(string_split(md5(table_text), ''), lambda c: cast('0x' || c AS bigint))), lambda a, d: (a * 16 + d) % n_fit)"


def _filled() -> str:
    out = "text"
    for k in G.KEYS:
        out = f"replace({out}, '{{{k}}}', coalesce(\"{k}\", '~'))"
    return f"CASE WHEN contains({out}, '~') THEN regexp_replace({out}, '\\s*~\\s*', ' ', 'g') ELSE {out} END"


_MORE = "CASE family " + " ".join(f"WHEN '{f}' THEN {m}" for f, m in CHOICES) + " END"
_ORDER = "CASE family " + " ".join(f"WHEN '{f}' THEN {i}" for i, (f, _) in enumerate(CHOICES)) + " END"
_HAS = {
    "opener": "true", "teae": "\"TEAE_PCT_B\" IS NOT NULL AND \"TEAE_PCT_A\" IS NOT NULL", "grade34": "\"G34_PCT_B\" IS NOT NULL AND \"G34_PCT_A\" IS NOT NULL", "sae": "\"SAE_PCT_B\" IS NOT NULL AND \"SAE_PCT_A\" IS NOT NULL",
    "drug_sae": "\"DR_SAE_PCT_B\" IS NOT NULL", "drug_teae": "\"DR_TEAE_PCT_B\" IS NOT NULL", "fatal": "\"FATAL_PCT_B\" IS NOT NULL",
    "drug_disc": "\"DR_DISC_PCT_B\" IS NOT NULL AND (\"DR_TEAE_PCT_B\" IS NOT NULL OR \"DR_SAE_PCT_B\" IS NOT NULL)", "disc": "\"DISC_PCT_B\" IS NOT NULL OR \"DISC_N_B\" IS NOT NULL",
    "counting": "\"TEAE_PCT_B\" IS NOT NULL AND \"G34_PCT_B\" IS NOT NULL AND \"SAE_PCT_B\" IS NOT NULL", "similar": "abs(teae_b - teae_a) < 5 AND teae_b > 50",
}
_SHOWN = "CASE family " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in _HAS.items()) + " END"
_CHOSEN = f"""{_KV}, {_WIDENED}, profiled AS (SELECT wide.*, table_text, {_PROFILED} FROM wide JOIN shapes USING (table_id)),
variants(family, i, text, needed, min_teae, max_pct, min_pct) AS (VALUES {_VARIANTS}),
tried AS (SELECT p.*, v.*, len(list_filter(needed, lambda s: NOT list_contains(keys, s))) AS lacks FROM profiled p, variants v),
fits AS (SELECT *, lacks = 0 AND coalesce(least(teae_b, teae_a) >= min_teae, true) AND coalesce(greatest(sae_b, sae_a, g34_b, g34_a) <= max_pct, true) AND coalesce(greatest(disc_b, disc_a) >= min_pct, true) AS fit FROM tried),
ranked AS (SELECT *, count(*) FILTER (WHERE fit) OVER f AS n_fit, row_number() OVER (PARTITION BY table_id, family ORDER BY fit DESC, i) - 1 AS r, row_number() OVER (PARTITION BY table_id, family ORDER BY lacks, i) AS fewest FROM fits WINDOW f AS (PARTITION BY table_id, family)),
chosen AS (SELECT * FROM ranked WHERE CASE WHEN n_fit > 0 THEN fit AND r = ({_MOD} + {_MORE}) % n_fit ELSE fewest = 1 END)"""
_SAID = f"""{_CHOSEN}, phrased AS (SELECT *, {_filled()} AS done, list_filter(regexp_extract_all(text, '\\{{([A-Z0-9_]+)\\}}', 1), lambda s: NOT list_contains(keys, s)) AS gone FROM chosen WHERE {_SHOWN}),
said AS (SELECT table_id, family, CASE WHEN len(gone) = 0 THEN done WHEN len(list_filter(gone, lambda s: contains(s, 'PCT') OR contains(s, '_N_'))) > 0 THEN NULL
  WHEN length(regexp_replace(trim(regexp_replace(done, '\\s+', ' ', 'g')), '\\s+([.,;:])', '\\1', 'g')) > 20 THEN regexp_replace(trim(regexp_replace(done, '\\s+', ' ', 'g')), '\\s+([.,;:])', '\\1', 'g') END AS sentence FROM phrased)"""


def _polished(t: str) -> str:
    for pattern, to, how in (("\\(\\s*\\)", "", "g"), (",\\s*,", ",", "g"), ("\\.\\s*\\.", ".", "g"), ("\\s{2,}", " ", "g"), ("\\s+([.,!?;%])", "\\1", "g"), ("versus\\s+in the\\s+", "versus ", "gi")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', '{how}')"
    return f"trim({t})"


#: Sentences of the templates: a sentence is shown if more than half of its slots are there; here a sentence has one to four.
_TEMPLATES = ", ".join(f"({_q(k)}, {i}, {_q(s)}, {G.needed(s)}::varchar[])" for k, (_, t) in G.CLUSTERS.items() for i, s in enumerate(t.replace(". ", ".\x00").split("\x00")))


def _blanked() -> str:
    out = "text"
    for k in G.KEYS:
        out = f"replace({out}, '{{{k}}}', coalesce(\"{k}\", ''))"
    return out


_LEGACY = f"""{FEATURES_SQL}, clustered AS (SELECT table_id, {CLUSTER_SQL} AS cluster FROM feature_values),
templates(cluster, i, text, needed) AS (VALUES {_TEMPLATES}),
parts AS (SELECT *, {_blanked()} AS done, len(needed) = 0 OR len(list_filter(needed, lambda s: list_contains(keys, s))) > len(needed) // 2 AS ready FROM clustered JOIN templates USING (cluster) JOIN wide USING (table_id)),
legacy AS (SELECT table_id, any_value(cluster) AS cluster, coalesce(string_agg(done, ' ' ORDER BY i) FILTER (WHERE ready), '') AS text, coalesce(array_to_string(list_sort(list_distinct(flatten(list(needed) FILTER (WHERE NOT ready)))), ','), '') AS unfilled FROM parts GROUP BY table_id)"""
_TENTH = lambda t: f"cast({t} // 10 AS varchar) || '.' || cast({t} % 10 AS varchar) || '%'"
#: In shape 7, whose values have cells of their own, the second cell is taken for the control's and the third for the experimental arm's.
_LISTED = f"""events AS (SELECT table_id, row_index, label, CASE WHEN shape <> 6 THEN n_a END AS na, CASE WHEN shape NOT IN (6, 7) THEN n_b END AS nb, CASE WHEN shape = 7 THEN 0 ELSE t_a END AS t_a, CASE WHEN shape = 7 THEN t_a ELSE t_b END AS t_b,
    CASE shape WHEN 6 THEN 'Control' WHEN 3 THEN 'Placebo double-blind' ELSE 'Placebo' END AS arm_a, CASE shape WHEN 6 THEN 'Experimental' WHEN 3 THEN 'Drug A open-label' ELSE 'Drug A' END AS arm_b
  FROM shaped_rows WHERE shape <> 2 AND NOT regexp_matches(label, '{T.OVERVIEW_PATTERN}') AND NOT (t_a = 0 AND (shape = 7 OR t_b = 0))),
picked AS (SELECT * FROM events WHERE regexp_matches(label, '{T.SAE_PATTERN}') OR regexp_matches(label, '{T.SEVERE_PATTERN}') OR abs(t_b - t_a) >= 30 OR t_b >= 50),
listed AS (SELECT table_id, string_agg(label || ' was reported in ' || coalesce(nb || ' (', '') || {_TENTH('t_b')} || CASE WHEN nb IS NULL THEN '' ELSE ')' END || ' of subjects in the ' || arm_b || ' arm versus '
    || coalesce(na || ' (', '') || {_TENTH('t_a')} || CASE WHEN na IS NULL THEN '' ELSE ')' END || ' in the ' || arm_a || ' arm.', ' ' ORDER BY row_index) AS listing FROM picked GROUP BY table_id)"""
#: (table_id, filled, missing): slots of the cluster's template that a table has and lacks.
COVERAGE_SQL = f"""{_KV}, {_WIDENED}, {_LEGACY}, every AS (SELECT cluster, list_distinct(flatten(list(needed))) AS needed FROM templates GROUP BY cluster)
  SELECT table_id, array_to_string(list_sort(list_filter(needed, lambda s: list_contains(keys, s))), ',') AS filled, array_to_string(list_sort(list_filter(needed, lambda s: NOT list_contains(keys, s))), ',') AS missing
  FROM clustered JOIN every USING (cluster) JOIN wide USING (table_id)"""

QUERIES = {
    "fact_sheet": (fact_sheet, f"{_KV} SELECT * FROM kv"),
    "data_profile": (data_profile, f"{_KV}, wide AS (SELECT table_id, {_WIDE} FROM kv GROUP BY table_id) SELECT table_id, {_PROFILE}, abs({_PCT('TEAE_PCT_B')} - {_PCT('TEAE_PCT_A')}) AS pct_diff FROM wide"),
    "wordings": (wordings, f"{_CHOSEN} SELECT table_id, {', '.join(f'''max(md5(text)) FILTER (WHERE family = '{f}') AS {f}''' for f, _ in CHOICES)} FROM chosen GROUP BY table_id"),
    "realized_narratives": (realize, f"{_SAID} SELECT table_id, count(sentence) AS n, string_agg(sentence, ' ' ORDER BY {_ORDER}) AS narrative FROM said GROUP BY table_id"),
    "legacy_fill": (legacy, f"{_KV}, {_WIDENED}, {_LEGACY} SELECT table_id, text, unfilled FROM legacy"),
    "event_listing": (event_listing, f"WITH {SHAPES_SQL}, {_LISTED} SELECT table_id, listing FROM listed"),
    "summaries": (summaries, f"""{_SAID}, told AS (SELECT table_id, count(sentence) AS n, string_agg(sentence, ' ' ORDER BY {_ORDER}) AS narrative FROM said GROUP BY table_id), {_LEGACY}, {_LISTED},
      bodies AS (SELECT table_id, cluster, CASE WHEN n >= 2 THEN 'realized' ELSE 'template' END AS origin, CASE WHEN n >= 2 THEN narrative ELSE text END AS body, listing FROM legacy JOIN told USING (table_id) LEFT JOIN listed USING (table_id))
      SELECT table_id, origin, {_polished("CASE WHEN cluster <> 'C14_individual_ae_listing' OR listing IS NULL THEN body WHEN length(body) < 20 THEN listing ELSE body || ' ' || listing END")} AS summary, cast(NULL AS varchar) AS error FROM bodies"""),
    "text_polish": (text_polish, f"WITH {SLOTS_SQL.split('WITH ', 1)[1]}, t AS (SELECT table_id, substr(table_text, 1, 40) || ' ( ) a , , b . . c  d ; e 5 % versus in the ' || substr(table_text, 41) || ' !' AS t FROM shapes) SELECT table_id, md5({_polished('t')}) AS text_md5 FROM t"),
    "cluster_dimension": (clusters, f"SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {_q(d)}, {_q(t)})' for k, (d, t) in G.CLUSTERS.items())}) c(cluster, description, template)"),
    "feature_dimension": (feature_names, f"SELECT * FROM (VALUES {', '.join(f'({i}::bigint, {_q(k)})' for i, k in enumerate(T.FEATURES))}) f(position, name)"),
}
