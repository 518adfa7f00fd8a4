"""Synthesis queries: other summarisers, decisions and votes, augmentation, oversampling, clusters, adapted write-ups, texts around tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import pages as P, tables as T
from ..operators import adapt as D, augment as A, generation as G, nlg as N, voting as V
from ..operators.clusters import ward_of_all
from ..operators.neighbours import nearest_by_pivots
from ..session import cut
from ..sources.shapes import SHAPES_SQL, shapes
from ..sources.trials import TRIALS_SQL, trials
from .composing import COVERAGE_SQL, facts
from .parsing import KIND_SQL, PREFIX_SQL
from .scoring import rounded


def line_rows(spark, sf_dir):
    """Rows whose end stands on their line, against all rows: here every second row of every third table goes on after a line break."""
    broken = F.regexp_replace("table_text", r"(\[ROW\] [^\[]*?) \[ROW\] ", "$1\n[ROW] ")
    rows = shapes(spark, sf_dir).withColumn("t", F.when(F.col("table_id") % 3 == 0, broken).otherwise(F.col("table_text")))
    return rows.select("table_id", F.size(T.line_rows(F.col("t"))).cast("long").alias("n_line"), F.size(T.raw_rows(F.col("t"))).cast("long").alias("n_all"))


def nlg_events(spark, sf_dir):
    rows = shapes(spark, sf_dir).withColumn("e", N.events_of(F.col("table_text"))).select("table_id", F.col("e.total").alias("total"), F.col("e.control").alias("of_control"), F.explode("e.events").alias("x"))
    return rounded(rows.select("table_id", "total", "of_control", "x.label", "x.drug", "x.control", "x.ratio", F.col("x.sae").alias("sae"), F.col("x.severe").alias("severe")), "total", "of_control", "drug", "control", "ratio")


def forced_decisions(spark, sf_dir):
    rows = shapes(spark, sf_dir).select("table_id", F.explode(N.events_of(F.col("table_text"))["events"]).alias("x"))
    return rows.select("table_id", "x.label", N.forced(F.col("x"), N.rule_score(F.col("x"))).alias("f")).select("table_id", "label", "f.score", "f.decision")


def nlg_summaries(spark, sf_dir):
    return shapes(spark, sf_dir).select("table_id", N.summary_of(F.col("table_text")).alias("summary"))


def older_summaries(spark, sf_dir):
    return shapes(spark, sf_dir).select("table_id", N.older_summary(F.col("table_text")).alias("summary"))


def low_signal_rows(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    return A.low_signal(ids)


def sentence_shuffle(spark, sf_dir):
    return trials(spark, sf_dir).select("table_id", F.md5(A.shuffled(F.col("ml"), "42")).alias("text_md5"))


def varied_tables(spark, sf_dir):
    """Two variants of each table with other sizes and, for some, other arms, with its write-up; and one with its numbers moved by up to 15 percent."""
    told = trials(spark, sf_dir).select("table_id", F.col("reference").alias("writeup"))
    rows = shapes(spark, sf_dir).join(told, "table_id").withColumn("seed", F.explode(F.array(*[F.lit(str(i)) for i in range(3)])))
    moved = F.struct(A.varied_numbers(F.col("table_text"), F.col("seed")).alias("table_text"), F.col("writeup"), F.lit(1.0).alias("scale_factor"))
    return rows.select("table_id", "seed", F.when(F.col("seed") == "2", moved).otherwise(A.varied_table(F.col("table_text"), F.col("writeup"), F.col("seed"))).alias("x")).select("table_id", "seed", "x.*")


def template_examples(spark, sf_dir):
    return A.template_tables(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id")), "id")


FEATURES_6 = ("drug_pct", "ctrl_pct", "abs_risk_diff", "relative_risk", "is_sae", "is_severe")


def labelled_rows(spark, sf_dir) -> DataFrame:
    """Rows of single events with six features, a label, and an id of their own."""
    rows = T.parsed_rows(trials(spark, sf_dir))
    numbers = [F.col(f).cast("double").alias(f) for f in FEATURES_6]
    return rows.select((F.col("table_id") * 100 + F.col("row_index")).alias("id"), "table_id", "row_index", *numbers, (F.col("abs_risk_diff") >= 4).cast("long").alias("label"))


def oversample(spark, sf_dir):
    """The new rows of the rarer class, each with the two rows that it lies between."""
    rows = cut(labelled_rows(spark, sf_dir).drop("table_id", "row_index"))
    made = A.new_points(rows, FEATURES_6, "label", "id", lambda v, k: nearest_by_pivots(v, v, k, metric="euclidean")[0])
    if made is None:
        made = rows.limit(0).select(F.col("id").alias("parent"), F.col("id").alias("other"), F.lit(1).alias("t"), *FEATURES_6, "label")
    return rounded(made.withColumn("t", F.col("t").cast("long")), *FEATURES_6)


def event_clusters(spark, sf_dir):
    rows = A.ward_clusters(labelled_rows(spark, sf_dir), "table_id", "row_index", FEATURES_6)
    return rows.select("table_id", F.col("row_index").cast("long").alias("row_index"), "cluster")


def row_clusters(spark, sf_dir):
    """Ward clusters of the rows of all tables together."""
    return ward_of_all(labelled_rows(spark, sf_dir), "id", FEATURES_6, 4.0)


def _fold_scores(spark, sf_dir) -> DataFrame:
    return V.out_of_fold(cut(labelled_rows(spark, sf_dir)), V.tree_and_line_learners(("drug_pct", "ctrl_pct", "relative_risk", "is_sae", "is_severe")))


def fold_vote(spark, sf_dir):
    """Each row by the weighted vote of three learners, none of which was fitted on it."""
    return V.voted(cut(_fold_scores(spark, sf_dir)))[0]


def fold_weights(spark, sf_dir):
    """Area under the curve and weight of each learner, over rows that it was not fitted on."""
    return V.voted(cut(_fold_scores(spark, sf_dir)))[1]


MODELS = ("by_share", "by_gap", "by_ratio")


def ensemble_vote(spark, sf_dir):
    """Three scores of each row, weighted by their areas under the curve on the labels, which are brought to a sum of one."""
    rows = labelled_rows(spark, sf_dir).select("id", "label", F.round(F.least(F.col("drug_pct") / 100, F.lit(1.0)), 4).alias("by_share"), F.round(F.least(F.col("abs_risk_diff") / 20, F.lit(1.0)), 4).alias("by_gap"), F.round(F.least(F.col("relative_risk") / 20, F.lit(1.0)), 4).alias("by_ratio"))
    weights = V.areas(rows.unpivot(["id", "label"], list(MODELS), "model", "score")).groupBy().pivot("model", list(MODELS)).agg(F.max("auc"))
    rows = rows.join(F.broadcast(weights.withColumnsRenamed({m: f"w_{m}" for m in MODELS})))
    score = A.vote({m: F.col(m) for m in MODELS}, {m: F.col(f"w_{m}") for m in MODELS})
    return rounded(rows.select("id", score.alias("score"), (score > 0.5).alias("told")), "score")


def historical_slots(spark, sf_dir):
    return shapes(spark, sf_dir).select("table_id", F.explode(D.last_slots(F.col("table_text"))).alias("slot", "value"))


def slot_coverage(spark, sf_dir):
    """Slots of each table's cluster template that the table has and that it lacks."""
    from .composing import clustered

    rows = clustered(spark, sf_dir).withColumns({"slots": G.slots_of(F.col("table_text")), "t": F.try_element_at(G.cluster_templates(), F.col("cluster"))})
    names = F.array_distinct(F.regexp_extract_all("t", F.lit(r"\{([A-Z0-9_]+)\}"), 1))
    rows = rows.withColumns({"needed": names, "known": F.map_keys("slots")})
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select("table_id", join(F.array_intersect("needed", "known")).alias("filled"), join(F.array_except("needed", "known")).alias("missing"))


def page_texts(spark, sf_dir) -> DataFrame:
    caption = lambda k: F.concat(F.lit(f"Table {k}: events of study "), F.col("table_id").cast("string"))
    page = F.concat_ws("\n", F.lit("intro"), caption(1), F.lit("x"), F.when(F.col("table_id") % 2 == 0, caption(2)))
    tail = F.when(F.col("table_id") % 3 == 0, F.concat(F.lit("\nOverall, "), F.col("ml"), F.lit("\n\nnext"))).when(F.col("table_id") % 3 == 1, F.concat(F.lit("\nA total of no digits "), F.lit("x" * 60), F.lit("\n\n"), F.lit("Subjects in the "), F.col("reference"))).otherwise("")
    return trials(spark, sf_dir).select("table_id", F.concat(page, tail).alias("page"))


def captions(spark, sf_dir):
    rows = page_texts(spark, sf_dir)
    first = F.when(F.col("table_id") % 5 == 0, F.array(F.lit("Table 9"), F.lit("rows"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    name = F.concat(F.lit("safety_run-"), F.col("table_id").cast("string"))
    return rows.select("table_id", *[P.caption(F.col("page"), F.lit(i)).alias(f"caption_{i}") for i in (0, 1)], P.inferred_title(first, name, F.lit(1)).alias("inferred"))


def writeups(spark, sf_dir):
    return page_texts(spark, sf_dir).select("table_id", F.md5(P.writeup(F.col("page"))).alias("writeup_md5"))


def recovered_items(spark, sf_dir):
    """Objects of model outputs: bare, fenced, with words around them, broken, and with other values between."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    one = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))
    items = F.concat(F.lit("["), one, F.lit(", 7, "), one, F.lit("]"))
    kinds = F.array(items, F.concat(F.lit("Here:\n```json\n"), items, F.lit("\n```\nbye")), F.concat(F.lit("see [1] and "), items, F.lit(" end")), F.concat(F.lit("["), one), F.lit("none"))
    text = F.get(kinds, (F.col("event_id") % 5).cast("int"))
    got = F.from_json(P.recovered_json(text), "array<struct<id: bigint, kind: string>>")
    return e.select("event_id", F.explode_outer(got).alias("x")).groupBy("event_id").agg(F.count("x").alias("n"), F.max("x.id").alias("id"), F.max("x.kind").alias("kind"))


def boxes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    rows = e.select("user_id", "event_id", (F.col("event_id") * 13 % 50).alias("x"), (F.col("event_id") * 7 % 60).alias("y"), F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("word"))
    out = P.box_rows(rows, ("user_id",), "event_id", "x", "y", "word")
    return out.select("user_id", F.col("row").cast("long").alias("row"), F.md5(F.array_join("cells", " ")).alias("cells_md5"))


def positional_zip(spark, sf_dir):
    """Customers with suppliers by position."""
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    return P.zipped(a, b, "c_custkey", "s_suppkey").select("position", "c_custkey", "s_suppkey")


def random_sample(spark, sf_dir, n: int = 2000):
    """The documents with the smallest hashes, in the order of these: the same sample on every run."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", h.alias("h")).orderBy("h").limit(n).select("doc_id")


def batched(df: DataFrame, most: int = 50) -> DataFrame:
    """df, if it has so many rows at most; more are an error, as a batch is answered at once."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a batch has {most} rows at most")
    return df


# -- SQL ------------------------------------------------------------------------------------------------------------
_S = f"WITH {SHAPES_SQL}"
_U = lambda key, salt: f"cast('0x' || substr(md5({key} || ':{salt}'), 1, 8) AS bigint) / 4294967296.0::double"
_PCT = lambda c: f"coalesce(try_cast(nullif(regexp_extract({c}, '\\(?(\\d+\\.?\\d*)\\s*%\\)?', 1), '') AS double), 0)"
_EVENTS = f"""{_S}, c AS (SELECT *, string_split(label || ' | ' || cells, ' | ') AS c, lower(label) AS low FROM shaped_rows),
v AS (SELECT *, {_PCT('c[-1]')} AS drug, CASE WHEN shape = 2 THEN 0 ELSE {_PCT('c[2]')} END AS control, regexp_matches(low, 'serious|sae|fatal|death') AS sae, regexp_matches(low, 'grade 3|grade 4|severe') AS severe FROM c),
w AS (SELECT *, regexp_matches(low, 'any teae|overall') OR low = 'teae' OR (contains(low, 'subjects with') AND NOT sae AND NOT severe) AS whole FROM v),
x AS (SELECT *, drug / (control + 0.001) AS ratio, coalesce(arg_min(drug, row_index) FILTER (WHERE whole AND drug <> 0) OVER t, max(drug) FILTER (WHERE NOT whole) OVER t, 0) AS total,
  coalesce(arg_min(control, row_index) FILTER (WHERE whole AND drug <> 0) OVER t, max(control) FILTER (WHERE NOT whole) OVER t, 0) AS of_control FROM w WINDOW t AS (PARTITION BY table_id))"""
_LAB = f"""WITH {TRIALS_SQL}, lab AS (SELECT table_id * 100 + pos AS id, t_b / 10 AS drug_pct, abs(t_b / 10 - t_a / 10) AS diff, CASE WHEN t_a > 0 THEN (t_b / 10) / (t_a / 10) WHEN t_b > 0 THEN 20 ELSE 1 END AS rr
  FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_index) - 1 AS pos FROM counted) WHERE row_index > 1 AND NOT (t_a = 0 AND t_b = 0)),
scored AS (SELECT id, (diff >= 4)::int AS label, round(least(drug_pct / 100, 1), 4) AS by_share, round(least(diff / 20, 1), 4) AS by_gap, round(least(rr / 20, 1), 4) AS by_ratio FROM lab)"""
_SIX = f"""WITH {TRIALS_SQL}, six AS (SELECT id, drug_pct, ctrl_pct, abs(drug_pct - ctrl_pct) AS abs_risk_diff, CASE WHEN ctrl_pct > 0 THEN least(drug_pct / ctrl_pct, 20) WHEN drug_pct > 0 THEN 20 ELSE 1 END::double AS relative_risk, is_sae, is_severe, (abs(drug_pct - ctrl_pct) >= 4)::bigint AS label
  FROM (SELECT table_id * 100 + row_number() OVER (PARTITION BY table_id ORDER BY row_index) - 1 AS id, row_index, t_b / 10 AS drug_pct, t_a / 10 AS ctrl_pct, regexp_matches(label, 'SAE|Fatal')::int::double AS is_sae, regexp_matches(label, 'Grade 3-4')::int::double AS is_severe FROM counted)
  WHERE row_index > 1 AND NOT (drug_pct = 0 AND ctrl_pct = 0))"""
_AUC = lambda m: f"(SELECT sum(CASE WHEN n.{m} < p.{m} THEN 1.0 WHEN n.{m} = p.{m} THEN 0.5 ELSE 0 END) / count(*) FROM scored p, scored n WHERE p.label = 1 AND n.label = 0)"
_PAGES = f"""WITH {TRIALS_SQL}, pages AS (SELECT table_id, 'intro' || chr(10) || 'Table 1: events of study ' || table_id || chr(10) || 'x' || CASE WHEN table_id % 2 = 0 THEN chr(10) || 'Table 2: events of study ' || table_id ELSE '' END AS head,
  CASE table_id % 3 WHEN 0 THEN 'Overall, ' || ml WHEN 1 THEN 'Subjects in the ' || reference ELSE '' END AS told FROM trials)"""
_PARTS = (("n_b", "N_B"), ("p_b", "PCT_B"), ("n_a", "N_A"), ("p_a", "PCT_A"))
#: By single cells: in shape 7 the control's cell holds its count and the drug's the control's percent; in shape 1 there are no percent signs but counts with brackets.
_LAST = f"""{_S}, kinds AS (SELECT table_id, row_index, {KIND_SQL} AS kind, CASE WHEN shape <> 6 THEN n_a END AS n_a, CASE WHEN shape NOT IN (6, 7) THEN n_b END AS n_b,
    CASE WHEN shape = 7 THEN NULL ELSE nullif(t_a / 10, 0) END AS p_a, nullif(CASE WHEN shape = 7 THEN t_a ELSE t_b END / 10, 0) AS p_b FROM shaped_rows WHERE shape <> 2),
  prefixed AS (SELECT *, {PREFIX_SQL} AS prefix FROM kinds WHERE kind IS NOT NULL),
  last AS ({' UNION ALL '.join(f"SELECT table_id, prefix || '_{k}' AS slot, cast(arg_max({c}, row_index) AS varchar) AS value FROM prefixed WHERE {c} IS NOT NULL GROUP BY ALL" for c, k in _PARTS)})"""
_KINDS = (("TEAE", "Any TEAE", 82, 99), ("G34", "Grade 3-4 AE", 20, 65), ("SAE", "SAE", 10, 45), ("DISC", "Discontinuation due to AE", 3, 25))
_DRAWN = ", ".join([*(f"floor(100 + 501 * ({_U('s_suppkey', f'n{x}')}))::bigint AS n{x}" for x in "ab"), *(f"{lo} + {hi - lo} * ({_U('s_suppkey', f'{k}{x}')}) AS {k}_{x}" for k, _, lo, hi in _KINDS for x in "ab")])
_CELL = lambda k, x: f"round(n{x} * {k}_{x} / 100)::bigint || ' (' || round({k}_{x}, 1) || '%)'"
_MADE_TABLE = " || ".join(["'start_table [HEADERS: | Event | Drug B (N=' || na || ') | Placebo (N=' || nb || ')]'", *(f"' [ROW] {label} | ' || {_CELL(k, 'a')} || ' | ' || {_CELL(k, 'b')}" for k, label, *_ in _KINDS), "' end_table'"])
_MADE_TEXT = " || ' ' || ".join(f"'{label} was reported in ' || {_CELL(k, 'a')} || ' of subjects in the Drug B arm and ' || {_CELL(k, 'b')} || ' in the Placebo arm.'" for k, label, *_ in _KINDS)

QUERIES = {
    "line_rows": (line_rows, f"{_S}, n AS (SELECT table_id, count(*) AS n FROM shaped_rows GROUP BY table_id) SELECT table_id, CASE WHEN table_id % 3 = 0 THEN n - n // 2 ELSE n END AS n_line, n AS n_all FROM n"),
    "nlg_events": (nlg_events, f"{_EVENTS} SELECT table_id, round(total, 6) AS total, round(of_control, 6) AS of_control, label, round(drug, 6) AS drug, round(control::double, 6) AS control, round(ratio, 6) AS ratio, sae, severe FROM x WHERE NOT whole"),
    "forced_decisions": (forced_decisions, f"{_EVENTS} SELECT table_id, label, CASE WHEN sae OR severe OR drug >= 5 THEN 1.0::double ELSE 0.0::double END AS score, CASE WHEN sae OR severe THEN 'told by rule' WHEN drug >= 5 THEN 'told by model' ELSE 'left out' END AS decision FROM x WHERE NOT whole"),
    "nlg_summaries": (nlg_summaries, None),
    "older_summaries": (older_summaries, None),
    "low_signal_rows": (low_signal_rows, f"""WITH u AS (SELECT s_suppkey AS id, 0.1 + 4.8 * {_U('s_suppkey', 'placebo')} AS c, -1.5 + 3.0 * {_U('s_suppkey', 'diff')} AS r FROM supplier), d AS (SELECT *, greatest(c + r, 0.1) AS d FROM u)
      SELECT id, round(d, 1) AS drug_pct, round(c, 1) AS placebo_pct, round(r, 1) AS risk_diff, round(d / (c + 0.001), 2) AS relative_risk, 0::bigint AS is_sae, 0::bigint AS is_severe, 0::bigint AS label FROM d"""),
    "sentence_shuffle": (sentence_shuffle, f"""WITH {TRIALS_SQL}, p AS (SELECT table_id, ml, list_transform(string_split(ml, '. '), lambda x, i: CASE WHEN i < len(string_split(ml, '. ')) THEN x || '.' ELSE x END) AS s FROM trials),
      m AS (SELECT table_id, ml, s, unnest(s[2:-2]) AS x, unnest(range(0, len(s[2:-2]))) AS i FROM p), o AS (SELECT table_id, string_agg(x, ' ' ORDER BY md5(x || ':42' || i), x) AS mid FROM m GROUP BY table_id)
      SELECT table_id, md5(CASE WHEN len(s) < 3 THEN ml ELSE s[1] || ' ' || mid || ' ' || s[-1] END) AS text_md5 FROM p LEFT JOIN o USING (table_id)"""),
    "varied_tables": (varied_tables, None),
    "template_examples": (template_examples, f"WITH d AS (SELECT s_suppkey AS id, {_DRAWN} FROM supplier) SELECT id, {_MADE_TABLE} AS table_text, {_MADE_TEXT} AS writeup FROM d"),
    "oversample": (oversample, f"""{_SIX}, n AS (SELECT label, count(*) AS n FROM six GROUP BY label), rare AS (SELECT arg_min(label, (n, label)) AS label, max(n) - min(n) AS lacking, min(n) AS own FROM n HAVING count(*) = 2 AND max(n) > min(n)),
      few AS (SELECT six.*, lacking, own, row_number() OVER (ORDER BY md5(cast(id AS varchar)), id) AS place FROM six JOIN rare USING (label)),
      times AS (SELECT *, unnest(range(1, lacking // own + CASE WHEN place <= lacking % own THEN 1 ELSE 0 END + 1)) AS t FROM few),
      d AS (SELECT a.id AS q, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt({' + '.join(f'power(a.{f} - b.{f}, 2)' for f in FEATURES_6)}), 9), b.id) AS r FROM few a JOIN few b ON a.id <> b.id),
      l AS (SELECT q, list(other ORDER BY r) AS ids FROM d WHERE r <= 5 GROUP BY q),
      u AS (SELECT times.*, {_U("id || '/' || t", 'smote')} AS u, coalesce(ids[floor({_U("id || '/' || t", 'smote-of')} * len(ids))::int + 1], id) AS other FROM times LEFT JOIN l ON q = id)
      SELECT u.id AS parent, u.other, u.t, {', '.join(f'round(u.{f} + u.u * (o.{f} - u.{f}), 6) AS {f}' for f in FEATURES_6)}, u.label FROM u JOIN few o ON o.id = u.other"""),
    "event_clusters": (event_clusters, None),
    "row_clusters": (row_clusters, None),
    "fold_vote": (fold_vote, None),
    "fold_weights": (fold_weights, None),
    "ensemble_vote": (ensemble_vote, f"{_LAB}, w AS (SELECT {', '.join(f'{_AUC(m)} AS w_{m}' for m in MODELS)}), v AS (SELECT id, ({' + '.join(f'{m} * w_{m}' for m in MODELS)}) / ({' + '.join(f'w_{m}' for m in MODELS)}) AS score FROM scored, w) SELECT id, round(score, 6) AS score, score > 0.5 AS told FROM v"),
    "historical_slots": (historical_slots, f"{_LAST} SELECT * FROM last"),
    "slot_coverage": (slot_coverage, COVERAGE_SQL),
    "captions": (captions, f"""{_PAGES} SELECT table_id, 'Table 1: events of study ' || table_id AS caption_0, CASE WHEN table_id % 2 = 0 THEN 'Table 2: events of study ' || table_id ELSE '' END AS caption_1,
      CASE WHEN table_id % 5 = 0 THEN 'Table 9 rows' ELSE 'Table 2: Safety Run ' || table_id END AS inferred FROM pages"""),
    "writeups": (writeups, f"{_PAGES} SELECT table_id, md5(CASE WHEN length(regexp_extract(told, '(?s)^(?:Overall, |Subjects in the )(.*)$', 1)) <= 800 THEN told ELSE '' END) AS writeup_md5 FROM pages"),
    "recovered_items": (recovered_items, "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 2 ELSE 0 END::bigint AS n, CASE WHEN event_id % 5 < 3 THEN event_id END AS id, CASE WHEN event_id % 5 < 3 THEN event_type END AS kind FROM events"),
    "box_rows": (boxes, """WITH b AS (SELECT user_id, event_id, event_id * 13 % 50 AS x, event_id * 7 % 60 AS y FROM events), g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 15 THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::bigint AS row FROM g) SELECT user_id, row, md5(string_agg('w' || event_id, ' ' ORDER BY x, event_id)) AS cells_md5 FROM r GROUP BY user_id, row"""),
    "positional_zip": (positional_zip, "SELECT a.p AS position, c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) b ON a.p = b.p"),
    "random_sample": (random_sample, "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42') LIMIT 2000"),
}
