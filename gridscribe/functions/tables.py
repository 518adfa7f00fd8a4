"""Column functions on linearized tables: rows, cells, arms, row and table types, features, routing, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import PERCENT_BEFORE_PAREN, doubles, found, let, plain_numbers

ROW = r"(?s)\[ROW\](.*?)(?=\[ROW\]|end_table)"

# Keywords and patterns that decide types, in the order in which they are tried.
CONTROL_KEYWORDS = (
    "placebo", "vehicle", "soc", "standard of care", "standard care", "best supportive", "observation", "watchful waiting", "chemotherapy", "chemo", "docetaxel",
    "paclitaxel", "cabazitaxel", "carboplatin", "cisplatin", "gemcitabine", "fluorouracil", "control", "comparator", "reference arm",
)
LABEL_COLUMNS = ("event", "parameter", "category", "adverse event", "ae", "term")
SAE_PATTERN = r"(?i)serious adverse|treatment-related sae|treatment emergent sae|\bsaes?\b|serious teae|treatment-emergent serious|fatal|death|died|mortality|grade 5"
SEVERE_PATTERN = r"(?i)grade\s*3[-–]?4|grade\s*3\s*or\s*4|grade\s*3/4|grade\s*[34]\b|\bsevere\b|grade ≥ 3|grade >= 3"
OVERVIEW_PATTERN = r"(?i)\bany\s+teae\b|total.*teae|subjects with teae|treatment[- ]emergent adverse|at least one|overview of teae|summary of teae"
ROW_TYPES = (
    ("disc_drug", r"drug[- ]related.*discontinu|related.*permanent\s*discontinu"),
    ("grade34_drug", r"drug[- ]related.*grade\s*3[-–]?4|related.*grade\s*(3|4)"),
    ("sae_drug", r"drug[- ]related.*saes?|related.*serious"),
    ("teae_drug", r"drug[- ]related.*teae|drug[- ]related.*adverse"),
    ("sae_grade34", r"grade\s*3[-–]?4.*saes?|saes?.*grade\s*3"),
    ("grade34", r"grade\s*3[-–]?4|grade\s*3\s*or\s*4|grade\s*3/4|severe\s*ae|grade\s*[34]\b|grade\s*\d.*neutropenia|grade\s*\d.*\b(ae|teae)\b"),
    ("disc", r"discontinu|leading to.*discontinu"),
    ("sae", r"\bsaes?\b|serious adverse|serious teae"),
    ("fatal", r"fatal|death|died|mortality|grade\s*5"),
    ("teae", r"\bteae|treatment[- ]emergent adverse|with teae|subjects with teae"),
)
TABLE_TYPES = (
    ("adverse_event", ("teae", "sae", "adverse event")), ("demographics", ("demographic", "age", "sex", "gender", "race")),
    ("efficacy", ("efficacy", "response", "survival", "pfs", "os")), ("laboratory", ("laboratory", "lab", "haematology", "hematology")),
)
SPLIT_TYPES = (("adverse_event", ("adverse event", "teae", "sae")), ("demographics", ("demographic", "age", "gender")), ("efficacy", ("efficacy", "response", "survival")))
SLOT_PREFIX = {"teae": "TEAE", "teae_drug": "DR_TEAE", "grade34": "G34", "grade34_drug": "DR_G34", "sae": "SAE", "sae_drug": "DR_SAE", "sae_grade34": "SAE_G34", "disc": "DISC", "disc_drug": "DR_DISC", "fatal": "FATAL"}
FEATURES = (
    "num_count", "max_number", "min_number", "mean_number", "std_number", "pct_count", "max_pct", "min_pct", "mean_pct", "num_arms", "total_patients", "arm_size_ratio",
    "has_high_teae", "has_sae", "has_grade34", "has_discontinuation", "has_death", "arm_pct_difference", "num_comparative_rows", "has_title", "has_headers",
    "table_length_chars", "num_rows", "num_columns", "arm_count", "has_dual_phase", "discontinuation_delta", "grade_3_4_ratio", "sae_drug_related_flag",
    "data_completeness_score", "footnote_count", "n_subjects_imbalance",
)
# End of fixed values.


def raw_rows(text: Column) -> Column:
    """Texts of the rows; a last row without end_table is no row."""
    return found(text, ROW)


def line_rows(text: Column) -> Column:
    """Rows of a text whose rows stand on one line: a row that goes on after a line break is none, as its end is looked for on its line."""
    return found(text, r"\[ROW\](.*?)(?=\[ROW\]|end_table)")


def unmerged(row: Column) -> Column:
    """Cells without those that repeat their left neighbour, as merged cells do."""
    return F.filter(F.transform(row, lambda c, i: F.when((i == 0) | (c != F.get(row, i - 1)), c)), lambda c: c.isNotNull())


def linearized(grid: Column, title: Column) -> Column:
    """A grid (array of rows of cells) as a table text: the first row is the header; rows without any text go, merged cells become one.
    Without a title, or with an empty one, there is no title mark."""
    clean = F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))

    def of(rows: Column) -> Column:
        body = F.filter(F.slice(rows, 2, F.lit(1 << 30)), lambda r: F.exists(r, lambda c: c != ""))
        lines = F.transform(body, lambda r: F.concat(F.lit("[ROW] "), F.array_join(let(r, unmerged), " | ")))
        mark = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("[TABLE_TITLE: "), title, F.lit("] "))).otherwise("")
        head = F.concat(F.lit("[HEADERS: | "), F.array_join(let(F.get(rows, F.lit(0)), unmerged), " | "), F.lit("] "))
        return F.concat(F.lit("start_table "), mark, head, F.array_join(lines, " "), F.lit(" end_table"))

    return let(clean, of)


def cells(row: Column) -> Column:
    return F.transform(F.split(row, r"\|", -1), lambda c: F.trim(c))


def cell_value(cell: Column) -> Column:
    """(n, pct) of `35 (8.5%)`, `35 (8.5)`, `8.5%`, `35`, `8.5`: a missing count is null, a missing percent 0."""
    c = F.replace(F.replace(F.trim(cell), F.lit("\n"), F.lit(" ")), F.lit(","), F.lit(""))
    num = lambda p, g: F.regexp_extract(c, p, g)
    both, pct, whole, dec = r"^(\d+)\s*\((\d+\.?\d*)", r"^(\d+\.?\d*)\s*%", r"^(\d+)$", r"^(\d+\.\d+)$"
    n = F.when(c.rlike(both), num(both, 1).try_cast("int")).when(c.rlike(pct), None).when(c.rlike(whole), num(whole, 1).try_cast("int"))
    p = F.when(c.rlike(both), num(both, 2).try_cast("double")).when(c.rlike(pct), num(pct, 1).try_cast("double")).when(c.rlike(whole), F.lit(0.0)).when(c.rlike(dec), num(dec, 1).try_cast("double"))
    return F.struct(n.alias("n"), F.coalesce(p, F.lit(0.0)).alias("pct"))


def row_type(label: Column) -> Column:
    """The first type whose pattern the label has; null without one."""
    return F.coalesce(*[F.when(F.lower(label).rlike(p), F.lit(name)) for name, p in ROW_TYPES])


def typed(text: Column, table=TABLE_TYPES) -> Column:
    """The first type one of whose words the text has, also inside words; `other` without one."""
    low, out = F.lower(text), None
    for name, keys in table:
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def header(text: Column) -> Column:
    """Parts of the header with their sizes: (label, n), blanks dropped."""
    body = F.regexp_extract(text, r"(?s)\[HEADERS:(.*?)\]", 1)
    parts = F.filter(F.transform(F.split(body, r"\|", -1), lambda p: F.trim(p)), lambda p: p != "")
    bare = lambda p: F.btrim(F.trim(F.regexp_replace(F.regexp_replace(p, r"(?i)\(N\s*=\s*\d+\)", ""), r"(?i)\bN\s*=\s*\d+\b", "")), F.lit(" /|:,"))
    return F.transform(parts, lambda p: F.struct(bare(p).alias("label"), F.regexp_extract(p, r"(?i)N\s*=\s*(\d+)", 1).try_cast("int").alias("n")))


def arms(text: Column) -> Column:
    """(control, experimental, n_control, n_experimental, exp_idx, n_arms): a known label column goes; fewer control words make an arm experimental."""
    low = lambda x: F.lower(x["label"])
    score = lambda x: sum((low(x).contains(k).cast("int") for k in CONTROL_KEYWORDS), F.lit(0))

    def of(h: Column) -> Column:
        drop = (F.size(h) >= 3) & F.try_element_at(h, F.lit(1))["n"].isNull() & low(F.try_element_at(h, F.lit(1))).isin(*LABEL_COLUMNS)
        return let(F.when(drop, F.slice(h, 2, F.lit(1 << 30))).otherwise(h), chosen)

    def chosen(h: Column) -> Column:
        a, b = F.try_element_at(h, F.lit(1)), F.try_element_at(h, F.lit(2))
        first = score(b) > score(a)  # the second is more of a control
        sizes = F.transform(found(text, r"N\s*=\s*(\d+)"), lambda x: x.try_cast("int"))
        some = F.struct(
            F.when(first, b["label"]).otherwise(a["label"]).alias("control"), F.when(first, a["label"]).otherwise(b["label"]).alias("experimental"),
            F.when(first, b["n"]).otherwise(a["n"]).alias("n_control"), F.when(first, a["n"]).otherwise(b["n"]).alias("n_experimental"),
            F.when(first, 0).otherwise(1).alias("exp_idx"), F.size(h).alias("n_arms"))
        none = F.struct(
            F.lit("Control").alias("control"), F.lit("Experimental").alias("experimental"), F.try_element_at(sizes, F.lit(1)).alias("n_control"), F.try_element_at(sizes, F.lit(2)).alias("n_experimental"),
            F.lit(1).alias("exp_idx"), F.when(F.size(sizes) > 0, F.size(sizes)).otherwise(2).alias("n_arms"))
        return F.when(F.size(h) >= 2, some).otherwise(none)

    return let(header(text), of)


def long_rows(df: DataFrame, text_col: str = "table_text") -> DataFrame:
    """One row per table row: (row_index before any filter, label, cells)."""
    rows = df.select("*", F.posexplode(raw_rows(F.col(text_col))).alias("row_index", "raw")).withColumn("cells", cells(F.col("raw")))
    return rows.withColumn("label", F.element_at("cells", 1)).drop("raw")


def parsed_rows(df: DataFrame, text_col: str = "table_text") -> DataFrame:
    """Rows of single events with both arms' values: labelled, no overview rows, two cells, not both percents 0."""
    rows = long_rows(df.withColumn("_exp", arms(F.col(text_col))["exp_idx"]), text_col)
    rows = rows.where((F.size("cells") >= 3) & (F.col("label") != "") & ~F.col("label").rlike(OVERVIEW_PATTERN))
    at = lambda i: cell_value(F.try_element_at("cells", i))
    rows = rows.withColumns({"_d": at(F.col("_exp") + 2), "_c": at(3 - F.col("_exp"))}).where("not (_d.pct = 0 and _c.pct = 0)")
    d, c = F.col("_d.pct"), F.col("_c.pct")
    return rows.withColumns({
        "drug_n": F.col("_d.n"), "drug_pct": d, "ctrl_n": F.col("_c.n"), "ctrl_pct": c, "abs_risk_diff": F.abs(d - c), "risk_dir": F.signum(d - c).cast("int"),
        "relative_risk": F.when(c > 0, d / F.nullif(c, F.lit(0.0))).when(d > 0, 20.0).otherwise(1.0), "is_sae": F.col("label").rlike(SAE_PATTERN), "is_severe": F.col("label").rlike(SEVERE_PATTERN),
    }).drop("_d", "_c", "_exp")


def row_features(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """The twelve features of a row; ranks are against the largest value of its table."""
    table = Window.partitionBy(key)
    rank = lambda c: F.when(F.max(c).over(table) > 0, F.col(c) / F.nullif(F.max(c).over(table), F.lit(0.0))).otherwise(0.0)
    return rows.withColumns({
        "relative_risk": F.least("relative_risk", F.lit(20.0)), "drug_pct_rank": rank("drug_pct"), "abs_diff_rank": rank("abs_risk_diff"),
        "drug_above_5pct": (F.col("drug_pct") > 5).cast("int"), "drug_above_10pct": (F.col("drug_pct") > 10).cast("int"), "diff_above_5pp": (F.col("abs_risk_diff") > 5).cast("int"),
    })


def selected(rows: DataFrame) -> DataFrame:
    """Selection by rule: severe and serious rows and differences of 5 points always, else 5 percent or 3 points; score and reason."""
    d, r = F.col("drug_pct"), F.col("abs_risk_diff")
    override = F.col("is_sae") | F.col("is_severe") | (r >= 5.0)
    raw = (
        F.when(d > 0, F.least(d / 30, F.lit(0.4))).otherwise(0.0) + F.when(r > 0, F.least(r / 20, F.lit(0.4))).otherwise(0.0)
        + F.when(F.col("is_sae"), 0.15).otherwise(0.0) + F.when(F.col("is_severe"), 0.10).otherwise(0.0) + F.when(F.col("relative_risk") > 2, 0.05).otherwise(0.0))
    return rows.withColumns({
        "is_override": override, "selected": override | (d >= 5.0) | (r >= 3.0), "score": F.when(override, 1.0).otherwise(F.least(raw, F.lit(1.0))),
        "reason": F.when(F.col("is_sae"), "serious").when(F.col("is_severe"), "severe").when(r >= 5.0, "difference").otherwise("rule"),
    })


def table_features(text: Column) -> dict[str, Column]:
    """The 32 features of a table, in the order of FEATURES; two pairs of them are equal by definition."""
    low = F.lower(text)
    flag = lambda c: c.cast("int")
    pcts = lambda t: doubles(found(t, PERCENT_BEFORE_PAREN))
    numbers, percents, rows = plain_numbers(text), pcts(text), raw_rows(text)
    sizes = F.transform(found(text, r"N\s*=\s*(\d+)"), lambda x: x.try_cast("double"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    avg = lambda x: F.when(F.size(x) > 0, add(x) / F.nullif(F.size(x), F.lit(0))).otherwise(0.0)
    std = let(numbers, lambda x: let(avg(x), lambda m: F.sqrt(avg(F.transform(x, lambda v: (v - m) * (v - m))))))
    ratio = let(sizes, lambda n: F.when((F.size(n) >= 2) & (F.array_min(n) > 0), F.array_max(n) / F.nullif(F.array_min(n), F.lit(0.0))).otherwise(1.0))
    gap = lambda p: F.when(F.size(p) >= 2, F.abs(F.element_at(p, 1) - F.element_at(p, 2))).otherwise(0.0)
    columns = F.when(text.rlike(r"\[HEADERS:(.*?)\]"), F.size(F.split(F.regexp_extract(text, r"\[HEADERS:(.*?)\]", 1), r"\|", -1))).otherwise(0)
    first = lambda keep: F.try_element_at(F.filter(rows, keep), F.lit(1))
    grade = pcts(first(lambda r: F.lower(r).contains("grade 3") & F.lower(r).contains("teae")))
    teae = pcts(first(lambda r: r.rlike(r"(?i)\bteae\b") & ~F.lower(r).contains("grade")))
    ratio34 = let(grade, lambda g: let(teae, lambda t: F.when((F.size(g) > 0) & (F.try_element_at(t, F.lit(1)) > 0), F.element_at(g, 1) / F.nullif(F.element_at(t, 1), F.lit(0.0))).otherwise(0.0)))
    related = F.exists(F.filter(rows, lambda r: F.lower(r).contains("drug-related") & F.lower(r).contains("sae")), lambda r: F.exists(pcts(r), lambda p: p > 5))
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(F.filter(F.split(r, r"\|", -1), lambda c: F.trim(c) != "")))
    complete = F.when(F.size(rows) > 0, filled / F.nullif(F.size(rows) * F.when(columns > 0, columns).otherwise(2), F.lit(0))).otherwise(1.0)
    bars = lambda r: F.size(F.split(r, r"\|", -1)) - 1
    values = (
        F.size(numbers), F.coalesce(F.array_max(numbers), F.lit(0.0)), F.coalesce(F.array_min(numbers), F.lit(0.0)), let(numbers, avg), std, F.size(percents), F.coalesce(F.array_max(percents), F.lit(0.0)),
        F.coalesce(F.array_min(percents), F.lit(0.0)), let(percents, avg), F.size(sizes), add(sizes), ratio, flag(F.exists(percents, lambda p: p > 50)),
        flag(text.contains("SAE") | low.contains("serious adverse")), flag(text.contains("Grade 3") | text.contains("Grade 4")), flag(low.contains("discontinu")), flag(low.contains("death") | low.contains("fatal")),
        F.coalesce(F.array_max(F.transform(rows, lambda r: let(pcts(r), gap))), F.lit(0.0)), F.regexp_count(text, F.lit(r"\[ROW\]")), flag(text.contains("TABLE_TITLE")), flag(text.contains("HEADERS")), F.length(text),
        F.regexp_count(text, F.lit(r"\[ROW\]")), columns, F.when(F.size(sizes) > 0, F.size(sizes)).otherwise(F.coalesce(F.greatest(F.lit(1), bars(F.try_element_at(rows, F.lit(1)))), F.lit(2))),
        flag((low.contains("double-blind") | low.contains("double blind")) & (low.contains("open-label") | low.contains("open label"))),
        let(pcts(first(lambda r: F.lower(r).contains("discontinu"))), gap), ratio34, flag(related), complete, F.regexp_count(text, F.lit(r"\b[a-d]\b")), ratio)
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in zip(FEATURES, values, strict=True)}


# Fixed: names of the template clusters and the order in which they are tried.
def cluster() -> Column:
    """The template cluster of a table from its feature columns: fourteen, the more specific first."""
    has = lambda c: F.col(c) > 0
    g, s, d = has("has_grade34"), has("has_sae"), has("has_discontinuation")
    rules = (
        (F.col("num_arms") == 1, "C13_single_arm"), (has("has_dual_phase"), "C06_open_label_summary"), (has("has_death") & s, "C04_sae_fatal_emphasis"),
        (has("sae_drug_related_flag") & d, "C08_drug_related_full"), (has("sae_drug_related_flag"), "C02_drug_related_emphasis"), (has("has_high_teae") & g & s & d, "C03_high_incidence_both_arms"),
        (g & s & d, "C01_standard_two_arm_overall"), (g & s, "C11_grade34_no_disc"), (s & d, "C05_no_grade34_sae_only"), (d & (F.col("discontinuation_delta") > 10), "C12_high_discontinuation"),
        (d & ~s & ~g, "C07_minimal_teae_disc"), (~s & ~g & ~d & (F.col("num_rows") >= 4), "C14_individual_ae_listing"), (~s & ~g & ~d, "C10_teae_only"))
    return F.coalesce(*[F.when(c, F.lit(k)) for c, k in rules], F.lit("C09_safety_population_note"))


def overview_slots(df: DataFrame, text_col: str = "table_text", key: str = "table_id") -> DataFrame:
    """(key, prefix, n_a, pct_a, n_b, pct_b): per table and type the first row's value of each part; a percent of 0 counts as missing.

    Several cells of an arm are read together; the header's label column counts among the arms where its name is unknown.
    """
    rows = long_rows(df.withColumn("_a", arms(F.col(text_col))), text_col).where(F.size("cells") >= 3).withColumn("kind", row_type(F.col("label"))).where("kind is not null")
    each = F.greatest(F.lit(1), ((F.size("cells") - 1) / F.greatest(F.lit(2), F.col("_a.n_arms") - 1)).cast("int"))
    arm = lambda i: F.array_join(F.slice("cells", i * each + 2, each), " ")
    rows = rows.withColumns({"_b": multi_value(arm(F.col("_a.exp_idx"))), "_c": multi_value(arm(1 - F.col("_a.exp_idx")))})
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in SLOT_PREFIX.items() for x in kv]), F.col("kind"))
    part = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("row_index")))
    pct = lambda c: F.when(F.col(c) != 0, F.col(c))
    return rows.groupBy(key, prefix.alias("prefix")).agg(part(F.col("_c.n")).alias("n_a"), part(pct("_c.pct")).alias("pct_a"), part(F.col("_b.n")).alias("n_b"), part(pct("_b.pct")).alias("pct_b"))


def multi_value(text: Column) -> Column:
    """(n, pct) of one or more cells: `n (p`, `n p%`, any `p%`, `n`."""
    c = F.trim(F.replace(text, F.lit("|"), F.lit(" ")))
    num = lambda p, g, t: F.regexp_extract(c, p, g).try_cast(t)
    both, apart, pct, whole = r"^(\d+)\s*\((\d+\.?\d*)", r"^(\d+)\s+(\d+\.?\d*)\s*%", r"(\d+\.?\d*)\s*%", r"^(\d+)$"
    n = F.when(c.rlike(both), num(both, 1, "int")).when(c.rlike(apart), num(apart, 1, "int")).when(c.rlike(pct), None).when(c.rlike(whole), num(whole, 1, "int"))
    p = F.when(c.rlike(both), num(both, 2, "double")).when(c.rlike(apart), num(apart, 2, "double")).when(c.rlike(pct), num(pct, 1, "double"))
    return F.struct(n.alias("n"), F.coalesce(p, F.lit(0.0)).alias("pct"))
