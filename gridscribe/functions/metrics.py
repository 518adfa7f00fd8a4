"""Metrics of a generated text against its table and reference, as columns over arrays that stay within a row.

No metric joins or shuffles: numbers of a table are some dozens, so tolerant semi-, anti- and nearest joins are array functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .bertscore import bert_scores
from .text import SEVERITY, arm_values, extract_numbers, facts, let, near, plain_numbers, sentences, token_numbers, tokens

TOLERANCE = 0.01


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(0.0))


def share(part: Column, of: Column, empty: float) -> Column:
    return F.when(of > 0, part / of).otherwise(F.lit(empty))


def ungrounded(numbers: Column, source: Column, tolerance: float = TOLERANCE) -> Column:
    """Distinct numbers without one of the source within the relative tolerance. Those that the source has as they are, by far the most, go first."""
    return F.filter(F.array_except(numbers, source), lambda g: ~F.exists(source, lambda s: near(g, s, tolerance)))


def nearest(number: Column, source: Column) -> Column:
    """The source number at the least distance, the first of equal ones."""
    return F.array_min(F.transform(source, lambda s, i: F.struct(F.abs(number - s).alias("d"), i.alias("i"), s.alias("s"))))["s"]


def nar(gen: Column, src: Column) -> Column:
    return F.when(F.size(gen) == 0, F.lit(1.0)).otherwise(1 - F.size(ungrounded(gen, src)) / F.size(gen))


def hallucinated(sents: Column, bad: Column) -> Column:
    """Sentences that hold one of the text's ungrounded numbers. No number goes beyond a sentence, so the text's are those of its sentences."""
    return F.when(F.size(bad) > 0, F.filter(sents, lambda s: F.arrays_overlap(extract_numbers(s), bad))).otherwise(F.slice(sents, 1, 0))


def omitted(source_facts: Column, gen: Column) -> Column:
    """Facts none of whose numbers has one of the text within the tolerance; the fact's number is the base."""
    return F.filter(source_facts, lambda f: ~F.exists(f["numbers"], lambda n: F.exists(gen, lambda g: near(g, n, TOLERANCE))))


def paired(gen: Column, src: Column) -> Column:
    """(g, s): each number of the text with the nearest of the source, which is itself where the source has it."""
    return F.transform(gen, lambda g: F.struct(g.alias("g"), F.when(F.array_contains(src, g), g).otherwise(nearest(g, src)).alias("s")))


def relative(pairs: Column) -> Column:
    return F.transform(pairs, lambda x: F.abs(x["g"] - x["s"]) / F.greatest(F.abs(x["s"]), F.lit(0.01)))


def ndi(gen: Column, src: Column, pairs: Column | None = None) -> Column:
    """Mean relative distance to the nearest source number; 0 without numbers, 1 without source numbers."""
    pairs = paired(gen, src) if pairs is None else pairs
    return F.when(F.size(gen) == 0, F.lit(0.0)).when(F.size(src) == 0, F.lit(1.0)).otherwise(mean(relative(pairs)))


def risk_index(gen: Column, src: Column, sign: int, pairs: Column | None = None) -> Column:
    """Mean relative size of differences to the nearest source number beyond half a unit to one side."""
    moved = F.filter(paired(gen, src) if pairs is None else pairs, lambda x: sign * (x["g"] - x["s"]) > 0.5)
    return F.when((F.size(gen) > 0) & (F.size(src) > 0), let(relative(moved), mean)).otherwise(F.lit(0.0))


def contraindication_omission(gen: Column, src: Column) -> Column:
    """Of death and discontinuation, as far as the source has them: the share that the text leaves out."""
    has = [(F.lower(src).rlike(p), F.lower(gen).rlike(p)) for p in (r"\bfatal\b|\bdeath\b|\bdied\b", r"\bdiscontinu")]
    there = sum((s.cast("int") for s, _ in has), F.lit(0))
    gone = sum(((s & ~g).cast("int") for s, g in has), F.lit(0))
    return share(gone, there, 0.0)


def owned_values(gen_pairs: list[Column], src_pairs: list[Column]) -> Column:
    """For each arm the distinct values of the text near any arm that the source has first near this one."""
    owner = lambda v: F.coalesce(*[F.when(F.array_contains(values, v) | F.exists(values, lambda s: near(v, s, TOLERANCE)), F.lit(k)) for k, values in enumerate(src_pairs)])
    values = F.transform(F.array_distinct(F.concat(*gen_pairs)), lambda v: F.struct(v.alias("v"), owner(v).alias("o")))
    return let(values, lambda x: F.array(*[F.transform(F.filter(x, lambda y: y["o"] == k), lambda y: y["v"]) for k in range(len(src_pairs))]))  # noqa: B023


def confusion(gen_pairs: list[Column], src_pairs: list[Column]) -> Column:
    """(confused, evaluated): values near an arm in the text that the source has first near another arm; repeats count. Owners are found once for each distinct value."""

    def counted(owned: Column) -> Column:
        hits = [[F.size(F.filter(values, lambda v: F.array_contains(F.get(owned, F.lit(o)), v))) for o in range(len(gen_pairs))] for values in gen_pairs]  # noqa: B023
        confused = sum((n for k, of in enumerate(hits) for o, n in enumerate(of) if o != k), F.lit(0))
        return F.struct(confused.alias("confused"), sum((n for of in hits for n in of), F.lit(0)).alias("evaluated"))

    return let(owned_values(gen_pairs, src_pairs), counted)


def delta_error(gen: list[Column], src: list[Column]) -> Column:
    """Difference between the arms' largest values, in the text against the source; 0 where an arm has none."""
    some = (F.size(gen[0]) > 0) & (F.size(gen[1]) > 0) & (F.size(src[0]) > 0) & (F.size(src[1]) > 0)
    gap = lambda x: F.abs(F.array_max(x[0]) - F.array_max(x[1]))
    return F.when(some, F.abs(gap(gen) - gap(src))).otherwise(F.lit(0.0))


def safety(nar_: Column, hr: Column, omission: Column, acr: Column) -> Column:
    return 0.35 * nar_ + 0.25 * (1 - hr) + 0.20 * (1 - omission) + 0.20 * (1 - acr)


def fluency(rouge_l: Column, bert: Column, meteor: Column) -> Column:
    return F.least(0.30 * rouge_l + 0.45 * bert + 0.25 * meteor, F.lit(1.0))


def common_length(a, b) -> int:
    """Length of the longest common subsequence of two lists, a row of the table as the bits of one integer."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """common_length of two token arrays, in Arrow batches; 0 for a null."""
    return pd.Series([0 if x is None or y is None else common_length(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge(gen: Column, ref: Column) -> dict[str, Column]:
    """Token overlap without a stemmer: unigram share of the text's distinct tokens, 0.6 of it, and LCS over the reference."""
    g, r = tokens(gen), tokens(ref)
    some = (F.size(g) > 0) & (F.size(r) > 0)
    one = F.size(F.array_intersect(g, r)) / F.size(F.array_distinct(g))
    return {
        "rouge_1": F.when(some, one).otherwise(F.lit(0.0)), "rouge_2": F.when(some, one * 0.6).otherwise(F.lit(0.0)),
        "rouge_l": F.when(some, lcs(r, g) / F.size(r)).otherwise(F.lit(0.0))}


def meteor_proxy(gen: Column, ref: Column) -> Column:
    g, r = F.array_distinct(tokens(gen)), F.array_distinct(tokens(ref))
    hits = F.size(F.array_intersect(g, r))
    p, q = hits / F.greatest(F.size(g), F.lit(1)), hits / F.greatest(F.size(r), F.lit(1))
    return 10 * p * q / F.greatest(9 * p + q, F.lit(1e-9))


def bert_proxy(rouge_l: Column) -> Column:
    return F.least(0.72 + rouge_l * 0.22, F.lit(0.97))


def fk_grade(text: Column) -> Column:
    """Words per sentence mark and vowel groups per word, trailing e and s cut first."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    stops = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.regexp_count(F.regexp_replace(F.lower(w), "[es]+$", ""), F.lit("[aeiouy]+")), F.lit(1)))
    return F.when(F.length(text) > 0, 0.39 * (n / stops) + 11.8 * (syllables / n) - 15.59).otherwise(F.lit(0.0))


def value_hallucination(gen: Column, source: Column, tolerance: float, allowed: tuple[float, ...]) -> Column:
    """Share of all numbers of the text, repeats included, that are neither allowed nor within the absolute tolerance of a source number."""
    g, s = plain_numbers(F.regexp_replace(F.coalesce(gen, F.lit("")), r"(?i)\btable\s+\d+(\.\d+)*", " ")), plain_numbers(source)
    return let(s, lambda src: let(g, lambda n: share(F.size(F.filter(n, lambda x: ~x.isin(*allowed) & ~F.exists(src, lambda y: F.abs(x - y) <= tolerance))), F.size(n), 0.0)))


def accuracy_vs_reference(gen: Column, ref: Column, tolerance: float = 1.01) -> Column:
    """Share of the reference's numbers, repeats included, that the text has within the tolerance; 1 without numbers."""
    g, r = plain_numbers(gen), plain_numbers(ref)
    return let(g, lambda n: let(r, lambda m: share(F.size(F.filter(m, lambda x: F.exists(n, lambda y: F.abs(x - y) <= tolerance))), F.size(m), 1.0)))


#: Array columns that hang on the table alone, besides its arms' values _s0, _s1, ...
SOURCE_SIDE = ("_src", "_facts")


def with_source_side(df: DataFrame, arms: tuple[str, ...], radius: int = 30, table=SEVERITY, text_col: str = "table_text") -> DataFrame:
    """df with the numbers and facts of its tables and the values near their arms. Before texts of one table become rows of their own, so that each table is read once."""
    src = F.col(text_col)
    df = df.withColumns({"_src": extract_numbers(src), "_facts": facts(src, table), "_sread": token_numbers(src)})
    return df.withColumns({f"_s{k}": arm_values(F.col("_sread"), a, radius) for k, a in enumerate(arms)}).drop("_sread")


def evaluate(df: DataFrame, arms: tuple[str, ...], radius: int = 30, table=SEVERITY) -> DataFrame:
    """df (generated, reference, table_text, ...) with all grounded metrics, in one pass without a shuffle.

    What hangs on the tables is taken from with_source_side, of the same arms, radius and severity words, if df has it.
    """
    gen, src = F.col("generated"), F.col("table_text")
    if not set(SOURCE_SIDE) <= set(df.columns):
        df = with_source_side(df, arms, radius, table)
    rows = df.withColumns({"_gen": extract_numbers(gen), "_sents": sentences(gen), "_gread": token_numbers(gen)})
    rows = rows.withColumns({f"_g{k}": arm_values(F.col("_gread"), a, radius) for k, a in enumerate(arms)})
    g, s = F.col("_gen"), F.col("_src")
    gp, sp = [F.col(f"_g{k}") for k in range(len(arms))], [F.col(f"_s{k}") for k in range(len(arms))]
    rows = rows.withColumns({"_gone": omitted(F.col("_facts"), g), "_lost": ungrounded(g, s), "_arms": confusion(gp, sp), "_pairs": F.when(F.size(s) > 0, paired(g, s))})
    rows = rows.withColumn("_bad", hallucinated(F.col("_sents"), F.col("_lost")))
    lost, pairs = F.size("_lost"), F.col("_pairs")
    tiers = lambda c: F.aggregate(F.col(c), F.lit(0), lambda a, f: a + f["tier"])
    rows = rows.withColumns({
        "nar": F.when(F.size(g) == 0, F.lit(1.0)).otherwise(1 - lost / F.size(g)), "hr": share(F.size("_bad"), F.size("_sents"), 0.0), "or_score": share(F.size("_gone"), F.size("_facts"), 0.0), "swos": share(tiers("_gone"), tiers("_facts"), 0.0),
        "ndi": ndi(g, s, pairs), "rdi": risk_index(g, s, -1, pairs), "rii": risk_index(g, s, 1, pairs), "cor": contraindication_omission(gen, src),
        "acr": share(F.col("_arms.confused"), F.col("_arms.evaluated"), 0.0) if len(arms) > 1 else F.lit(0.0), "dpe": delta_error(gp, sp) if len(arms) > 1 else F.lit(0.0),
        "n_source_nums": F.size(s).cast("long"), "n_output_nums": F.size(g).cast("long"), "n_halluc_sents": F.size("_bad").cast("long"), "n_total_sents": F.size("_sents").cast("long"),
    })
    rows = rows.withColumn("safety_score", safety(F.col("nar"), F.col("hr"), F.col("or_score"), F.col("acr")))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def tiers_lost(gone: Column, all_facts: Column) -> Column:
    """How many facts of each severity tier the source has and the text leaves out: a map tier -> (omitted, total)."""
    count = lambda x, t: F.size(F.filter(x, lambda f: f["tier"] == t)).cast("long")
    return F.create_map(*[x for t in (1, 2, 3, 4) for x in (F.lit(t), F.struct(count(gone, t).alias("omitted"), count(all_facts, t).alias("total")))])


def omission_reading(swos: Column, omission: Column) -> Column:
    """What weighting by severity says against the plain omission rate, with a margin of 0.05."""
    return F.when(swos > omission + 0.05, "severe facts go first").when(swos < omission - 0.05, "severe facts stay").otherwise("even")


#: Every metric of a text, in the order of the report, by what it is made from.
TEXT_METRICS = ("rouge_1", "rouge_2", "rouge_l", "bertscore_f1", "meteor")
TABLE_METRICS = ("nar", "hr", "or_score", "swos", "ndi", "acr", "rdi", "rii", "cor", "dpe")
ALL_METRICS = (*TEXT_METRICS, "fk_grade", *TABLE_METRICS)
_SCORES = StructType([*(StructField(c, DoubleType()) for c in ("rouge_1", "rouge_2", "rouge_l", "meteor")), StructField("errors", ArrayType(StringType()))])


def text_scores_by(thesaurus: str | None = None):
    """Column function (generated, reference) -> ROUGE with stems and METEOR, with the synonyms of the thesaurus if one is given. Each by itself: what one cannot score is 0 there and named, and
    the other stays."""

    @F.pandas_udf(_SCORES)
    def scored(generated: pd.Series, reference: pd.Series) -> pd.DataFrame:
        from .meteor import meteor, synonyms_of
        from .rouge import scores

        out = []
        for g, r in zip(generated, reference):
            errors, rouge_, meteor_ = [], (0.0, 0.0, 0.0), 0.0
            try:
                rouge_ = scores(g, r)
            except Exception as e:
                errors.append(f"rouge: {e}")
            try:
                meteor_ = meteor(g, r, synonyms_of(thesaurus) if thesaurus else None)
            except Exception as e:
                errors.append(f"meteor: {e}")
            out.append((*rouge_, meteor_, errors))
        return pd.DataFrame(out, columns=[f.name for f in _SCORES.fields])

    return scored


text_scores = text_scores_by()


def evaluate_whole(df: DataFrame, arms: tuple[str, ...], radius: int = 30, table=SEVERITY, model: str | None = None, thesaurus: str | None = None) -> DataFrame:
    """df (generated, reference, table_text, ...) with ALL_METRICS, safety_score and fluency_score, the counts of evaluate(), and errors (array of text).

    A metric that cannot be had leaves the others as they are: it is 0, and an entry of errors says of what kind it is and why. A missing text touches the metrics that read it: without a
    reference ROUGE, METEOR and BERTScore, without a table those that hold the text against it, without the text itself all. bertscore_f1 is by the transformer of the folder `model`
    (functions.bertscore); without one it is 0 everywhere, as in the suite whose library is missing, and fluency is made from what there is. METEOR takes the
    synonyms of the table `thesaurus` (functions.meteor), if one is given. Python works in Arrow batches on these three alone.
    """

    no_text, no_reference, no_table = (F.col(c).isNull() for c in ("generated", "reference", "table_text"))
    said = F.coalesce("generated", F.lit(""))
    df = df.withColumn("_t", text_scores_by(thesaurus)("generated", "reference"))
    if model:
        df = df.withColumn("_b", bert_scores(model)("generated", "reference"))
    more = [c for c in df.columns if c.startswith("_")]
    kept = df.select("*", F.struct(*[F.col(c) for c in more]).alias("text_side")).drop(*more)
    rows = evaluate(kept, arms, radius, table)
    missing = lambda when, what, names: F.when(when, F.array(*[F.lit(f"{n}: no {what}") for n in names])).otherwise(F.array().cast("array<string>"))
    errors = F.concat(
        missing(no_text, "text", ALL_METRICS), missing(~no_text & no_reference, "reference", TEXT_METRICS), missing(~no_text & no_table, "table", TABLE_METRICS),
        F.coalesce("text_side._t.errors", F.array().cast("array<string>")), *([F.array_compact(F.array("text_side._b.error"))] if model else []))
    bert = F.when(no_text | no_reference, 0.0).otherwise(F.col("text_side._b.bertscore_f1")) if model else F.lit(0.0)
    text = {c: F.when(no_text | no_reference, 0.0).otherwise(F.col(f"text_side._t.{c}")) for c in ("rouge_1", "rouge_2", "rouge_l", "meteor")}
    held = {c: F.when(no_text | no_table, 0.0).otherwise(F.col(c)) for c in TABLE_METRICS}
    rows = rows.withColumns({**text, "bertscore_f1": bert, "fk_grade": F.when(no_text, 0.0).otherwise(fk_grade(said)), **held, "errors": errors}).drop("text_side")
    return rows.withColumns({
        "safety_score": safety(F.col("nar"), F.col("hr"), F.col("or_score"), F.col("acr")), "fluency_score": fluency(F.col("rouge_l"), F.col("bertscore_f1"), F.col("meteor"))})
