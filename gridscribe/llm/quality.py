"""Quality rules: divergence of a document's histograms from its language's, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD_SPACE, cut, packed, table, unpacked

#: Documents below this many words, or with more than this share of words in repeated runs of three, fail before the method judges.
MIN_WORDS, MOST_REPEATED = 50, 0.5
#: Limit of the Jensen-Shannon distance (0 to 1) of the character classes. That of the common words is a share of the distance that
#: a text without any of them has in its language, and leaves room for so many times the square that chance gives a text of its length.
MOST_CLASSES, MOST_WORDS, CHANCE = 0.30, 0.40, 2.0
#: Common words of a language, the most frequent of all words: a text is held to one for each WORDS_PER_BIN words of it, within these bounds.
FEWEST_COMMON, COMMON, WORDS_PER_BIN = 8, 32, 12
#: Places of a language's bit table, which tells most words from common ones at once.
BITS = 256
SPACE = r"[\x20\x09-\x0D]+"
#: Languages whose references are broadcast at most; with more of them the join is by shuffle.
MOST_LANGUAGES = 10_000


def words_of(text: Column) -> Column:
    """Words in order; the ends are trimmed first, so that a text without words alone gives an empty one."""
    return F.split(F.btrim(text, F.lit(WORD_SPACE)), SPACE, -1)


def dropped(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def with_classes(rows: DataFrame) -> DataFrame:
    """rows (_t) with _word_chars, _n_symbols and _classes: punctuation, A-Z, digits, white space, symbols, beyond ASCII, the rest.

    a-z go first, so one scan of the text is a full one; white space next, and the other classes are looked for in what is left.
    """
    rows = rows.withColumn("_bare", dropped(F.col("_t"), "[a-z]+")).withColumn("_left", dropped(F.col("_bare"), SPACE))
    size = lambda c: F.length(c).cast("long")
    of = lambda others: size(dropped(F.col("_left"), others))
    rows = rows.withColumns({
        "_chars": size("_t"), "_space": size("_bare") - size("_left"), "_marks": of(r"[^.,;:!?'\"()-]+"), "_upper": of("[^A-Z]+"), "_digits": of("[^0-9]+"),
        "_n_symbols": of("[^#*$%&|<>]+"), "_other": of("[\\x00-\\x7F]+")}).drop("_bare", "_left")
    six = [F.col(c) for c in ("_marks", "_upper", "_digits", "_space", "_n_symbols", "_other")]
    classes = F.array(*[c.cast("double") for c in (*six, F.col("_chars") - sum(six[1:], six[0]))])
    return rows.withColumns({"_word_chars": F.col("_chars") - F.col("_space"), "_classes": classes}).drop("_chars", "_space", "_marks", "_upper", "_digits", "_other")


def run_hash(x: Column, y: Column, z: Column) -> Column:
    return F.xxhash64(x, y, z)


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows (_w, _n_words) with _n_repeat_words: words in runs of three that the text holds twice or more.

    Runs are hashed. Where hashes recur, each is shortened by the bits that its place takes and sorted with it as one number; equal
    neighbours propose the runs that may be found twice. Those are sorted by their words, and equal ones are found twice: each covers its place and the next two.
    """
    word = lambda i: F.get("_w", i)
    runs = F.transform(F.slice("_w", 1, F.greatest(F.col("_n_words") - 2, F.lit(0)).cast("int")), lambda x, i: run_hash(x, word(i + 1), word(i + 2)))
    rows = rows.withColumn("_runs", runs)
    recurring = F.size(F.array_distinct("_runs")) < F.size("_runs")
    rows = rows.withColumn("_bits", F.when(recurring, F.length(F.bin(F.col("_n_words")))).otherwise(0).cast("int"))
    placed = F.sort_array(F.transform("_runs", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")) + i))  # no nulls: they are sorted as plain numbers
    rows = rows.withColumn("_placed", F.when(F.col("_bits") > 0, placed)).drop("_runs")
    at = lambda i: F.get("_placed", i)
    same = lambda i: F.call_function("shiftrightunsigned", at(i).bitwiseXOR(at(i - 1)), F.col("_bits")) == 0
    rows = rows.withColumn("_again", F.when(F.col("_bits") > 0, F.filter(F.sequence(F.lit(1), F.size("_placed") - 1), same)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    may = F.array_distinct(F.transform(F.concat("_again", F.transform("_again", lambda i: i - 1)), lambda i: at(i).bitwiseAND(mask)))
    rows = rows.withColumn("_may", F.when(F.size("_again") > 0, may)).drop("_placed", "_again", "_bits")
    # words hold no spaces, so joined by them they say which words they are
    said = lambda p: F.concat_ws(" ", word(p.cast("int")), word(p.cast("int") + 1), word(p.cast("int") + 2))
    rows = rows.withColumn("_said", F.sort_array(F.transform("_may", lambda p: F.struct(said(p).alias("s"), p.alias("p"))))).drop("_may")
    one = lambda i: F.get("_said", i)["s"]
    twice = F.filter("_said", lambda x, i: x["s"].eqNullSafe(one(i - 1)) | x["s"].eqNullSafe(one(i + 1)))
    rows = rows.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("_said")
    covered = F.transform("_twice", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_twice", i + 1) - p, F.lit(3).cast("long"))))
    return rows.withColumn("_n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0).cast("long"))).drop("_twice")


def with_repeated_lines(rows: DataFrame) -> DataFrame:
    """rows (_t) with _n_dup_lines: lines with a word that equal an earlier line."""
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    rows = rows.withColumn("_lines", lines)
    return rows.withColumn("_n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")


def with_common(rows: DataFrame) -> DataFrame:
    """rows (_w, _n_words, r_hashes, r_bits, r_counts, r_words) with _own and _theirs: how often the document and its language use as many of the
    language's common words as the document's length allows for, and at the end all other words."""
    bins = F.least(F.lit(COMMON), F.greatest(F.lit(FEWEST_COMMON), F.floor(F.col("_n_words") / WORDS_PER_BIN))).cast("int")
    known = lambda h: F.get("r_bits", h.bitwiseAND(BITS - 1).cast("int")) & F.array_contains("r_hashes", h)
    rows = rows.withColumn("_seen", F.sort_array(F.filter(F.transform("_w", lambda x: F.xxhash64(F.lower(x))), known)))
    # sorted, equal hashes are neighbours: where they begin gives how many there are
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_seen")), lambda i: F.get("_seen", i).eqNullSafe(F.get("_seen", i - 1)) == F.lit(False)))
    which = F.transform(F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), lambda i: F.get("_seen", i))
    count = lambda k: F.when(k > 0, F.get("_at", k) - F.get("_at", k - 1)).otherwise(0).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    places = let(which, lambda v: F.transform(F.slice("r_hashes", 1, bins), lambda h: F.array_position(v, h).cast("int")))
    rows = rows.withColumns({"_own": F.transform(places, count), "_theirs": F.slice("r_counts", 1, bins)}).drop("_seen", "_at")
    return rows.withColumns({
        "_bins": F.size("_theirs"), "_own": F.concat("_own", F.array(F.col("_n_words") - total(F.col("_own")))),
        "_theirs": F.concat("_theirs", F.array(F.col("r_words") - total(F.col("_theirs"))))})


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts with base 2: 0 for equal shares, 1 for none in common; 0 if one is empty."""

    def of(a: Column, b: Column) -> Column:
        def part(x: Column, y: Column) -> Column:
            return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

        total = F.aggregate(F.zip_with(a, b, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, x: s + x)
        return F.sqrt(F.greatest(total / 2, F.lit(0.0)))

    def shares(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(x, lambda v: v / t))

    full = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) > 0
    return F.when(full(p) & full(q), let(shares(p), lambda a: let(shares(q), lambda b: of(a, b)))).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: as the variable of a lambda it is not evaluated again wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(r_lang, r_classes, r_hashes, r_bits, r_counts, r_words): histograms of each language over all of its documents.

    Common words are the COMMON most frequent of all its words in lower case, ties by code point; they come as hashes, the most
    frequent first, and as marks at the hashes modulo BITS. One row per language; sums and counts are combined before they are shuffled, and each task passes on no more
    than COMMON words of a language, so a language of most documents is no hot task.
    """
    base = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    of = with_classes(base).groupBy("_lang").agg(F.array(*[F.sum(F.col("_classes")[i]) for i in range(7)]).alias("r_classes"))
    word = base.select("_lang", F.explode(words_of(F.lower("_t"))).alias("w")).where("w <> ''").groupBy("_lang", "w").agg(F.count("*").alias("n"))
    words = word.groupBy("_lang").agg(F.sum("n").cast("double").alias("r_words"))
    top = word.withColumn("r", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    top = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", F.xxhash64("w").alias("h"), F.col("n").cast("double").alias("n")))).alias("top"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hashes = F.coalesce("top.h", none("bigint"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.exists(hashes, lambda h: h.bitwiseAND(BITS - 1) == i))
    return of.join(words, "_lang", "left").join(top, "_lang", "left").select(
        F.col("_lang").alias("r_lang"), "r_classes", hashes.alias("r_hashes"), bits.alias("r_bits"), F.coalesce("top.n", none("double")).alias("r_counts"),
        F.coalesce("r_words", F.lit(0.0)).alias("r_words"))


def most_words(n: Column, bins: Column, theirs: Column) -> Column:
    """The square of the limit of the word distance for n words and so many common ones. A text of its language's own words has the mean
    bins / (8 ln 2 n); one without any of them reaches what follows from the share c that they have in the language. Where a language uses them
    so little that a text of n words may well hold none, the limit is above that reach."""
    total = F.aggregate(theirs, F.lit(0.0), lambda a, v: a + v)
    c = F.when(total > 0, 1 - F.element_at(theirs, -1) / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    reach = (F.log2(2 / (2 - c)) + c + F.when(c < 1, (1 - c) * F.log2(2 * (1 - c) / (2 - c))).otherwise(0.0)) / 2
    return MOST_WORDS * MOST_WORDS * reach + CHANCE * bins / (8 * math.log(2) * F.greatest(n, F.lit(1)))


def judge_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _class_distance, _word_distance, _base_failed, _kept.

    The references are made of all documents, language by language. A document that passes the base rules (50 words, and at
    most half of them in repeated runs of three) is kept unless its character classes or its common words are further from
    its language's than the limits; the limit of the common words follows the language and the document's length. Documents below 50 words get no verdict of the method: their histograms say too little.

    Null and empty texts: all counts 0, base failed. Null languages form one of their own. Each row is judged by itself: repeated
    rows and ties need nothing special. Very long texts are measured whole, in the arrays of one row. Empty table: no rows. Further columns stay; columns named like the results are replaced.
    The references are one row per language: up to 10,000 of them are broadcast, more are joined by a shuffle.
    """
    roles = {text_col: "_text", lang_col: "lang0"}
    refs = cut(references(docs, text_col, lang_col))
    refs = F.broadcast(refs) if refs.count() <= MOST_LANGUAGES else refs
    rows = packed(docs, roles).withColumns({"_t": F.coalesce(F.col("_text"), F.lit("")), "_lang": F.coalesce(F.col("lang0"), F.lit(""))})
    rows = rows.withColumn("_w", words_of(F.col("_t")))
    rows = rows.withColumn("_n_words", F.when(F.get("_w", F.lit(0)) == "", 0).otherwise(F.size("_w")).cast("long"))
    rows = with_common(with_repeats(rows).join(refs, F.col("_lang") == F.col("r_lang"), "left")).drop("_w")
    rows = with_repeated_lines(with_classes(rows))
    n, repeated = F.col("_n_words"), F.col("_n_repeat_words")
    rows = rows.withColumns({
        "failed": (n < MIN_WORDS) | (100 * repeated > int(100 * MOST_REPEATED) * n),
        "by_class": F.when(n >= MIN_WORDS, distance(F.col("_classes"), F.col("r_classes"))),
        "by_word": F.when(n >= MIN_WORDS, distance(F.col("_own"), F.col("_theirs"))),
        "most": most_words(n, F.col("_bins"), F.col("_theirs")),
    })
    kept = ~F.col("failed") & (F.col("by_class") <= MOST_CLASSES) & (F.pow("by_word", F.lit(2)) <= F.col("most"))
    return unpacked(rows, docs.columns, roles, {
        "_n_words": n, "_word_chars": F.col("_word_chars"), "_n_symbols": F.col("_n_symbols"), "_n_dup_lines": F.col("_n_dup_lines"), "_n_repeat_words": repeated,
        "_class_distance": F.col("by_class"), "_word_distance": F.col("by_word"), "_base_failed": F.col("failed"), "_kept": F.coalesce(kept, F.lit(False))})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"), F.round("_class_distance", 6).alias("class_distance"), F.round("_word_distance", 6).alias("word_distance"),
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def _sql() -> str:
    gone = lambda c: f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))"
    classes = ["[.,;:!?''\"()-]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[^\x00-\x7F]"]
    counts = ", ".join(f"{gone(c)} AS c{i}" for i, c in enumerate(classes))
    rest = " - ".join(["length(t)", *[f"c{i}" for i in range(6)]])
    share = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    jsd = f"sqrt(greatest(sum({share.format(x='p', y='q')} + {share.format(x='q', y='p')}) / 2, 0))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
counted AS (SELECT doc_id, lang, t, len(ws) AS n_words, {counts} FROM d),
base AS (SELECT *, {rest} AS c6, length(t) - c3 AS word_chars FROM counted),
one AS (SELECT doc_id, lang, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
run AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM run WHERE z IS NOT NULL) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lined AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
class_long AS (SELECT doc_id, lang, cast(k[2:] AS int) AS k, a::double AS a FROM base UNPIVOT (a FOR k IN (c0, c1, c2, c3, c4, c5, c6))),
class_ref AS (SELECT lang, k, sum(a) AS b FROM class_long GROUP BY lang, k),
class_share AS (SELECT doc_id, a / nullif(sum(a) OVER (PARTITION BY doc_id), 0) AS p, b / nullif(sum(b) OVER (PARTITION BY doc_id), 0) AS q FROM class_long JOIN class_ref USING (lang, k)),
by_class AS (SELECT doc_id, {jsd} AS v FROM class_share GROUP BY doc_id),
word AS (SELECT lang, lower(x) AS w, count(*) AS n FROM one GROUP BY ALL),
totals AS (SELECT lang, sum(n)::double AS total FROM word GROUP BY lang),
common AS (SELECT * FROM (SELECT lang, w, n::double AS b, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM word) WHERE r <= {COMMON}),
used AS (SELECT doc_id, lower(x) AS w, count(*) AS a FROM one GROUP BY ALL),
bins AS (SELECT doc_id, r, b, coalesce(a, 0)::double AS a, n_words, total
  FROM base JOIN common USING (lang) JOIN totals USING (lang) LEFT JOIN used USING (doc_id, w) WHERE r <= least({COMMON}, greatest({FEWEST_COMMON}, n_words // {WORDS_PER_BIN}))),
word_hist AS (SELECT doc_id, a, b, n_words, total FROM bins UNION ALL SELECT doc_id, any_value(n_words) - sum(a), any_value(total) - sum(b), any_value(n_words), any_value(total) FROM bins GROUP BY doc_id),
word_share AS (SELECT doc_id, a / nullif(n_words, 0) AS p, b / total AS q FROM word_hist),
by_word AS (SELECT doc_id, {jsd} AS v FROM word_share GROUP BY doc_id),
covered AS (SELECT doc_id, count(*) AS k, sum(b) / any_value(total) AS c, any_value(n_words) AS n FROM bins GROUP BY doc_id),
limits AS (SELECT doc_id, {MOST_WORDS} * {MOST_WORDS} * (log2(2 / (2 - c)) + c + CASE WHEN c < 1 THEN (1 - c) * log2(2 * (1 - c) / (2 - c)) ELSE 0 END) / 2 + {CHANCE} * k / (8 * ln(2) * greatest(n, 1)) AS most FROM covered),
judged AS (
  SELECT base.doc_id, n_words, word_chars, c4 AS n_symbols, coalesce(lined.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    CASE WHEN n_words >= {MIN_WORDS} THEN by_class.v END AS cd, CASE WHEN n_words >= {MIN_WORDS} THEN by_word.v END AS wd, most,
    n_words < {MIN_WORDS} OR 100 * coalesce(repeated.n, 0) > {int(100 * MOST_REPEATED)} * n_words AS base_failed
  FROM base LEFT JOIN lined USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN by_class USING (doc_id) LEFT JOIN by_word USING (doc_id) LEFT JOIN limits USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, base_failed,
  coalesce(NOT base_failed AND cd <= {MOST_CLASSES} AND wd * wd <= most, false) AS kept FROM judged"""


SQL = _sql()
