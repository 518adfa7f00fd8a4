"""Curation queries: fingerprints, leakage, audits, splits, resume, unions, narratives, links."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window, functions as F

from ..functions.text import found
from ..sources.trials import TRIALS_SQL, trials
from .scoring import rounded


def docs(spark, sf_dir, *more):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more)


def fingerprint_dedup(spark, sf_dir):
    """Tables by the md5 of their sorted number strings; the first of each stays."""
    nums = F.array_join(F.sort_array(found(F.col("table_text"), r"(\d+\.?\d*)")), "")
    rows = trials(spark, sf_dir).select("table_id", F.md5(nums).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.min("table_id").alias("table_id"), F.count("*").alias("n"))


def fingerprint(text):
    """md5 of a text's number strings in order; texts without numbers have one in common."""
    return F.md5(F.array_join(F.sort_array(found(text, r"(\d+\.?\d*)")), ""))


def leakage_guard(spark, sf_dir):
    """Tables whose fingerprint no table of the training split has; the split is every fifth table and the first rows of the others."""
    rows = trials(spark, sf_dir).withColumn("shown", F.when(F.col("table_id") % 7 == 0, F.lit("start_table end_table")).otherwise(F.col("table_text")))
    train = rows.where("table_id % 5 = 0").select(fingerprint(F.col("shown")).alias("k")).distinct()
    return rows.select("table_id", fingerprint(F.col("shown")).alias("k")).join(train, "k", "left_anti").select("table_id")


def prefix_dedup(spark, sf_dir):
    """One document for each md5 of the first 200 characters, the smallest id."""
    return docs(spark, sf_dir).groupBy(F.md5(F.substring("text", 1, 200)).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


def quality_audit(spark, sf_dir):
    """Share of a text's number strings that its table has, share of characters outside printable ASCII, length, and the verdict."""
    rows = trials(spark, sf_dir)
    narr, tab = F.array_distinct(found(F.col("reference"), r"\b(\d+\.?\d*)\b")), F.array_distinct(found(F.col("table_text"), r"\b(\d+\.?\d*)\b"))
    both = F.concat("table_text", "reference")
    noise = F.length(F.regexp_replace(both, r"[\x20-\x7E\n\t]", "")) / F.greatest(F.length(both), F.lit(1))
    rows = rows.select("table_id", F.when(F.size(narr) > 0, F.size(F.array_intersect(narr, tab)) / F.size(narr)).otherwise(0.0).alias("overlap"), noise.alias("noise"), F.length("reference").cast("long").alias("len"))
    return rounded(rows.withColumn("passes", (F.col("overlap") >= 0.3) & (F.col("noise") < 0.02) & (F.col("len") > 80)), "overlap", "noise")


#: Fixed: words of which a narrative has one.
INDICATORS = ("subjects", "reported", "adverse", "safety", "percent", "arm", "treatment")
#: Fixed: patterns of a narrative, and of the statistics that it must hold.
NARRATIVE = r"(?i)overall[,\s]+teae.*were reported|treatment[- ]emergent adverse.*were reported|subjects.*experienced.*teae|incidence of.*adverse events|no (clinically significant|serious|grade 3)|\d+\s*\(\d+\.\d+%\).*subjects.*arm"
STATISTIC = r"\d+\.\d+%|\d+\s*\(\d+"
#: Fixed: patterns of a safety table, and of the numbers that make it a table of data.
SAFETY = r"(?i)treatment[- ]emergent adverse|\bteae\b|overall summary.*adverse|adverse event.*summary|safety.*summary|incidence.*adverse|grade\s*3[-–]?4|\bsae\b|serious adverse|discontinuation.*teae|drug[- ]related.*adverse"
DATA = r"\d+\.\d+%|\(\d+\.\d+\%\)|\d{2,}\s*\("


def is_narrative(text):
    """Texts of 40 characters or more that are no title, note or mark of a write-up and name an indicator word."""
    t = F.lower(text)
    short = F.length(t) < 60
    return (F.length(t) >= 40) & ~(t.startswith("table") & short) & ~(t.startswith("note:") & short) & ~t.contains("write up of table") & reduce(or_, [t.contains(w) for w in INDICATORS])


def pieces(spark, sf_dir):
    """Texts of many kinds: what is said of a table, its first sentence, the table itself, a title, a note, and documents."""
    rows = trials(spark, sf_dir)
    kinds = [
        F.col("ml"), F.substring_index("ml", ". ", 1), F.col("table_text"), F.concat(F.lit("Table "), F.col("table_id").cast("string"), F.lit(": safety")),
        F.lit("Note: percentages are of subjects"), F.concat(F.lit("Write up of table "), F.col("table_id").cast("string"), F.lit(" with all subjects of the safety set")), F.lit("x")]
    said = rows.select(F.concat(F.lit("t"), F.col("table_id").cast("string")).alias("of"), F.posexplode(F.array(*kinds)).alias("kind", "text"))
    return said.unionByName(docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("of"), F.lit(99).alias("kind"), "text"))


def scrub(spark, sf_dir):
    rows = pieces(spark, sf_dir)
    return rows.where(is_narrative(F.col("text"))).select("of", F.col("kind").cast("long").alias("kind"))


def safety_tables(spark, sf_dir):
    """Texts that look like a safety table: a telling pattern and numbers as data have them."""
    rows = pieces(spark, sf_dir)
    return rows.where(F.col("text").rlike(SAFETY) & F.col("text").rlike(DATA)).select("of", F.col("kind").cast("long").alias("kind"))


def stratified_split(spark, sf_dir, buckets: int = 256):
    """70 / 15 / 15 within each language by the rank of a hash, the same on every run.

    Ranks are counted per bucket of hash prefixes first and then within a bucket, so no window holds a language.
    """
    rows = docs(spark, sf_dir, "lang").select("doc_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("h")).withColumn("b", F.substring("h", 1, 2))
    sizes = rows.groupBy("lang", "b").agg(F.count("*").alias("size"))
    by = Window.partitionBy("lang")
    sizes = sizes.select("lang", "b", (F.sum("size").over(by.orderBy("b")) - F.col("size")).alias("ahead"), F.sum("size").over(by).alias("of"))
    rank = F.rank().over(Window.partitionBy("lang", "b").orderBy("h")) - 1
    rows = rows.withColumn("r", rank).join(sizes, ["lang", "b"])
    r = F.when(F.col("of") > 1, (F.col("ahead") + F.col("r")) / (F.col("of") - 1)).otherwise(0.0)
    return rows.select("doc_id", "lang", F.when(r < 0.7, "train").when(r < 0.85, "val").otherwise("test").alias("split"))


def hash_split(spark, sf_dir):
    """90 / 10 by a hash: no shuffle at all."""
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long")
    return docs(spark, sf_dir).select("doc_id", F.when(h % 10 < 9, "train").otherwise("test").alias("split"))


def resume(spark, sf_dir):
    """Documents that the labels do not have yet."""
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return docs(spark, sf_dir).select("doc_id").join(done, "doc_id", "left_anti")


def gold_predictions(spark, sf_dir):
    """Every gold table with the last prediction for it and its overlap columns told apart: a left join on the id as text.

    Predictions are the texts of every second table, twice over with a later run; the later one stays.
    """
    gold = trials(spark, sf_dir).select(F.col("table_id").cast("string").alias("table_id"), F.length("reference").cast("long").alias("length"))
    runs = trials(spark, sf_dir).where("table_id % 2 = 0").select(F.col("table_id").cast("string").alias("table_id"), F.posexplode(F.array("dl_base", "finetuned")).alias("run", "text"))
    last = runs.groupBy("table_id").agg(F.max("run").cast("long").alias("run"), F.max_by("text", "run").alias("text"))
    pred = last.select("table_id", "run", F.length("text").cast("long").alias("length_pred"))
    return gold.join(pred, "table_id", "left").select("table_id", F.col("length").alias("length_gold"), "run", "length_pred")


def keep_last_join(spark, sf_dir):
    """Each document with the last of its predictions by turn, where a prediction is a conversation turn of that id."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pred = conv.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))
    return docs(spark, sf_dir).select("doc_id").join(pred, "doc_id", "left")


def source_union(spark, sf_dir):
    """Three sources under one schema, tagged, old column names under the new ones; of each pair of prefix md5s the first by source."""
    gold = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("gold").alias("origin"), F.col("item_id").alias("id"), F.lit(None).cast("string").alias("table_text"), F.col("text").alias("input"), F.lit("").alias("writeup"))
    scraped = docs(spark, sf_dir, "source").select(F.lit("scraped").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("table_text"), F.lit("").alias("writeup"))
    made = trials(spark, sf_dir).select(F.lit("synthetic").alias("origin"), F.col("table_id").alias("id"), F.lit("").alias("table_text"), F.col("table_text").alias("input"), F.col("reference").alias("output"))
    rows = gold.unionByName(scraped, allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    rows = rows.select("origin", "id", first("table_text", "input").alias("t"), first("writeup", "output").alias("w"))
    best = rows.groupBy(F.md5(F.substring("t", 1, 200)).alias("a"), F.md5(F.substring("w", 1, 200)).alias("b")).agg(F.min(F.struct("origin", "id")).alias("x"))
    return best.groupBy(F.col("x.origin").alias("origin")).agg(F.count("*").alias("n"), F.min("x.id").alias("first_id"))


def pages_of(spark, sf_dir):
    """(doc_id, page, text): whole documents as pages of lines, with paragraphs of a trial's text in those that have the id of a trial."""
    said = trials(spark, sf_dir).select(F.col("table_id").alias("doc_id"), "ml", "reference")
    rows = docs(spark, sf_dir).join(said, "doc_id", "left")
    page = lambda *parts: F.concat_ws("\n\n", *parts)
    text, told = F.coalesce("text", F.lit("")), F.coalesce("ml", F.lit(""))
    first = F.when(F.col("doc_id") % 3 == 0, page(F.lit("short"), told, text)).otherwise(text)
    texts = F.array(first, page(text, F.coalesce("reference", F.lit(""))), F.when(F.col("doc_id") % 2 == 0, told).otherwise(F.lit("")))
    return rows.select("doc_id", F.posexplode(texts).alias("page", "text"))


def narrative_of(text):
    """The first paragraph of 80 characters or more that reads like a narrative and holds a statistic, white space squeezed; null without one."""
    fits = lambda p: (F.length(p) >= 80) & p.rlike(NARRATIVE) & p.rlike(STATISTIC)
    first = F.try_element_at(F.filter(F.transform(F.split(text, r"\n{2,}", -1), lambda p: F.btrim(p, F.lit(" \t\n\r"))), fits), F.lit(1))
    return F.trim(F.regexp_replace(first, r"\s+", " "))


def narrative_finder(spark, sf_dir):
    """The narrative on each page, else that on the page after it."""
    rows = pages_of(spark, sf_dir).withColumn("here", narrative_of(F.col("text")))
    after = F.lead("here").over(Window.partitionBy("doc_id").orderBy("page"))
    return rows.select("doc_id", F.col("page").cast("long").alias("page"), F.md5(F.coalesce("here", after, F.lit(""))).alias("narrative_md5"))


def narrative_window(spark, sf_dir, before: int = 1, after: int = 5):
    """The narrative near a table's page: pages from one before to four after, the first that has a pattern, from ten characters before it,
    three paragraphs and 2,000 characters at most, if it has more than 80. Each page is sent to the tables whose window it is in."""
    pages = pages_of(spark, sf_dir)
    near = pages.withColumn("of", F.explode(F.sequence(F.greatest(F.lit(0), F.col("page") - after + 1), F.col("page") + before)))
    at = F.regexp_instr("text", F.lit(NARRATIVE))
    tail = F.array_join(F.slice(F.split(F.substr("text", F.greatest(F.lit(1), at - 10)), r"\n\s*\n", -1), 1, 3), " ")
    rows = near.where(F.col("text").rlike(NARRATIVE)).withColumn("found", F.trim(tail)).where(F.length("found") > 80)
    best = rows.groupBy("doc_id", "of").agg(F.min_by(F.substring("found", 1, 2000), "page").alias("found"))
    keys = pages.select("doc_id", F.col("page").alias("of"))
    return keys.join(best, ["doc_id", "of"], "left").select("doc_id", F.col("of").cast("long").alias("page"), F.md5(F.coalesce("found", F.lit(""))).alias("narrative_md5"))


def next_page(spark, sf_dir):
    """Each turn with the text of the next one."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return conv.select("conv_id", "turn", F.md5(F.coalesce(nxt, F.lit(""))).alias("next_md5"))


def trial_ids(spark, sf_dir):
    """Registry id, else a letter and digits, else the first 15 characters."""
    t = F.col("url")
    some = lambda p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce(some(r"NCT\d{8}"), some(r"[A-Z]\d{6}"), F.substring(t, 1, 15)).alias("trial_id"))


def page_links(spark, sf_dir):
    """Links of each page, counted with the distinct ones."""
    links = found(F.col("html"), r'href="([^"]+)"')
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"), F.md5(F.array_join(links, "|")).alias("links_md5"))


def scrubbed(text):
    """Page marks, document ids and confidentiality notes go, white space is squeezed."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)page \d+ of \d+", ""), r"(?i)document id:? \S+", ""), r"(?i)confidential", "")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def reference_scrub(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(scrubbed("text")).alias("text_md5"))


def item_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir, "lang", "source").select("doc_id", F.substring(F.md5(F.concat("lang", F.col("doc_id").cast("string"), "source")), 1, 12).alias("fingerprint"))


def sentence_dedup(spark, sf_dir):
    """Lines of a document whose first 80 characters, in lower case, no earlier line has."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("k", F.lower(F.substring("line", 1, 80)))
    kept = rows.groupBy("doc_id", F.md5("k").alias("k")).agg(F.min("pos").alias("pos"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum(F.col("pos").cast("long")).alias("sum_pos"))


def augmentation_breakdown(spark, sf_dir):
    return docs(spark, sf_dir, "source").groupBy(F.coalesce(F.nullif(F.col("source"), F.lit("src0")), F.lit("original")).alias("kind")).count().withColumnRenamed("count", "n")


def mentioned(label, text):
    """Whether a text names a label: longer ones anywhere, those of three letters or less as a word between white space."""
    low, said = F.lower(label), F.lower(text)
    return ((F.length(low) > 3) & said.contains(low)) | F.array_contains(F.split(said, r"\s+", -1), low)


def weak_labels(spark, sf_dir):
    """Rows of single events of a table, and whether its reference names them; a row of SAE stands for the short labels."""
    from ..functions.tables import parsed_rows

    rows = parsed_rows(trials(spark, sf_dir))
    return rows.select("table_id", "label", mentioned(F.col("label"), F.col("reference")).cast("long").alias("mentioned"))


def fill_missing(spark, sf_dir):
    return filled(spark, sf_dir, False)


def fill_overwrite(spark, sf_dir):
    return filled(spark, sf_dir, True)


def filled(spark, sf_dir, overwrite: bool):
    """A summary is added where it is blank, or everywhere if `overwrite`; where the new one failed the old stays and the error is told.

    Every fourth draft is blank here, and every sixth new summary failed.
    """
    id_ = F.col("table_id")
    rows = trials(spark, sf_dir).select("table_id", F.when(id_ % 4 == 0, F.lit("  ")).otherwise(F.col("ml")).alias("draft"), F.when(id_ % 6 != 0, F.col("reference")).alias("new"))
    wanted = (F.trim("draft") == "") | F.lit(overwrite)
    text = F.when(wanted & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("draft"))
    return rows.select("table_id", F.md5(text).alias("text_md5"), F.when(wanted & F.col("new").isNull(), F.lit("no summary")).alias("error"))


_W = f"WITH {TRIALS_SQL} "
_PIECES = f"""{_W}, said AS (SELECT 't' || table_id AS of, unnest([ml, string_split(ml, '. ')[1], table_text, 'Table ' || table_id || ': safety', 'Note: percentages are of subjects', 'Write up of table ' || table_id || ' with all subjects of the safety set', 'x']) AS text,
  unnest(range(0, 7)) AS kind FROM trials), pieces AS (SELECT of, kind, text, lower(text) AS low FROM said UNION ALL SELECT 'd' || doc_id, 99, text, lower(text) FROM documents)"""
_PAGES = f"""{_W}, pages_of AS (SELECT doc_id, unnest(range(0, 3)) AS page, unnest([
    CASE WHEN doc_id % 3 = 0 THEN 'short' || chr(10) || chr(10) || coalesce(ml, '') || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END,
    coalesce(text, '') || chr(10) || chr(10) || coalesce(reference, ''), CASE WHEN doc_id % 2 = 0 THEN coalesce(ml, '') ELSE '' END]) AS text FROM documents LEFT JOIN trials ON doc_id = table_id)"""
QUERIES = {
    "fingerprint_dedup": (fingerprint_dedup, f"{_W}, f AS (SELECT table_id, md5(array_to_string(list_sort(regexp_extract_all(table_text, '\\d+\\.?\\d*')), '')) AS fingerprint FROM trials) SELECT fingerprint, min(table_id) AS table_id, count(*) AS n FROM f GROUP BY fingerprint"),
    "leakage_guard": (leakage_guard, f"{_W}, s AS (SELECT table_id, CASE WHEN table_id % 7 = 0 THEN '' ELSE array_to_string(list_sort(regexp_extract_all(table_text, '\\d+\\.?\\d*')), '') END AS k FROM trials) SELECT table_id FROM s WHERE k NOT IN (SELECT k FROM s WHERE table_id % 5 = 0)"),
    "prefix_dedup": (prefix_dedup, "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY substr(text, 1, 200)"),
    "quality_audit": (quality_audit, f"{_W}, n AS (SELECT *, list_distinct(regexp_extract_all(reference, '\\b\\d+\\.?\\d*\\b')) AS r, list_distinct(regexp_extract_all(table_text, '\\b\\d+\\.?\\d*\\b')) AS t FROM trials), a AS (SELECT table_id, len(list_intersect(r, t)) / len(r) AS overlap, length(regexp_replace(table_text || reference, '[\\x20-\\x7E\\n\\t]', '', 'g')) / length(table_text || reference) AS noise, length(reference) AS len FROM n) SELECT table_id, round(overlap, 6) AS overlap, round(noise, 6) AS noise, len, overlap >= 0.3 AND noise < 0.02 AND len > 80 AS passes FROM a"),
    "scrub": (scrub, f"{_PIECES} SELECT of, kind FROM pieces WHERE length(low) >= 40 AND NOT (length(low) < 60 AND (starts_with(low, 'table') OR starts_with(low, 'note:'))) AND NOT contains(low, 'write up of table') AND regexp_matches(low, '{'|'.join(INDICATORS)}')"),
    "safety_tables": (safety_tables, f"{_PIECES} SELECT of, kind FROM pieces WHERE regexp_matches(text, '{SAFETY}') AND regexp_matches(text, '{DATA}')"),
    "stratified_split": (stratified_split, "WITH r AS (SELECT doc_id, lang, percent_rank() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id AS varchar))) AS r FROM documents) SELECT doc_id, lang, CASE WHEN r < 0.7 THEN 'train' WHEN r < 0.85 THEN 'val' ELSE 'test' END AS split FROM r"),
    "hash_split": (hash_split, "SELECT doc_id, CASE WHEN cast('0x' || substr(md5(cast(doc_id AS varchar)), 1, 6) AS bigint) % 10 < 9 THEN 'train' ELSE 'test' END AS split FROM documents"),
    "resume": (resume, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "keep_last_join": (keep_last_join, "SELECT d.doc_id, c.role, c.turn FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) c ON c.conv_id = d.doc_id AND c.r = 1"),
    "gold_predictions": (gold_predictions, f"{_W} SELECT cast(table_id AS varchar) AS table_id, length(reference) AS length_gold, CASE WHEN table_id % 2 = 0 THEN 1 END::bigint AS run, CASE WHEN table_id % 2 = 0 THEN length(finetuned) END AS length_pred FROM trials"),
    "source_union": (source_union, f"""{_W}, u AS (SELECT 'gold' AS origin, item_id AS id, text AS t, '' AS w FROM benchmark UNION ALL SELECT 'scraped', doc_id, coalesce(text, ''), '' FROM documents UNION ALL SELECT 'synthetic', table_id, table_text, reference FROM trials),
      b AS (SELECT min((origin, id)) AS b FROM u GROUP BY substr(t, 1, 200), substr(w, 1, 200)) SELECT b[1] AS origin, count(*) AS n, min(b[2]) AS first_id FROM b GROUP BY ALL"""),
    "narrative_finder": (narrative_finder, f"""{_PAGES}, h AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: length(p) >= 80 AND regexp_matches(p, '{NARRATIVE}') AND regexp_matches(p, '{STATISTIC}'))[1] AS here FROM pages_of)
      SELECT doc_id, page, md5(coalesce(trim(regexp_replace(coalesce(here, lead(here) OVER (PARTITION BY doc_id ORDER BY page)), '\\s+', ' ', 'g')), '')) AS narrative_md5 FROM h"""),
    "narrative_window": (narrative_window, f"""{_PAGES}, hits AS (SELECT *, length(regexp_extract(text, '(?s)^(.*?)(?:{NARRATIVE.replace('(?i)', '(?i-s:')}))', 1)) AS skipped FROM pages_of WHERE regexp_matches(text, '{NARRATIVE}')),
      cut AS (SELECT doc_id, page, trim(array_to_string(regexp_split_to_array(substr(text, greatest(1, skipped + 1 - 10)), '\\n\\s*\\n')[1:3], ' ')) AS found FROM hits)
      SELECT p.doc_id, p.page, md5(coalesce((SELECT arg_min(substr(found, 1, 2000), c.page) FROM cut c WHERE c.doc_id = p.doc_id AND length(found) > 80 AND c.page BETWEEN p.page - 1 AND p.page + 4), '')) AS narrative_md5 FROM pages_of p"""),
    "next_page": (next_page, "SELECT conv_id, turn, md5(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS next_md5 FROM conversations"),
    "trial_ids": (trial_ids, "SELECT page_id, coalesce(nullif(regexp_extract(url, 'NCT\\d{8}'), ''), nullif(regexp_extract(url, '[A-Z]\\d{6}'), ''), substr(url, 1, 15)) AS trial_id FROM pages"),
    "page_links": (page_links, "WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages) SELECT page_id, len(l) AS n_links, len(list_distinct(l)) AS n_distinct, md5(array_to_string(l, '|')) AS links_md5 FROM l"),
    "reference_scrub": (reference_scrub, "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'page \\d+ of \\d+', '', 'gi'), 'document id:? \\S+', '', 'gi'), 'confidential', '', 'gi'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM documents"),
    "item_fingerprint": (item_fingerprint, "SELECT doc_id, substr(md5(lang || doc_id || source), 1, 12) AS fingerprint FROM documents"),
    "sentence_dedup": (sentence_dedup, "WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, string_split(text, chr(10)) AS s FROM documents), k AS (SELECT doc_id, lower(substr(s[pos + 1], 1, 80)) AS k, min(pos) AS pos FROM l GROUP BY ALL) SELECT doc_id, count(*) AS n_kept, sum(pos)::bigint AS sum_pos FROM k GROUP BY doc_id"),
    "augmentation_breakdown": (augmentation_breakdown, "SELECT coalesce(nullif(source, 'src0'), 'original') AS kind, count(*) AS n FROM documents GROUP BY ALL"),
    "weak_labels": (weak_labels, f"{_W} SELECT table_id, label, ((length(label) > 3 AND contains(lower(reference), lower(label))) OR list_contains(regexp_split_to_array(lower(reference), '\\s+'), lower(label)))::bigint AS mentioned FROM counted JOIN trials USING (table_id) WHERE row_index > 1 AND NOT (t_a = 0 AND t_b = 0)"),
    "fill_missing": (fill_missing, f"{_W} SELECT table_id, md5(CASE WHEN table_id % 12 = 0 THEN '  ' WHEN table_id % 4 = 0 THEN reference ELSE ml END) AS text_md5, CASE WHEN table_id % 12 = 0 THEN 'no summary' END AS error FROM trials"),
    "fill_overwrite": (fill_overwrite, f"{_W} SELECT table_id, md5(CASE WHEN table_id % 6 <> 0 THEN reference WHEN table_id % 4 = 0 THEN '  ' ELSE ml END) AS text_md5, CASE WHEN table_id % 6 = 0 THEN 'no summary' END AS error FROM trials"),
}
