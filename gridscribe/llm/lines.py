"""Line deduplication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import packed, rest_of, table, unpacked

MIN_CHARS, MIN_DOCS = 40, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without the six white space characters at its ends and with A-Z in lower case, other letters as they are."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hash(line: Column, min_chars: int) -> Column:
    """A struct of two independent hashes of the key (96 bits); null for a key that is too short to count."""
    key = line_key(line)
    return F.when(F.length(F.btrim(line, F.lit(SPACE))) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b")))


def with_kept_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows (_text, lost: the keys that the document loses, or null) with _lines and kept, the lines that stay.

    Lost keys and the keys of long lines are sorted together: a lost key comes first among its equals, and what follows it up to the next key are the places of lost
    lines. The places between those stay. Every step is linear in the lines of the row, or a sort of them.
    """
    at = lambda name, i: F.get(name, i)
    rows = rows.withColumn("_lines", F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1))
    keys = F.concat(
        F.transform("lost", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("place"))),
        F.filter(F.transform("_lines", lambda x, i: F.struct(line_hash(x, min_chars).alias("k"), i.alias("place"))), lambda s: s["k"].isNotNull()))
    rows = rows.withColumn("_keys", F.when(F.col("lost").isNotNull(), F.sort_array(keys)))
    heads = F.filter(F.sequence(F.lit(0), F.size("_keys") - 1), lambda i: ~at("_keys", i)["k"].eqNullSafe(at("_keys", i - 1)["k"]))
    rows = rows.withColumn("_heads", F.when(F.col("_keys").isNotNull(), heads))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    of = lambda i, j: F.when(at("_keys", i)["place"] < 0, span(i + 1, F.coalesce(at("_heads", j + 1), F.size("_keys")) - 1)).otherwise(none)
    gone = F.transform(F.flatten(F.transform("_heads", of)), lambda i: at("_keys", i)["place"])
    rows = rows.withColumn("_gone", F.sort_array(gone)).drop("_keys", "_heads")
    between = lambda j: span(F.coalesce(at("_gone", j - 1), F.lit(-1)) + 1, F.coalesce(at("_gone", j), F.size("_lines")) - 1)
    stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), between))
    kept = F.when(F.size("_gone") > 0, F.transform(stay, lambda i: at("_lines", i))).otherwise(F.col("_lines"))
    return rows.withColumn("kept", kept).drop("_gone")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text reassembled from the lines that stay, and _n_lines and _n_dropped (long).

    Lines of at least `min_chars` whose key is in at least `min_docs` documents go, except in the document with the largest id
    that holds it. Only hashes of long lines are shuffled, once per document and key; documents per key are counted with
    map-side sums, so a line that a third of all documents hold is a few rows; the list of lost keys of a document is no longer than the document.

    Null or empty text: one empty line, and the text becomes empty. Very long texts are cut into lines whole, in the arrays of one row; their lines and lost keys are sorted together. Ties cannot be: a key has one largest id. Rows with the same id count as one document for a key and each is
    reassembled. Rows with a null id count for no key and lose no line. Empty table: no rows. Further columns stay, and
    columns named like the two results are replaced.
    """
    roles = {id_col: "_id", text_col: "_text"}
    rows = packed(docs, roles)
    rest = rest_of(rows)
    held = rows.where("_id is not null").select(
        F.col("_id").alias("at"),
        F.explode(F.array_distinct(F.filter(F.transform(F.split("_text", "\n", -1), lambda x: line_hash(x, min_chars)), lambda h: h.isNotNull()))).alias("h"))
    held = held.select("at", F.col("h.a").alias("a"), F.col("h.b").alias("b")).distinct()
    common = held.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("at").alias("keeper")).where(F.col("n") >= min_docs)
    lost = held.join(common, ["a", "b"]).where("at <> keeper").groupBy("at").agg(F.collect_list(F.struct("a", "b")).alias("lost"))
    rows = rows.join(lost.hint("shuffle_hash"), F.col("_id") == F.col("at"), "left").select("_id", *rest, "_text", "lost")
    rows = with_kept_lines(rows, min_chars).select("_id", *rest, F.size("_lines").cast("long").alias("n_lines"), "kept")
    rows = rows.select("_id", *rest, "n_lines", F.size("kept").cast("long").alias("n_left"), F.array_join("kept", "\n").alias("_text"))
    return unpacked(rows, docs.columns, roles, {"_n_lines": F.col("n_lines"), "_n_dropped": F.col("n_lines") - F.col("n_left")})


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


#: For any input named docs (doc_id, text, ...): the lines that stay, joined.
LINE_CTES = """
lined AS (
  SELECT d.doc_id, i AS pos, string_split(coalesce(d.text, ''), chr(10))[i] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM docs) d),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lined),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT x.doc_id, x.pos, x.line, c.k IS NOT NULL AND x.doc_id <> c.keeper AS lost FROM keyed x LEFT JOIN common c ON x.k = c.k),
assembled AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS kept
  FROM judged GROUP BY doc_id)
"""

SQL = f"""WITH docs AS (SELECT doc_id, text FROM documents), {LINE_CTES}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM assembled"""
