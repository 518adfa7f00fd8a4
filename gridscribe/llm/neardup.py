"""Near-duplicate documents: BagMinHash signatures of word-shingle multisets, banding, and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Words, chunks, components, cut, in_arrow, join_labels, mix64, shuffles_released, table

SHINGLE, THRESHOLD = 5, 0.8
#: 36 bands of 6 rows: two documents of similarity 0.8 share no band with a chance of 2e-5, of 0.2 a band with one of 2e-3.
BANDS, ROWS = 36, 6
#: Documents of a part of a group; a task compares two parts.
PART = 512
#: Pairs of so many rows at most are broadcast to find their texts; more are joined by a shuffle.
FEW_PAIRS = 200_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, multiplicity) of each distinct run of five words; a text of one to four words is one shingle."""
    runs, whole = words.runs(size)
    at = np.flatnonzero(whole)
    doc, key = words.doc[at], runs[at]
    n = np.diff(words.first)
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        i, j = words.first[d], words.first[d + 1]
        h = mix64(np.array([np.bitwise_xor.reduce(mix64(words.hash[i:j] + np.arange(1, j - i + 1, dtype=np.uint64) * _GOLD))], np.uint64) + np.uint64(j - i))
        doc, key = np.r_[doc, d], np.r_[key, h]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    if not len(doc):
        return doc, key, doc
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    return doc[first], key[first], np.diff(np.r_[first, len(doc)])


def bag_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) identities of the first points: two rows agree in a place with the chance of their weighted Jaccard similarity.

    Each element carries Poisson processes over its weight levels: one over level 0, then one over each span of levels [1, 2),
    [2, 4), [4, 8) ..., of a rate as its width. A point of a span lies at one of its levels and counts if the weight reaches above it, so a smaller
    weight sees a part of the points of a larger one. Points come in ascending time, and each falls into one of m places; a process
    stops once its time is past the latest first point of its document. A document without elements has zeros.
    """
    spans = np.zeros(len(weight), np.int64)
    top = weight.astype(np.int64) - 1
    while top.any():  # bit length of weight - 1: the spans that the levels 0 to weight - 1 touch, besides level 0
        spans += top > 0
        top >>= 1
    count = spans + 1
    of = np.repeat(np.arange(len(doc)), count)
    span = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low = np.where(span == 0, 0, 1 << np.maximum(span - 1, 0)).astype(np.int64)
    width = np.where(span == 0, 1, low).astype(np.int64)
    d, w = doc[of], weight[of].astype(np.int64)
    seed = mix64(key[of] + (span.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    t, c = np.zeros(len(of)), np.zeros(len(of), np.uint64)
    best = np.full(n_docs * m, np.inf)
    name = np.zeros(n_docs * m, np.uint64)
    live = np.arange(len(of))
    while len(live):
        per_doc = np.bincount(d[live], minlength=n_docs)
        steps = np.clip(m // np.maximum(per_doc, 1), 1, 64)[d[live]]
        for b, most in ((1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 65)):
            some = live[(steps >= b) & (steps < most)]
            if not len(some):
                continue
            k = c[some][:, None] + np.arange(1, b + 1, dtype=np.uint64)[None, :]
            u = mix64(seed[some][:, None] + k * _GOLD)
            gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[some][:, None]
            gap[:, 0] += t[some]
            time = np.cumsum(gap, 1)  # adds in sequence, so the times of an element are the same in every document
            t[some], c[some] = time[:, -1], k[:, -1]
            v = mix64(u ^ np.uint64(0xA0761D6478BD642F))
            place = d[some][:, None] * m + ((v >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            level = low[some][:, None] + ((v & np.uint64(0xFFFFFFFF)).astype(np.int64) % width[some][:, None])
            good = (level < w[some][:, None]) & (time < best[place])
            place, time, u = place[good], time[good], v[good]
            np.minimum.at(best, place, time)
            first = best[place] == time
            name[place[first]] = u[first]
        limit = best.reshape(n_docs, m).max(1)
        live = live[t[live] < limit[d[live]]]
    return name.reshape(n_docs, m)


def sketch(docs: DataFrame) -> DataFrame:
    """(_id, f1, f2, n, bands) of documents with words: multiset fingerprint, size, band hashes."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text", 1 << 20):
                words = Words(part.column("_text"))
                doc, key, weight = shingles(words)
                sig = bag_minhash(doc, key, weight, part.num_rows, BANDS * ROWS)
                bag = mix64(key) * (weight.astype(np.uint64) * np.uint64(2) + np.uint64(1))
                sums = []
                for x in (bag, mix64(bag + _GOLD)):
                    s = np.zeros(part.num_rows, np.uint64)
                    np.add.at(s, doc, x)
                    sums.append(s.view(np.int64))
                n = np.zeros(part.num_rows, np.int64)
                np.add.at(n, doc, weight)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (part.num_rows, BANDS)) * _GOLD
                for r in range(ROWS):
                    band = mix64(band + sig[:, r::ROWS][:, :BANDS] * np.uint64(2 * r + 1))
                some = np.flatnonzero(n)
                off = pa.array(np.arange(0, BANDS * len(some) + 1, BANDS), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(pa.array(some)), pa.array(sums[0][some]), pa.array(sums[1][some]), pa.array(n[some]),
                    pa.ListArray.from_arrays(off, pa.array(band[some].view(np.int64).ravel()))], ["_id", "f1", "f2", "n", "bands"])

    return in_arrow(docs, run, f"_id {docs.schema['_id'].dataType.simpleString()}, f1 bigint, f2 bigint, n bigint, bands array<bigint>")


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts, exactly; 0 if both are empty."""
    n = len(a)
    sides = [shingles(Words(x)) for x in (a, b)]
    doc = np.concatenate([x[0] for x in sides])
    key = np.concatenate([x[1] for x in sides])
    weight = np.concatenate([x[2] for x in sides])
    order = np.lexsort((key, doc))
    doc, key, weight = doc[order], key[order], weight[order]
    twin = np.flatnonzero((doc[1:] == doc[:-1]) & (key[1:] == key[:-1])) if len(doc) else np.zeros(0, np.int64)
    common = np.bincount(doc[twin], np.minimum(weight[twin], weight[twin + 1]), n)
    total = np.bincount(doc, weight, n)
    return common / np.maximum(total - common, 1)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold. A lead with many partners is a skewed join, whose partitions can be split."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "ta", 1 << 20):
                hit = pa.array(overlap(part.column("ta"), part.column("tb")) >= THRESHOLD)
                yield part.select(["a", "b"]).filter(hit)

    texts = docs.select("_id", "_text")
    with shuffles_released(docs.sparkSession):
        few = pairs.count() <= FEW_PAIRS
    if few:  # their ids fit a broadcast of some MB; the texts of those alone are shuffled
        ids = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
        texts = texts.join(F.broadcast(ids), "_id", "left_semi")
    rows = pairs.join(texts.withColumnsRenamed({"_id": "a", "_text": "ta"}), "a").join(texts.withColumnsRenamed({"_id": "b", "_text": "tb"}), "b")
    rows = rows.select("a", "b", "ta", "tb")
    return in_arrow(rows, run, rows.select("a", "b").schema)


def joined_within(texts: pa.Array, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes that link, as (class, class) pairs of a spanning forest: all texts of `left` against all of `right`, exactly.

    Each occurrence of a shingle is a column of 0 and 1, so products of the rows are the multisets' overlaps; columns that one text alone
    has are left out, and the others come in slices.
    """
    doc, key, weight = shingles(Words(texts))
    n, size = len(texts), np.bincount(doc, weight, len(texts))
    row = np.repeat(doc, weight)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(weight) - weight, weight)
    _, column, seen = np.unique(mix64(np.repeat(key, weight) + nth.astype(np.uint64) * _GOLD), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, (int(column[-1]) + 1) if len(column) else 0, 4096):
        x = np.zeros((n, 4096), np.float32)
        p, q = np.searchsorted(column, (lo, lo + 4096))
        x[row[p:q], column[p:q] - lo] = 1
        common += x[left] @ x[right].T
    both = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero((common / np.maximum(both, 1) >= THRESHOLD) & (comp[left][:, None] != comp[right][None, :]))
    names, at = np.unique(comp, return_inverse=True)
    label = np.arange(len(names))
    join_labels(label, at[left[i]], at[right[j]])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _within(rest: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): classes that link, of all documents that the buckets of `rest` connect, compared in parts of PART documents.

    No pair is a row: a task holds two parts of a group (or all of many small groups), multiplies them and returns a spanning forest.
    """
    lead = rest.groupBy("band").agg(F.min("_id").alias("lead"))
    edges = rest.join(lead, "band").select(F.col("_id").alias("a"), F.col("lead").alias("b")).distinct()
    group = cut(components(edges))
    one = _grouped(rest, group)
    size = one.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    placed = one.join(size, "grp").withColumn("mine", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    placed = placed.select("_id", "cls", "grp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("parts") == 1, F.pmod(F.xxhash64("grp"), F.lit(4096))).otherwise(F.col("grp")).alias("pack"))
    rows = placed.join(docs.select("_id", "_text"), "_id")

    def run(task: pa.Table) -> pa.Table:
        task = task.combine_chunks()
        grp, mine, cls = (task.column(c).to_numpy() for c in ("grp", "mine", "cls"))
        i, j = task.column("i")[0].as_py(), task.column("j")[0].as_py()
        texts = task.column("_text").chunk(0)
        order = np.argsort(grp, kind="stable")
        starts = np.flatnonzero(np.r_[True, grp[order][1:] != grp[order][:-1]]).tolist()
        out = []
        for s, e in zip(starts, [*starts[1:], len(order)]):
            at = order[s:e]
            if e - s > 1:
                m = mine[at]
                out.append(joined_within(texts.take(pa.array(at)), cls[at], np.flatnonzero(m == i), np.flatnonzero(m == j)))
        a, b = (np.concatenate([x[k] for x in out]) if out else cls[:0] for k in (0, 1))
        return pa.table({"a": a, "b": b})

    kind = dict(rest.dtypes)["comp"]
    return rows.groupBy("pack", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def _grouped(rest: DataFrame, group: DataFrame) -> DataFrame:
    one = rest.groupBy("_id").agg(F.min("comp").alias("cls"))
    return one.join(group.select(F.col("id").alias("_id"), F.col("comp").alias("grp")), "_id", "left").withColumn("grp", F.coalesce("grp", "_id"))


def _stars(rest: DataFrame) -> DataFrame:
    """(a, b): each document of the buckets with a lead, the smallest id of a bucket: the lead that it shares most bands with."""
    lead = rest.groupBy("band").agg(F.min("_id").alias("lead"))
    shared = rest.join(lead, "band").where("_id <> lead").groupBy("_id", "lead").agg(F.count("*").alias("k"))
    best = shared.groupBy("_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "lead")).alias("best"))
    return best.select(F.least("_id", "best.lead").alias("a"), F.greatest("_id", "best.lead").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, class_id, copies): for each document with words the smallest id of its class, and how many have the very same shingles.

    A link joins documents whose multisets of five-word shingles have a weighted Jaccard similarity of 0.8 or more; a class is a
    connected component of links. Candidates are pairs that share a band of the BagMinHash signatures; each is compared exactly
    unless already in one class.

    1. Documents with the same multiset are one representative from here on, however many they are.
    2. Each representative is compared with the lead of one of its buckets, the one that it shares most bands with, and those that
       link are joined: as many pairs as documents, also for buckets with a third of all rows.
    3. Documents of buckets that still hold several classes are compared all with all, within what these
       buckets connect, in parts of 512 documents: tasks multiply occurrence matrices and return a spanning forest, so no pair is a row.

    Null or empty texts have no row here and stay by themselves. Very long texts are shingled whole, each as a slice of its own. Rows with the same id are
    one document, linked if one of its texts is. Ties: of leads, classes and copies the smallest id counts, so the result does not hang on the order of rows. Null ids have
    no row. Empty table: no rows. Other columns play no part, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    sketched = cut(sketch(docs))
    same = sketched.groupBy("f1", "f2", "n").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    member = sketched.select("_id", "f1", "f2", "n").join(same, ["f1", "f2", "n"]).select("_id", "rep", "copies")
    reps = sketched.join(same.select(F.col("rep").alias("_id"), "f1", "f2", "n"), ["_id", "f1", "f2", "n"], "left_semi")
    rows = reps.select("_id", F.explode("bands").alias("band"))
    crowded = rows.groupBy("band").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("band")
    labelled = cut(rows.join(crowded, "band").withColumn("comp", F.col("_id")))
    labels = cut(labelled.groupBy("_id").agg(F.min("comp").alias("comp")))
    for last in (False, True):
        held = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"))
        mixed = cut(held.groupBy("band").agg(F.count("*").alias("classes")).where("classes > 1").select("band"))
        if mixed.isEmpty():
            break
        rest = cut(labelled.join(mixed, "band"))
        if last:
            edges = _within(rest, docs)
        else:
            links = verified(cut(_stars(rest)), docs)
            of = lambda side: labels.select(F.col("_id").alias(side), F.col("comp").alias(f"c{side}"))  # noqa: E731,B023
            edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        step = components(cut(edges))
        step = cut(step.select(F.col("id").alias("comp"), F.col("comp").alias("top")))
        relabel = lambda df: cut(df.join(step, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top"))  # noqa: E731,B023
        labels, labelled = relabel(labels), relabel(rest)
    found = labels.select(F.col("_id").alias("rep"), F.col("comp"))
    final = member.join(found, "rep", "left").select("_id", F.coalesce("comp", "rep").alias("class_id"), "copies")
    return final.dropDuplicates(["_id"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose class has a smaller id. Documents without words and null ids stay, and so do all columns, whatever their names."""
    gone = near_duplicates(docs, id_col, text_col).where("_id <> class_id").select(F.col("_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    rows = docs.select("doc_id").join(found, F.col("doc_id") == F.col("_id"), "left")
    cls = F.coalesce("class_id", "doc_id")
    return rows.select("doc_id", cls.alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), (F.col("doc_id") == cls).alias("kept"))


#: All pairs of documents that share a shingle, compared exactly; who reaches whom by links gives the classes.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, CASE WHEN len(ws) < {SHINGLE} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {SHINGLE} - 1], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {SHINGLE} + 2))) AS i FROM d WHERE len(ws) > 0)),
bags AS (SELECT doc_id, s, count(*) AS n FROM placed GROUP BY ALL),
whole AS (SELECT doc_id, sum(n) AS size, md5(string_agg(s || chr(10) || n, chr(10) ORDER BY s)) AS bag FROM bags GROUP BY doc_id),
same AS (SELECT bag, min(doc_id) AS rep, count(*) AS copies FROM whole GROUP BY bag),
rep_bags AS (SELECT bags.* FROM bags JOIN same ON doc_id = rep),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS k FROM rep_bags x JOIN rep_bags y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN whole p ON a = p.doc_id JOIN whole q ON b = q.doc_id WHERE k >= {THRESHOLD} * (p.size + q.size - k)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT DISTINCT a AS id, a AS other FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(class_id, rep, d.doc_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(class_id, rep, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN whole USING (doc_id) LEFT JOIN same USING (bag) LEFT JOIN classes ON rep = id"""
