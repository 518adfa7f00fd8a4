"""Substring deduplication: recurring passages as Aho-Corasick automata that documents are streamed through."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import Words, chunks, in_arrow, left_over, packed, partitions, rest_of, table, unpacked

WINDOW = 50
#: Words of an anchor run. A window's anchor is the least hash of its runs of so many words.
ANCHOR = 12
#: Words of the passages that one automaton holds at most; each is a letter, so there are no more letters than these.
SHARD_WORDS = 400_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima to both sides of every w-th place."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchored(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows within one text, and the anchor of each."""
    runs, _ = words.runs(anchor, seed=1)
    least = sliding_min(runs, window - anchor + 1)
    starts = np.flatnonzero(words.doc[: len(least)] == words.doc[window - 1 :][: len(least)]) if len(least) else np.zeros(0, np.int64)
    return starts, least[starts].view(np.int64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("_id").to_numpy(zero_copy_only=False))


def find_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, _id): anchors of the documents' windows; adjoining windows mostly share theirs."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                words = Words(part.column("_text"))
                starts, a = anchored(words, window, anchor)
                doc = words.doc[starts]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else starts
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(_ids(part)[doc[new]])], ["a", "_id"])

    return in_arrow(docs, run, f"a bigint, _id {docs.schema['_id'].dataType.simpleString()}")


def _wanted(part: pa.RecordBatch, words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (first word, anchor in 32 bits) whose anchor is among the _marks of their own text."""
    starts, a = anchored(words, window, anchor)
    column = part.column("_marks")
    off = column.offsets.to_numpy()
    marks = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
    wanted = np.unique((np.repeat(np.arange(part.num_rows), np.diff(off)) << 32) | (marks & 0xFFFFFFFF))
    hit = np.isin((words.doc[starts] << 32) | (a & 0xFFFFFFFF), wanted)
    return starts[hit], a[hit].astype(np.int32)


def _stretches(starts: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of adjoining windows with one anchor."""
    if not len(starts):
        return starts, starts
    first = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (a[1:] != a[:-1])])
    return first, np.r_[first[1:], len(starts)] - 1


def find_stretches(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """(s, a, _id): hash of the words that adjoining windows of one recurring anchor cover."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                words = Words(part.column("_text"))
                starts, a = _wanted(part, words, window, anchor)
                first, last = _stretches(starts, a)
                s = words.stretches(starts[first], starts[last] + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(a[first]), pa.array(_ids(part)[words.doc[starts[first]]])], ["s", "a", "_id"])

    return in_arrow(marked, run, f"s bigint, a int, _id {marked.schema['_id'].dataType.simpleString()}")


def find_windows(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """(w, _id, a): hash, document and anchor of single windows with a marked anchor."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                words = Words(part.column("_text"))
                starts, a = _wanted(part, words, window, anchor)
                w = words.runs(window)[0][starts].view(np.int64) if len(starts) else starts
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(_ids(part)[words.doc[starts]]), pa.array(a)], ["w", "_id", "a"])

    return in_arrow(marked, run, f"w bigint, _id {marked.schema['_id'].dataType.simpleString()}, a int")


def cut_passages(owners: DataFrame, window: int, anchor: int) -> DataFrame:
    """(owner, a, passage): the words that adjoining windows of one anchor cover in the document that has them first."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                words = Words(part.column("_text"))
                starts, a = _wanted(part, words, window, anchor)
                first, last = _stretches(starts, a)
                texts = [words.joined(i, j) for i, j in zip(starts[first].tolist(), (starts[last] + window).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(_ids(part)[words.doc[starts[first]]]), pa.array(a[first]), pa.array(texts, pa.string())], ["owner", "a", "passage"])

    return in_arrow(owners, run, f"owner {owners.schema['_id'].dataType.simpleString()}, a int, passage string")


def _longest(most: int, equal) -> int:
    """The largest n up to `most` with equal(0, n), where equal(i, j) compares what lies between i and j: stretches double until one differs, which is then halved."""
    n, step = 0, 64
    while n < most:
        k = min(step, most - n)
        if equal(n, n + k):
            n, step = n + k, 2 * step
            continue
        low, high = 0, k
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if equal(n + low, n + mid) else (low, mid)
        return n + low
    return n


def agreement(a: str, i: int, b: str, j: int) -> int:
    """Letters that agree from a[i] and b[j] on."""
    return _longest(min(len(a) - i, len(b) - j), lambda x, y: a[i + x : i + y] == b[j + x : j + y])


def agreement_before(a: str, i: int, b: str, j: int) -> int:
    """Letters that agree before a[i] and b[j]."""
    return _longest(min(i, j), lambda x, y: a[i - y : i - x] == b[j - y : j - x])


class Shard:
    """An automaton over some passages, each word one letter of the shard's own alphabet.

    Patterns are the passages' aligned runs of half a window: any window of a passage holds a whole one. Each pattern carries
    the passages and places it comes from; a hit is widened to both sides as far as passage and document agree.
    """

    def __init__(self, passages: list[tuple[list[bytes], int]], window: int):
        self.window, self.letter, self.passages = window, {}, []
        half = window // 2
        places: dict[str, list[tuple[int, int]]] = {}
        for words, owner in passages:
            letters = []
            for w in words:
                c = self.letter.get(w)
                if c is None:
                    n = len(self.letter) + 1
                    c = self.letter[w] = chr(n if n < 0xD800 else n + 0x800)
                letters.append(c)
            string = "".join(letters)
            for o in range(0, len(string) - half + 1, half):
                places.setdefault(string[o : o + half], []).append((len(self.passages), o))
            self.passages.append((string, owner))
        self.automaton = ahocorasick.Automaton()
        for tile, where in places.items():
            self.automaton.add_word(tile, (len(tile), where))
        self.automaton.make_automaton()

    def occurrences(self, words: list[bytes], doc_id) -> list[tuple[int, int]]:
        """Stretches [i, j) of the document, a window long at least, that a passage of a smaller document covers; together they hold every word of every such window.

        Any such window holds a whole hit and reaches no further than a window less the hit to either side of it. So a hit is passed over, and the rest of its places too, once all
        words that near to it are in one stretch: a passage that repeats itself is not tried at each of its places against each place of the text.
        """
        get = self.letter.get
        text = "".join([get(w, "\0") for w in words])
        n, seen, out = len(text), {}, []
        low, high = 0, 0  # what joined stretches cover last
        for last, (size, where) in self.automaton.iter(text):
            p = last + 1 - size
            first, end = max(0, p - self.window + size), min(n, p + self.window)
            for k, o in where:
                if low <= first and end <= high:
                    break
                passage, owner = self.passages[k]
                shift = p - o
                if owner >= doc_id or seen.get((k, shift), -1) > p:
                    continue
                i = p - agreement_before(passage, o, text, p)
                j = p + size + agreement(passage, o + size, text, p + size)
                seen[k, shift] = j
                if j - i >= self.window:
                    out.append((i, j))
                    low, high = (min(low, i), max(high, j)) if i <= high and low <= j else (i, j)
        return out


def shards(passages: list[tuple[bytes, int]], window: int):
    """Automata of at most SHARD_WORDS words each. A longer passage is cut into pieces that share a window less one word, so that each of its windows is in one."""
    now, size = [], 0
    for text, owner in passages:
        words = text.split(b" ")
        for i in range(0, max(1, len(words) - window + 1), SHARD_WORDS - window + 1):
            piece = words[i : i + SHARD_WORDS]
            if now and size + len(piece) > SHARD_WORDS:
                yield Shard(now, window)
                now, size = [], 0
            now.append((piece, owner))
            size += len(piece)
    if now:
        yield Shard(now, window)


def strip_occurrences(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, removed words and what is left of each text of the part, whose _passages are compiled and located."""
    words = Words(part.column("_text"))
    removed = np.zeros(len(words.start) + 1, np.int64)
    ids, column = _ids(part), part.column("_passages")
    first: dict[bytes, int] = {}
    for one in column.to_pylist():
        for x in one or ():
            text = x["passage"].encode()
            first[text] = min(x["owner"], first.get(text, x["owner"]))
    to_stream = np.flatnonzero(list_sizes(column) > 0).tolist()
    for shard in shards(list(first.items()), window):
        for d in to_stream:
            i, j = int(words.first[d]), int(words.first[d + 1])
            data = words.data
            mine = [data[s:e].tobytes() for s, e in zip(words.start[i:j].tolist(), words.end[i:j].tolist())]
            for a, b in shard.occurrences(mine, ids[d]):
                removed[i + a] += 1
                removed[i + b] -= 1
    gone = np.cumsum(removed[:-1]) > 0
    counts = np.bincount(words.doc[gone], minlength=part.num_rows)
    return np.diff(words.first), counts, left_over(words, gone)


def list_sizes(column: pa.Array) -> np.ndarray:
    off = column.offsets.to_numpy()
    return np.where(np.asarray(column.is_null()), 0, np.diff(off))


def with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts of marked documents; marks are hashed, so that the texts need no sort."""
    return texts.join(marks.hint("shuffle_hash"), "_id")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with _n_words, _n_removed (long) and _kept (the words that stay, joined by one space).

    A word goes if a window of `window` words covers it whose words also begin somewhere in a document with a smaller id.

    1. Each window has an anchor, the least hash of its 12-word runs: equal windows have equal anchors, and one in twenty words
       begins a new one. Anchors of two documents or more recur.
    2. The words that adjoining windows of such an anchor cover are a stretch, hashed as a whole; a stretch that two documents
       hold is confirmed, and the smallest id owns it. Where an anchor has different stretches, their windows are hashed one by one, and
       those that two first holders share are confirmed in the same way. So copies are confirmed by a row per stretch, and only
       the edges of passages by a row per window.
    3. The owners' texts give the passages. Each document is sent those that it was confirmed to share; per slice of documents
       they are compiled to automata of bounded size, through which the documents of that slice are streamed. Occurrences are
       compared word by word, so hashes only propose. A document that is sent nothing holds no confirmed window and stays as it is.

    Only hashes and passages are shuffled besides one pass of the texts, which three joins share. A passage that a third of all documents share is one owner and small
    aggregates; each document gets passages in proportion to its own repeated words.

    Null or empty text: no words, nothing kept. Ties: a passage has one smallest id, its owner; which of equal hashes comes first plays no part. Rows with the same id are one document: they do not remove each other's words.
    Null ids: kept whole, they own nothing. Empty table: no rows. Texts are never cut. Further columns stay; columns named like
    the results are replaced.
    """
    spark = docs.sparkSession
    roles = {id_col: "_id", text_col: "_text"}
    rows = packed(docs, roles)
    texts = rows.where("_id is not null").repartition(partitions(spark), "_id")
    bare = texts.select("_id", "_text")
    anchors = find_anchors(rows.where("_id is not null").select("_id", "_text"), window, ANCHOR)
    recurring = anchors.groupBy("a").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("a")
    marks = anchors.join(recurring, "a").groupBy("_id").agg(F.collect_set("a").alias("_marks"))
    stretches = find_stretches(with_marks(bare, marks), window, ANCHOR)
    # the conditions below always hold: with them, both uses of a step read the same columns and Spark reuses its exchange
    held = stretches.groupBy("s", "a").agg(F.min("_id").alias("owner"), F.max("_id").alias("last")).where("owner <= last").select("s", "a", "owner", "last")
    whole = stretches.join(held.where("owner < last").select("s", "owner"), "s").where("_id > owner").select("_id", "owner", "a")
    varied = held.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    marks = held.join(varied, "a").groupBy(F.col("owner").alias("_id")).agg(F.collect_set("a").alias("_marks"))
    windows = find_windows(with_marks(bare, marks), window, ANCHOR)
    owned = windows.groupBy("w").agg(F.min("_id").alias("owner"), F.max("_id").alias("last")).where("owner < last").select("w", "owner")
    parts = windows.join(owned, "w").where("_id > owner").select("_id", "owner", "a")
    links = whole.union(parts).groupBy("_id", "owner", "a").agg(F.count("*").alias("k")).where("k > 0").select("_id", "owner", "a")
    sources = links.groupBy("owner").agg(F.collect_set("a").alias("_marks")).withColumnRenamed("owner", "_id")
    passages = cut_passages(with_marks(bare, sources), window, ANCHOR)
    sent = links.join(passages, ["owner", "a"]).groupBy("_id").agg(F.collect_list(F.struct("owner", "passage")).alias("_passages"))
    nameless = rows.where("_id is null").withColumn("_passages", F.lit(None).cast(sent.schema["_passages"].dataType))
    rows = texts.join(sent.hint("shuffle_hash"), "_id", "left").unionByName(nameless)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                n_words, n_removed, kept = strip_occurrences(part, window)
                names = [c for c in part.schema.names if c != "_passages"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)), kept], [*names, "n_words", "n_removed", "kept"])

    rows = rows.select("_id", "_text", *rest_of(rows), "_passages")
    fields = [f for f in rows.schema.fields if f.name != "_passages"] + StructType.fromDDL("n_words bigint, n_removed bigint, kept string").fields
    results = {"_n_words": F.col("n_words"), "_n_removed": F.col("n_removed"), "_kept": F.col("kept")}
    return unpacked(in_arrow(rows, run, StructType(fields)), docs.columns, roles, results)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


#: Every window of every document by its words.
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW} - 1], ' ')) AS k FROM placed),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hits, (SELECT unnest(range(0, {WINDOW})) AS j)),
one AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
