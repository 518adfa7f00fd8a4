"""Periodic run detection: power-of-two names of word stretches give squares on a grid and their extensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD_SPACE, Words, appending, chunks, left_over, table

#: A run repeats its period at least so many times and has so many words.
MIN_EXPONENT, MIN_WORDS = 4, 6
#: Candidates that are looked at together.
AT_ONCE = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"


def word_names(words: Words) -> np.ndarray:
    """A number for each word of the chunk, equal for equal words."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    offsets = np.r_[0, np.cumsum(words.end - words.start)].astype(np.int32)
    column = pa.BinaryArray.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(words.data[inside])])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def named(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For n places: one name for all of `at` whose values are equal, -1 for values that occur once and for all other places."""
    out = np.full(n, -1, np.int32)
    if len(at):
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        group = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]]) - 1
        again = np.bincount(group)[group] > 1
        out[at[order[again]]] = group[again]
    return out


def name_levels(names: np.ndarray, end: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k names the stretches of 2**k words from each place: equal names for equal stretches, -1 where a stretch occurs once or leaves its text.

    A level is made from the pairs of names that the level below gives to both halves; it takes the places only whose halves recur, and there is none
    beyond the first without any.
    """
    n = len(names)
    levels = [named(names, np.arange(n), n)]
    while (size := 2 << (len(levels) - 1)) < longest:
        below, half = levels[-1], size // 2
        at = np.flatnonzero(below >= 0)
        at = at[at + size <= end[at]]
        at = at[below[at + half] >= 0]
        level = named(below[at].astype(np.int64) * n + below[at + half], at, n)
        if not (level >= 0).any():
            break
        levels.append(level)
    return levels


def common_extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, bound: np.ndarray, ahead: bool) -> np.ndarray:
    """Words that agree from places i and j on (i < j < bound), or before them (bound <= i): level by level, the longest first."""
    n = np.zeros(len(i), np.int64)
    last = len(levels[0]) - 1
    for k in reversed(range(len(levels))):
        level, size = levels[k], 1 << k
        active = np.arange(len(i))
        while len(active):
            if ahead:
                x, y = i[active] + n[active], j[active] + n[active]
                inside = y + size <= bound[active]
            else:
                x, y = i[active] - n[active] - size, j[active] - n[active] - size
                inside = x >= bound[active]
            name = level[np.clip(x, 0, last)]
            active = active[inside & (name >= 0) & (name == level[np.clip(y, 0, last)])]
            n[active] += size
            if k + 1 < len(levels):
                break  # below the highest level a stretch fits once at most
    return n


def grid(q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All multiples p of 2 * q with p + 2 * q <= n, for each period of q: (p, q)."""
    count = n // (2 * q)
    periods = np.repeat(q, count)
    return (np.arange(len(periods)) - np.repeat(np.cumsum(count) - count, count)) * 2 * periods, periods


def find_runs(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period; text t holds the places first[t] to first[t + 1] - 1.

    A run of period q has four periods at least, so a multiple of 2 * q begins a square of period q within it. Whether a place does is told
    by two pairs of names. A square is widened to both sides by the names of all levels; squares within a run of a smaller period that is known
    already are the same run. Of equal stretches the smallest period is the period.
    """
    n, sizes = len(names), np.diff(first)
    longest = int(sizes.max(initial=0))
    none = np.zeros((0, 3), np.int64)
    if longest < MIN_WORDS:
        return none
    text = np.repeat(np.arange(len(sizes)), sizes)
    start, end = first[:-1][text], first[1:][text]
    levels = name_levels(names, end, longest)
    known, found = np.zeros(n, np.int64), [none]
    for k, level in enumerate(levels):
        low, high = 1 << k, min((2 << k) - 1, longest // MIN_EXPONENT)
        while low <= high:
            step = max(1, AT_ONCE * 2 * low // n)
            p, q = grid(np.arange(low, min(low + step, high + 1)), n)
            low += step
            name = level[p]
            ok = (name >= 0) & (name == level[p + q]) & (p + 2 * q <= end[p]) & (known[p] < p + 2 * q)
            p, q, name = p[ok], q[ok], level[p[ok] + q[ok] - (1 << k)]
            ok = (name >= 0) & (name == level[p + 2 * q - (1 << k)])
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            s = p - common_extension(levels, p, p + q, start[p], False)
            e = p + q + common_extension(levels, p, p + q, end[p], True)
            ok = e - s >= np.maximum(MIN_WORDS, MIN_EXPONENT * q)
            if ok.any():
                runs = np.unique(np.stack([s[ok], e[ok], q[ok]], 1), axis=0)
                found.append(runs)
                np.maximum.at(known, runs[:, 0], runs[:, 1])
                np.maximum.accumulate(known, out=known)
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)]] if len(runs) else runs
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _run_columns(runs: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """_runs and _best of each text; starts are counted from the first word of the text."""
    of = np.searchsorted(runs[:, 0], first)
    start = runs[:, 0] - np.repeat(first[:-1], np.diff(of))
    length, period = runs[:, 1] - runs[:, 0], runs[:, 2]
    names = ["start", "length", "period"]
    every = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names))
    rows = list(zip(start.tolist(), length.tolist(), period.tolist()))
    best: list[dict | None] = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        # quotients of numbers below 2**31 that differ do so after 64 further bits too
        s, n, q = min(rows[a:b], key=lambda r: (-((r[1] << 64) // r[2]), r[0], r[2]), default=(None, None, None))
        best.append(None if q is None else {"start": s, "length": n, "period": q, "exponent_milli": 1000 * n // q})
    kind = pa.struct([(c, pa.int64()) for c in (*names, "exponent_milli")])
    return every, pa.array(best, kind)


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _runs (array of start, length, period, by start and period), _best (the run of the greatest length / period with its exponent_milli; ties: the
    smallest start, then period; null without a run) and _collapsed, the text's words but for those that any run holds after its first period, joined by one space.

    Words are named by their bytes, stretches of two, four, eight and more words by the pair of names of their halves: no hash decides anything. The levels of a chunk
    of texts end with the longest repeat in it. Their memory is four bytes a word and level, so a text that is one run throughout takes log2 of its words times that:
    some 100 bytes a word.

    Null and empty texts: no runs, nothing left. Each row by itself, without a shuffle: ties, repeated rows and empty tables need nothing special; a very long text is
    a chunk of its own and is looked at whole. Further columns stay; columns named like the results are replaced.
    """
    docs = docs.drop("_runs", "_best", "_collapsed")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                words = Words(part.column(text_col))
                runs = find_runs(word_names(words), words.first)
                gone = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 1], -1)
                kept = left_over(words, np.cumsum(gone[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, *_run_columns(runs, words.first), kept], [*part.schema.names, "_runs", "_best", "_collapsed"])

    shape = "start: bigint, length: bigint, period: bigint"
    return appending(docs, run, f"_runs array<struct<{shape}>>, _best struct<{shape}, exponent_milli: bigint>, _collapsed string")


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text in which, for one document in ten, the words from a place on repeat a stretch (place and stretch follow from the id); null ids and other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.split(F.btrim(text, F.lit(WORD_SPACE)), SPACE, -1)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(w, lambda _, i: F.get(w, place(i))), " ")

    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeat), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    rows = collapse_runs(docs)
    listed = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))
