"""Shared pieces: reading tables, Arrow text buffers as numpy words, connected components."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import cut, shared_folder, shuffles_released  # noqa: F401

#: The white space of the word rule ``[^\x20\x09-\x0D]+``: only these six characters part words.
WORD_SPACE = " \t\n\x0b\x0c\r"

#: Odd multipliers of the rolling hashes.
_BYTE_MUL, _WORD_MUL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Powers that a worker remembers; longer texts compute theirs anew.
MOST_POWERS = (1 << 19) + 2
#: Bytes and rows of an Arrow batch, and bytes of text that are worked on at once; a longer text is a slice of its own.
BATCH_BYTES, BATCH_ROWS, SLICE = 4 << 20, 2000, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the Python stages by bytes and rows, so that long texts do not pile up in one.

    Spark reads these settings when a plan runs, so they stay in the session; lower ones of the caller's own are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives free memory of this worker back to the machine: reused workers otherwise keep the most that any of their stages took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow whose worker gives its memory back at the end of each partition."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def appending(df: DataFrame, run, extra: str) -> DataFrame:
    """in_arrow whose batches are those of df with further columns (a DDL string) at the end; columns with a dot in their name have another one within."""
    more = StructType.fromDDL(extra).fields
    plain = df.toDF(*[f"_column_{i}" if "." in c or "`" in c else c for i, c in enumerate(df.columns)])
    return in_arrow(plain, run, StructType([*plain.schema.fields, *more])).toDF(*df.columns, *[f.name for f in more])


def packed(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The columns of `roles` (column: role) under their roles, all others, if any, in one struct _rest: no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in roles]
    return df.select(*[F.col(f"`{c}`").alias(r) for c, r in roles.items()], *([F.struct(*rest).alias("_rest")] if rest else []))


def rest_of(df: DataFrame) -> list[str]:
    return ["_rest"] if "_rest" in df.columns else []


def unpacked(df: DataFrame, columns: list[str], roles: dict[str, str], results: dict) -> DataFrame:
    """The reverse, in the order of `columns`, with results (name: column) at the end; a column that a result replaces goes."""
    own = [F.col(roles[c]).alias(c) if c in roles else F.col("_rest").getField(c).alias(c) for c in columns if c not in results]
    return df.select(*own, *[v.alias(k) for k, v in results.items()])


def powers(mul: int, inverse: bool, n: int) -> np.ndarray:
    """mul**i (or its inverse) modulo 2**64 for i < n."""
    have = _POWERS.get((mul, inverse))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), pow(mul, -1, 2**64) if inverse else mul, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= MOST_POWERS:
            _POWERS[mul, inverse] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """Bytes of a letter run: ASCII letters in lower case, all bytes of other characters; everything else is a space."""
    out = np.full(256, 32, np.uint8)
    out[0x61:0x7B] = out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


_LETTERS = _letters()


class Words:
    """The words of a chunk of texts, found on the UTF-8 bytes of the Arrow buffer.

    ``start``/``end`` are byte offsets into ``data``; words of text i are those from ``first[i]`` to ``first[i + 1]``;
    ``hash`` depends on a word's bytes only. White space is ASCII, so no UTF-8 sequence is cut. A null has no words.
    """

    def __init__(self, texts: pa.Array, letters: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        if letters:  # words are runs of letters then, in lower case (ASCII and Latin-1)
            upper = np.zeros(len(b), bool)
            upper[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
            b = _LETTERS[b] + np.uint8(0x20) * upper
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at, to = off[:-1][off[:-1] < len(b)], off[1:][off[1:] > 0] - 1
        first[at], last[to] = inside[at], inside[to]
        self.data, self.offsets = b, off
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.data)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_MUL, False, n), out=total[1:])
            h = (total[self.end] - total[self.start]) * powers(_BYTE_MUL, True, n + 1)[self.start]
            self._total = total
            self._hash = mix64(h + (self.end - self.start).astype(np.uint64))
        return self._hash

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of the first `size` bytes of each word."""
        end = np.minimum(self.end, self.start + size)
        return mix64((self._total[end] - self._total[self.start]) * powers(_BYTE_MUL, True, len(self.data) + 1)[self.start] + np.uint64(size << 32))

    def stretches(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the words i to j - 1, for arrays of both."""
        n = len(self.hash)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * powers(_WORD_MUL, False, n), out=total[1:])
        return mix64((total[j] - total[i]) * powers(_WORD_MUL, True, n + 1)[i] + mix64((j - i).astype(np.uint64)))

    def runs(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words at their first word, and which of them lie within one text."""
        h = self.hash if not seed else mix64(self.hash + np.uint64(seed))
        n = len(h)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(_WORD_MUL, False, n), out=total[1:])
        out = mix64((total[k:] - total[:-k]) * powers(_WORD_MUL, True, n - k + 1))
        return out, self.doc[: n - k + 1] == self.doc[k - 1 :]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by one space."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))


def left_over(words: Words, gone: np.ndarray) -> pa.Array:
    """The words of each text that are not gone, joined by one space."""
    keep = np.flatnonzero(~gone)
    n = len(words.data)
    edge = np.zeros(n + 1, np.int8)
    edge[words.start[keep]] += 1
    edge[words.end[keep]] -= 1  # words never touch
    mask = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    data = words.data.copy()
    joint = keep[:-1][words.doc[keep[:-1]] == words.doc[keep[1:]]] if len(keep) else keep
    mask[words.end[joint]] = True
    data[words.end[joint]] = 32
    texts = len(words.offsets) - 1
    sizes = np.add.reduceat(np.r_[mask, False].astype(np.int64), np.minimum(words.offsets[:-1], n)) if texts else np.zeros(0, np.int64)
    sizes[np.diff(words.offsets) == 0] = 0
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(texts, pa.py_buffer(offsets), pa.py_buffer(data[mask]))


def chunks(batch: pa.RecordBatch, column: str, most: int = SLICE):
    """Slices of the batch with about `most` bytes of text at the most; a longer text is a slice of its own."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; label points to the least member."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each id of the undirected edges (a, b) reaches; those smallest ids themselves have no row.

    Alternating large-star and small-star rounds on deduplicated edges: the number of rounds grows with the logarithm of
    the longest chain, the rows never exceed the edges, and no id gathers its neighbours in one task (only minima are
    aggregated, and joins on a hub's id can be split). Each round ends in a checkpoint.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    previous = None
    while True:
        # large star: neighbours above u link to the smallest neighbour of u
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e1 = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node itself and its smaller neighbours link to the smallest
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(low, "u")
        e = cut(e2.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        with shuffles_released(e.sparkSession):
            mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == previous:
            return e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
        previous = mark
