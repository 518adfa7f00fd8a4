"""Periodic runs against a search of all periods, and the query against its contract word by word."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from gridscribe.llm import periodic
from gridscribe.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) of all runs: each maximal stretch of each period, the smallest period of equal stretches."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def of_texts(texts):
    words = Words(pa.array(texts, pa.string()))
    runs = periodic.find_runs(periodic.word_names(words), words.first)
    out = [[] for _ in texts]
    for s, e, q in runs.tolist():
        t = int(np.searchsorted(words.first, s, "right")) - 1
        out[t].append((s - int(words.first[t]), e - s, q))
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_runs_of_random_texts(letters):
    rng = np.random.default_rng(len(letters))
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            unit = list(rng.choice(list(letters), rng.integers(1, 12)))
            parts += (unit * int(rng.integers(1, 9)))[: int(rng.integers(1, 60))] + list(rng.choice(list(letters), rng.integers(0, 6)))
        texts.append(" ".join(parts))
    texts += ["", " ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b c a b c a b c a b", "a b a b a b a b a"]
    assert of_texts(texts) == [brute_runs(t.split()) for t in texts]


def test_neighbouring_texts_make_no_run_together():
    assert of_texts(["a a a", "a a a", "a b a b", "a b a b a b a b", None, "b a a a a a a"]) == [[], [], [], [(0, 8, 2)], [], [(1, 6, 1)]]


def test_long_texts_of_one_period():
    for period in (1, 2, 7, 1000, 50_000):
        n = 200_003
        w = [f"w{i % period}" for i in range(n)]
        assert of_texts([" ".join(["head", *w, "tail"])]) == [[(1, n, period)]]


def test_few_candidates_at_once(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 8)
    text = " ".join(list("xyabcabcabcabcabcab") + ["z"] * 9 + list("qrstqrstqrstqrst"))
    assert of_texts([text])[0] == brute_runs(text.split())


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = periodic.op13_periodic_runs(spark, SF).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in rows}
    assert len(rows) == len(docs) and got == {d: brute_row(d, t) for d, t in docs}
    assert sum(r[0] for r in got.values()) > 10


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, _runs string, source string, `a.b` int"
    rows = [(1, None, "x", None, 1), (2, "", "x", "s", None), (3, " \n\t", None, "s", 1), (None, "a " * 6, "x", "s", 1), (4, "b c " * 4, "x", "s", 1), (4, "b c " * 4, "x", "s", 1), (5, "é" * 50_000, "x", "s", 1)]
    got = periodic.collapse_runs(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "source", "a.b", "_runs", "_best", "_collapsed"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["_runs"], r["_best"] and tuple(r["_best"]), r["_collapsed"]))
    assert by[1] == by[2] == by[3] == [([], None, "")] and by[5] == [([], None, "é" * 50_000)]
    assert by[None] == [([(0, 6, 1)], (0, 6, 1, 6000), "a")] and by[4] == [([(0, 8, 2)], (0, 8, 2, 4000), "b c")] * 2
    assert periodic.collapse_runs(spark.createDataFrame([], schema)).count() == 0
