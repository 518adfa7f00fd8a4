"""Nearest neighbours by pivots and with scalers of their own, against all pairs and against rebuilding."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from gridscribe.operators import neighbours as N


def brute(ids, x, c_ids, c, k, metric, exclude=True):
    out = {}
    for i, v in zip(ids, x):
        d = N.distances(v[None], c, metric)[0]
        order = sorted((float(e), j) for e, j in zip(d, c_ids) if not exclude or j != i)[:k]
        out[i] = order
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(e) for e in v]) for i, v in zip(ids, x)], "id bigint, v array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pivots_equal_all_pairs(spark, metric):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 5
    x = np.concatenate([centres[rng.integers(12, size=500)] + rng.normal(size=(500, 8)) * 0.3, np.repeat(centres[:1], 200, 0), np.zeros((3, 8))])
    ids = np.arange(len(x))
    got, work = N.nearest_by_pivots(frame(spark, ids[::7], x[::7]), frame(spark, ids, x), 4, metric, pivots=16)
    found = {}
    for r in got.collect():
        found.setdefault(r["q"], []).append((r["rank"], r["distance"], r["id"]))
    want = brute(ids[::7], x[::7], ids, x, 4, metric)
    assert {q: [(d, i) for _, d, i in sorted(v)] for q, v in found.items()} == {q: [(pytest.approx(d, abs=1e-8), i) for d, i in v] for q, v in want.items()}
    done = work.first()
    assert done["pairs"] == len(ids[::7]) * len(ids) and done["compared"] < 0.5 * done["pairs"]


def test_pivots_of_odd_rows(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id bigint, v array<double>")
    got = {(r["q"], r["rank"]): (r["id"], r["distance"]) for r in N.nearest_by_pivots(c, c, 3)[0].collect()}
    assert got[1, 1] == (5, 0.0) and got[1, 2] == (3, 1.0) and got[3, 1] == (1, 1.0) and len(got) == 12
    none = c.where("id > 99")
    assert N.nearest_by_pivots(c, none, 3)[0].count() == 0 and N.nearest_by_pivots(none, c, 3)[0].count() == 0
    one = c.where("id = 1")
    assert N.nearest_by_pivots(one, one, 3)[0].count() == 0


def test_small_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "PART", 32)
    x = np.random.default_rng(3).normal(size=(200, 3))
    ids = np.arange(200)
    got = {(r["q"], r["rank"]): r["id"] for r in N.nearest_by_pivots(frame(spark, ids, x), frame(spark, ids, x), 2, pivots=4)[0].collect()}
    want = brute(ids, x, ids, x, 2, "cosine")
    assert got == {(q, r + 1): i for q, v in want.items() for r, (_, i) in enumerate(v)}
    rows = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x)], "id bigint, a double, b double, c double")
    assert left_out(rows, ["a", "b", "c"]) == rebuilt(ids, x)


def test_visits_do_not_hang_on_batches(spark, monkeypatch):
    """Bounds whose last digits change with the batch, as those of matrix products do, and a join that deals the queries anew: no cell is left out of both rounds or visited in both."""

    class Shifting(N.Cells):
        def bounds(self, x):
            return super().bounds(x) + np.random.default_rng(zlib.crc32(x.tobytes())).uniform(0, 1e-8, (len(x), len(self.n)))

    monkeypatch.setattr(N, "Cells", Shifting)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    ids = rng.permutation(len(x))
    rows = frame(spark, ids, x)
    try:
        got = sorted((r["q"], r["rank"], r["id"]) for r in N.nearest_by_pivots(rows.coalesce(1), rows, 3, pivots=8)[0].collect())
    finally:
        spark.conf.set(key, before)
    assert got == sorted((i, r + 1, j) for i, v in brute(ids, x, ids, x, 3, "cosine").items() for r, (_, j) in enumerate(v))


def test_six_digits_as_sql_rounds(spark):
    import duckdb
    from pyspark.sql import functions as F

    from gridscribe.plans.retrieval import six_digits

    got = spark.range(2000).select(six_digits((F.col("id") * 1000 + 500) / 1e9).alias("d")).collect()
    assert [r["d"] for r in got] == [r[0] for r in duckdb.sql("SELECT round((i * 1000 + 500) / 1e9, 6) FROM range(2000) t(i)").fetchall()]


def left_out(rows, names):
    return {r["q"]: (r["id"], pytest.approx(r["distance"], abs=1e-7)) for r in N.nearest_left_out(rows, 1, names).collect()}


def rebuilt(ids, x):
    """The scaler fitted anew for each row, on the others."""
    out = {}
    for i in range(len(x)):
        rest = np.delete(x, i, 0)
        s = np.where(rest.min(0) < rest.max(0), rest.std(0), 1.0)
        d = N.distances(((x[i] - rest.mean(0)) / s)[None], (rest - rest.mean(0)) / s, "cosine")[0]
        best = min((round(float(e), 8), j) for e, j in zip(d, np.delete(ids, i)))
        out[int(ids[i])] = (int(best[1]), best[0])
    return out


def test_left_out_equals_rebuilding(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=60), rng.normal(size=60) * 1e6, np.ones(60), np.r_[5.0, np.zeros(59)], np.r_[1e9, rng.normal(size=59)], rng.integers(0, 2, 60)])
    ids = np.arange(60)
    names = [f"f{i}" for i in range(6)]
    rows = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x)], "id bigint, " + ", ".join(f"{n} double" for n in names))
    got, want = {r["q"]: (r["id"], r["distance"]) for r in N.nearest_left_out(rows, 1, names).collect()}, rebuilt(ids, x)
    assert {q: i for q, (i, _) in got.items()} == {q: i for q, (i, _) in want.items()}
    assert all(got[q][1] == pytest.approx(want[q][1], abs=1e-6) for q in want)


def test_left_out_of_few_rows(spark):
    kind = "id bigint, a double"
    assert N.nearest_left_out(spark.createDataFrame([], kind), 1, ["a"]).count() == 0 and N.nearest_left_out(spark.createDataFrame([(1, 2.0)], kind), 1, ["a"]).count() == 0
    assert [(r["q"], r["id"], r["distance"]) for r in N.nearest_left_out(spark.createDataFrame([(1, 2.0), (2, None)], kind), 1, ["a"]).orderBy("q").collect()] == [(1, 2, 1.0), (2, 1, 1.0)]


def test_leave_one_out_report_equals_rebuilding(spark):
    """Scores of each table from a neighbour that is found with a scaler fitted without it, and their statistics by numpy."""
    from conftest import SF
    from gridscribe.functions.tables import FEATURES
    from gridscribe.plans import retrieval as R

    feats = R.features(spark, SF).toPandas().sort_values("table_id")
    near = rebuilt(feats.table_id.to_numpy(), feats[list(FEATURES)].to_numpy(float))
    assert {r["q"]: r["id"] for r in R.loo_neighbours(spark, SF).collect()} == {q: i for q, (i, _) in near.items()}
    scores = R.loo_scores(spark, SF).toPandas()
    assert len(scores) == len(feats) and set(scores.origin) <= {"adapted", "realized", "template"} and "adapted" in set(scores.origin)
    for r in R.loo_report(spark.createDataFrame(scores)).collect():
        v = scores[r["metric"]].to_numpy(float)
        want = (v.mean(), v.std(), *np.percentile(v, (10, 50, 90)), v.min(), v.max())
        assert [r[c] for c in ("mean", "std", "p10", "p50", "p90", "min", "max")] == pytest.approx(list(want), abs=6e-5) and r["n"] == len(v)
        assert r["goals"] == {f"{s} {sign} {g}": (r[s] > g if sign == ">" else r[s] < g) for m, s, sign, g in R.LOO_GOALS if m == r["metric"]}
