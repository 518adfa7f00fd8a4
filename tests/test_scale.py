"""Steps that were too slow or too large for large tables: the same results from less work."""

from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from gridscribe.functions import meteor as M, metrics, text
from gridscribe.operators import neighbours as N


def followed_beams(monkeypatch):
    beams, whole = [], M._followed
    monkeypatch.setattr(M, "_followed", lambda *a: beams.append(a[-1]) or whole(*a))
    return beams


def test_meteor_stops_at_the_fewest_chunks_that_there_can_be(monkeypatch):
    said = [f"{k} was reported in {n} ({n}.5%) subjects in the placebo arm and {n + 1} ({n}.7%) subjects in the drug a arm." for k, n in zip(("teae", "sae", "disc", "fatal", "nausea", "pain"), range(20, 90, 11))]
    generated, reference = " ".join(said).split(), " ".join(said[:4]).split()
    beams = followed_beams(monkeypatch)
    assert M.align(generated, reference) == (len(reference), 1) and beams == [1]
    moved = [w if w != "(20.5%)" else "(21.7%)" for w in generated]
    assert M.align(moved, reference) == (len(reference) - 1, 2) and beams == [1, 1]


def test_meteor_is_that_of_the_whole_beam(monkeypatch):
    rng, beams = random.Random(5), followed_beams(monkeypatch)
    for _ in range(300):
        g, r = ([rng.choice(("report", "reported", "reports", "arm", "arms", "in", "the", "x", "y")) for _ in range(rng.randint(1, 9))] for _ in range(2))
        got = M.align(g, r)
        monkeypatch.setattr(M, "FIRST_BEAMS", ())
        whole, wider = M.align(g, r), M.align(g, r, 100_000)
        assert got[0] == whole[0] == wider[0] and wider[1] <= got[1] <= whole[1], (g, r)
        monkeypatch.setattr(M, "FIRST_BEAMS", (1, 4))
    assert 1 in beams and 32 in beams


def test_no_more_distances_than_a_slice_are_held_at_once():
    rng, asked = np.random.default_rng(1), []
    q_ids, c_ids = np.arange(600), np.r_[rng.permutation(600)[:500], 7, 7]
    d = rng.integers(0, 40, (600, len(c_ids))) / 10 + rng.choice([0, 3e-10, 2e-12], (600, len(c_ids)))
    d[3] = np.inf
    for k in (1, 3, 1000):
        for own in (False, True):
            got = N.best_in_slices(q_ids, d, c_ids, d, k, own, lambda lo, hi: asked.append(len(d[lo:hi])) or d[lo:hi].copy())
            want = []
            for q in q_ids[np.isfinite(d).all(1)]:
                at = [j for j in range(len(c_ids)) if not own or c_ids[j] != q]
                want += [(q, i, x) for x, i in sorted((round(d[q, j], 9), c_ids[j]) for j in at)[:k]]
            assert list(zip(*(got.column(c).to_pylist() for c in ("q", "id", "distance")))) == want, (k, own)
    assert max(asked) <= N.SLICE < len(q_ids)


def test_copies_are_compared_once_and_found_by_their_smallest_ids(spark):
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 5, (9, 3)).astype(float)
    x = kinds[rng.integers(0, 9, 60)]
    x[0] = (9, 9, 9)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = {(r["q"], r["rank"]): (r["id"], r["distance"]) for r in N.nearest_left_out(rows, 2, ["a", "b", "c"]).collect()}
    assert len(got) == 120
    for q in range(60):
        others = np.delete(np.arange(60), q)
        m, s = x[others].mean(0), x[others].std(0)
        z = (x - m) / np.where(s > 0, s, 1.0)
        d = N.distances(z[[q]], z[others], "cosine")[0]
        order = np.lexsort((others, np.round(d, 9)))[:2]
        assert [got[q, k + 1][0] for k in range(2)] == others[order].tolist(), q
        assert np.allclose([got[q, k + 1][1] for k in range(2)], d[order], atol=1e-8)


def test_metric_correlation_has_no_filter_on_metrics(spark):
    from gridscribe.plans.scoring import metric_correlation

    from conftest import SF

    plan = metric_correlation(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and len(line) > 2000 or "Filter" in line and "lambda" in line]


def test_owners_of_distinct_values_and_first_numbers_of_tokens(spark):
    rows = spark.sql("SELECT array(1.0D, 1.0D, 2.0D, 5.0D, 9.0D) g0, array(1.0D, 2.0D, 2.0D) g1, array(1.0D, 2.01D) s0, array(2.0D, 5.0D) s1, '1.234.567 a 2,5% (12.6%), x3 7' t")
    got = rows.select(metrics.confusion([F.col("g0"), F.col("g1")], [F.col("s0"), F.col("s1")]).alias("c"), text.token_numbers(F.col("t"))["nums"].alias("n")).first()
    assert tuple(got["c"]) == (4, 7)  # 5.0 of the first arm is the second's; all three of the second are the first's, as 2.01 is near 2
    assert [(x["i"], x["v"]) for x in got["n"]] == [(2, 25.0), (3, 12.6), (5, 7.0)]


def test_rows_that_are_read_often_are_made_once(spark):
    from conftest import SF

    from gridscribe.plans.synthesis import row_clusters
    from gridscribe.plans.writing import selector

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan(selector(spark, SF)[1]) and "MapInArrow" not in plan(row_clusters(spark, SF))
