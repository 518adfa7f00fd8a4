"""Hand-made rows for the quirks of numbers, cells, arms and metrics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridscribe.functions import metrics as M, tables as B, text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("45 (12.3%) N=1234 N=123", [45, 12.3, 123]), ("1,234 and 12,3 and 1.234", [1234, 123, 1.234]), ("Grade 3-4 and -5.2", [3, 4, -5.2]), ("0.0% .5 10.", [0, 0.5, 10]), ("none", []), (None, []),
])
def test_numbers(spark, text, want):
    assert one(spark, T.extract_numbers(F.col("t")), t=text) == want


def test_sentences_keep_digits_at_their_ends(spark):
    assert one(spark, T.sentences(F.col("t")), t=" 0 of 10. One had 1. then 2! Next 3") == ["0 of 10.", "One had 1. then 2!", "Next 3"]


@pytest.mark.parametrize("cell, n, pct", [("35 (8.5%)", 35, 8.5), ("35 (8.5)", 35, 8.5), ("8.5%", None, 8.5), ("35", 35, 0.0), ("8.5", None, 8.5), ("", None, 0.0)])
def test_cells(spark, cell, n, pct):
    assert tuple(one(spark, B.cell_value(F.col("c")), c=cell)) == (n, pct)


@pytest.mark.parametrize("head, control, experimental, index", [
    ("Event | A (N=10) | Placebo (N=20)", "Placebo", "A", 0), ("Adverse Event Category | X N = 10 | Placebo N = 20", "Adverse Event Category", "X", 1), ("only", "Control", "Experimental", 1),
])
def test_arms(spark, head, control, experimental, index):
    a = one(spark, B.arms(F.col("t")), t=f"start_table [HEADERS: | {head}] [ROW] a | 1 | 2 end_table")
    assert (a["control"], a["experimental"], a["exp_idx"]) == (control, experimental, index)


def test_percent_quirk(spark):
    f = B.table_features(F.col("t"))
    assert one(spark, f["max_pct"], t="5 (12.3%) of") == 0
    assert one(spark, f["max_pct"], t="(N=120)") == 120
    assert len(f) == 32


def test_last_row_without_end_is_lost(spark):
    assert one(spark, F.size(B.raw_rows(F.col("t"))), t="[ROW] a | 1 [ROW] b | 2") == 1


def test_empty_sets(spark):
    none = F.array().cast("array<double>")
    some = F.array(F.lit(1.0))
    for column, want in ((M.nar(none, some), 1.0), (M.ndi(some, none), 1.0), (M.ndi(none, some), 0.0), (M.risk_index(none, some, 1), 0.0)):
        assert one(spark, column, t="") == want
    assert one(spark, M.contraindication_omission(F.lit("fine"), F.lit("One death")), t="") == 1.0


def score(spark, generated, table="start_table [HEADERS: | Event | Placebo (N=50) | Drug A (N=60)] [ROW] Nausea | 5 (10.0%) | 12 (20.0%) end_table"):
    df = spark.createDataFrame([(1, "x", generated, generated, table)], "table_id int, mode string, generated string, reference string, table_text string")
    return M.evaluate(df, ("Placebo", "Drug A")).first()


def test_swapping_arms_keeps_grounding_and_drift_does_not_raise_it(spark):
    from gridscribe.plans.scoring import with_drift, with_swap

    text = "Nausea was reported in 5 (10.0%) subjects in the Placebo arm and 12 (20.0%) subjects in the Drug A arm."
    base = score(spark, text)
    swapped = score(spark, one(spark, with_swap(F.col("t")), t=text))
    drifted = score(spark, one(spark, with_drift(F.col("t")), t=text))
    assert base["nar"] == 1.0 == swapped["nar"] and drifted["nar"] < 1.0 and drifted["hr"] > 0
    assert one(spark, with_drift(F.col("t")), t="no percent") == "no percent"


def test_drift_takes_any_percent(spark):
    from gridscribe.plans.scoring import with_drift, without_severe

    got = [one(spark, with_drift(F.col("t")), t=t) for t in ("a 12% b 3%", "12.34% x", "0.5%", "none")]
    assert got == ["a 13.2% b 3%", "13.5% x", "1.7%", "none"]
    assert one(spark, without_severe(F.col("t")), t="Two died. Any serious adverse reaction was mild. sae here\nNausea. One death.") == "Two died."
    assert one(spark, without_severe(F.col("t")), t="Grade 3 only.") == "Grade 3 only."


def test_common_length_against_the_table():
    import random

    from gridscribe.functions.metrics import common_length

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert common_length(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_lcs(spark):
    assert one(spark, M.lcs(F.split("a", " "), F.split("b", " ")), a="a b c d e", b="b x d e") == 3
    assert one(spark, M.rouge(F.col("a"), F.col("b"))["rouge_l"], a="", b="x") == 0.0


def test_a_missing_text_leaves_the_other_metrics(spark):
    rows = [("ok", "SAE in 5 (5.0%) subjects.", "SAE in 5 (5.0%) subjects.", "SAE | 5 (5.0%)"), ("no reference", "SAE in 5.", None, "SAE | 5 (5.0%)"), ("no table", "SAE in 5.", "SAE in 5.", None), ("none", None, "x", "SAE | 5")]
    df = spark.createDataFrame(rows, "mode string, generated string, reference string, table_text string").withColumn("extra", F.lit("kept"))
    got = {r["mode"]: r for r in M.evaluate_whole(df, ("Placebo", "Drug A")).collect()}
    assert got["ok"]["errors"] == [] and got["ok"]["rouge_l"] == 1.0 and got["ok"]["nar"] == 1.0 and got["ok"]["extra"] == "kept" and got["ok"]["meteor"] > 0.9
    assert got["no reference"]["nar"] == 1.0 and got["no reference"]["rouge_1"] == 0.0 and [e.split(":")[0] for e in got["no reference"]["errors"]] == list(M.TEXT_METRICS)
    assert got["no table"]["rouge_1"] == 1.0 and got["no table"]["nar"] == 0.0 and [e.split(":")[0] for e in got["no table"]["errors"]] == list(M.TABLE_METRICS)
    assert len(got["none"]["errors"]) == len(M.ALL_METRICS) == 16 and got["none"]["fk_grade"] == 0.0


def test_one_python_metric_that_fails_leaves_the_other(monkeypatch):
    import pandas as pd
    from gridscribe.functions import rouge

    def broken(g, r):
        if g == "bad":
            raise RuntimeError("broken")
        return 1.0, 1.0, 1.0

    monkeypatch.setattr(rouge, "scores", broken)
    got = M.text_scores.func(pd.Series(["bad", "a"]), pd.Series(["bad", "a"]))
    assert got.errors.tolist() == [["rouge: broken"], []] and got.rouge_1.tolist() == [0.0, 1.0] and got.meteor[0] > 0 and got.meteor[1] > 0
