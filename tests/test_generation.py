"""Hand-made rows for parsing, wording, summarising, adapting, augmenting and statistics."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscribe.functions import exact, pages as P, rouge, tables as T
from gridscribe.operators import adapt as D, augment as A, generation as G, nlg as N
from gridscribe.plans import synthesis
from gridscribe.plans.retrieval import nearest
from gridscribe.sources import files

HEAD = "start_table [TABLE_TITLE: Table 7: Safety] [HEADERS: | Event | Placebo (N=100) | Drug A (N=200)] "
TABLE = HEAD + "[ROW] Any TEAE | 50 (50.0%) | 120 (60.0%) [ROW] SAE | 5 (5.0%) | 30 (15.0%) [ROW] Grade 3-4 AE | 8 (8.0%) | 20 (10.0%) [ROW] Nausea | 7 (7.0%) | 24 (12.0%) [ROW] Rash | 3 (3.0%) | 8 (4.0%) end_table"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def features(spark, table):
    rows = spark.createDataFrame([(1, table)], "table_id int, table_text string")
    return rows.select("table_id", *[v.alias(k) for k, v in T.table_features(F.col("table_text")).items()])


@pytest.mark.parametrize("wanted, body", [
    ("C13_single_arm", "[HEADERS: | Drug (N=9)] [ROW] Nausea | 1 (11.1%)"), ("C06_open_label_summary", "[HEADERS: | A double-blind (N=9) | B open-label (N=9)] [ROW] Nausea | 1 (1) | 2 (2)"),
    ("C04_sae_fatal_emphasis", "[HEADERS: | A (N=9) | B (N=9)] [ROW] SAE | 1 (1) | 2 (2) [ROW] Fatal | 1 (1) | 1 (1)"),
    ("C08_drug_related_full", "[HEADERS: | A (N=9) | B (N=9)] [ROW] Drug-related SAE | 1 (7.0) | 2 (9.0) [ROW] Discontinued | 1 (1) | 2 (2)"), ("C02_drug_related_emphasis", "[HEADERS: | A (N=9) | B (N=9)] [ROW] Drug-related SAE | 1 (7.0) | 2 (9.0)"),
    ("C03_high_incidence_both_arms", "[HEADERS: | A (N=9) | B (N=9)] [ROW] TEAE | 1 (90.0) | 2 (9) [ROW] SAE | 1 (1) | 1 (1) [ROW] Grade 3 | 1 (1) | 1 (1) [ROW] Discontinued | 1 (1) | 1 (1)"),
    ("C01_standard_two_arm_overall", "[HEADERS: | A (N=9) | B (N=9)] [ROW] SAE | 1 (1) | 1 (1) [ROW] Grade 3 | 1 (1) | 1 (1) [ROW] Discontinued | 1 (1) | 1 (1)"), ("C11_grade34_no_disc", "[HEADERS: | A (N=9) | B (N=9)] [ROW] SAE | 1 (1) | 1 (1) [ROW] Grade 3 | 1 (1) | 1 (1)"),
    ("C05_no_grade34_sae_only", "[HEADERS: | A (N=9) | B (N=9)] [ROW] SAE | 1 (1) | 1 (1) [ROW] Discontinued | 1 (1) | 1 (1)"), ("C12_high_discontinuation", "[HEADERS: | A (N=9) | B (N=9)] [ROW] Discontinued | 1 (1.0) | 1 (20.0)"),
    ("C07_minimal_teae_disc", "[HEADERS: | A (N=9) | B (N=9)] [ROW] Discontinued | 1 (1.0) | 1 (2.0)"), ("C14_individual_ae_listing", "[HEADERS: | A (N=9) | B (N=9)]" + " [ROW] Rash | 1 (1) | 1 (1)" * 4),
    ("C10_teae_only", "[HEADERS: | A (N=9) | B (N=9)] [ROW] Rash | 1 (1) | 1 (1)"), ("C09_safety_population_note", "[HEADERS: | A (N=9) | B (N=9)] [ROW] Grade 3 | 1 (1) | 1 (1)"),
])
def test_every_cluster(spark, wanted, body):
    assert features(spark, f"start_table {body} end_table").select(T.cluster().alias("c")).first()["c"] == wanted


@pytest.mark.parametrize("label, kind", [
    ("Drug-related TEAE leading to discontinuation: related permanent discontinuation", "disc_drug"), ("Drug-related Grade 3-4", "grade34_drug"), ("Drug-related SAEs", "sae_drug"), ("Drug-related TEAEs", "teae_drug"),
    ("Grade 3-4 SAEs", "sae_grade34"), ("Grade 3/4", "grade34"), ("Discontinued", "disc"), ("SAEs", "sae"), ("Grade 5", "fatal"), ("Any TEAE", "teae"), ("Nausea", None),
])
def test_every_row_type(spark, label, kind):
    assert one(spark, T.row_type(F.col("t")), t=label) == kind


@pytest.mark.parametrize("cell, n, pct", [("371 (93.2%)", 371, 93.2), ("65 60.2%", 65, 60.2), ("95.7%", None, 95.7), ("n/a 12%", None, 12.0), ("12", 12, 0.0), ("", None, 0.0), ("| 4 | 5%", 4, 5.0)])
def test_cells_read_together(spark, cell, n, pct):
    assert tuple(one(spark, T.multi_value(F.regexp_replace(F.col("c"), r"\s+\|\s+", " ")), c=cell)) == (n, pct)


def test_slots(spark):
    got = one(spark, G.slots_of(F.col("t")), t=TABLE)
    assert got == {"ARM_A": "Placebo", "ARM_B": "Drug A", "N_A": "100", "N_B": "200", **{f"{p}_{k}_{s}": v for p, a, b in (("TEAE", ("50", "50.0"), ("120", "60.0")), ("SAE", ("5", "5.0"), ("30", "15.0")), ("G34", ("8", "8.0"), ("20", "10.0"))) for s, x in (("A", a), ("B", b)) for k, v in zip(("N", "PCT"), x)}}
    assert one(spark, G.slots_of(F.col("t")), t=None) == {"ARM_A": "Control", "ARM_B": "Experimental"}
    assert one(spark, F.size(G.slots_of(F.col("t"))), t="") == 2


def test_fill(spark):
    slots = F.create_map(F.lit("ARM_B"), F.lit("Drug A"), F.lit("TEAE_PCT_B"), F.lit("60.0"))
    fill = lambda t: one(spark, G.fill(F.col("t"), slots), t=t)
    assert fill("Of {ARM_B} there were {TEAE_PCT_B}%.") == "Of Drug A there were 60.0%." and fill("{SAE_PCT_B}% on {ARM_B}") is None
    assert fill("In all {N_B} subjects on {ARM_B} , events were seen.") == "In all subjects on Drug A, events were seen." and fill("{N_B} on {ARM_B}") is None


def test_choice_falls_back_to_the_fewest_missing(spark):
    slots, none = F.create_map(F.lit("ARM_B"), F.lit("x"), F.lit("DR_SAE_PCT_B"), F.lit("1.0")), G.profile_of(F.create_map(F.lit("a"), F.lit("b")))
    got = one(spark, G.choose("drug_teae", slots, none, F.col("t")), t="z")
    assert got == G.FAMILIES["drug_teae"][0][0]
    assert one(spark, G.choose("drug_sae", slots, none, F.col("t")), t="z") == G.FAMILIES["drug_sae"][1][0]


def test_legacy_fill(spark):
    slots = F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2"))
    got = one(spark, G.legacy_fill(F.col("t"), slots), t="No slot. {A} and {B} and {C}! {A} or {C}. {C}?")
    assert got["text"] == "No slot. 1 and 2 and !" and got["unfilled"] == ["A", "C"]


def test_polish_and_repeats(spark):
    assert one(spark, G.polish(F.col("t")), t=" a ( ) b , , c . . d  e , f 5 % versus in the arm ") == "a b, c. d e, f 5% versus arm"
    got = one(spark, G.unrepeated(F.split("t", "/")), t="A b./a B/ /c/" + "x" * 80 + "1/" + "X" * 80 + "2")
    assert got == ["A b.", "c", "x" * 80 + "1"]
    assert [one(spark, G.merged(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("{X}", "list"), ("an overview long enough", "list"), ("x", ""))] == ["list", "an overview long enough list", "x"]


def test_composed_keeps_bad_rows(spark):
    tables = spark.createDataFrame([(1, TABLE, "C01_standard_two_arm_overall", None), (2, None, "C10_teae_only", None), (3, TABLE, "C01_standard_two_arm_overall", "An adapted text that is long enough.")], "table_id int, table_text string, cluster string, adapted string")
    rows = {r["table_id"]: r for r in G.composed(tables, spark.createDataFrame([], "table_id int, listing string")).collect()}
    assert (rows[2]["summary"], rows[2]["error"]) == (None, "no table") and rows[3]["origin"] == "adapted" and rows[1]["origin"] == "realized"
    assert "60.0%" in rows[1]["summary"] and "{" not in rows[1]["summary"] and rows[1]["error"] is None


def test_nlg_summary(spark):
    got = one(spark, N.summary_of(F.col("t")), t=TABLE)
    assert got == "Events are summed up. They were reported by 60.0% of subjects on Drug A and 50.0% of the control arm. The most frequent ones were Nausea (12.0% vs 7.0%). Serious or severe ones were SAE (15.0% vs 5.0%), and Grade 3-4 AE (10.0% vs 8.0%)." or "more often" in got
    assert one(spark, N.summary_of(F.col("t")), t=HEAD + "[ROW] Rash | 1 (1.0%) | 2 (1.0%) end_table") == N.NOTHING
    single = one(spark, N.summary_of(F.col("t")), t="start_table [HEADERS: | Drug Z (N=9)] [ROW] Any TEAE | 5 (55.6%) [ROW] Rash | 12.5 end_table")
    assert single == "Events of subjects on Drug Z are summed up. They were reported by 55.6% of subjects. The most frequent ones were Rash (12.5%). No serious or fatal events were reported."
    wide = one(spark, N.summary_of(F.col("t")), t=HEAD + "[ROW] Rash | 1 (1.0%) | 50 (25.0%) end_table")
    assert wide.startswith("Subjects on Drug A had events more often")


def test_forced(spark):
    rows = spark.createDataFrame([(True, False, 0.1), (False, False, 0.7), (False, False, 0.5)], "sae boolean, severe boolean, s double").withColumn("e", F.struct("sae", "severe"))
    assert [tuple(r["f"]) for r in rows.select(N.forced(F.col("e"), F.col("s")).alias("f")).collect()] == [(1.0, "told by rule"), (0.7, "told by model"), (0.5, "left out")]


def test_older_summary(spark):
    table = "start_table [TABLE_TITLE: Table 12 of it] [HEADERS: | Arm X (N=10) | Arm Y (N=20)] [ROW] Any TEAE | 9 (90.0) | 20 (100.0) [ROW] SAE | 1 (2.5) | 2 (3.5) [ROW] SAE again | 3 (30.0) | 4 (20.0) end_table"
    assert one(spark, N.older_summary(F.col("t")), t=table) == "Table 12 presents adverse events. All except for 1 on Arm X had events. 3 of 10 subjects (30%) on Arm X and 4 of 20 subjects (20%) on Arm Y had serious events."
    words = lambda n, p, of: one(spark, N.number_words(F.lit(n), F.lit(p), F.lit(of)), t="")
    assert [words(5, 99.6, 5), words(0, 0.4, 9), words(8, 80.0, 9), words(20, 50.0, 90), words(21, 50.0, 90), words(0, 5.0, 9)] == ["All", "None", "All except for 1", "Twenty", "21", "0"]


def test_row_that_goes_on(spark):
    assert one(spark, F.array(F.size(T.line_rows(F.col("t"))), F.size(T.raw_rows(F.col("t")))), t="[ROW] a | 1\nb [ROW] c | 2 end_table") == [1, 2]


def test_linearized(spark):
    grid = F.array(F.array(F.lit(" Event"), F.lit("A"), F.lit("A")), F.array(F.lit(""), F.lit(None).cast("string"), F.lit(" ")), F.array(F.lit("x"), F.lit("x"), F.lit("1")))
    assert one(spark, T.linearized(grid, F.col("t")), t="T 1") == "start_table [TABLE_TITLE: T 1] [HEADERS: | Event | A] [ROW] x | 1 end_table"


def test_adapted_writeup(spark):
    old = "start_table [HEADERS: | Event | Vehicle (N=40) | Drug Q (N=80)] [ROW] Any TEAE | 20 (50.0%) | 60 (75.0%) [ROW] SAE | 2 (5.0%) | 10 (12.5%) end_table"
    said = "Events were seen in 60 (75.0%) on Drug Q and 20 (50.0%) on vehicle. Serious ones were seen in 10 (12.5%) on Drug Q. Deaths were few."
    read = spark.createDataFrame([(said, old, TABLE)], "w string, old string, new string").select("w", "new", T.arms(F.col("old")).alias("a"), D.last_slots(F.col("old")).alias("s")).cache()
    rows = read.withColumn("t", D.delexicalized("w", F.col("a.control"), F.col("a.experimental"), "s"))
    assert rows.select(D.adapted(F.col("t"), G.slots_of(F.col("new"))).alias("x")).first()["x"] == "Events were seen in 120 (60.0%) on Drug A and 50 (50.0%) on Placebo. Serious ones were seen in 30 (15.0%) on Drug A. Deaths were few."
    assert D.delexicalize("Nothing of it.", "a1", "b1", {"X": "7"}) is None and D.delexicalize(None, "a", "b", {}) is None


def test_plainly_adapted_writeup(spark):
    old = "start_table [HEADERS: | Event | Vehicle (N=40) | Drug Q (N=80)] [ROW] Any TEAE | 20 (50.0%) | 60 (75.0%) [ROW] SAE | 2 (5.0%) | 10 (12.5%) end_table"
    got = lambda w: one(spark, D.plainly_delexicalized(F.col("w"), F.col("t")), w=w, t=old)
    assert got("60 (75.0%) on drug q, 160 on x, 75.05 and 2.5.") == "{TEAE_N_B} ({TEAE_PCT_B}%) on {ARM_B}, 160 on x, 75.05 and 2.5."
    assert got("Nothing of it.") is None and one(spark, D.plainly_delexicalized(F.col("w"), F.col("t")), w="x", t="no table") is None


def brute_variant(table, writeup, seed):
    """The variant of a table, step by step in Python from the same draws."""
    draw = lambda salt: int(hashlib.md5(f"{table}:{seed}:{salt}".encode()).hexdigest()[:8], 16) / 2**32
    scale = 0.7 + 0.7 * draw("scale")
    old = list(dict.fromkeys(int(x) for x in re.findall(r"N\s*=\s*(\d+)", table)))
    if not old:
        return None
    size = {n: max(20, round(n * scale / 10) * 10) for n in old}

    def cell(piece):
        m = re.match(r"(\s*)(\d+)\s*\((\d+\.?\d*)(%?)\)", piece)
        fit = m and next((size[n] for n in old if abs(float(m[3]) - int(m[2]) / n * 100) < 5), None)
        if not fit:
            return piece
        n = round(int(m[2]) * scale)
        return f"{m[1]}{n} ({math.floor(n / fit * 1000 + 0.5) / 10}{m[4]})" + piece[m.end() :]

    out = "|".join(cell(p) for p in re.sub(r"(N\s*=\s*)(\d+)", lambda m: m[1] + str(size[int(m[2])]), table).split("|"))
    if draw("rename") < 0.3:
        for name, names, salt in (("Drug A", A.NEW_DRUGS, "drug"), ("Placebo", A.NEW_CONTROLS, "control")):
            new = names[int(draw(salt) * len(names))]
            out, writeup = out.replace(name, new), writeup.replace(name, new)
    return out, writeup, round(scale, 3)


def test_varied_tables(spark):
    said = "Events were seen in 120 (60.0%) on Drug A and 50 (50.0%) on Placebo."
    rows = [(str(i), TABLE.replace("N=100", "N = 200") if i % 3 else TABLE, said) for i in range(40)] + [("x", "no sizes", said), ("y", None, None)]
    df = spark.createDataFrame(rows, "seed string, t string, w string")
    got = {r["seed"]: r["x"] and tuple(r["x"]) for r in df.select("seed", A.varied_table(F.col("t"), F.col("w"), F.col("seed")).alias("x")).collect()}
    assert got == {s: brute_variant(t, w, s) if t else None for s, t, w in rows}
    assert 4 < sum("Drug A" not in v[0] for v in got.values() if v) < 22


def test_varied_numbers(spark):
    df = spark.createDataFrame([("100 of 12345 and 50 (x) 99 a77 7 2024.5",), (None,), ("",)], "t string")
    moved, null, empty = (r["x"] for r in df.select(A.varied_numbers(F.col("t"), F.lit("s")).alias("x")).collect())
    words = moved.split()
    assert 85 <= int(words[0]) <= 115 and 84 <= int(words[6]) <= 114 and words[2] == "12345" and words[4:6] == ["50", "(x)"] and words[7:9] == ["a77", "7"] and null is None and empty == ""


def test_ward_against_the_definition():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (14, 2))

    def brute(threshold):
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            cost = lambda a, b: math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
            (a, b), least = min(((p, cost(*p)) for p in itertools.combinations(groups, 2)), key=lambda e: e[1])
            if least >= threshold:
                break
            groups = [g for g in groups if g not in (a, b)] + [a + b]
        return {frozenset(g) for g in groups}

    for threshold in (0.5, 2.0, 4.0, 100.0):
        of = A.ward(x, threshold)
        assert {frozenset(np.flatnonzero(of == k).tolist()) for k in set(of.tolist())} == brute(threshold)
    assert len(A.ward(x[:0], 1.0)) == 0


def test_oversampling_balances_within_the_hull(spark):
    rows = spark.createDataFrame([(i, float(i), 1.0, 0) for i in range(20)] + [(100 + i, 50.0 + i, 2.0, 1) for i in range(6)], "id bigint, a double, b double, label bigint")
    out = A.oversampled(rows, ("a", "b"), "label", "id", lambda v, k: nearest(v, v, k, metric="euclidean"))
    new = out.where("id is null").collect()
    assert len(new) == 14 and all(50 <= r["a"] <= 55 and r["b"] == 2.0 and r["label"] == 1 for r in new) and out.count() == 40
    assert sorted(map(str, new)) == sorted(map(str, A.oversampled(rows, ("a", "b"), "label", "id", lambda v, k: nearest(v, v, k, metric="euclidean")).where("id is null").collect()))
    assert A.oversampled(rows.where("label = 0"), ("a", "b"), "label", "id", None).count() == 20


def test_vote(spark):
    df = spark.createDataFrame([(0.2, 0.8)], "x double, y double")
    assert df.select(A.vote({"x": F.col("x"), "y": F.col("y")}, {"x": F.lit(3.0), "y": F.lit(1.0)}).alias("v")).first()["v"] == pytest.approx(0.35)


def test_batch_has_a_bound(spark):
    assert synthesis.batched(spark.range(50)).count() == 50
    with pytest.raises(ValueError):
        synthesis.batched(spark.range(51))


def test_json_recovery():
    items = [{"a": 1}, {"b": [2]}]
    text = json.dumps(items)
    for given in (text, f"x\n```json\n{text}\n```", f"see [1], then {text}.", f"```\n{text}```"):
        assert P.json_array(given) == items
    assert P.json_array('x [{"a": "]["}] and [{"b": 1}, {"b": 2}]') == [{"b": 1}, {"b": 2}] and P.json_array('[{"a": "] ["}]') == [{"a": "] ["}]
    assert P.json_array("```\\n[1]\\n``` then [{\"a\": 1}]".replace("\\n", "\n")) == [] and P.json_array("[" * 5000) == []
    assert P.json_array("[1, 2]") == [] == P.json_array(None) == P.json_array("[{") == P.json_array('{"a": 1}')


def test_stems():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formality formal sensitivity sensit triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate cease ceas controlling control rolling roll".split()
    assert {w: rouge.stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def test_stems_of_the_library():
    """Words of the library's own description, and of the rules that it adds to those of 1980."""
    words = "caresses flies dies mules denied died agreed owned humbled sized meeting stating siezing itemization sensational traditional reference colonizer plotted".split()
    assert [rouge.stem(w) for w in words] == "caress fli die mule deni die agre own humbl size meet state siez item sensat tradit refer colon plot".split()
    more = "dying lied skies sky news enjoy happy biology possibly hopefully ace proceed".split()
    assert [rouge.stem(w) for w in more] == "die lie sky sky news enjoy happi biolog possibl hope ace proceed".split()


def test_rouge_f1(spark):
    a, b = rouge.scores("The cats were running home", "the cat ran home")[0], rouge.scores("a b c d", "a x c d")
    assert a == pytest.approx(2 * (3 / 5) * (3 / 4) / (3 / 5 + 3 / 4)) and b == (0.75, pytest.approx(1 / 3), 0.75) and rouge.scores("", "x") == (0.0, 0.0, 0.0) == rouge.scores(None, None)


def test_fisher_against_all_tables():
    for a, b, c, d in ((3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (7, 7, 7, 7), (0, 0, 3, 4)):
        n, row, col = a + b + c + d, a + b, a + c
        p = {x: math.comb(col, x) * math.comb(n - col, row - x) / math.comb(n, row) for x in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(v for v in p.values() if v <= p[a] * (1 + 1e-9)) if row and c + d else 1.0
        assert exact.two_sided(a, b, c, d) == pytest.approx(want)


def test_fisher_by_exact_fractions():
    rnd = random.Random(1)
    for _ in range(400):
        a, b, c, d = (rnd.randrange(rnd.choice([5, 60, 200])) for _ in range(4))
        n, row, col = a + b + c + d, a + b, a + c
        if row and c + d and col and b + d:
            chance = lambda x: math.comb(col, x) * math.comb(n - col, row - x)  # noqa: E731, B023
            every = [chance(x) for x in range(max(0, row + col - n), min(row, col) + 1)]
            want = float(Fraction(sum(p for p in every if p * 10**7 <= chance(a) * (10**7 + 1)), sum(every)))
            assert exact.two_sided(a, b, c, d) == pytest.approx(want, rel=1e-9)


def test_fisher_of_many_cases():
    """A hundred million cases against the sum of all terms by logarithms, and a trillion in no time."""
    a, b, c, d = 25_010_000, 24_990_000, 24_995_000, 25_005_000
    n, row, col = a + b + c + d, a + b, a + c
    mode = (row + 1) * (col + 1) // (n + 2)
    x = np.arange(mode - 60_000, mode + 60_000, dtype=np.float64)
    up = np.cumsum(np.log((row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1))))
    p = np.exp(np.r_[0.0, up] - up.max())
    want = p[p <= p[a - (mode - 60_000)] * (1 + 1e-7)].sum() / p.sum()
    assert exact.two_sided(a, b, c, d) == pytest.approx(want, rel=1e-6)
    assert exact.two_sided(10**11 + 10**6, 10**11, 10**11, 10**11 + 7 * 10**5) == pytest.approx(0.0071897083, rel=1e-6)
    assert exact.two_sided(10**6, 0, 0, 10**6) < 1e-300


def test_jsonl_modes(spark, tmp_path):
    schema = files.StructType([files.StructField("t", files.StringType())])
    lines = spark.createDataFrame([(1, '{"t": "x"}'), (2, "  "), (3, "bad"), (4, None)], "n int, line string")
    assert [tuple(r) for r in files.parse_jsonl(lines, schema).orderBy("n").collect()] == [(1, "x", None), (3, None, "bad")]
    assert files.parse_jsonl(lines, schema, "skip").count() == 1 and files.parse_jsonl(lines.where("n < 3"), schema, "strict").count() == 1
    with pytest.raises(Exception, match='"n":3'):
        files.parse_jsonl(lines, schema, "strict").collect()
    (tmp_path / "a.jsonl").write_text('{"t": "x"}\n\n{"t": "y"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, n_max=2).count() == 1


def test_summary_sinks(spark, tmp_path):
    files.summary(spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.5)], "mode string, nar double"), str(tmp_path / "run"), ("mode",), ("nar",), "r1")
    manifest = spark.read.json(str(tmp_path / "run/manifest")).first()
    assert (manifest["run_id"], manifest["n_examples"], manifest["n_groups"]) == ("r1", 3, 2) and spark.read.csv(str(tmp_path / "run/summary"), header=True).count() == 2
