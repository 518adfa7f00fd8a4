"""Joins by nearness, sketches, alignment, clusters, votes, pages and filtered appends, against brute force."""

from __future__ import annotations

import itertools
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscribe.functions import html as H, meteor as E
from gridscribe.functions.rouge import stem
from gridscribe.operators import augment as A, clusters as C, joins as J, quantiles as Q, voting as V
from gridscribe.plans import relational as R
from gridscribe.sources import files
from gridscribe.streaming import incremental

TEXT = "key int, tag string, g double"
KNOWN = "key int, place int, s double"


def nearest(spark, asks, known):
    rows = J.nearest_values(spark.createDataFrame(asks, TEXT), spark.createDataFrame(known, KNOWN), ["key"])
    one = J.nearest_one(F.col("below"), F.col("above"), F.col("g"))
    return {(r["key"], r["tag"]): (r["s"], r["place"]) for r in rows.select("key", "tag", one["s"].alias("s"), one["place"].alias("place")).collect()}


def test_nearest_values(spark):
    rng = np.random.default_rng(5)
    known = [(int(k), i, float(v)) for k in (1, 2) for i, v in enumerate(rng.integers(-40, 40, 60))] + [(3, 0, None), (None, 0, 1.0)]
    asks = [(int(rng.integers(1, 5)), f"t{i}", float(rng.integers(-60, 60)) + 0.5 * int(rng.integers(2))) for i in range(300)]
    got = nearest(spark, asks, known)
    assert len(got) == 300
    for key, tag, g in asks:
        have = [(abs(g - s), p, s) for k, p, s in known if k == key and s is not None]
        assert got[key, tag] == ((min(have)[2], min(have)[1]) if have else (None, None))
    assert nearest(spark, [], known) == {} and nearest(spark, [(1, "a", 2.0)], []) == {(1, "a"): (None, None)}


def test_nearest_values_of_one_large_key(spark):
    """A text of 100,000 numbers against a table of as many, in ranges, not pairs."""
    n = 100_000
    asks = spark.range(n).select(F.lit(1).alias("key"), F.col("id").cast("string").alias("tag"), (F.col("id") * 2.0 + 0.5).alias("g"))
    known = spark.range(n).select(F.lit(1).alias("key"), F.col("id").cast("int").alias("place"), (F.col("id") * 2.0).alias("s"))
    began = time.time()
    rows = J.nearest_values(asks, known, ["key"])
    one = J.nearest_one(F.col("below"), F.col("above"), F.col("g"))["s"]
    assert rows.select(F.sum(F.abs(F.col("g") - one)).alias("x"), F.count("*").alias("n")).first() == (0.5 * n, n) and time.time() - began < 60


def test_drift_in_a_row_and_by_join(spark):
    source = " ".join(f"{i}.5" for i in range(300))
    rows = [(1, "a", "12.4 and 700", source), (1, "b", "no numbers", source), (2, "a", "5 6", "none"), (3, "a", "", None), (4, "a", "3 4", "3.5")]
    df = spark.createDataFrame(rows, "table_id int, mode string, generated string, table_text string")
    got = {(r["table_id"], r["mode"]): r["ndi"] for r in R.drift(df, ["table_id", "mode"], "table_id", "generated", "table_text").collect()}
    assert got == {(1, "a"): pytest.approx((0.1 / 12.5 + 400.5 / 299.5) / 2), (1, "b"): 0.0, (2, "a"): 1.0, (3, "a"): 0.0, (4, "a"): pytest.approx(0.5 / 3.5)}


def test_within_radius(spark):
    rng = np.random.default_rng(6)
    left = [(int(k), int(i)) for k, i in zip(rng.integers(0, 2, 80), rng.integers(0, 500, 80))]
    right = [(int(k), int(j)) for k, j in zip(rng.integers(0, 2, 80), rng.integers(0, 500, 80))]
    for radius in (0, 1, 30):
        got = J.within_radius(spark.createDataFrame(left, "key int, i int"), spark.createDataFrame(right, "key int, j int"), ["key"], radius).collect()
        want = [(k, i, j) for k, i in left for m, j in right if k == m and abs(i - j) <= radius]
        assert Counter((r["key"], r["i"], r["j"]) for r in got) == Counter(want)


def test_confusion_of_a_long_text(spark):
    """Fifty thousand mentions of two arms: each number beside the wrong one."""
    n = 25_000
    said = " ".join(f"Placebo {i % 900}.5 x x x Drug A {i % 900}.25 y y y" for i in range(n))
    table = " ".join(f"Drug A {i}.5 x x x Placebo {i}.25 y y y" for i in range(900))
    df = spark.createDataFrame([(1, "m", said, table)], "table_id int, mode string, generated string, table_text string")
    began = time.time()
    r = R.arm_confusion(df, ["table_id", "mode"], "table_id", "generated", "table_text", ("Placebo", "Drug A"), radius=2).first()
    assert r["evaluated"] > 0 and time.time() - began < 90
    small = " ".join(said.split()[:40])
    from gridscribe.functions import metrics as M

    one = spark.createDataFrame([(1, "m", small, table, "")], "table_id int, mode string, generated string, table_text string, reference string")
    want = M.evaluate(one, ("Placebo", "Drug A"), radius=3).first()["acr"]
    got = R.arm_confusion(one, ["table_id", "mode"], "table_id", "generated", "table_text", ("Placebo", "Drug A"), radius=3).first()
    assert got["confused"] / got["evaluated"] == pytest.approx(want)


def test_sketches_merge_within_their_error(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") % 8).alias("run"), F.sqrt(F.pmod(F.hash("id"), F.lit(10**6))).alias("value"))
    shares = {"p01": 0.01, "p50": 0.5, "p90": 0.9}
    whole = Q.report(Q.sketches(rows, ["g"]), ["g"], shares).collect()
    parts = Q.report(Q.merged(Q.sketches(rows, ["g", "run"]), ["g"]), ["g"], shares).collect()
    for r in whole + parts:
        v = np.sort(np.array([x[0] for x in rows.where(f"g = {r['g']}").select("value").collect()]))
        assert r["n"] == len(v) and r["min"] == v[0] and r["max"] == v[-1] and r["rank_error"] == pytest.approx(Q.rank_error())
        for k, p in shares.items():
            low, high = np.searchsorted(v, r[k], "left") / len(v), np.searchsorted(v, r[k], "right") / len(v)
            assert low - 2 * r["rank_error"] <= p <= high + 2 * r["rank_error"]
    few = Q.report(Q.sketches(rows.limit(100).withColumn("g", F.lit(0)).unionByName(rows.limit(1).select(F.lit(0).alias("g"), "run", F.lit(None).cast("double").alias("value"))), ["g"]), ["g"], shares).first()
    assert few["n"] == 100 and few["rank_error"] == 0.0


def brute_align(g, r):
    """(matches, chunks) over all alignments: most by form, then most by stem, then fewest chunks."""
    best = None
    for taken in itertools.product(*[[None, *range(len(r))] for _ in g]):
        used = [j for j in taken if j is not None]
        if len(used) != len(set(used)) or any(j is not None and r[j] != w and stem(r[j]) != stem(w) for w, j in zip(g, taken)):
            continue
        exact = sum(j is not None and r[j] == w for w, j in zip(g, taken))
        chunks = sum(j is not None and (i == 0 or taken[i - 1] is None or taken[i - 1] + 1 != j) for i, j in enumerate(taken))
        best = max(best or (-1, 0, 0), (exact, len(used), -chunks))
    return best[1], -best[2]


def test_meteor_alignment_against_all():
    rng = np.random.default_rng(8)
    words = ["run", "runs", "running", "cat", "cats", "dog"]
    for _ in range(60):
        g, r = (list(rng.choice(words, rng.integers(1, 6))) for _ in range(2))
        assert E.align(g, r) == brute_align(g, r), (g, r)


def test_meteor_matches_synonyms_last():
    """With synonyms against all alignments: most by form, then by stem, then as synonyms, then fewest chunks."""
    synonyms = {w: frozenset(x) for w, x in {"death": ("death", "demise"), "demise": ("demise", "death", "end"), "end": ("end", "demise"), "cat": ("cat", "feline"), "feline": ("feline", "cat")}.items()}
    rng = np.random.default_rng(9)
    for _ in range(60):
        g, r = (list(rng.choice(["death", "deaths", "demise", "end", "cat", "feline", "the"], rng.integers(1, 6))) for _ in range(2))
        best = None
        for taken in itertools.product(*[[None, *range(len(r))] for _ in g]):
            used = [j for j in taken if j is not None]
            kinds = [0 if r[j] == w else 1 if stem(r[j]) == stem(w) else 2 if r[j] in synonyms.get(w, ()) else None for w, j in zip(g, taken) if j is not None]
            if len(used) == len(set(used)) and None not in kinds:
                chunks = sum(j is not None and (i == 0 or taken[i - 1] is None or taken[i - 1] + 1 != j) for i, j in enumerate(taken))
                best = max(best or (-1,), (kinds.count(0), kinds.count(0) + kinds.count(1), len(used), -chunks))
        assert E.align(g, r, synonyms=synonyms) == (best[2], -best[3]), (g, r)


def test_synonyms_of_the_sessions_thesaurus(spark, tmp_path):
    from conftest import SF
    from gridscribe.functions import metrics as M
    from gridscribe.plans.relational import meteor

    path = str(tmp_path / "synsets.parquet")
    spark.createDataFrame([(1, "Death"), (1, "demise"), (2, "demise"), (2, "end"), (None, "end"), (3, None), (4, "reported"), (4, "subjects")], "synset int, word string").toPandas().to_parquet(path)
    assert E.synonyms_of(path)["demise"] == {"death", "demise", "end"} and E.synonyms_of(path)["death"] == {"death", "demise"}
    df = spark.createDataFrame([("the demise came", "the death came", "Fatal | 5")], "generated string, reference string, table_text string")
    without, by = (M.evaluate_whole(df, ("Placebo", "Drug A"), thesaurus=t).first() for t in (None, path))
    assert by["meteor"] == pytest.approx(1 - 0.5 / 27) and without["meteor"] == pytest.approx((1 - 0.5) * 2 / 3) and by["errors"] == []
    assert by["fluency_score"] - without["fluency_score"] == pytest.approx(0.25 * (by["meteor"] - without["meteor"]))
    spark.conf.set(E.THESAURUS, path)
    try:
        assert meteor(spark, SF).count() == meteor(spark, SF).where("meteor > 0").count()
    finally:
        spark.conf.unset(E.THESAURUS)


def test_meteor_by_hand():
    assert E.meteor("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1 - 0.5 * (1 / 6) ** 3)
    p, q = 4 / 5, 4 / 6
    assert E.meteor("cats sat on a mat", "the cat sat on the mat") == pytest.approx((1 - 0.5 * (2 / 4) ** 3) * p * q / (0.9 * p + 0.1 * q))
    assert E.meteor("", "x") == E.meteor(None, None) == E.meteor("a", "b") == 0.0


def test_ward_of_all_equals_the_definition(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 9])] + [np.zeros((5, 3))])
    rows = spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(x)], "id bigint, a double, b double, c double")
    got = {r["id"]: r["cluster"] for r in C.ward_of_all(rows.repartition(7), "id", ("a", "b", "c"), 4.0).collect()}
    want = A.ward(x, 4.0)
    first = {c: int(np.flatnonzero(want == c)[0]) for c in set(want)}
    assert got == {i: first[c] for i, c in enumerate(want)} and len(set(got.values())) > 3


def test_ward_with_fewer_leaves_than_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 2)) * 0.1 + c for c in ([0, 0], [50, 0], [0, 50])])
    rows = spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(x)], "id bigint, a double, b double")
    got = {r["id"]: r["cluster"] for r in C.ward_of_all(rows.repartition(9), "id", ("a", "b"), 100.0, most=40).collect()}
    assert set(got.values()) == {0, 300, 600} and all(c == i // 300 * 300 for i, c in got.items())
    assert C.ward_of_all(rows.where("id < 0"), "id", ("a", "b"), 1.0).count() == 0


def test_no_row_is_scored_by_a_fit_that_saw_it(spark):
    """A learner that knows the rows it was fitted on by heart says 1 for these and 0 for others."""
    rows = spark.createDataFrame([(i, i % 2) for i in range(60)], "id bigint, label bigint")

    def learn(seen):
        return lambda held: held.join(seen.select("id").withColumn("score", F.lit(1.0)), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

    scores = V.out_of_fold(rows, {"heart": learn, "coin": lambda _: lambda held: held.withColumn("score", F.lit(0.5))}, folds=4)
    got = scores.collect()
    assert len(got) == 120 and len({r["fold"] for r in got}) == 4 and all(r["score"] == (0.0 if r["model"] == "heart" else 0.5) for r in got)
    votes, weights = V.voted(scores)
    assert votes.count() == 60 and {r["model"]: r["weight"] for r in weights.collect()} == {"heart": 0.5, "coin": 0.5}
    alone = V.out_of_fold(rows.withColumn("label", F.lit(1)), {"heart": learn}).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_votes_weigh_by_area(spark):
    scores = spark.createDataFrame([(i, i % 2, 0, m, s) for i in range(20) for m, s in (("good", float(i % 2)), ("bad", 0.5))], "id bigint, label bigint, fold int, model string, score double")
    votes, weights = V.voted(scores)
    assert {r["model"]: (r["auc"], pytest.approx(r["weight"])) for r in weights.collect()} == {"good": (1.0, 2 / 3), "bad": (0.5, 1 / 3)}
    assert all(r["told"] == (r["label"] == 1) and r["score"] == pytest.approx(2 / 3 * r["label"] + 1 / 6) for r in votes.collect())


def brute_grid(cells):
    """Rows of (text, columns, rows) placed one after another into an occupancy set."""
    held = {}
    for y, row in enumerate(cells):
        x = 0
        for text, w, h in row:
            while (y, x) in held:
                x += 1
            for c in range(x, x + w):
                if (y, c) in held:
                    break
                for r in range(y, min(y + h, len(cells))):
                    held.setdefault((r, c), text)
    width = max((c + 1 for _, c in held), default=0)
    return [[held.get((y, c), "") for c in range(width)] for y in range(len(cells))]


def test_grids_equal_brute_force():
    rng = np.random.default_rng(4)
    for closing in (True, False):
        for _ in range(80):
            cells = [[(f"c{y}.{i}", int(rng.integers(1, 4)), int(rng.integers(1, 4))) for i in range(rng.integers(0, 4))] for y in range(rng.integers(1, 6))]
            end = ("</td>", "</tr>") if closing else ("", "")
            page = "<table>" + "".join("<tr>" + "".join(f'<td colspan={w} rowspan="{h}">{t}{end[0]}' for t, w, h in row) + end[1] for row in cells) + "</table>"
            assert H.read_page(page)["tables"][0]["rows"] == brute_grid(cells), page


def test_pages_that_are_not_closed():
    page = H.read_page('<table><caption>A &amp; B<tr><td>x</caption><td>1<table><tr><td>in</table> 2<tr><td rowspan=0>y<script>var t="</td>";</script><td colspan=z>3<tr><td>4')
    assert [t["rows"] for t in page["tables"]] == [[["x", "1 2"], ["y", "3"], ["y", "4"]], [["in"]]]
    page = H.read_page('<div class="views-row"><h3><a href="/d?a=1&amp;b=2"> Trial  one </a></h3><div>text<div>more</div></div><a href=/x.pdf>PDF</div><article><h1>Two</h1><h2>other</h2>')
    assert [(r["title"], [(x["url"], x["label"]) for x in r["links"]]) for r in page["records"]] == [("Trial one", [("/d?a=1&b=2", "Trial one"), ("/x.pdf", "PDF")]), ("Two", [])] or page["records"][0]["title"] == "Trial one"
    assert [x["url"] for x in page["links"]] == ["/d?a=1&b=2", "/x.pdf"]
    assert H.read_page(None) == H.read_page("") == {"tables": [], "records": [], "links": []} and H.read_page("<<a <b>< td")["tables"] == []


def test_append_reads_only_parts_that_may_match(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_KEYS", 100)
    path = str(tmp_path / "target")
    rows = lambda a, b, t="x": spark.range(a, b).select("id", F.lit(t).alias("v"))
    got, parts, read = files.append_filtered(rows(0, 1000), path, "id")
    assert (got.count(), parts, read) == (1000, 0, 0)
    got, parts, read = files.append_filtered(rows(1000, 1200), path, "id")
    assert (got.count(), parts) == (1200, 10) and read <= 1
    got, parts, read = files.append_filtered(rows(350, 380, "y").unionByName(rows(1200, 1210)).unionByName(rows(1200, 1210)), path, "id")
    assert (got.count(), parts) == (1210, 12) and 1 <= read <= 3 and got.where("v = 'y'").count() == 0
    got, parts, read = files.append_filtered(rows(0, 1210), path, "id")
    assert (got.count(), read) == (1210, parts) and got.select("id").distinct().count() == 1210
    nulls = spark.createDataFrame([(None, "n")], "id bigint, v string")
    assert files.append_filtered(nulls, path, "id")[0].count() == 1210 and files.append_filtered(nulls, str(tmp_path / "none"), "id")[0].count() == 0


def test_filtered_stream_takes_each_file_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(0, 50).select("id", F.lit("x").alias("v"))
    df.write.parquet(source)
    for n in (50, 70):
        incremental.append_stream_filtered(spark, source, df.schema, target, str(tmp_path / "checkpoint"), "id")
        assert files.filtered_target(spark, target, df.schema).count() == n
        spark.range(40, 70).select("id", F.lit("y").alias("v")).write.mode("append").parquet(source)


def test_titles_are_read_as_written_but_for_the_references_of_markup():
    from gridscribe.functions.html import read_page

    page = '<article><h1>a &amp;&amp; b &lt;c&gt; &amp;lt; token = &quot;x and&amp</h1><a href="/d?a=1&amp;b=&quot;">it&#39;s</a>'
    assert read_page(page, as_written=True)["records"][0]["title"] == "a && b <c> &lt; token = &quot;x and&amp"
    assert read_page(page, as_written=True)["links"] == [{"url": "/d?a=1&b=&quot;", "label": "it&#39;s"}]
    assert read_page(page)["records"][0]["title"] == 'a && b <c> &lt; token = "x and&' and read_page(None, True)["records"] == []
