"""Summaries from tables without arms' parsing: events by cells' places, buckets of selected events in one of three frames, and the older
summariser that writes small numbers as words. All within the row. Wordings are our own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.tables import cells, header, line_rows
from ..functions.text import let

#: Fixed: a percent anywhere in a cell, and the `n (p)` of the older parse.
PERCENT, PAIR = r"\(?(\d+\.?\d*)\s*%\)?", r"(\d+)\s*\((\d+\.?\d*)\)"
#: An event is told if its score is above this; very common ones have this share of subjects at least.
TOLD, VERY_COMMON = 0.4, 10.0
#: Fixed: words of numbers from one to twenty.
NUMBER_WORDS = ("One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen", "Twenty")
FRAMES = {
    "single": ("Events of subjects on {drug} are summed up. They were reported by {total}% of subjects.", "No serious or fatal events were reported."),
    "imbalanced": ("Subjects on {drug} had events more often than those of the control arm ({total}% against {control}%).", ""),
    "standard": ("Events are summed up. They were reported by {total}% of subjects on {drug} and {control}% of the control arm.", "No serious or severe events were reported."),
}
NOTHING = "No significant or severe events were found."


def percent_in(cell: Column) -> Column:
    return F.coalesce(F.regexp_extract(cell, PERCENT, 1).try_cast("double"), F.lit(0.0))


def events_of(text: Column) -> Column:
    """(single, drug, total, control, events) of a table whose rows stand on one line.

    One part of the header is a single arm, else the last one is the drug. A row's second cell is the control's, the last the drug's; of a single arm
    the last may be a bare number. The first row of all events with a share above 0 gives the totals, else the largest shares of the
    others do. An event is (label, drug, control, diff, ratio, sae, severe). Null: no events.
    """

    def of(h: Column) -> Column:
        single = F.size(h) == 1
        name = F.when(F.size(h) > 0, F.trim(F.substring_index(F.element_at(h, -1), "(", 1))).otherwise("Experimental Drug")

        def row(c: Column) -> Column:
            label = F.lower(F.get(c, F.lit(0)))
            has = lambda *ks: _any([label.contains(k) for k in ks])
            last = F.get(c, F.size(c) - 1)
            bare = F.when(single & last.rlike(r"^\d+\.?\d*$"), last.try_cast("double"))
            drug = F.when(last.rlike(PERCENT), percent_in(last)).otherwise(F.coalesce(bare, F.lit(0.0)))
            control = F.when(single, F.lit(0.0)).otherwise(percent_in(F.get(c, F.lit(1))))
            sae, severe = has("serious", "sae", "fatal", "death"), has("grade 3", "grade 4", "severe")
            whole = has("any teae", "overall") | (label == "teae") | (has("subjects with") & ~sae & ~severe)
            return F.when(F.size(c) >= 2, F.struct(
                F.get(c, F.lit(0)).alias("label"), drug.alias("drug"), control.alias("control"), F.abs(drug - control).alias("diff"), (drug / (control + 0.001)).alias("ratio"),
                sae.alias("sae"), severe.alias("severe"), whole.alias("whole")))

        def put(rows: Column) -> Column:
            events, first = F.filter(rows, lambda r: ~r["whole"]), F.get(F.filter(rows, lambda r: r["whole"] & (r["drug"] != 0)), F.lit(0))
            most = lambda k: F.coalesce(F.array_max(F.transform(events, lambda r: r[k])), F.lit(0.0))
            return F.struct(
                single.alias("single"), name.alias("drug"), F.coalesce(first["drug"], most("drug")).alias("total"), F.coalesce(first["control"], most("control")).alias("control"), events.alias("events"))

        return let(F.filter(F.transform(line_rows(text), lambda r: let(cells(r), row)), lambda r: r.isNotNull()), put)

    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"\[HEADERS:\s*\|\s*(.*?)\s*\]", 1)
    return let(F.filter(F.transform(F.split(body, r"\|", -1), lambda p: F.trim(p)), lambda p: p != ""), of)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rule_score(event: Column) -> Column:
    """The score where there is no model: 1 from a share of five percent on."""
    return F.when(event["drug"] >= 5.0, 1.0).otherwise(0.0)


def forced(event: Column, score: Column, threshold: float = 0.5) -> Column:
    """(score, decision): serious and severe events are told by rule with a score of 1, others if the model's score is above the threshold."""
    rule = event["sae"] | event["severe"]
    return F.struct(F.when(rule, 1.0).otherwise(score).alias("score"), F.when(rule, "told by rule").when(score > threshold, "told by model").otherwise("left out").alias("decision"))


def listed(items: Column, comma: str = ", and ") -> Column:
    """a; a and b; a, b and c."""
    head, last = F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.element_at(items, -1)
    return F.when(F.size(items) == 1, F.get(items, F.lit(0))).when(F.size(items) > 1, F.concat(F.array_join(head, ", "), F.lit(comma), last))


def summary_of(text: Column, score=rule_score) -> Column:
    """The summary of a table: told events in three buckets within the frame that the arms and their differences ask for."""

    def of(t: Column) -> Column:
        def put(told: Column) -> Column:
            show = lambda e: F.concat(e["label"], F.lit(" ("), e["drug"].cast("string"), F.when(t["single"], F.lit("%)")).otherwise(F.concat(F.lit("% vs "), e["control"].cast("string"), F.lit("%)"))))
            bucket = lambda keep: F.transform(F.filter(told, keep), show)
            serious = bucket(lambda e: e["sae"] | e["severe"])
            rest = lambda e: ~(e["sae"] | e["severe"])
            common, other = bucket(lambda e: rest(e) & (e["drug"] >= VERY_COMMON)), bucket(lambda e: rest(e) & (e["drug"] < VERY_COMMON))
            gap = F.aggregate(told, F.lit(0.0), lambda a, e: a + e["diff"])
            frame = F.when(t["single"], "single").when((gap > 15.0) | (t["total"] - t["control"] > 10.0), "imbalanced").otherwise("standard")
            pick = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for f, v in FRAMES.items() for x in (f, v[k])]), frame)
            opening = pick(0)
            for k, v in (("drug", t["drug"]), ("total", t["total"].cast("string")), ("control", t["control"].cast("string"))):
                opening = F.replace(opening, F.lit("{" + k + "}"), v)
            said = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), listed(items), F.lit(".")))
            parts = F.array(opening, said("The most frequent ones were ", common), said("Others were ", other), F.coalesce(said("Serious or severe ones were ", serious), F.nullif(pick(1), F.lit(""))))
            return F.when(F.size(told) == 0, F.lit(NOTHING)).otherwise(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "))

        return let(F.filter(t["events"], lambda e: e["sae"] | e["severe"] | (score(e) > TOLD)), put)

    return let(events_of(text), of)


def number_words(n: Column, pct: Column, of: Column) -> Column:
    """All, None, all but one, a word up to twenty, else digits."""
    word = F.get(F.array(*[F.lit(w) for w in NUMBER_WORDS]), (n - 1).cast("int"))
    return F.when(pct >= 99.5, "All").when(pct <= 0.5, "None").when(of - n == 1, "All except for 1").when(n.between(1, 20), word).otherwise(n.cast("string"))


def category(label: Column) -> Column:
    """The category of a row of the older parse; null without one."""
    low = F.lower(label)
    return (
        F.when(low.contains("teae") | (low.contains("treatment-emergent") & low.contains("adverse")), "teae").when(low.contains("serious adverse") | low.contains("sae"), "sae")
        .when(low.contains("grade 3") | low.contains("grade 4"), "grade34").when(low.contains("discontinu"), "discontinuation").when(low.contains("drug-related"), "drug_related"))


def older_rows(text: Column) -> Column:
    """(category, n_a, pct_a, n_b, pct_b) of rows on one line whose second and third cells hold `n (p)`; of a category the last row counts."""

    def row(c: Column) -> Column:
        part = lambda i, k, t: F.regexp_extract(F.get(c, F.lit(i)), PAIR, k).try_cast(t)
        return F.struct(category(F.get(c, F.lit(0))).alias("category"), part(1, 1, "int").alias("n_a"), part(1, 2, "double").alias("pct_a"), part(2, 1, "int").alias("n_b"), part(2, 2, "double").alias("pct_b"))

    rows = F.filter(F.transform(line_rows(text), lambda r: let(cells(r), row)), lambda r: r["category"].isNotNull() & r["n_a"].isNotNull() & r["n_b"].isNotNull())
    return let(rows, lambda x: F.filter(x, lambda r, i: ~F.exists(F.slice(x, i + 2, F.lit(1 << 30)), lambda later: later["category"] == r["category"])))


def older_summary(text: Column) -> Column:
    """A sentence for each category that the table has, in a fixed order; percents are rounded half to even. Arms are those of the header with a size; without two
    there is the opening alone."""
    arms = F.filter(header(text), lambda h: h["n"].isNotNull())

    def of(rows: Column) -> Column:
        def put(h: Column) -> Column:
            a, b = F.get(h, F.lit(0)), F.get(h, F.lit(1))
            whole = lambda p: F.bround(p, 0).cast("int").cast("string")

            def said(name: str, body) -> Column:
                return F.transform(F.filter(rows, lambda r: r["category"] == name), body)

            def teae(r: Column) -> Column:
                one, two = number_words(r["n_a"], r["pct_a"], a["n"]), number_words(r["n_b"], r["pct_b"], b["n"])
                return (
                    F.when((one == "All") & (two == "All"), F.lit("All subjects of both arms had events.")).when(one.startswith("All except"), F.concat(one, F.lit(" on "), a["label"], F.lit(" had events.")))
                    .otherwise(F.concat(one, F.lit(" subjects on "), a["label"], F.lit(" and "), r["n_b"].cast("string"), F.lit(" on "), b["label"], F.lit(" had events."))))

            def counted(end: str, out_of: bool):
                share = lambda n, p, arm: F.concat(n.cast("string"), F.concat(F.lit(" of "), arm["n"].cast("string")) if out_of else F.lit(""), F.lit(" subjects ("), whole(p), F.lit("%) on "), arm["label"])
                return lambda r: F.concat(share(r["n_a"], r["pct_a"], a), F.lit(" and "), share(r["n_b"], r["pct_b"], b), F.lit(end))

            parts = F.concat(
                said("teae", teae), said("sae", counted(" had serious events.", True)), said("grade34", counted(" had grade 3-4 events.", False)),
                said("discontinuation", counted(" stopped treatment.", False)))
            number = F.regexp_extract(text, r"\[TABLE_TITLE:[^\]]*?Table\s+(\d+)", 1)
            opening = F.concat(F.lit("Table"), F.when(number != "", F.concat(F.lit(" "), number)).otherwise(""), F.lit(" presents adverse events."))
            return F.array_join(F.concat(F.array(opening), F.when(F.size(h) >= 2, parts).otherwise(F.array().cast("array<string>"))), " ")

        return let(arms, put)

    return let(older_rows(text), of)
