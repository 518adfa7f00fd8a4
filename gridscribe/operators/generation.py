"""Summaries of a table from its facts: slots, choice of wordings, realization, composition and polish, as columns within a row.

A fact is a slot of a map, such as TEAE_PCT_B: type of row, count or percent, and arm (A control, B experimental). Wordings are our own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import SLOT_PREFIX, arms, cells, multi_value, raw_rows, row_type
from ..functions.text import let

KEYS = ("ARM_A", "ARM_B", "N_A", "N_B", *[f"{p}_{part}_{arm}" for p in SLOT_PREFIX.values() for part in ("N", "PCT") for arm in ("A", "B")])

#: Wordings of each family: (text, limits). Limits: `min_teae` for the smaller share of events, `max_pct` for the largest of the serious and grade 3-4
#: shares, `min_pct` for the larger share of discontinuations. All slots of a text are needed, but for those that are told to be `free`.
FAMILIES: dict[str, tuple[tuple[str, dict], ...]] = {
    "opener": (("The table gives an overview of adverse events.", {}), ("Adverse events of the safety population are shown in the table.", {}), ("An overview of treatment-emergent adverse events follows.", {})),
    "teae": (
        ("Adverse events were reported by {TEAE_N_B} ({TEAE_PCT_B}%) of {N_B} subjects on {ARM_B} and {TEAE_N_A} ({TEAE_PCT_A}%) of {N_A} on {ARM_A}.", {}),
        ("Nearly all subjects had an event: {TEAE_PCT_B}% on {ARM_B} and {TEAE_PCT_A}% on {ARM_A}.", {"min_teae": 90.0}),
        ("Of subjects on {ARM_B}, {TEAE_PCT_B}% had at least one event, against {TEAE_PCT_A}% on {ARM_A}.", {}),
        ("At least one event occurred in {TEAE_N_B} ({TEAE_PCT_B}%) subjects on {ARM_B} and {TEAE_N_A} ({TEAE_PCT_A}%) on {ARM_A}.", {"free": True}),
    ),
    "grade34": (
        ("Grade 3-4 events occurred in {G34_N_B} ({G34_PCT_B}%) subjects on {ARM_B} and {G34_N_A} ({G34_PCT_A}%) on {ARM_A}.", {}),
        ("Grade 3-4 events were few: {G34_PCT_B}% on {ARM_B} and {G34_PCT_A}% on {ARM_A}.", {"max_pct": 10.0}),
        ("A grade 3-4 event was seen in {G34_PCT_B}% of {N_B} subjects on {ARM_B} and in {G34_PCT_A}% of {N_A} on {ARM_A}.", {}),
    ),
    "sae": (
        ("Serious events occurred in {SAE_N_B} ({SAE_PCT_B}%) subjects on {ARM_B} and {SAE_N_A} ({SAE_PCT_A}%) on {ARM_A}.", {}),
        ("Serious events were rare, with {SAE_PCT_B}% on {ARM_B} and {SAE_PCT_A}% on {ARM_A}.", {"max_pct": 10.0}),
    ),
    "drug_sae": (("Serious events related to the drug were seen in {DR_SAE_PCT_B}% on {ARM_B} and {DR_SAE_PCT_A}% on {ARM_A}.", {}), ("Of subjects on {ARM_B}, {DR_SAE_PCT_B}% had a serious event related to the drug.", {"free": True})),
    "drug_teae": (("Events related to the drug were reported by {DR_TEAE_PCT_B}% on {ARM_B} and {DR_TEAE_PCT_A}% on {ARM_A}.", {}), ("On {ARM_B}, {DR_TEAE_PCT_B}% had an event related to the drug; on {ARM_A}, {DR_TEAE_PCT_A}%.", {})),
    "fatal": (("Fatal events occurred in {FATAL_PCT_B}% on {ARM_B} and {FATAL_PCT_A}% on {ARM_A}.", {}), ("Deaths were reported for {FATAL_PCT_B}% of subjects on {ARM_B}.", {})),
    "drug_disc": (("Events related to the drug ended treatment for {DR_DISC_PCT_B}% on {ARM_B} and {DR_DISC_PCT_A}% on {ARM_A}.", {}), ("Because of events related to the drug, {DR_DISC_PCT_B}% on {ARM_B} stopped.", {})),
    "disc": (
        ("Treatment was discontinued by {DISC_N_B} ({DISC_PCT_B}%) subjects on {ARM_B} and {DISC_N_A} ({DISC_PCT_A}%) on {ARM_A}.", {}),
        ("Discontinuations were frequent: {DISC_PCT_B}% on {ARM_B} and {DISC_PCT_A}% on {ARM_A}.", {"min_pct": 10.0}),
    ),
    "counting": (("A subject with several events counts once in each row.", {}), ("Subjects are counted once for each kind of event.", {})),
    "similar": (("The arms were alike in the share of subjects with events.", {}), ("Events were about as frequent in both arms.", {})),
}
#: What a summary of each cluster says, and its sentences where too few facts are there to choose wordings.
CLUSTERS = {
    "C01_standard_two_arm_overall": ("two arms with all kinds of rows", "Events were reported by {TEAE_PCT_B}% on {ARM_B} and {TEAE_PCT_A}% on {ARM_A}. Serious events occurred in {SAE_PCT_B}% and {SAE_PCT_A}%."),
    "C02_drug_related_emphasis": ("events related to the drug", "Events related to the drug were reported by {DR_TEAE_PCT_B}% on {ARM_B}. Serious ones occurred in {DR_SAE_PCT_B}%."),
    "C03_high_incidence_both_arms": ("most subjects of both arms with events", "Most subjects had events: {TEAE_PCT_B}% on {ARM_B} and {TEAE_PCT_A}% on {ARM_A}."),
    "C04_sae_fatal_emphasis": ("serious and fatal events", "Serious events occurred in {SAE_PCT_B}% on {ARM_B} and {SAE_PCT_A}% on {ARM_A}. Fatal events occurred in {FATAL_PCT_B}% and {FATAL_PCT_A}%."),
    "C05_no_grade34_sae_only": ("serious events without grades", "Serious events occurred in {SAE_PCT_B}% on {ARM_B} and {SAE_PCT_A}% on {ARM_A}. Treatment was discontinued by {DISC_PCT_B}% and {DISC_PCT_A}%."),
    "C06_open_label_summary": ("double-blind and open-label phases", "In both phases {TEAE_PCT_B}% on {ARM_B} and {TEAE_PCT_A}% on {ARM_A} had events."),
    "C07_minimal_teae_disc": ("events and discontinuations", "Events were reported by {TEAE_PCT_B}% on {ARM_B}. Treatment was discontinued by {DISC_PCT_B}%."),
    "C08_drug_related_full": ("events related to the drug, with discontinuations", "Events related to the drug were reported by {DR_TEAE_PCT_B}% on {ARM_B}. They ended treatment for {DR_DISC_PCT_B}%."),
    "C09_safety_population_note": ("a note on the safety population", "The safety population had {N_B} subjects on {ARM_B} and {N_A} on {ARM_A}."),
    "C10_teae_only": ("events alone", "Events were reported by {TEAE_PCT_B}% on {ARM_B} and {TEAE_PCT_A}% on {ARM_A}."),
    "C11_grade34_no_disc": ("grade 3-4 and serious events", "Grade 3-4 events occurred in {G34_PCT_B}% on {ARM_B} and {G34_PCT_A}% on {ARM_A}."),
    "C12_high_discontinuation": ("many discontinuations", "Treatment was discontinued by {DISC_PCT_B}% on {ARM_B} and {DISC_PCT_A}% on {ARM_A}."),
    "C13_single_arm": ("one arm", "Events of one arm are shown. They were reported by {TEAE_PCT_B}% on {ARM_B}."),
    "C14_individual_ae_listing": ("single events", "Single events are listed."),
}


def needed(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([A-Z0-9_]+)\}", text)))


def slots_of(text: Column) -> Column:
    """The facts of a table as a map slot -> text. Of rows of a type the first that has a part gives it; a percent of 0 counts as missing.

    Null or rowless texts have the arms' names alone. All within the row: neither explode nor shuffle.
    """

    def of(a: Column) -> Column:
        def row(c: Column) -> Column:
            each = F.greatest(F.lit(1), ((F.size(c) - 1) / F.greatest(F.lit(2), a["n_arms"] - 1)).cast("int"))
            arm = lambda i: multi_value(F.array_join(F.slice(c, i * each + 2, each), " "))
            return F.when(F.size(c) >= 3, F.struct(row_type(F.get(c, F.lit(0))).alias("kind"), arm(a["exp_idx"]).alias("b"), arm(1 - a["exp_idx"]).alias("a")))

        rows = F.filter(F.transform(raw_rows(text), lambda r: let(cells(r), row)), lambda x: x["kind"].isNotNull())

        def entries(x: Column) -> Column:
            out = [("ARM_A", a["control"]), ("ARM_B", a["experimental"]), ("N_A", a["n_control"]), ("N_B", a["n_experimental"])]
            for kind, prefix in SLOT_PREFIX.items():
                for side in ("a", "b"):
                    n = F.filter(x, lambda r: (r["kind"] == kind) & r[side]["n"].isNotNull())  # noqa: B023
                    p = F.filter(x, lambda r: (r["kind"] == kind) & (r[side]["pct"] != 0))  # noqa: B023
                    out += [(f"{prefix}_N_{side.upper()}", F.get(n, F.lit(0))[side]["n"]), (f"{prefix}_PCT_{side.upper()}", F.get(p, F.lit(0))[side]["pct"])]
            pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in out])
            return F.map_from_entries(F.filter(pairs, lambda e: F.coalesce(e["v"], F.lit("")) != ""))

        return let(rows, entries)

    return let(arms(F.coalesce(text, F.lit(""))), of)


def profile_of(slots: Column) -> Column:
    """Shares that decide on wordings, 0 where missing, and the difference of the shares of events."""
    pct = lambda k: F.coalesce(F.try_element_at(slots, F.lit(k)).try_cast("double"), F.lit(0.0))
    names = [(p, s) for p in ("TEAE", "G34", "SAE", "DISC") for s in ("B", "A")]
    return F.struct(*[pct(f"{p}_PCT_{s}").alias(f"{p.lower()}_pct_{s.lower()}") for p, s in names], F.abs(pct("TEAE_PCT_B") - pct("TEAE_PCT_A")).alias("pct_diff"))


def md5_mod(text: Column, n: Column, more: int = 0) -> Column:
    """(md5 of the text as a number + more) modulo n, hex digit by hex digit."""
    digits = F.filter(F.split(F.md5(text), ""), lambda d: d != "")
    low = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("long")) % n)
    return (low + more) % n


def choose(family: str, slots: Column, profile: Column, text: Column, more: int = 0) -> Column:
    """The wording of a family: of those whose slots are all there and whose limits hold, the one that the md5 of the table picks; if there is none,
    the first of those with the fewest missing slots."""
    rows = [(t, [] if c.get("free") else needed(t), c) for t, c in FAMILIES[family]]
    limit = lambda c, k: F.lit(c.get(k)).cast("double").alias(k)
    variants = F.array(*[
        F.struct(F.lit(t).alias("text"), F.array(*[F.lit(s) for s in ns]).cast("array<string>").alias("needed"), limit(c, "min_teae"), limit(c, "max_pct"), limit(c, "min_pct")) for t, ns, c in rows])
    lacks = lambda v: F.size(F.filter(v["needed"], lambda s: F.coalesce(F.try_element_at(slots, s), F.lit("")) == ""))
    p = profile
    fits = lambda v: (
        (lacks(v) == 0) & F.coalesce(F.least(p["teae_pct_b"], p["teae_pct_a"]) >= v["min_teae"], F.lit(True))
        & F.coalesce(F.greatest(p["sae_pct_b"], p["sae_pct_a"], p["g34_pct_b"], p["g34_pct_a"]) <= v["max_pct"], F.lit(True))
        & F.coalesce(F.greatest(p["disc_pct_b"], p["disc_pct_a"]) >= v["min_pct"], F.lit(True)))
    fewest = F.array_min(F.transform(variants, lambda v, i: F.struct(lacks(v).alias("n"), i.alias("i"))))["i"]
    picked = lambda a: F.when(F.size(a) > 0, F.get(a, md5_mod(text, F.size(a), more).cast("int"))).otherwise(F.get(variants, fewest))["text"]
    return let(F.filter(variants, fits), picked)


def fill(template: Column, slots: Column) -> Column:
    """The template with its slots filled. A missing count or percent makes it null; a missing name or size is cut out, with the white space around it, and what is
    left must be longer than 20 characters."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Z0-9_]+)\}"), 1))
    missing = F.filter(names, lambda s: F.coalesce(F.try_element_at(slots, s), F.lit("")) == "")

    def of(gone: Column) -> Column:
        bare = F.aggregate(gone, template, lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"\s*\{"), s, F.lit(r"\}\s*")), F.lit(" ")))
        bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s+([.,;:])", "$1")
        full = lambda t: F.aggregate(F.map_entries(slots), t, lambda x, e: F.replace(x, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
        return (
            F.when(F.size(gone) == 0, full(template)).when(F.exists(gone, lambda s: s.contains("PCT") | s.contains("_N_")), F.lit(None))
            .otherwise(let(full(bare), lambda t: F.when(F.length(t) > 20, t))))

    return let(missing, of)


def legacy_fill(template: Column, slots: Column) -> Column:
    """(text, unfilled): sentence by sentence; one stays if it has no slot or more than half of them are there, and missing ones become empty."""
    value = lambda s: F.coalesce(F.try_element_at(slots, s), F.lit(""))
    parts = F.transform(F.split(template, r"(?<=[.!?])\s+", -1), lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(r"\{([A-Z0-9_]+)\}"), 1).alias("s")))
    ready = lambda x: (F.size(x["s"]) == 0) | (F.size(F.filter(x["s"], lambda s: value(s) != "")) > F.floor(F.size(x["s"]) / 2))
    filled = F.transform(F.filter(parts, ready), lambda x: F.aggregate(x["s"], x["t"], lambda t, s: F.replace(t, F.concat(F.lit("{"), s, F.lit("}")), value(s))))
    lost = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda x: ~ready(x)), lambda x: x["s"]))))
    return F.struct(F.array_join(filled, " ").alias("text"), lost.alias("unfilled"))


def realized(slots: Column, profile: Column, text: Column) -> Column:
    """Sentences in their order: opener, events, grade 3-4, serious, drug-related serious, drug-related, fatal, drug-related discontinuations, discontinuations,
    closers; each if its facts are there."""
    has = lambda *ks: [F.coalesce(F.try_element_at(slots, F.lit(k)), F.lit("")) != "" for k in ks]
    both = lambda p: _all(has(f"{p}_PCT_B", f"{p}_PCT_A"))
    drug = _any(has("DR_TEAE_PCT_B", "DR_SAE_PCT_B"))
    said = lambda family: fill(choose(family, slots, profile, text), slots)
    alone = lambda k: has(k)[0]
    return F.filter(F.array(
        choose("opener", slots, profile, text), F.when(both("TEAE"), said("teae")), F.when(both("G34"), said("grade34")), F.when(both("SAE"), said("sae")),
        F.when(drug & alone("DR_SAE_PCT_B"), said("drug_sae")), F.when(drug & alone("DR_TEAE_PCT_B"), said("drug_teae")), F.when(alone("FATAL_PCT_B"), said("fatal")),
        F.when(drug & alone("DR_DISC_PCT_B"), said("drug_disc")), F.when(_any(has("DISC_PCT_B", "DISC_N_B")), said("disc")),
        F.when(_all(has("TEAE_PCT_B", "G34_PCT_B", "SAE_PCT_B")), choose("counting", slots, profile, text, 1)),
        F.when((profile["pct_diff"] < 5) & (profile["teae_pct_b"] > 50), choose("similar", slots, profile, text, 2))), lambda s: s.isNotNull())


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def unrepeated(sentences: Column) -> Column:
    """Sentences whose first 80 characters, in lower case and without final stops, no earlier one has; empty ones go."""
    key = lambda s: F.lower(F.substring(F.rtrim(F.trim(s), F.lit(".")), 1, 80))
    return let(F.transform(sentences, key), lambda ks: F.filter(sentences, lambda s, i: (F.get(ks, i) != "") & (F.array_position(ks, F.get(ks, i)) == i + 1)))


# What is polished, in this order.
POLISHED = ((r"\(\s*\)", ""), (r",\s*,", ","), (r"\.\s*\.", "."), (r"\s{2,}", " "), (r"\s+([.,!?;%])", "$1"), (r"(?i)versus\s+in the\s+", "versus "))


def polish(text: Column) -> Column:
    """Empty brackets, doubled commas and stops, runs of white space, white space before marks, and `versus in the` go."""
    for pattern, to in POLISHED:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def merged(overview: Column, listing: Column) -> Column:
    """Both texts; the listing alone where the overview without its open slots has fewer than 20 characters."""
    bare = F.trim(F.regexp_replace(overview, r"\{[A-Z_]+\}", ""))
    return F.when(F.coalesce(listing, F.lit("")) == "", overview).when(F.length(bare) < 20, listing).otherwise(F.concat_ws(" ", overview, listing))


def event_sentence() -> Column:
    """A row of values (drug_n, drug_pct, ctrl_n, ctrl_pct, _a) as a sentence."""
    value = lambda n, p: F.concat(F.when(F.col(n).isNotNull(), F.concat(F.col(n).cast("string"), F.lit(" ("))).otherwise(""), F.format_string("%.1f%%", F.col(p)), F.when(F.col(n).isNotNull(), ")").otherwise(""))
    return F.concat(
        "label", F.lit(" was reported in "), value("drug_n", "drug_pct"), F.lit(" of subjects in the "), F.col("_a.experimental"), F.lit(" arm versus "), value("ctrl_n", "ctrl_pct"),
        F.lit(" in the "), F.col("_a.control"), F.lit(" arm."))


def cluster_templates() -> Column:
    return F.create_map(*[F.lit(x) for k, (_, t) in CLUSTERS.items() for x in (k, t)])


def composed(tables: DataFrame, listings: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, origin, summary) of tables (key, table_text, cluster, optionally adapted) and listings (key, listing): the cascade.

    A summary adapted from a neighbour comes first where there is one; else the realized sentences without repeats, if two are left; else the cluster's
    template. A table of single events gets its listing. Then all is polished. A table without text keeps its row, with an error instead of a summary.
    """
    adapted = F.col("adapted") if "adapted" in tables.columns else F.lit(None).cast("string")
    text = F.col("table_text")
    rows = tables.withColumns({"_adapted": adapted, "_slots": slots_of(text)}).withColumn("_profile", profile_of(F.col("_slots")))
    rows = rows.withColumn("_said", unrepeated(realized(F.col("_slots"), F.col("_profile"), F.coalesce(text, F.lit("")))))
    rows = rows.withColumn("_legacy", legacy_fill(F.try_element_at(cluster_templates(), F.col("cluster")), F.col("_slots"))["text"])
    kept = F.length(F.trim("_adapted")) > 20
    rows = rows.withColumns({
        "origin": F.when(kept, "adapted").when(F.size("_said") >= 2, "realized").otherwise("template"),
        "_text": F.when(kept, F.col("_adapted")).when(F.size("_said") >= 2, polish(F.array_join("_said", " "))).otherwise(F.col("_legacy"))})
    rows = rows.join(listings.select(key, "listing"), key, "left")
    full = F.when(F.col("cluster") == "C14_individual_ae_listing", merged(F.col("_text"), F.col("listing"))).otherwise(F.col("_text"))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return rows.select(key, F.when(~blank, F.col("origin")).alias("origin"), F.when(~blank, polish(full)).alias("summary"), F.when(blank, F.lit("no table")).alias("error"))
