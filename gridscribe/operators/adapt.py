"""Adapting the write-up of a neighbouring table: its names and numbers become slots, which are filled with the facts of the table at hand."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..functions.tables import SLOT_PREFIX, arms, cell_value, cells, raw_rows, row_type
from ..functions.text import let
from .generation import fill, legacy_fill, slots_of

# A write-up counts as adapted from so many replacements on, if so large a share of its slots is known; a number stands for a slot's if it is nearer than this.
REPLACEMENTS, COVERAGE, NEAR = 5, 0.5, 0.5


def last_slots(text: Column) -> Column:
    """Slots of a table by single cells, of rows of a type the last one's: what a write-up about it may have said. A map without the arms' names."""

    def of(a: Column) -> Column:
        def row(c: Column) -> Column:
            at = lambda i: cell_value(F.coalesce(F.get(c, i + 1), F.lit("")))
            return F.when(F.size(c) >= 3, F.struct(row_type(F.get(c, F.lit(0))).alias("kind"), at(a["exp_idx"]).alias("b"), at(1 - a["exp_idx"]).alias("a")))

        rows = F.reverse(F.filter(F.transform(raw_rows(text), lambda r: let(cells(r), row)), lambda x: x["kind"].isNotNull()))

        def entries(x: Column) -> Column:
            out = []
            for kind, prefix in SLOT_PREFIX.items():
                for side in ("b", "a"):
                    n = F.filter(x, lambda r: (r["kind"] == kind) & r[side]["n"].isNotNull())  # noqa: B023
                    p = F.filter(x, lambda r: (r["kind"] == kind) & (r[side]["pct"] != 0))  # noqa: B023
                    out += [(f"{prefix}_N_{side.upper()}", F.get(n, F.lit(0))[side]["n"]), (f"{prefix}_PCT_{side.upper()}", F.get(p, F.lit(0))[side]["pct"])]
            pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in out])
            return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))

        return let(rows, entries)

    return let(arms(F.coalesce(text, F.lit(""))), of)


def delexicalize(writeup: str | None, control: str | None, experimental: str | None, slots: dict | None) -> str | None:
    """The write-up with its arms' names and its table's numbers as slots; null below REPLACEMENTS replacements.

    Names first, as whole words in any case; then each slot's number: everywhere it stands as written, else once where a number within half a unit of it stands
    outside of a slot.
    """
    if not writeup:
        return None
    out, done = writeup, 0
    for name, slot in ((control, "ARM_A"), (experimental, "ARM_B")):
        if name and len(name) >= 2:
            out, n = re.subn(rf"(?<!\{{)\b{re.escape(name)}\b(?!\}})", "{" + slot + "}", out, flags=re.IGNORECASE)
            done += n
    for slot, value in (slots or {}).items():
        exact = rf"(?<![\w.{{]){re.escape(str(value))}(?![\w}}]|\.\d)"
        out, n = re.subn(exact, "{" + slot + "}", out)
        if not n:
            near = next((m for m in re.finditer(r"(?<![\w.{])\d+\.?\d*(?![\w}])", out) if abs(float(m[0]) - float(value)) < NEAR), None)
            if near:
                out, n = out[: near.start()] + "{" + slot + "}" + out[near.end() :], 1
        done += bool(n)
    return out if done >= REPLACEMENTS and "{" in out else None


@F.pandas_udf(StringType())
def _delexicalized(writeup: pd.Series, control: pd.Series, experimental: pd.Series, slots: pd.Series) -> pd.Series:
    return pd.Series([delexicalize(w, a, b, dict(s) if s is not None else None) for w, a, b, s in zip(writeup, control, experimental, slots)], dtype="object")


#: delexicalize in Arrow batches. Marked as not deterministic, so that its result is a column of its own: functions over arrays cannot hold Python ones. Its slots, too, are to come from
#: a column that is computed before, as on a side of a join.
delexicalized = _delexicalized.asNondeterministic()


def plainly_delexicalized(writeup: Column, old_table: Column) -> Column:
    """The older way, for write-ups that delexicalize() gives up: names of arms and first values of the old table's slots become slots wherever they stand as whole words and numbers; null where none does."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))

    def named(text: Column, name: Column, slot: str) -> Column:
        word = F.concat(F.lit(r"(?i)\b"), quoted(name), F.lit(r"\b"))
        return F.when(F.length(name) >= 2, F.regexp_replace(text, word, F.lit("{" + slot + "}"))).otherwise(text)

    def of(a: Column) -> Column:
        text = named(named(writeup, a["control"], "ARM_A"), a["experimental"], "ARM_B")
        values = F.map_filter(slots_of(old_table), lambda k, v: ~k.rlike("^(ARM|N)_"))
        number = lambda v: F.concat(F.lit(r"(?<![\w.{])"), quoted(v), F.lit(r"(?![\w}]|\.\d)"))
        whole = F.aggregate(F.map_entries(values), text, lambda t, e: F.regexp_replace(t, number(e["value"]), F.concat(F.lit("{"), e["key"], F.lit("}"))))
        return let(whole, lambda t: F.when(t.contains("{"), t))

    return let(arms(old_table), of)


def adapted(template: Column, slots: Column) -> Column:
    """A delexicalized write-up filled with the facts of another table: null if less than COVERAGE of its slots are known. A sentence stays if more than half
    of its slots are."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Z0-9_]+)\}"), 1))
    known = F.size(F.array_intersect(names, F.map_keys(slots)))
    whole = fill(template, slots)
    return F.when((F.size(names) > 0) & (known >= COVERAGE * F.size(names)), F.coalesce(whole, legacy_fill(template, slots)["text"]))
