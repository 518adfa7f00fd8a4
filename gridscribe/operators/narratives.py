"""Narratives from slots, and checks of a narrative against its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import share
from ..functions.text import let, plain_numbers
from .generation import slots_of

#: Two wordings of each part, in the order of the narrative; {0} and {1} are the arms, {2} to {5} counts and percents of control and experiment.
PARTS = (
    ("TEAE", ("At least one event occurred in {2} ({3}%) subjects on {0} and {4} ({5}%) on {1}.", "Events were seen in {4} ({5}%) subjects on {1} against {2} ({3}%) on {0}.")),
    ("G34", ("Grade 3-4 events occurred in {2} ({3}%) subjects on {0} and {4} ({5}%) on {1}.", "Of subjects on {1}, {4} ({5}%) had a grade 3-4 event; on {0}, {2} ({3}%).")),
    ("SAE", ("Serious events occurred in {2} ({3}%) subjects on {0} and {4} ({5}%) on {1}.", "A serious event was seen in {4} ({5}%) subjects on {1} and {2} ({3}%) on {0}.")),
    ("FATAL", ("Fatal events occurred in {2} ({3}%) subjects on {0} and {4} ({5}%) on {1}.", "Deaths were {4} ({5}%) on {1} and {2} ({3}%) on {0}.")),
    ("DISC", ("Treatment was discontinued by {2} ({3}%) subjects on {0} and {4} ({5}%) on {1}.", "Discontinuations were {4} ({5}%) on {1} and {2} ({3}%) on {0}.")),
)


def fill(template: str, values: list[Column]) -> Column:
    """The template with its slots filled; null if a value is missing, so that the sentence goes."""
    out = F.lit(template)
    for k, v in enumerate(values):
        out = F.replace(out, F.lit("{" + str(k) + "}"), v.cast("string"))
    return out


def narratives(tables: DataFrame, key: str = "table_id", text_col: str = "table_text") -> DataFrame:
    """(key, narrative): sentences of the parts whose slots are all there, each in the wording that the md5 of the table picks. All within the row."""
    rows = tables.select(key, slots_of(F.col(text_col)).alias("_slots"), (F.conv(F.substring(F.md5(text_col), 32, 1), 16, 10).cast("int") % 2).alias("_v"))
    slot = lambda k: F.try_element_at("_slots", F.lit(k))

    def sentence(p: str, wordings: tuple[str, str]) -> Column:
        values = [slot(k) for k in ("ARM_A", "ARM_B", f"{p}_N_A", f"{p}_PCT_A", f"{p}_N_B", f"{p}_PCT_B")]
        return F.when(F.col("_v") == 0, fill(wordings[0], values)).otherwise(fill(wordings[1], values))

    return rows.select(key, F.array_join(F.filter(F.array(*[sentence(p, w) for p, w in PARTS]), lambda s: s.isNotNull()), " ").alias("narrative"))


def verify(text: Column, source: Column, allowed: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0), tolerance: float = 0.11) -> Column:
    """(accuracy, verified): share of numbers that are allowed or within the absolute tolerance of one of the source; 1 without numbers."""
    good = let(plain_numbers(source), lambda s: let(plain_numbers(text), lambda n: share(F.size(F.filter(n, lambda x: x.isin(*allowed) | F.exists(s, lambda y: F.abs(x - y) <= tolerance))), F.size(n), 1.0)))
    return F.struct(good.alias("accuracy"), (good >= 1.0).alias("verified"))


def attribution(text: Column) -> Column:
    """Percents said of an arm: (arm, pct) of `x%) subjects in the <arm> arm`."""
    pattern = r"(\d+\.?\d*)%\)? (?:of )?subjects in the ([A-Za-z ]+?) arm"
    pct, arm = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.zip_with(arm, pct, lambda a, p: F.struct(a.alias("arm"), p.try_cast("double").alias("pct")))
