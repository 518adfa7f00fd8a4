"""Column functions on texts: numbers, sentences, severity, arms. All are built-in expressions; none is a UDF."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

#: Fixed: a number is at most three leading digits with separators, or a bare decimal, and touches no word character.
NUMBER = r"(?<!\w)(-?\d{1,3}(?:[,.]\d{3})*(?:[,.]\d+)?|-?\.\d+)%?(?!\w)"
PLAIN_NUMBER = r"\b(\d+\.?\d*)\b"
PERCENT_BEFORE_PAREN = r"(\d+\.?\d*)\s*\)"
#: Fixed: words of each severity tier, the highest first.
SEVERITY = ((4, r"\bfatal\b|\bdeath\b|\bdied\b|\bmortality\b"), (3, r"\bserious adverse event\b|\bsae\b|\bhospitaliz"), (2, r"\bgrade\s*3\b|\bgrade\s*4\b|\bsevere\b"))
#: The standalone scorer's words.
SEVERITY_SHORT = ((4, r"\bfatal\b|\bdeath\b"), (3, r"\bsae\b|\bserious"), (2, r"\bgrade\s*[34]\b|\bsevere\b"))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)


def doubles(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def extract_numbers(text: Column) -> Column:
    """Distinct numbers in order: separators and percent signs go, four decimals stay. Null: none."""
    return F.array_distinct(F.filter(F.transform(doubles(found(text, NUMBER)), lambda x: F.round(x, 4)), lambda x: x.isNotNull()))


def plain_numbers(text: Column) -> Column:
    """All numbers, with repeats, without signs or separators."""
    return doubles(found(text, PLAIN_NUMBER))


def sentences(text: Column) -> Column:
    """Split after . ! or ? where a capital follows; blanks are dropped."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+(?=[A-Z])", -1)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def severity(text: Column, table=SEVERITY) -> Column:
    """Highest tier whose words the text has; 1 without any."""
    low, out = F.lower(text), None
    for tier, pattern in table:
        out = F.when(low.rlike(pattern), tier) if out is None else out.when(low.rlike(pattern), tier)
    return out.otherwise(1)


def facts(text: Column, table=SEVERITY) -> Column:
    """Sentences with a number: (numbers, tier)."""
    return F.filter(F.transform(sentences(text), lambda s: F.struct(extract_numbers(s).alias("numbers"), severity(s, table).alias("tier"))), lambda f: F.size(f["numbers"]) > 0)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), lambda t: t != "")


def near(a: Column, b: Column, tolerance: float) -> Column:
    """a within the relative tolerance of b."""
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) <= tolerance


def token_numbers(text: Column) -> Column:
    """(toks, nums): the tokens, and (place, first number) of those that hold one."""
    plain = lambda t: F.round(F.replace(F.regexp_extract(t, NUMBER, 1), F.lit(","), F.lit("")).try_cast("double"), 4)
    first = lambda t: F.when(t.rlike("[0-9]"), F.coalesce(plain(t), F.try_element_at(extract_numbers(t), F.lit(1))))
    numbers = lambda toks: F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("i"), first(t).alias("v"))), lambda x: x["v"].isNotNull())
    return let(tokens(text), lambda toks: F.struct(toks.alias("toks"), numbers(toks).alias("nums")))


def arm_starts(toks: Column, arm: str) -> Column:
    """Places at which the arm's name begins, token for token."""
    name = arm.lower().split()
    here = lambda i: [F.get(toks, i + k) == w for k, w in enumerate(name)]
    return F.filter(F.sequence(F.lit(0), F.size(toks)), lambda i: F.coalesce(reduce(and_, here(i)), F.lit(False)))


def arm_values(read: Column, arm: str, radius: int) -> Column:
    """First numbers of tokens at most `radius` tokens from an occurrence of the arm's name, once per occurrence; `read` is token_numbers."""

    def of(x: Column) -> Column:
        near = lambda p: F.transform(F.filter(x["nums"], lambda n: F.abs(n["i"] - p) <= radius), lambda n: n["v"])
        return F.flatten(F.transform(arm_starts(x["toks"], arm), near))

    return let(read, of)
