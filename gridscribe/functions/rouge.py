"""ROUGE with a stemmer: token F1 by the published definitions, in Arrow batches. The stemmer is Porter's with the later rules that NLTK adds by default."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .metrics import common_length

# Suffixes of the steps of Porter's algorithm, in the published order.
_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Fixed: words that the rules would stem otherwise.
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return (_shape(word)[-3:] == "cvc" and word[-1] not in "wxy") or _shape(word) == "vc"


def _swap(word: str, pairs, least: int) -> str:
    for end, to in pairs:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + to if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) < 3:
        return word
    for end, to in (("sses", "ss"), ("ies", "ie" if len(word) == 4 else "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e)), None)
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    if word.endswith("logi"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    word = _swap(_swap(word, _STEP_2, 0), _STEP_3, 0)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 in lower case; those of more than three letters are stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", (text or "").lower())]


def f1(hits: int, of: int, wanted: int) -> float:
    if not hits:
        return 0.0
    p, r = hits / of, hits / wanted
    return 2 * p * r / (p + r)


def scores(generated: str | None, reference: str | None) -> tuple[float, float, float]:
    """F1 of shared words, of shared pairs of words, and of the longest common subsequence; 0 where either text has none."""
    g, r = words(generated), words(reference)
    out = []
    for n in (1, 2):
        a, b = (Counter(zip(*[x[k:] for k in range(n)])) for x in (g, r))
        out.append(f1((a & b).total(), a.total(), b.total()))
    return out[0], out[1], f1(common_length(g, r), len(g), len(r))


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rouge_1", "rouge_2", "rouge_l")]))
def rouge_f1(generated: pd.Series, reference: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scores(g, r) for g, r in zip(generated, reference)], columns=["rouge_1", "rouge_2", "rouge_l"])
