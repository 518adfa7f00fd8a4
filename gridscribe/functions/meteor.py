"""METEOR: words aligned by their form, then by their stem, then as synonyms where a thesaurus is given, in the fewest chunks."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .rouge import stem

# Weight of precision against recall, and weight and power of the penalty.
ALPHA, GAMMA, BETA = 0.9, 0.5, 3
#: Partial alignments that are followed at once, and places that each tries for a word, besides the one that goes on with its last: those from which most words agree. Short texts have no
#: more; where longer ones do, the fewest chunks found are an upper bound.
BEAM, PLACES = 32, 6
#: Beams that are tried one after another, until one finds no more chunks than any alignment must have.
FIRST_BEAMS = (1, 4)
#: Setting of a session: a Parquet table (synset, word) that all executors read, such as WordNet's synsets.
THESAURUS = "spark.gridscribe.meteor.thesaurus"


@lru_cache(maxsize=1)
def synonyms_of(path: str) -> dict[str, frozenset[str]]:
    """For each word, in lower case, all words of the synsets that hold it."""
    import pyarrow.parquet as pq

    table = pq.read_table(path, columns=["synset", "word"])
    synsets, words = defaultdict(set), defaultdict(set)
    for s, w in zip(table.column("synset").to_pylist(), table.column("word").to_pylist()):
        if s is not None and w is not None:
            synsets[s].add(w.lower())
    for members in synsets.values():
        for w in members:
            words[w] |= members
    return {w: frozenset(x) for w, x in words.items()}


def runs_of(generated: list[str], reference: list[str]) -> list[dict[int, int]]:
    """For each word of the text the places of the reference that hold it, with how many words agree from both on."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(reference):
        places.setdefault(w, []).append(j)
    out: list[dict[int, int]] = [{} for _ in range(len(generated) + 1)]
    for i in range(len(generated) - 1, -1, -1):
        out[i] = {j: 1 + out[i + 1].get(j + 1, 0) for j in places.get(generated[i], ())}
    return out


def fewest_chunks(generated: list[str], reference: list[str], stems: dict[str, str], exact: dict[str, int]) -> int:
    """A number of chunks that no alignment comes below, whatever words it takes.

    Words of which all occurrences match by form (in the text, or in the reference) must be covered, and a chunk that covers one goes on at most as long as the stems from there on recur
    anywhere on the other side. From left to right, each in reach of the one before it or the first of a new chunk.
    """
    most = 1
    for one, other in ((generated, reference), (reference, generated)):
        have = Counter(one)
        runs = runs_of([stems[w] for w in one], [stems[w] for w in other])
        chunks, reach = 0, 0
        for i, w in enumerate(one):
            if i >= reach and exact.get(w, 0) == have[w]:
                chunks, reach = chunks + 1, i + max(runs[i].values())
        most = max(most, chunks)
    return most


def align(generated: list[str], reference: list[str], beam: int = BEAM, synonyms: dict[str, frozenset[str]] | None = None) -> tuple[int, int]:
    """(matches, chunks): as many words by form as there are, then as many of the rest by stem as there are, then as synonyms, in as few chunks as possible.

    How many words of a form or stem match follows from their counts alone; which of equal words match is what chunks hang on. Words of the text are taken one after another, and
    states are the words of the reference that are used, the last one, and the forms and stems that may yet be passed over. An alignment with all matches and as few chunks as any must
    have is the best, however few states were followed; most texts have one among the first, and the whole beam is for the others. How many synonyms match does not follow from counts, as
    words may share no synset with the synonyms of each other: texts that have any take the whole beam.
    """
    stems = {w: stem(w) for w in {*generated, *reference}}
    runs, by_stem = runs_of(generated, reference), {}
    for j, w in enumerate(reference):
        by_stem.setdefault(stems[w], []).append(j)
    have, want = Counter(generated), Counter(reference)
    exact = {w: min(n, want[w]) for w, n in have.items()}
    left_have, left_want = Counter(), Counter()
    for w in {*have, *want}:
        left_have[stems[w]] += have[w] - exact.get(w, 0)
        left_want[stems[w]] += want[w] - exact.get(w, 0)
    total = sum(exact.values()) + sum(min(n, left_want[s]) for s, n in left_have.items())
    alike = {w: [j for j, r in enumerate(reference) if stems[r] != stems[w] and r in synonyms[w]] for w in have if w in synonyms} if synonyms else {}
    alike = {w: places for w, places in alike.items() if places}
    if not total and not alike:
        return 0, 0
    least = fewest_chunks(generated, reference, stems, exact)
    sides = (generated, reference, stems, runs, by_stem, alike, {w: want[w] - n for w, n in exact.items()})
    for tried in (*(b for b in FIRST_BEAMS if b < beam and not alike), beam):
        by_form, matches, chunks = _followed(*sides, tried)
        if (by_form, matches, chunks) == (sum(exact.values()), total, least):
            break
    return matches, chunks


def _followed(generated: list[str], reference: list[str], stems: dict[str, str], runs: list[dict[int, int]], by_stem: dict[str, list[int]], alike: dict[str, list[int]], spare: dict[str, int], beam: int) -> tuple[int, int, int]:
    """The best (matches by form, matches, chunks) of the states that a beam keeps; alike are the places of a word's synonyms, spare is how many words of a form the reference has beyond those that match."""
    # (used, last): (matches by form, by form or stem, all, -chunks); last is the place that the word before took, -1 for none
    states: dict[tuple[int, int], tuple[int, int, int, int]] = {(0, -1): (0, 0, 0, 0)}
    later = Counter(generated)
    for i, w in enumerate(generated):
        later[w] -= 1
        same = sorted(runs[i], key=lambda j: (-runs[i][j], j))
        others = [j for j in by_stem.get(stems[w], ()) if reference[j] != w]
        after: dict[tuple[int, int], tuple[int, int, int, int]] = {}

        def reach(key: tuple[int, int], value: tuple[int, int, int, int]) -> None:
            if key not in after or value > after[key]:
                after[key] = value

        for (used, last), (e, t, m, c) in states.items():
            free = [j for j in same if not used >> j & 1]
            # as many words of this form match as can: it is passed over only if enough of them follow
            if len(free) - later[w] <= spare[w]:
                reach((used, -1), (e, t, m, c))
                for j in [j for j in others if not used >> j & 1][:PLACES]:
                    reach((used | 1 << j, j), (e, t + 1, m + 1, c if last >= 0 and j == last + 1 else c - 1))
                for j in [j for j in alike.get(w, ()) if not used >> j & 1][:PLACES]:
                    reach((used | 1 << j, j), (e, t, m + 1, c if last >= 0 and j == last + 1 else c - 1))
            next_one = [last + 1] if last >= 0 and last + 1 in runs[i] and not used >> (last + 1) & 1 else []
            for j in dict.fromkeys([*next_one, *free[:PLACES]]):
                reach((used | 1 << j, j), (e + 1, t + 1, m + 1, c if last >= 0 and j == last + 1 else c - 1))
        if len(after) > beam:
            after = dict(sorted(after.items(), key=lambda x: x[1], reverse=True)[:beam])
        states = after
    by_form, _, matches, chunks = max(states.values())
    return by_form, matches, -chunks


def meteor(generated: str | None, reference: str | None, synonyms: dict[str, frozenset[str]] | None = None) -> float:
    """0 where either text has no words or none match."""
    g, r = (generated or "").lower().split(), (reference or "").lower().split()
    if not g or not r:
        return 0.0
    m, chunks = align(g, r, synonyms=synonyms)
    if not m:
        return 0.0
    p, q = m / len(g), m / len(r)
    return (1 - GAMMA * (chunks / m) ** BETA) * p * q / (ALPHA * p + (1 - ALPHA) * q)


def meteor_by(thesaurus: str | None = None):
    """Column function (generated, reference) -> METEOR, with the synonyms of the thesaurus if one is given."""

    @F.pandas_udf(DoubleType())
    def scored(generated: pd.Series, reference: pd.Series) -> pd.Series:
        synonyms = synonyms_of(thesaurus) if thesaurus else None
        return pd.Series([meteor(g, r, synonyms) for g, r in zip(generated, reference)], dtype="float64")

    return scored


meteor_scores = meteor_by()
