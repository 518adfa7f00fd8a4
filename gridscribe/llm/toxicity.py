"""Toxicity: ordinal regression of severity grades on sparse word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import Words, appending, chunks, cut, in_arrow, table

#: Labelled documents of each class that the model is fitted on, at most; those with the smallest hash of the id.
SAMPLE = 2500
#: Features that the model keeps, by their log odds between the classes.
FEATURES = 2048
#: Bytes of the prefix features.
PREFIX = 6
#: A feature must be in this share of the toxic sample (2 to 10 documents of it) and this much likelier there, in log odds.
SUPPORT, TELLING = 0.01, 1.5
#: What rejecting a clean document costs against missing a toxic one, as shares of their classes.
FALSE_COST = 20.0


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(text, feature hash) of every word and of every word's prefix."""
    words = Words(texts, letters=True)
    whole = words.hash
    return np.concatenate([words.doc, words.doc]), np.concatenate([whole, words.prefix(PREFIX)]).view(np.int64), words


def _counted(doc: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, of) with how often each comes."""
    if not len(doc):
        return doc, of, doc
    order = np.lexsort((of, doc))
    doc, of = doc[order], of[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])])
    return doc[at], of[at], np.diff(np.r_[at, len(doc)])


@dataclass(frozen=True)
class Ordinal:
    """P(grade <= k) = sigmoid(cuts[k] - w.x): one weight of each feature for all cuts, x = log(1 + count).

    Documents whose score w.x reaches `reject` are rejected. Without labels of both classes there is no model: keys and cuts are
    empty and every severity is 0.
    """

    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    reject: float = np.inf

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(texts))
        doc, of, _ = _features(texts)
        at = np.minimum(np.searchsorted(self.keys, of), len(self.keys) - 1)
        hit = self.keys[at] == of
        doc, at, n = _counted(doc[hit], at[hit])
        return np.bincount(doc, self.weights[at] * np.log1p(n), len(texts))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by column; adding them up gives the expected grade."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 400, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of a cumulative-link model by full-batch Adam; cuts are a first one and positive steps."""
    n, m = x.shape
    par = np.zeros(m + grades - 1)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 0.01, 0.99)
    start = np.log(share / (1 - share))
    par[m], par[m + 1 :] = start[0], np.log(np.maximum(np.diff(start), 0.05))
    mean, var = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, rounds + 1):
        steps = np.exp(par[m + 1 :])
        cuts = par[m] + np.concatenate([[0.0], np.cumsum(steps)])
        z = cuts[None, :] - (x @ par[:m].astype(x.dtype)).astype(float)[:, None]
        below = np.hstack([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(z, -40, 40))), np.ones((n, 1))])
        slope = below * (1 - below)
        row = np.arange(n)
        p = np.maximum(below[row, grade + 1] - below[row, grade], 1e-12)
        hi, lo = slope[row, grade + 1] / p, slope[row, grade] / p
        d_score = (hi - lo) / n  # of the negative log-likelihood: the cuts enter with the opposite sign
        d_cuts = np.array([(lo * (grade == k + 1)).sum() - (hi * (grade == k)).sum() for k in range(grades - 1)]) / n
        grad = np.empty_like(par)
        grad[:m] = (d_score.astype(x.dtype) @ x).astype(float) + l2 * par[:m]
        grad[m] = d_cuts.sum()
        grad[m + 1 :] = np.cumsum(d_cuts[::-1])[::-1][1:] * steps
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        par -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    return par[:m], par[m] + np.concatenate([[0.0], np.cumsum(np.exp(par[m + 1 :]))])


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The score above which rejecting costs least on the sample: the middle of the widest of equally good gaps, always above 0."""
    seen = np.unique(np.append(scores, 0.0))
    seen = seen[seen >= 0]
    middle = np.append((seen[1:] + seen[:-1]) / 2, seen[-1] + 1)
    width = np.append(np.diff(seen), 0.0)
    missed = np.searchsorted(np.sort(scores[toxic == 1]), middle) / max(1, (toxic == 1).sum())
    wrong = 1 - np.searchsorted(np.sort(scores[toxic == 0]), middle) / max(1, (toxic == 0).sum())
    cost = missed + FALSE_COST * wrong
    return float(middle[np.lexsort((-width, cost))[0]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> Ordinal:
    """The model of `labels` (id, toxic 0/1), fitted on at most `sample` documents of each class.

    Grades: 0 for documents that are not toxic; toxic ones with at most the median number of telling words of the toxic
    sample have grade 1, the others grade 2. Cuts are moved from the sample's balance of classes to that of all labels. Of near copies in
    the sample (same least hash of five words; below five words, the same words) that of the smallest id counts in each class, else the words of a much copied document would pass for telling ones. What
    comes to the driver: `features` counted features and as many numbers of each sampled document at most. Of rows with the same id the
    least text counts, of labels of one id the higher, so that the model follows from the tables alone.
    """
    none = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    labels = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    totals = {r["_toxic"]: r["n"] for r in labels.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return none
    chosen = None
    for y in (0, 1):
        part = labels.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select("_id", "_text", "_toxic")

    def featured(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                doc, of, words = _features(part.column("_text"))
                doc, of, n = _counted(doc, of)
                off = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                runs, whole = words.runs(5)
                key = np.full(part.num_rows, 2**63, np.uint64)
                np.minimum.at(key, words.doc[: len(runs)][whole], runs[whole])
                short = np.flatnonzero(np.diff(words.first) < 5)
                key[short] = words.stretches(words.first[short], words.first[short + 1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_toxic"), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(off, pa.array(of)), pa.ListArray.from_arrays(off, pa.array(n.astype(np.int32)))],
                    ["_id", "toxic", "key", "of", "n"])

    schema = StructType([rows.schema["_id"], *StructType.fromDDL("toxic int, key bigint, of array<bigint>, n array<int>").fields])
    rows = in_arrow(rows, featured, schema).groupBy("toxic", "key").agg(F.min_by(F.struct("of", "n"), "_id").alias("x"))
    rows = cut(rows.select("toxic", "key", "x.of", "x.n"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return none
    seen = rows.select("toxic", F.explode("of").alias("of")).groupBy("of").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (sizes[1] + 1.0) / ((F.col("q") + 0.5) / (sizes[0] + 1.0)))
    seen = seen.where(F.col("p") >= max(2, min(10, SUPPORT * sizes[1]))).select("of", odds.alias("odds"), (odds * F.sqrt(F.col("p") + F.col("q"))).alias("z"))
    keys = np.array(sorted(r["of"] for r in seen.where(F.col("odds") >= TELLING).orderBy(F.desc("z"), "of").limit(features).collect()), np.int64)
    if not len(keys):
        return none
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys.tolist())], "of bigint, at int"))
    flat = rows.select("toxic", "key", F.explode(F.arrays_zip("of", "n")).alias("x")).join(wanted, F.col("x.of") == F.col("of"))
    flat = flat.groupBy("toxic", "key").agg(F.collect_list("at").alias("at"), F.collect_list("x.n").alias("n"))
    got = rows.select("toxic", "key").join(flat, ["toxic", "key"], "left").orderBy("toxic", "key").collect()
    x = np.zeros((len(got), len(keys)), np.float32)
    told = np.zeros(len(got))
    for i, r in enumerate(got):
        if r["at"]:
            x[i, r["at"]] = np.log1p(np.array(r["n"], np.float32))
            told[i] = sum(r["n"])
    toxic = np.array([r["toxic"] for r in got])
    if len(set(toxic.tolist())) < 2:
        return none
    grade = np.where(toxic == 0, 0, np.where(told <= np.median(told[toxic == 1]), 1, 2))
    weights, cuts = fit_ordinal(x, grade, 3)
    shift = np.log((totals[0] / sizes[0]) / (totals[1] / sizes[1]))
    return Ordinal(keys, weights, cuts + shift, best_cut(x @ weights, toxic))


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """docs with _severity (expected grade, 0 to 2), _p_toxic (of grade 1 or more) and _rejected (the severity reaches
    that of the model's rejecting score), for whole texts.

    Null and empty texts have no feature and are not rejected. Each row by itself, so ties, repeated rows and empty tables need
    nothing special; further columns stay, columns named like the results are replaced.
    """
    docs = docs.drop("_severity", "_p_toxic", "_rejected")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                scores = model.scores(part.column(text_col))
                above = model.above(scores)
                blank = np.asarray(pc.fill_null(pc.binary_length(part.column(text_col)), 0)) == 0
                p = np.where(blank | (above.shape[1] == 0), 0.0, above[:, 0] if above.shape[1] else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.where(blank, 0.0, above.sum(1))), pa.array(p), pa.array((scores >= model.reject) & ~blank)],
                    [*part.schema.names, "_severity", "_p_toxic", "_rejected"])

    return appending(docs, run, "_severity double, _p_toxic double, _rejected boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.col("_severity").alias("severity"), F.col("_p_toxic").alias("p_toxic"), F.col("_rejected").alias("rejected"))
