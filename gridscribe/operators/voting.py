"""A weighted vote of learners on rows that none of them has seen: folds by hash, one fit for each fold and learner, weights from what the fits say of the rows left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Fits a learner on rows (features, label) and returns what adds `score`, the chance of label 1, to rows with features.
Learner = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def fold_of(key, folds: int, seed: str = "fold"):
    """The fold of a row by the md5 of its key: the same on every run."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def areas(rows: DataFrame) -> DataFrame:
    """(model, auc) of (model, score, label): areas under the curve by the rank sum. Ranks run over distinct scores in order, counted per range of
    scores first, so no window holds all rows of a model."""
    by = rows.groupBy("model", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).withColumn("b", F.floor(F.col("score") * 64))
    parts = by.groupBy("model", "b").agg(F.sum("q").alias("of"))
    parts = parts.select("model", "b", (F.sum("of").over(Window.partitionBy("model").orderBy("b")) - F.col("of")).alias("ahead"))
    inside = F.sum("q").over(Window.partitionBy("model", "b").orderBy("score")) - F.col("q")
    below = by.withColumn("inside", inside).join(parts, ["model", "b"]).withColumn("below", F.col("ahead") + F.col("inside"))
    total = F.sum("p").cast("double") * F.sum("q")
    return below.groupBy("model").agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(total, F.lit(0.0))).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(model, average_precision) of (model, score, label): the sum over distinct scores, the highest first, of the recall that each adds times the precision there. Counts run over ranges of scores
    first, as in areas()."""
    by = rows.groupBy("model", "score").agg(F.sum("label").alias("p"), F.count("*").alias("n")).withColumn("b", F.floor(F.col("score") * 64))
    parts = by.groupBy("model", "b").agg(F.sum("p").alias("of_p"), F.sum("n").alias("of_n"))
    above = Window.partitionBy("model").orderBy(F.desc("b"))
    parts = parts.select("model", "b", *[(F.sum(f"of_{c}").over(above) - F.col(f"of_{c}")).alias(f"ahead_{c}") for c in "pn"])
    inside = Window.partitionBy("model", "b").orderBy(F.desc("score"))
    upto = by.withColumns({f"in_{c}": F.sum(c).over(inside) for c in "pn"}).join(parts, ["model", "b"])
    precision = (F.col("ahead_p") + F.col("in_p")) / (F.col("ahead_n") + F.col("in_n"))
    return upto.groupBy("model").agg((F.sum(F.col("p") * precision) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def sweep(rows: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, n_told, precision, recall, f1) of (score, label): what a score above each threshold tells, in one pass; shares of nothing are null."""
    above = lambda t: F.col("score") > t
    sums = rows.agg(F.sum("label").alias("wanted"), *[x for i, t in enumerate(thresholds) for x in (F.count_if(above(t)).alias(f"told_{i}"), F.count_if(above(t) & (F.col("label") == 1)).alias(f"hit_{i}"))])
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"told_{i}").alias("n_told"), F.col(f"hit_{i}").alias("hit")) for i, t in enumerate(thresholds)])
    long = sums.select("wanted", F.explode(each).alias("x")).select("wanted", "x.*")
    p, r = F.try_divide("hit", "n_told"), F.try_divide("hit", "wanted")
    return long.select("threshold", "n_told", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def out_of_fold(rows: DataFrame, learners: dict[str, Learner], key: str = "id", label: str = "label", folds: int = 3) -> DataFrame:
    """(key, label, fold, one score column for each learner): each row scored by fits on the other folds alone.

    A fold without rows of both labels outside of it is scored 0.5. Rows with a null key are in one fold.
    """
    rows = rows.withColumn("_fold", F.coalesce(fold_of(F.col(key), folds), F.lit(0)))
    counts = {(r["_fold"], r[label]): r["n"] for r in rows.groupBy("_fold", label).agg(F.count("*").alias("n")).collect()}  # two rows a fold
    out = []
    for fold in sorted({f for f, _ in counts}):
        rest, held = rows.where(F.col("_fold") != fold), rows.where(F.col("_fold") == fold)
        able = all(any(n and f != fold and y == want for (f, y), n in counts.items()) for want in (0, 1))
        for name, learn in learners.items():
            scored = learn(rest.drop("_fold"))(held.drop("_fold")) if able else held.withColumn("score", F.lit(0.5))
            out.append(scored.select(key, F.col(label).alias("label"), F.lit(fold).alias("fold"), F.lit(name).alias("model"), F.col("score").cast("double").alias("score")))
    return reduce(DataFrame.unionByName, out)


def voted(scores: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(key, label, fold, score, told) and (model, auc, weight): the mean of the learners' scores weighted by their areas under the curve over all rows left out.

    scores are those of out_of_fold in long form; an area of null (one label alone) counts as one half.
    """
    area = areas(scores.select("model", F.round("score", 6).alias("score"), "label"))
    auc = F.coalesce("auc", F.lit(0.5))
    weights = area.select("model", auc.alias("auc")).withColumn("weight", F.col("auc") / F.sum("auc").over(Window.partitionBy()))  # a row a learner
    rows = scores.join(F.broadcast(weights.select("model", "weight")), "model").groupBy(key, "label", "fold").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
    return rows.withColumn("told", F.col("score") > 0.5), weights


def tree_and_line_learners(features: tuple[str, ...], label: str = "label", seed: int = 42) -> dict[str, Learner]:
    """Boosted trees, a forest and a logistic regression on the same features."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    common = {"featuresCol": "_features", "labelCol": label}

    def learner(estimator) -> Learner:
        def fit(rows: DataFrame):
            model = estimator.fit(assembler.transform(rows.withColumn(label, F.col(label).cast("double"))))
            return lambda held: model.transform(assembler.transform(held)).withColumn("score", F.element_at(vector_to_array("probability"), 2))

        return fit

    return {
        "boosted": learner(GBTClassifier(maxIter=8, maxDepth=3, seed=seed, **common)), "forest": learner(RandomForestClassifier(numTrees=12, maxDepth=4, seed=seed, **common)),
        "line": learner(LogisticRegression(maxIter=25, regParam=0.01, **common)),
    }
