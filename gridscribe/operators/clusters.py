"""Ward clusters of all rows of a table: rows are condensed to a bounded number of leaves, and these are merged by chains of nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Leaves of a task, a merge and the whole; with no more distinct rows than these every row is a leaf, and the clusters are those of the definition.
LEAVES = 2000
#: Lists of leaves that a merge takes in.
FAN = 8


class Leaves:
    """Counts, sums and square sums of points within `width` of each other's mean. Where there are too many, the width grows and the leaves are put together anew."""

    def __init__(self, dims: int, most: int = LEAVES):
        self.most, self.width = most, 0.0
        self.n, self.sums, self.squares = np.zeros(0), np.zeros((0, dims)), np.zeros(0)

    def add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        self.n, self.sums, self.squares = np.r_[self.n, n], np.concatenate([self.sums, sums]), np.r_[self.squares, squares]
        self._join_equal()
        while len(self.n) > self.most:
            self._grow()

    def _join_equal(self) -> None:
        means = self.sums / self.n[:, None]
        _, first, at = np.unique(means, axis=0, return_index=True, return_inverse=True)
        if len(first) < len(means):
            self._join(at.ravel(), len(first))

    def _join(self, at: np.ndarray, count: int) -> None:
        n, squares, sums = np.bincount(at, self.n, count), np.bincount(at, self.squares, count), np.zeros((count, self.sums.shape[1]))
        np.add.at(sums, at, self.sums)
        self.n, self.sums, self.squares = n, sums, squares

    def _grow(self) -> None:
        """Twice the width, or at first the middle distance of some leaves to their nearest one; then each leaf goes to the first leaf within it."""
        means = self.sums / self.n[:, None]
        if not self.width:
            some = means[np.linspace(0, len(means) - 1, 200).astype(int)]
            d = np.sqrt(np.maximum((some * some).sum(1)[:, None] + (means * means).sum(1) - 2 * some @ means.T, 0))
            d[d <= 1e-12] = np.inf
            nearest = d.min(1)
            self.width = float(np.median(nearest[np.isfinite(nearest)])) if np.isfinite(nearest).any() else 1.0
        else:
            self.width *= 2
        at, heads, left, rest = np.full(len(means), -1), 0, np.arange(len(means)), means
        while len(left):  # only what has no leaf yet is held against the next one
            near = ((rest - rest[0]) ** 2).sum(1) <= self.width**2
            near[0] = True
            at[left[near]] = heads
            heads, left, rest = heads + 1, left[~near], rest[~near]
        self._join(at, heads)

    def table(self, **more) -> pa.Table:
        return pa.table({**{k: pa.array([v] * len(self.n), pa.int32()) for k, v in more.items()}, "n": self.n, "sums": pa.array(self.sums.tolist(), pa.list_(pa.float64())), "squares": self.squares})


def ward_merges(n: np.ndarray, means: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of points with weights, by chains: from a cluster to its nearest one, until two are each other's nearest; these merge, and b takes the place of both.

    The height is the square root of 2 n m / (n + m) times the distance of the means: for two single points their distance. Time is the square of the points, memory their number.
    """
    n, means = n.astype(float).copy(), means.astype(float).copy()
    live, chain, out = np.ones(len(n), bool), [], []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        i = chain[-1]
        gap = 2 * n * n[i] / (n + n[i]) * ((means - means[i]) ** 2).sum(1)
        gap[~live] = np.inf
        gap[i] = np.inf
        j = int(gap.argmin())
        if len(chain) > 1 and gap[chain[-2]] <= gap[j]:
            j = chain[-2]
            chain = chain[:-2]
            a, b = (i, j) if i > j else (j, i)
            out.append((a, b, float(np.sqrt(gap[j]))))
            means[b] = (n[a] * means[a] + n[b] * means[b]) / (n[a] + n[b])
            n[b] += n[a]
            live[a] = False
        else:
            chain.append(j)
    return out


def below(merges: list[tuple[int, int, float]], count: int, threshold: float) -> np.ndarray:
    """Cluster of each point: merges lower than the threshold, and what they were made of, are joined."""
    of = np.arange(count)

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b, height in merges:
        if height < threshold:
            of[root(a)] = root(b)
    return np.array([root(i) for i in range(count)], np.int64)


def ward_of_all(rows: DataFrame, key: str, features: tuple[str, ...], threshold: float, most: int = LEAVES) -> DataFrame:
    """(key, cluster): Ward clusters of all rows on their features, merged while below the threshold; a cluster is named by its smallest key.

    Each task condenses its rows to `most` leaves at most: counts, sums and square sums of rows that are equal or, if there are too many of these, within a width that grows until they fit.
    Leaves of FAN tasks are put together in a task, and those again, until one list is left, whatever the number of tasks. Its leaves are clustered, and each row goes with the leaf
    that is nearest to it. With no more than `most` distinct rows nothing is rounded. Null features count as 0; rows with a null key are left out.
    """
    spark, dims = rows.sparkSession, len(features)
    key_type = dict(rows.dtypes)[key]
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)])
    rows = cut(rows)  # read by the leaves and by the assignment
    shape = "n double, sums array<double>, squares double"

    def points(batch) -> np.ndarray:
        return np.column_stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(dims)])

    def condense(batches):
        leaves = Leaves(dims, most)
        for batch in batches:
            if batch.num_rows:
                x = points(batch)
                leaves.add(np.ones(len(x)), x, (x * x).sum(1))
        yield from leaves.table().to_batches()

    def merge(task: pa.Table) -> pa.Table:
        leaves = Leaves(dims, most)
        sums = np.array(task.column("sums").to_pylist(), float).reshape(-1, dims)
        leaves.add(task.column("n").to_numpy(), sums, task.column("squares").to_numpy())
        return leaves.table(list=task.column("list")[0].as_py())

    parts = cut(rows.mapInArrow(condense, shape).withColumn("list", F.spark_partition_id()))
    while (last := parts.agg(F.max("list")).first()[0]) is not None and last > 0:
        parts = cut(parts.withColumn("list", F.floor(F.col("list") / FAN).cast("int")).groupBy("list").applyInArrow(merge, f"list int, {shape}"))
    found = parts.orderBy("sums").collect()  # LEAVES rows at most
    if not found:
        return spark.createDataFrame([], f"{key} {key_type}, cluster {key_type}")
    n = np.array([r["n"] for r in found])
    means = np.array([r["sums"] for r in found]) / n[:, None]
    of = below(ward_merges(n, means), len(n), threshold)

    def assign(batches):
        for batch in batches:
            x = points(batch)
            d = (x * x).sum(1)[:, None] + (means * means).sum(1) - 2 * x @ means.T
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(of[d.argmin(1)] if len(x) else np.zeros(0, np.int64))], ["key", "of"])

    told = cut(rows.mapInArrow(assign, f"key {key_type}, of bigint"))
    names = told.groupBy("of").agg(F.min("key").alias("cluster"))  # a row a cluster
    return told.join(names, "of").select(F.col("key").alias(key), "cluster")
