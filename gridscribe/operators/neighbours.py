"""Nearest neighbours, exactly: with pivots that rule out most of the corpus, and with a scaler of its own for each query."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

#: Pivots are so many vectors of the corpus, those with the smallest hashes; a cell of the corpus is what is nearest to one of them.
PIVOTS = 64
#: Queries and corpus vectors of a task.
BLOCK, PART = 1024, 16_384
#: Queries whose distances to a part are held at once: 32 MB a matrix.
SLICE = 256
#: What rounding to nine digits moves a distance by, at most.
TENTH_DIGIT = 1e-9
#: What rounding may move a distance by, and the share of a variance below which it is not to be had by taking a row's part off.
SLACK, LOST = 1e-6, 1e-6


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean distances order like the metric's. By cosine vectors get length one, and a zero vector a direction of its own, so that it is at distance 1 from others."""
    if metric == "euclidean":
        return x
    size = np.sqrt((x * x).sum(1))
    return np.column_stack([x / np.where(size > 0, size, 1.0)[:, None], size == 0])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Cosine or Euclidean distances to nine digits; by cosine a zero vector is at distance 1 from all."""
    if metric == "euclidean":
        return np.round(apart(q, c), 9)
    unit = lambda x: x / np.where((s := np.sqrt((x * x).sum(1))) > 0, s, 1.0)[:, None]
    return np.round(1 - unit(q) @ unit(c).T, 9)


def best_of(q_ids: np.ndarray, c_ids: np.ndarray, distance: np.ndarray, k: int, exclude_self: bool) -> pa.Table:
    """(q, id, distance): the k nearest of each row of distances by nine digits, ties by id. The distances are overwritten.

    The k-th least is found by k passes for the least; what is not beyond it by more than rounding may move is sorted.
    """
    rows, k = np.arange(len(q_ids)), min(k, len(c_ids))
    if exclude_self:
        order = np.argsort(c_ids, kind="stable")
        lo, hi = (np.searchsorted(c_ids[order], q_ids, side) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            distance[i, order[lo[i] : hi[i]]] = np.nan
    np.copyto(distance, np.inf, where=np.isnan(distance))  # those of no distance and a row's own
    if not k or not len(rows):
        return pa.table({"q": q_ids[:0], "id": c_ids[:0], "distance": np.zeros(0)})
    found, values = np.zeros((k, len(rows)), np.int64), np.zeros((k, len(rows)))
    for n in range(k):
        found[n] = distance.argmin(1)
        values[n] = distance[rows, found[n]]
        distance[rows, found[n]] = np.inf
    for n in range(k):
        distance[rows[np.isfinite(values[n])], found[n][np.isfinite(values[n])]] = values[n][np.isfinite(values[n])]
    limit = np.where(np.isfinite(values[-1]), values[-1] + 2 * TENTH_DIGIT, np.finfo(float).max)
    at, c = np.nonzero(distance <= limit[:, None])
    d = np.round(distance[at, c], 9)
    order = np.lexsort((c_ids[c], d, at))
    at, c, d = at[order], c[order], d[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return pa.table({"q": q_ids[at[first]], "id": c_ids[c[first]], "distance": d[first]})


def best_in_slices(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, exclude_self: bool, distance) -> pa.Table:
    """best_of for all queries, SLICE at a time: distance(lo, hi) are those of the queries lo to hi - 1 to all of c, and no more of them are held at once."""
    some = [best_of(q_ids[lo : lo + SLICE], c_ids, distance(lo, lo + SLICE), k, exclude_self) for lo in range(0, len(q), SLICE)]
    return pa.concat_tables(some) if some else best_of(q_ids, c_ids, np.zeros((0, len(c_ids))), k, exclude_self)


def nearest_in_task(task: pa.Table, k: int, metric: str, exclude_self: bool) -> pa.Table:
    """The k nearest of the task's queries (id, v, is_query) among its other rows."""
    ids, mine = task.column("id").to_numpy(), task.column("is_query").to_numpy()
    x = matrix(task.column("v"))
    q, c = x[mine], x[~mine]
    return best_in_slices(ids[mine], q, ids[~mine], c, k, exclude_self, lambda lo, hi: distances(q[lo:hi], c, metric))


def _ranked(local: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")).cast("long")
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "distance")


class Cells:
    """The corpus by pivots: how many vectors each cell has, and the least and largest distance of them from each pivot."""

    def __init__(self, pivots: np.ndarray, metric: str, rows: list):
        self.pivots, self.metric = pivots, metric
        p = len(pivots)
        self.n = np.zeros(p, np.int64)
        self.low, self.high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
        for cell, pivot, n, low, high in rows:
            self.n[cell] = n
            self.low[cell, pivot], self.high[cell, pivot] = low, high

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each point and cell a distance that no vector of the cell comes below: by the triangle inequality, of all pivots the best."""
        d = apart(placed(x, self.metric), self.pivots)
        out = np.zeros((len(x), len(self.n)))
        for cell in np.flatnonzero(self.n):
            out[:, cell] = np.maximum(d - self.high[cell], self.low[cell] - d).max(1, initial=0)
        out[:, self.n == 0] = np.inf
        return np.maximum(out, 0)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query visits first: those with the least bounds that hold more than k vectors together."""
        order = np.argsort(bounds, 1, kind="stable")
        before = np.cumsum(self.n[order], 1) - self.n[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, (before <= k) & np.isfinite(np.take_along_axis(bounds, order, 1)), 1)
        return out

    def limit(self, distance: np.ndarray) -> np.ndarray:
        """The bound up to which a cell may hold something as near as the distance; infinite for none."""
        d = np.where(np.isnan(distance), np.inf, distance)
        reach = d if self.metric == "euclidean" else np.sqrt(2 * np.maximum(d + 1e-9, 0))
        return reach + SLACK * (1 + np.where(np.isfinite(reach), reach, 0))


def _cells(corpus: DataFrame, pivots: int, metric: str) -> tuple[Cells | None, DataFrame]:
    """Cells, and the corpus with the cell of each vector."""
    sample = [r["v"] for r in corpus.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    if not sample:
        return None, corpus
    points = np.unique(placed(np.array(sample, float), metric), axis=0)

    def assign(batches):
        for batch in batches:
            d = apart(placed(matrix(batch.column("v")), metric), points) if len(batch) else np.zeros((0, len(points)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1), pa.int32())], [*batch.schema.names, "cell"])

    def measure(batches):
        n, low, high = np.zeros(len(points), np.int64), np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)
        for batch in batches:
            if not len(batch):
                continue
            d, at = apart(placed(matrix(batch.column("v")), metric), points), batch.column("cell").to_numpy()
            for cell in np.unique(at):
                mine = d[at == cell]
                n[cell] += len(mine)
                low[cell], high[cell] = np.minimum(low[cell], mine.min(0)), np.maximum(high[cell], mine.max(0))
        some, every = np.flatnonzero(n), np.arange(len(points))
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(np.repeat(some, len(every)), pa.int32()), "pivot": pa.array(np.tile(every, len(some)), pa.int32()), "n": np.repeat(n[some], len(every)),
            "low": low[some].ravel(), "high": high[some].ravel()})

    id_type = dict(corpus.dtypes)["id"]
    # the last digits of a distance hang on the batch that it is computed in: a vector's cell is found once
    corpus = cut(corpus.mapInArrow(assign, f"id {id_type}, v array<double>, cell int"))
    measured = corpus.mapInArrow(measure, "cell int, pivot int, n bigint, low double, high double")
    rows = measured.groupBy("cell", "pivot").agg(F.sum("n"), F.min("low"), F.max("high")).collect()
    return Cells(points, metric, [tuple(r) for r in rows]), corpus


def _compared(visits: DataFrame, corpus: DataFrame, cells: Cells, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """The k best of each query in the cells that it visits (id, v, cell), and how many queries visit each cell."""
    metric = cells.metric
    id_type = dict(corpus.dtypes)["id"]
    asked = cut(visits.groupBy("cell").agg(F.count("*").alias("asked")))
    parts = F.element_at(F.array(*[F.lit(max(1, math.ceil(int(n) / PART))) for n in cells.n]), F.col("cell") + 1)
    blocks = F.ceil(F.col("asked") / BLOCK)
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    small = F.broadcast(asked)  # a row a pivot
    q = visits.join(small, "cell").select("id", "v", F.lit(True).alias("is_query"), "cell", deal(blocks).alias("b"), every(parts).alias("p"))
    c = corpus.join(small, "cell").select("id", "v", F.lit(False).alias("is_query"), "cell", every(blocks).alias("b"), deal(parts).alias("p"))

    def best(task: pa.Table) -> pa.Table:
        return nearest_in_task(task, k, metric, exclude_self)

    return q.unionByName(c.select(*q.columns)).groupBy("cell", "b", "p").applyInArrow(best, f"q {id_type}, id {id_type}, distance double"), asked


def nearest_by_pivots(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(q, id, rank, distance) of the k nearest of (id, v), exactly, ties by id; and one row (compared, pairs) of how many pairs were compared and how many there are.

    Pivots cut the corpus into cells; of each the size and the distances to all pivots are known. A query first visits the cells with the least bounds that hold more than k vectors.
    Its k-th best distance so far rules out all cells whose bound is above it; it visits the others in a second round. What comes out is what all pairs would give: cells left out hold
    nothing as near.

    A cell is dealt in parts of PART vectors and its queries in blocks of BLOCK, so a cell of a third of the corpus, or one that all queries visit, is many tasks. Pivots and
    their bounds (PIVOTS squared numbers) are the only rows that reach the driver. Null vectors and ids are left out; repeated ids count as one vector each; fewer than k vectors give fewer rows.
    """
    tidy = lambda df: df.select("id", F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    queries, corpus = tidy(queries), tidy(corpus)
    id_type = dict(corpus.dtypes)["id"]
    spark = corpus.sparkSession
    cells, corpus = _cells(corpus, pivots, metric)
    shape = f"q {id_type}, rank bigint, id {id_type}, distance double"
    if cells is None:
        return spark.createDataFrame([], shape), spark.createDataFrame([(0, 0)], "compared bigint, pairs bigint")

    def begin(batches):
        for batch in batches:
            go = cells.first(cells.bounds(matrix(batch.column("v"))), k) if len(batch) else np.zeros((0, len(cells.n)), bool)
            ends = pa.array(np.append(0, go.sum(1).cumsum()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(np.nonzero(go)[1], pa.int32()))], [*batch.schema.names, "seen"])

    def go_on(batches):
        for batch in batches:
            if not len(batch):
                continue
            seen = batch.column("seen")
            go = cells.bounds(matrix(batch.column("v"))) <= cells.limit(batch.column("kth").to_numpy(zero_copy_only=False))[:, None]
            go[np.repeat(np.arange(len(batch)), seen.value_lengths().to_numpy()), seen.flatten().to_numpy()] = False
            who, cell = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(who)), batch.column("v").take(pa.array(who)), pa.array(cell, pa.int32())], ["id", "v", "cell"])

    # which cells a query visits first is written down: computed anew in batches of other sizes, bounds that are all but equal may come in another order, and a cell be left out or visited twice
    queries = cut(queries.mapInArrow(begin, f"id {id_type}, v array<double>, seen array<int>"))
    first, asked_first = _compared(queries.select("id", "v", F.explode("seen").alias("cell")), corpus, cells, k, exclude_self)
    first = cut(first)
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("r") == k).select(F.col("q").alias("id"), F.col("distance").alias("kth"))
    known = queries.join(kth, "id", "left").select("id", "v", "seen", F.coalesce("kth", F.lit(float("nan"))).alias("kth"))
    second, asked_later = _compared(known.mapInArrow(go_on, f"id {id_type}, v array<double>, cell int"), corpus, cells, k, exclude_self)
    sizes = F.element_at(F.array(*[F.lit(int(n)) for n in cells.n]), F.col("cell") + 1).cast("long")
    work = asked_first.unionAll(asked_later).agg(F.coalesce(F.sum(F.col("asked") * sizes), F.lit(0)).alias("compared"))
    work = work.join(F.broadcast(queries.agg((F.count("*") * int(cells.n.sum())).alias("pairs"))))
    return _ranked(first.unionByName(second), k), work


def nearest_left_out(rows: DataFrame, k: int, names: list[str]) -> DataFrame:
    """(q, rank, id, distance): for each row (id and the features) its k nearest by cosine among the others, where features are scaled by the means and deviations of these others.

    As if the scaler were fitted anew without the row. Features are first centred and scaled by all rows; leaving row i out moves a mean m to -x / (n - 1) and a variance to
    (n - x * x) / (n - 1) - m * m. With weights w = 1 / variance, (x_j - m) w (x_i - m) and the squares of the lengths are sums over features of x_j and x_j squared times numbers of row i
    alone: a block of queries is two matrix products with a part of the corpus, whatever scaler each query has. A feature that is the same in all other rows is only centred, which is told exactly, by
    the least and largest values and those next to them. At a length of 0 the distance is 1.

    Rows of equal features have equal scalers and distances, so they are one class, which is compared once; a query's own class stands for its copies. Every class is a query, so pairs of
    classes are compared in blocks of BLOCK x PART, of which a task holds SLICE x PART at once; a part is sent once for each block of queries. The k + 1 nearest classes with
    their k + 1 smallest ids hold the k nearest rows besides the query. Ids are unique; null features count as 0.
    """
    rows = rows.select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    rows = cut(rows)
    id_type = dict(rows.dtypes)["id"]
    ends = rows.agg(F.count("*").alias("n"), *[x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()
    n = ends["n"]
    if n < 2:
        return rows.sparkSession.createDataFrame([], f"q {id_type}, rank bigint, id {id_type}, distance double")
    inner = rows.agg(*[x for c in names for x in (
        F.count_if(F.col(c) == ends[f"a_{c}"]).alias(f"na_{c}"), F.count_if(F.col(c) == ends[f"b_{c}"]).alias(f"nb_{c}"),
        *[f(F.when(F.col(c) > ends[f"a_{c}"], F.col(c))).alias(f"{k}_{c}") for f, k in ((F.min, "a"), (F.avg, "ma"), (F.stddev_pop, "sa"))],
        *[f(F.when(F.col(c) < ends[f"b_{c}"], F.col(c))).alias(f"{k}_{c}") for f, k in ((F.max, "b"), (F.avg, "mb"), (F.stddev_pop, "sb"))])]).first()
    of = lambda row, k: np.array([row[f"{k}_{c}"] if row[f"{k}_{c}"] is not None else np.nan for c in names], float)
    mean, dev, low, high = (of(ends, k) for k in ("m", "s", "a", "b"))
    n_low, n_high, next_low, next_high, mean_up, dev_up, mean_down, dev_down = (of(inner, k) for k in ("na", "nb", "a", "b", "ma", "sa", "mb", "sb"))
    dev = np.where((low < high) & (dev > 0), dev, 1.0)

    def best(task: pa.Table) -> pa.Table:
        ids, mine = task.column("id").to_numpy(), task.column("is_query").to_numpy()
        raw = matrix(task.column("v"))
        x = (raw - mean) / dev
        q, c, r, rest = x[mine], x[~mine], raw[mine], raw[~mine]
        m = -q / (n - 1)
        # sums of squares are n for a feature that varies and 0 for one that does not
        var = (np.where(low < high, n, 0) - q * q) / (n - 1) - m * m
        lowest, highest = (r == low) & (n_low == 1), (r == high) & (n_high == 1)
        least, most = np.where(lowest, next_low, low), np.where(highest, next_high, high)
        same = ~(least < most)  # a feature without another value than the row's is the same in the others
        w = np.where(same, dev * dev, 1 / np.where(same | (var <= 0), 1.0, var))
        at = q - m
        wm = w * m
        both, own = np.hstack([c * c, c]).T, np.sqrt((w * at * at).sum(1))
        scaled, shift = np.hstack([w, -2 * wm]), (wm * m).sum(1)
        lost = (~same & (var < LOST)).any(1)

        def distance(lo: int, hi: int) -> np.ndarray:
            out = (w[lo:hi] * at[lo:hi]) @ c.T
            out -= (at[lo:hi] * wm[lo:hi]).sum(1)[:, None]
            length = scaled[lo:hi] @ both
            length += shift[lo:hi, None]
            np.sqrt(np.maximum(length, 0, out=length), out=length)
            length *= own[lo:hi, None]
            short = length <= 1e-12
            length[short] = 1.0
            out /= length
            np.subtract(1, out, out=out)
            out[short] = 1.0
            # a row that holds nearly all of a feature's variance is its least or largest; what is left is known exactly, and too small for the products above
            for i in np.flatnonzero(lost[lo:hi]) + lo:
                centre = np.where(lowest[i], mean_up, np.where(highest[i], mean_down, mean + dev * m[i]))
                spread = np.where(same[i], 1.0, np.where(lowest[i], dev_up, np.where(highest[i], dev_down, dev * np.sqrt(np.maximum(var[i], 0)))))
                out[i - lo] = distances(((r[i] - centre) / spread)[None], (rest - centre) / spread, "cosine")[0]
            return out

        return best_in_slices(ids[mine], q, ids[~mine], c, k + 1, False, distance)

    # the k + 1 smallest ids of each class; the first of them is its name
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).where(F.col("r") <= k + 1)
    classes = cut(least.groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.get("ids", F.lit(0))))
    count = classes.count()
    blocks, parts = math.ceil(count / BLOCK), math.ceil(count / PART)
    v = F.array(*[F.col(c) for c in names]).alias("v")
    deal = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asks = classes.select("id", v, F.lit(True).alias("is_query"), deal(blocks, 1).alias("b"), every(parts).alias("p"))
    answers = classes.select("id", v, F.lit(False).alias("is_query"), every(blocks).alias("b"), deal(parts, 2).alias("p"))
    near = _ranked(asks.unionByName(answers).groupBy("b", "p").applyInArrow(best, f"q {id_type}, id {id_type}, distance double"), k + 1)
    near = near.join(classes.select("id", "ids"), "id").select(F.col("q").alias("class"), "distance", F.explode("ids").alias("id"))
    of = rows.join(classes.select(F.col("id").alias("class"), *names), names).select(F.col("id").alias("q"), "class")
    return _ranked(of.join(near, "class").where("q <> id").select("q", "id", "distance"), k)
