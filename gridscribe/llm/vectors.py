"""Embedding near-duplicates: a pigeonhole join over blocks of rotated vectors, with exact verification."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, cut, in_arrow, join_labels, packed, table, unpacked

COSINE, BLOCKS = 0.95, 4
#: Vectors of a part of a cell; a task compares two parts.
CELL_ROWS = 65_536
#: Numbers of a slab of the matrix product.
SLAB = 1 << 22
#: Slack of squared distances: rounding of the rotation stays far below.
SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation: it spreads every difference evenly over the blocks, whatever axes the data use."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_229 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, blocks: int, cosine: float) -> list[tuple[int, int, float]]:
    """(first, end, squared-distance budget) of each block: budgets are as the block's dimensions and add up to the limit."""
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return [(a, b, (2 - 2 * cosine) * (b - a) / dim + SLACK) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled by a power of two first, so that no square overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=1e-300))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def grid_of(n: int) -> int:
    """Axes of the grid for n vectors: a third of a cell's vectors go with each."""
    return max(2, math.ceil(math.log(max(1, n / CELL_ROWS), 3)))


def cells(reps: DataFrame, blocks: int, cosine: float, grid: int) -> DataFrame:
    """(cell, home, rep, part): each vector's coordinates of a block once at home in its cell, and as a probe in the later ones of the cells next to it.

    The grid is over the block's first `grid` coordinates, with sides of twice the block's radius, so two vectors within the block's
    budget are in the same or in touching cells, and of two touching cells the earlier one's vector probes the later: they meet once.
    """

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            size = np.diff(column.offsets.to_numpy())
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                turned = unit(_matrix(column, at, dim)) @ rotation(dim)
                rows, names, home, parts = [], [], [], []
                for b, (lo, hi, budget) in enumerate(blocks_of(dim, blocks, cosine)):
                    g = min(grid, hi - lo)
                    place = turned[:, lo : lo + g] / (2 * math.sqrt(budget))
                    mine = np.floor(place).astype(np.int64)
                    side = np.where(place - mine >= 0.5, 1, -1)
                    for step in itertools.product((0, 1), repeat=g):
                        other = mine + side * np.array(step)
                        first = np.zeros(len(at), bool)
                        settled = np.zeros(len(at), bool)
                        for k in range(g):  # later in the order of coordinates?
                            first |= ~settled & (other[:, k] > mine[:, k])
                            settled |= other[:, k] != mine[:, k]
                        pick = np.arange(len(at)) if not any(step) else np.flatnonzero(first)
                        rows.append(at[pick])
                        names += [f"{dim}:{b}:" + ",".join(map(str, c)) for c in other[pick].tolist()]
                        home.append(np.full(len(pick), not any(step)))
                        parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1) * (hi - lo), pa.int32()), pa.array(turned[pick, lo:hi].astype(np.float32).ravel())))
                ids = batch.column("rep").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(home)), ids, pa.concat_arrays(parts)], ["cell", "home", "rep", "part"])

    kinds = {f.name: f.dataType.simpleString() for f in reps.schema.fields}
    return in_arrow(reps, run, f"cell string, home boolean, rep {kinds['rep']}, part array<float>")


def _sides(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors whose product is minus half the squared distance."""
    half = (part.astype(np.float64) ** 2).sum(1, keepdims=True).astype(np.float32) / 2
    return np.hstack([part, -half, np.ones_like(half)]), np.hstack([part, np.ones_like(half), -half]).T.copy()


def _close(left: np.ndarray, right: np.ndarray, rows: np.ndarray, budget: float) -> np.ndarray:
    return left[rows] @ right >= np.float32(-budget / 2 - 1e-5)


def with_candidates(cell: str, target: np.ndarray, part: np.ndarray, among: bool, dim: int, blocks: int, cosine: float) -> np.ndarray:
    """Which vectors of a task have another within the block's budget: a target and a row that is none, or two targets if `among`."""
    budget = blocks_of(dim, blocks, cosine)[int(cell.split(":")[1])][2]
    left, right = _sides(part)
    some, mine = np.zeros(len(part), bool), np.flatnonzero(target)
    step = max(16, SLAB // max(1, len(part)))
    for k in range(0, len(mine), step):
        rows = mine[k : k + step]
        near = _close(left, right, rows, budget)
        near[np.arange(len(rows)), rows] = False
        if not among:
            near[:, target] = False
        some[rows] |= near.any(1)
        some |= near.any(0)
    return some


def links_in(cell: str, target: np.ndarray, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, among: bool, blocks: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors x of a task: copies of linked partners of each, and the least id it is linked to here through links.

    Pairs of a target with a row that is none, and of two targets if `among`, are first held to the block's budget, then compared exactly. A
    pair counts in the first block whose budget it meets, and so once.
    """
    dim = x.shape[1]
    block = int(cell.split(":")[1])
    spans = blocks_of(dim, blocks, cosine)
    lo, hi, budget = spans[block]
    u = unit(x)
    turned = u @ rotation(dim)
    left, right = _sides(turned[:, lo:hi].astype(np.float32))
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)  # ranks by id, so that the least label is the least id
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label[:] = np.arange(len(ids))
    count = np.zeros(len(ids), np.int64)
    mine = np.flatnonzero(target)
    step = max(16, SLAB // max(1, len(ids)))
    for k in range(0, len(mine), step):
        rows = mine[k : k + step]
        i, j = np.nonzero(_close(left, right, rows, budget))
        i = rows[i]
        good = ~target[j] | ((i < j) & among)
        i, j = i[good], j[good]
        for c in range(0, len(i), 65_536):
            a, b = i[c : c + 65_536], j[c : c + 65_536]
            apart = (turned[a] - turned[b]) ** 2
            once = apart[:, lo:hi].sum(1) <= budget
            for p, q, most in spans[:block]:
                once &= apart[:, p:q].sum(1) > most
            a, b = a[once], b[once]
            near = (u[a] * u[b]).sum(1) >= cosine
            a, b = a[near], b[near]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            join_labels(label, rank[a], rank[b])
    return count, ids[order][label[rank]]


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vectors with _n_links (other rows at a cosine of `cosine` or more) and _component (least id reachable by links).

    Squared distance 2 - 2 cosine of unit vectors is split over the blocks of the rotated vector in proportion to their dimensions: a
    linked pair must stay within the budget in one block at least. Per block a grid brings the candidates together and a matrix
    product holds them to the budget; what is left of all blocks is compared exactly in double precision.

    1. Only the block's coordinates (single precision, with room for their rounding) and ids are sent to the cells. Tasks return the vectors that have
       a candidate there, never pairs.
    2. These alone are sent whole to the same tasks, which compare them exactly and return counts and a spanning forest.

    Equal vectors are one from the start, with their number: they are never paired. Cells with many vectors are cut into parts of
    65536 and every two parts are a task, so no task holds a whole group. More vectors get a finer grid; this changes the work, not the result.
    A grid of g axes sends a vector's block to about 2 ** (g - 1) cells.

    Vectors that are null, empty, zero, or hold null or non-finite components have no links. Vectors of different lengths have
    none with each other. Rows with the same id are rows of their own in the counts. Null ids: no links. Empty table: no rows. Further
    columns stay; columns named like the results are replaced.
    """
    roles = {id_col: "_id", vector_col: "_vector"}
    columns, vectors = vectors.columns, packed(vectors, roles)
    fine = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("_vector", lambda x: x != 0)
    marked = vectors.withColumn("_ok", F.col("_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    good = marked.where("_ok").select("_id", F.col("_vector").alias("embedding"))
    reps = cut(good.groupBy("embedding").agg(F.min("_id").alias("rep"), F.count("*").alias("copies")))
    n = reps.count()
    grid = grid_of(n)
    placed = cells(reps, blocks, cosine, grid)
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("parts"))
    placed = placed.join(parts, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # task (i, j): home vectors of part i against those of a later part j, or among themselves if j = i, and against the probes of part j
    places = """transform(sequence(0, parts - 1), k -> if(home, struct(mine as i, k as j, true as target), struct(k as i, mine as j, false as target))),
        transform(filter(sequence(0, parts - 1), k -> home and k < mine), k -> struct(k as i, mine as j, false as target))"""
    placed = placed.select("*", F.explode(F.expr(f"concat({places})")).alias("at")).select("cell", "at.i", "at.j", "at.target", "rep", "part")
    id_type = dict(reps.dtypes)["rep"]

    def propose(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cell, column = group.column("cell")[0].as_py(), group.column("part").chunk(0)
        part = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        some = with_candidates(cell, group.column("target").to_numpy(), part, group.column("i")[0] == group.column("j")[0], int(cell.split(":")[0]), blocks, cosine)
        return group.select(["cell", "i", "j", "target", "rep"]).filter(pa.array(some))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column, ids = group.column("embedding").chunk(0), group.column("rep").to_numpy()
        x = _matrix(column, np.arange(len(ids)), len(column[0]))
        count, least = links_in(group.column("cell")[0].as_py(), group.column("target").to_numpy(), x, ids, group.column("copies").to_numpy(), group.column("i")[0] == group.column("j")[0], blocks, cosine)
        some = np.flatnonzero(count)
        return pa.table({"rep": ids[some], "n": count[some], "least": least[some]})

    proposed = placed.groupBy("cell", "i", "j").applyInArrow(propose, f"cell string, i int, j int, target boolean, rep {id_type}")
    whole = proposed.join(reps, "rep").select("cell", "i", "j", "target", "rep", "copies", "embedding")
    found = cut(whole.groupBy("cell", "i", "j").applyInArrow(compare, f"rep {id_type}, n bigint, least {id_type}"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = reps.join(counts, "rep", "left").join(comp, reps["rep"] == comp["id"], "left").select(
        F.col("embedding").alias("_key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("comp", "rep").alias("_comp"))
    # rows without a vector that can link have no key to meet under
    linked = marked.where("_ok").join(known, F.col("_vector") == F.col("_key"), "left").drop("_key")
    rows = linked.unionByName(marked.where("not _ok"), allowMissingColumns=True)
    return unpacked(rows, columns, roles, {"_n_links": F.coalesce("_n", F.lit(0)).cast("long"), "_component": F.coalesce("_comp", "_id")})


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = link_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.col("_n_links").alias("n_links"), F.col("_component").alias("component_id"), (F.col("vec_id") == F.col("_component")).alias("kept"))


#: All pairs with a cosine of 0.95 or more; who reaches whom by them gives the components.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT DISTINCT a AS id, a AS other FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON vec_id = a LEFT JOIN (SELECT id, min(other) AS least FROM reach GROUP BY id) ON vec_id = id"""
