"""Nearest neighbours by stable projections: kd-trees over a few projected dimensions, verified until a chi-square test holds.

Largest inner products become smallest distances: every vector gets one more component, so that all have the length of the longest, and
a query gets 0 there. Gaussian directions project to ``dims`` dimensions; a true squared distance d times a chi-square variable
with ``dims`` degrees of freedom is the projected one. Projected neighbours are verified in ascending projected distance, a
leaf of the kd-tree at a time, until the next leaf's projected distance r satisfies r > d_k * quantile, where d_k is the k-th best true
squared distance so far and quantile that of the chi-square distribution at ``confidence``: then a nearer one is left
out with a probability of at most 1 - ``confidence``. Both comparisons allow for rounding (``SLACK`` of the longest squared length), so
exact copies of a query (d_k = 0) are met.

The top of the tree is fitted on a sample of at most ``SAMPLE`` vectors (a bounded parameter, and so a bound of the number of cells); every
vector goes to its cell, and cells larger than ``CELL`` are split further by id, so copies of one vector don't fill a task. Each query
gets a first d_k from the sample and is sent only to cells that its test can't rule out. The queries that reach a cell are counted and cut
into chunks of about ``QUERIES``; a cell's vectors are copied once per such chunk, so a cell that no query reaches is not moved. Cells meet
queries in bounded blocks: a task holds at most about ``CELL`` vectors and ``QUERIES`` queries, never all of either side.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another dimension than most take no part; a query is not
its own neighbour (same id); ties go to the smaller id; fewer than k candidates are all returned; an empty table gives
an empty table; ids are whole 64-bit numbers throughout; null ids take no part; other columns are not kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlab.llm.store import stored

SAMPLE, CELL, QUERIES, LEAF = 8192, 16384, 4096, 256
SLACK = 1e-9


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution, by bisection of the regularised incomplete gamma series."""

    def below(x: float) -> float:
        a, half = k / 2, x / 2
        term = total = 1 / a
        for i in range(1, 2000):
            term *= half / (a + i)
            total += term
            if term < total * 1e-14:
                break
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 1e-9, 40.0 * k
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def usable(column: Column) -> Column:
    """A vector with a direction: not null, all components finite, not all 0."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~odd & F.exists(column, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def kd_cells(points: np.ndarray, cells: int) -> list[np.ndarray]:
    """Rows of each of about ``cells`` cells, by median cuts of the widest dimension."""
    out, todo = [], [(np.arange(len(points)), cells)]
    while todo:
        rows, n = todo.pop()
        own = points[rows]
        if n <= 1 or len(rows) < 2 or not (spread := np.ptp(own, axis=0)).any():
            out.append(rows)
            continue
        order = rows[np.argsort(own[:, int(spread.argmax())], kind="stable")]
        half = len(order) // 2
        todo += [(order[:half], n // 2), (order[half:], n - n // 2)]
    return out


class Projection:
    """Lifts vectors to equal length and projects them."""

    def __init__(self, dimension: int, longest: float, dims: int, seed: int):
        self.longest = longest
        self.directions = np.random.default_rng(seed).standard_normal((dimension + 1, dims))

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]

    def squared(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """True squared distances from inner products."""
        return np.maximum(self.longest + (q * q).sum(axis=1).reshape(-1, *[1] * (scores.ndim - 1)) - 2 * scores, 0)


def best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k largest scores with their places (small whole numbers), ties to smaller places, in no order."""
    if scores.shape[1] <= k:
        return scores, places
    least = np.partition(scores, -k, axis=1)[:, -k][:, None]
    rank = np.where(scores > least, -1, np.where(scores == least, places, np.iinfo(np.int64).max))
    take = np.argpartition(rank, k - 1, axis=1)[:, :k]
    return np.take_along_axis(scores, take, 1), np.take_along_axis(places, take, 1)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, d] - q[:, d, None], q[:, d, None] - high[:, d]), 0)
        out += gap * gap
    return out


def search_block(x: np.ndarray, x_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, limit: np.ndarray, p: Projection,
                 quantile: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of a block for each query, verified leaf by leaf (score -inf: none). ``limit``: a known d_k of each query."""
    ascending = np.argsort(x_ids, kind="stable")       # so that a row's place orders like its id
    x, x_ids = x[ascending], x_ids[ascending]
    points, asked = p.points(x), p.queries(q)
    leaves = kd_cells(points, max(1, len(x) // LEAF))
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    away = box_distance(asked, low, high)
    order = np.argsort(away, axis=1, kind="stable")
    scores = np.full((len(q), k), -np.inf)
    places = np.zeros((len(q), k), np.int64)
    reach, slack = limit.copy(), SLACK * p.longest
    for turn in range(len(leaves)):
        leaf = order[:, turn]
        going = np.flatnonzero(away[np.arange(len(q)), leaf] <= reach * quantile + slack)
        if not len(going):
            break
        for at in np.unique(leaf[going]):
            mine = going[leaf[going] == at]
            rows = leaves[at]
            got = q[mine] @ x[rows].T
            got[q_ids[mine, None] == x_ids[rows][None]] = -np.inf
            own = np.broadcast_to(rows.astype(np.int64), got.shape)
            scores[mine], places[mine] = best(np.hstack((scores[mine], got)), np.hstack((places[mine], own)), k)
            kth = scores[mine].min(axis=1)
            reach[mine] = np.minimum(limit[mine], np.where(np.isfinite(kth), p.squared(q[mine], np.where(np.isfinite(kth), kth, 0)), np.inf))
    return scores, x_ids[places]


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", dims: int = 8,
               confidence: float = 0.97, seed: int = 7) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found for each query among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                          is_query.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = stored(rows, "vectors")
    shapes = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy(
        F.desc("n"), "d").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    (dimension, total, longest), = shapes
    rows = rows.filter(F.size("v") == dimension)
    p, quantile = Projection(dimension, longest, dims, seed), chi_square_quantile(confidence, dims)

    # a bounded sample: the smallest hashes of ids
    taken = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample, sample_ids = np.array([r.v for r in taken]), np.array([r.id for r in taken])
    placed = p.points(sample)
    cells = kd_cells(placed, max(1, -(-total // CELL)))
    # cells around the sample's; a vector goes to the nearest centre
    centres = np.array([placed[r].mean(axis=0) for r in cells])

    def cell_of(batches):
        for batch in batches:
            x = _matrix(batch["v"])
            if not len(x):
                continue
            at = p.points(x)
            own = ((at * at).sum(axis=1)[:, None] - 2 * at @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], batch["asks"], pa.array(own.astype(np.int32)), pa.array(list(at), pa.list_(pa.float64()))],
                ["id", "v", "asks", "cell", "at"])

    celled = stored(rows.mapInArrow(cell_of, "id long, v array<double>, asks boolean, cell int, at array<double>"), "vector-cells")
    boxes = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *(F.min(F.col("at")[i]).alias(f"low{i}") for i in range(dims)),
        *(F.max(F.col("at")[i]).alias(f"high{i}") for i in range(dims))).orderBy("cell").collect()      # a row per cell, at most SAMPLE
    cell_ids = np.array([b.cell for b in boxes])
    low, high = (np.array([[b[f"{side}{i}"] for i in range(dims)] for b in boxes]) for side in ("low", "high"))

    def routed(batches):
        for batch in batches:
            q, ids = _matrix(batch["v"]), np.asarray(batch["id"])
            if not len(q):
                continue
            found = q @ sample.T
            found[ids[:, None] == sample_ids[None]] = -np.inf
            limit = np.full(len(q), np.inf)
            if found.shape[1] > k:
                limit = p.squared(q, np.partition(found, -k, axis=1)[:, -k])
            near = box_distance(p.queries(q), low, high) <= (limit * quantile + SLACK * longest)[:, None]
            row, cell = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_ids[cell].astype(np.int32)), batch["id"].take(pa.array(row)), batch["v"].take(pa.array(row)), pa.array(limit[row])],
                ["cell", "id", "v", "limit"])

    asked = stored(celled.filter("asks").select("id", "v").mapInArrow(routed, "cell int, id long, v array<double>, limit double"), "asked")
    # blocks of a cell: parts of its vectors x chunks of the queries that reach it
    sizes = F.broadcast(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts")).join(
        asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks")), "cell"))        # at most SAMPLE rows

    def share(of: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(of) - 1).cast("int")))

    asked = asked.join(sizes, "cell").select("cell", "id", "v", "limit", share("chunks", 1).alias("chunk"), each("parts").alias("part"))
    stock = celled.select("cell", "id", "v").join(sizes, "cell").select("cell", "id", "v", share("parts", 2).alias("part"), each("chunks").alias("chunk"))

    def searched(own: pa.Table, questions: pa.Table) -> pa.Table:
        if not own.num_rows or not questions.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids = np.asarray(questions["id"].combine_chunks())
        scores, ids = search_block(_matrix(own["v"]), np.asarray(own["id"].combine_chunks()), _matrix(questions["v"]), q_ids,
                                   np.asarray(questions["limit"].combine_chunks()), p, quantile, k)
        row, place = np.nonzero(np.isfinite(scores))
        return pa.table({"query_id": q_ids[row], "vec_id": ids[row, place], "score": scores[row, place]})

    by = ["cell", "part", "chunk"]
    found = stock.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(searched, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
