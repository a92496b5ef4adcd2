"""Nearest neighbours by collision counting over single projections.

Every vector is projected on ``projections`` random directions; each projection is a sorted array. A
query opens a window centred on its own value in each array and widens all windows step by step
(virtual rehashing: a wider window stands for a coarser hash, nothing is hashed again). A vector is
counted once for each window it falls into; at ``COLLISIONS`` of the windows it becomes a candidate
and is verified with the original vectors. Widening ends once a share ``VERIFIED`` of the block (at
least ``LEAST`` vectors) are candidates: a high share, as in 64 dimensions of unstructured vectors
the 20 nearest are not much nearer than the rest.

The largest inner product is the nearest vector after each is extended to the largest norm of all, so
the projections see Euclidean distance.

Equal vectors form one class, of which only the ``k + 1`` smallest ids can be in any result (ties go
to smaller ids), so a hot vector costs one class. Classes are dealt to blocks of bounded size by hash;
queries, once per class, are dealt to all blocks in batches and each block returns its best, which one
more ranking merges.

Nulls: vectors that are null, empty, zero, of another length than the most frequent one, or hold null
or non-finite components take no part, as queries or candidates; neither do rows without an id.
Repeated ids are candidates each; a query leaves out its own id. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlane.session import materialise

PROJECTIONS = 96
BLOCK_ROWS = 16384
QUERY_ROWS = 512
COLLISIONS = 0.5
VERIFIED = 0.3
LEAST = 1000
FIRST, WIDER = 0.5, 0.06
SEED = 20
COPIES = 256


def usable(vector: Column) -> Column:
    """The vector as doubles; null where it takes no part."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.when((F.size(v) > 0) & ~bad & some, v)


class Block:
    """Sorted projections of a block of vectors, all extended to norm ``reach``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float, projections: int = PROJECTIONS):
        self.ids, self.vectors, self.reach = ids, vectors, reach
        rest = np.sqrt(np.maximum(reach**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, projections))
        self.axes = axes[:-1]
        values = (vectors @ axes[:-1] + rest[:, None] * axes[-1]).T
        self.order = np.argsort(values, 1, kind="stable")
        self.values = np.take_along_axis(values, self.order, 1)

    def search(self, queries: np.ndarray, k: int, share: float = VERIFIED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and inner products of its ``k`` best candidates, ties to smaller ids."""
        n, m = len(self.ids), len(self.values)
        enough, needed = min(n, max(LEAST, 4 * k, int(share * n))), int(np.ceil(COLLISIONS * m))
        centres = (queries / np.linalg.norm(queries, axis=1)[:, None] * self.reach) @ self.axes
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centres.T, strict=True)], 1)
        high, active = low.copy(), np.arange(len(queries))
        counts = np.zeros((len(queries), n), np.int32)
        radius, verified = FIRST * self.reach, [np.zeros(0, np.int64)] * len(queries)
        while len(active):
            to, end = np.empty((len(active), m), np.int64), np.empty((len(active), m), np.int64)
            for j, v in enumerate(self.values):
                to[:, j] = np.searchsorted(v, centres[active, j] - radius)
                end[:, j] = np.searchsorted(v, centres[active, j] + radius, side="right")
            going = []
            for i, q in enumerate(active):
                rows = zip(self.order, to[i], low[q], high[q], end[i], strict=True)
                met = np.concatenate([x for r, a, b, c, d in rows for x in (r[a:b], r[c:d])])
                counts[q] += np.bincount(met, minlength=n).astype(np.int32)
                found = np.flatnonzero(counts[q] >= needed)
                if len(found) >= enough or ((to[i] == 0).all() and (end[i] == n).all()):
                    verified[q] = found
                else:
                    going.append(q)
            low[active], high[active] = to, end
            active, radius = np.array(going, np.int64), radius + WIDER * self.reach
        for query, found in zip(queries, verified, strict=True):
            products = np.einsum("ij,j->i", self.vectors[found], query)
            best = np.lexsort((self.ids[found], -products))[:k]
            yield self.ids[found][best], products[best]


def smallest_copies(rows: DataFrame, k: int, most: int) -> DataFrame:
    """The ``k`` smallest vec_id of each class ``rep``, of which the largest has ``most`` rows.

    A class is ranked in slices of about ``COPIES`` rows, whose best are ranked again in eighths.
    """
    slices = -(-most // COPIES)
    while True:
        piece = F.pmod(F.xxhash64("vec_id"), F.lit(slices))
        order = Window.partitionBy("rep", piece).orderBy("vec_id")
        rows = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
        if slices == 1:
            return rows
        slices = -(-slices // 8)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, projections: int = PROJECTIONS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found rows of each query.

    ``is_query`` is an expression over vec_id; ``vectors`` has vec_id and embedding.
    """
    rows = vectors.select("vec_id", usable(F.col("embedding")).alias("v")).where("v is not null and vec_id is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm"))
    shape = shapes.orderBy(F.desc("n"), "d").first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, reach = shape.d, float(np.sqrt(shape.norm))
    keyed = rows.where(F.size("v") == size).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.xxhash64("v").alias("h1"),
        F.xxhash64(F.lit(1), "v").alias("h2"),
        is_query.alias("asked"),
        "v",
    )
    grouped = keyed.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.max("asked").alias("asked"), F.first("v").alias("v")
    )
    classes = materialise(grouped, "ann-classes")
    total, asked, most = classes.agg(F.count("*"), F.count_if("asked"), F.max("n")).first()
    found = _class_neighbours(classes, total, asked, k + 1, reach, projections)
    shared = classes.where("n > 1").select("h1", "h2", "rep")
    names = keyed.drop("v").join(shared, ["h1", "h2"], "left").select("vec_id", "asked", F.coalesce("rep", "vec_id").alias("rep"))
    copies = smallest_copies(keyed.join(shared, ["h1", "h2"]).select("rep", "vec_id"), k + 1, most)
    copies = copies.select(F.col("rep").alias("found"), "vec_id")
    spread = found.join(copies, "found", "left").select("rep", "score", F.coalesce("vec_id", "found").alias("vec_id"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    short = spread.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    queries = names.where("asked").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(short, "rep")
        .where("query_id != vec_id")
        .select("query_id", F.row_number().over(final).alias("rank"), "vec_id", "score")
        .where(F.col("rank") <= k)
    )


def _class_neighbours(classes: DataFrame, total: int, asked: int, k: int, reach: float, projections: int) -> DataFrame:
    """rep, found, score: the ``k`` nearest classes of each asked class, itself among them."""
    blocks, batches = -(-total // BLOCK_ROWS), max(1, -(-asked // QUERY_ROWS))

    def dealt(rows: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return rows.select(
            "rep",
            "v",
            F.pmod(F.xxhash64("rep"), F.lit(own_n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))).alias(other),
        )

    def search(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if data.empty or queries.empty:
            return pd.DataFrame({"rep": [], "found": [], "score": []})
        block = Block(data["rep"].to_numpy(), np.stack(data["v"].to_numpy()), reach, projections)
        results = list(block.search(np.stack(queries["v"].to_numpy()), k))
        n = [len(ids) for ids, _ in results]
        return pd.DataFrame(
            {
                "rep": np.repeat(queries["rep"].to_numpy(), n),
                "found": np.concatenate([ids for ids, _ in results]),
                "score": np.concatenate([products for _, products in results]),
            }
        )

    data = dealt(classes, "block", blocks, "batch", batches).groupBy("block", "batch")
    queries = dealt(classes.where("asked"), "batch", batches, "block", blocks).groupBy("block", "batch")
    found = data.cogroup(queries).applyInPandas(search, "rep long, found long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
