"""Approximate nearest neighbours by query-aware collision counting.

A shard of vectors is indexed by its projections on random directions, each a sorted array. A query opens a window
around its own projection in every array; widening all windows by the search radius stands for hashing anew with
wider buckets (virtual rehashing), and only what enters a window is counted. The projections of a difference of
length r have deviation r, so a vector within the radius lies in at least a known number of the windows with chance
1 - MISS. Vectors that reach the threshold are verified by their
distance. A query ends when its k-th distance is no larger than the radius: then each of the true k was met with
chance 1 - MISS. No number of candidates ends it sooner.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm import vectors
from quarrylens.llm.common import read, written

#: Directions; half a window as a multiple of the radius; chance that a vector within the radius stays below the threshold.
DIRECTIONS, WIDTH, MISS = 96, 1.2, 0.02
#: The radius grows by this factor, from this part of the k-th distance among some vectors of the shard.
GROWTH, START, SAMPLE = 1.2, 0.6, 512


def directions_of(length: int, number: int) -> np.ndarray:
    """The axes of random rotations, one after another, as columns. Axes of one rotation share a difference's length among
    them, which makes the number of collisions vary less than with independent directions."""
    rng = np.random.default_rng(7)
    turned = [np.linalg.qr(rng.standard_normal((length, length)))[0] for _ in range(-(-number // length))]
    return np.hstack(turned)[:, :number] * math.sqrt(length)


@functools.cache
def collision_threshold(length: int, directions: int, width: float, miss: float, trials: int = 20_000) -> int:
    """The most windows that a vector at the radius lies in with chance 1 - ``miss``, from ``trials`` random differences: a
    rotation makes a difference of any direction a random one."""
    rng = np.random.default_rng(11)
    hits = np.zeros(trials, np.int64)
    for at in range(0, directions, length):
        z = rng.standard_normal((trials, length))
        z *= math.sqrt(length) / np.linalg.norm(z, axis=1, keepdims=True)
        hits += (np.abs(z[:, : directions - at]) <= width).sum(axis=1)
    return int(np.quantile(hits, miss, method="lower"))


class Index:
    """The sorted projections of one shard."""

    def __init__(self, x: np.ndarray, directions: np.ndarray):
        self.x, self.directions = x, directions
        projected = np.ascontiguousarray((x @ directions).T)
        order = np.argsort(projected, axis=1)
        self.rows = order
        self.values = np.take_along_axis(projected, order, axis=1)
        self.slack = 1e-9 * (1 + float(np.abs(self.values).max(initial=0)))  # for rounding: equal vectors always collide

    def nearest(self, q: np.ndarray, k: int, threshold: int, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of all verified vectors; among them the k nearest with the chance stated above."""
        n, m = len(self.x), len(self.values)
        at = q @ self.directions
        some = np.sort(_distances(self.x[:: -(-n // SAMPLE)], q))
        radius = START * float(some[min(k, len(some)) - 1])
        left = np.array([np.searchsorted(v, a) for v, a in zip(self.values, at, strict=True)])
        right, count, met = left.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
        places, found = [], []
        while True:
            half = width * radius + self.slack
            entered = []
            for j in range(m):
                low, high = np.searchsorted(self.values[j], (at[j] - half, at[j] + half))
                low, high = min(low, left[j]), max(high, right[j])
                entered += [self.rows[j, low : left[j]], self.rows[j, right[j] : high]]
                left[j], right[j] = low, high
            count += np.bincount(np.concatenate(entered), minlength=n)
            fresh = np.flatnonzero((count >= threshold) & ~met)
            met[fresh] = True
            places.append(fresh)
            found.append(_distances(self.x[fresh], q))
            distances = np.concatenate(found)
            if met.all():
                break
            kth = np.partition(distances, k - 1)[k - 1] if len(distances) >= k else math.inf
            if kth <= radius:
                break
            wider = radius * GROWTH if radius > 0 else self.slack
            radius = min(wider, max(float(kth), radius)) if kth < math.inf else wider
        return np.concatenate(places), distances


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - q).sum(axis=1))


SCHEMA = "query_id long, query_which long, vec_id long, which long, score double"


def _search(k: int, directions: int, width: float, miss: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if rows.num_rows and queries.num_rows:
            ids, which = vectors.longs(rows, "id"), vectors.longs(rows, "which")
            keep = vectors.once(ids, which)
            ids, which = ids[keep], which[keep]
            x = vectors.matrix(rows, "vector")[keep]
            index = Index(x, directions_of(x.shape[1], directions))
            threshold = collision_threshold(x.shape[1], directions, width, miss)
            own_ids, own_which, q = vectors.longs(queries, "id"), vectors.longs(queries, "which"), vectors.matrix(queries, "vector")
            for i in vectors.once(own_ids, own_which):
                places, distances = index.nearest(q[i], k + 1, threshold, width)  # one more: the query may be here itself
                other = (ids[places] != own_ids[i]) | (which[places] != own_which[i])
                places, distances = places[other], distances[other]
                best = np.lexsort((ids[places], distances))[:k]
                for column, values in zip(out, (np.full(len(best), own_ids[i]), np.full(len(best), own_which[i]), ids[places[best]], which[places[best]], distances[best]), strict=True):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table({n: pa.array(c.astype(np.float64 if t == pa.float64() else np.int64), t) for n, c, t in zip(("query_id", "query_which", "vec_id", "which", "score"), columns, kinds, strict=True)})

    return run


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", directions: int = DIRECTIONS, width: float = WIDTH, miss: float = MISS, shard: int = vectors.SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest found among all other rows, by Euclidean distance in
    double precision on the vectors as they are, ties to the smaller id; all others if there are fewer.

    Every row is indexed; rows with a null id, and vectors null, empty, zero or with a null or non-finite component, take
    no part. Vectors are compared with those of their own length. Rows equal in id and vector are one row; rows that only
    share an id are rows of their own. Copies lie at distance 0 in every window and are all verified. An empty table gives
    no rows; other columns are not read. Each shard is searched to its own end, and the k best of each are merged."""
    values = F.col(vector).cast("array<double>")
    good = df.where(F.col(vec_id).isNotNull() & vectors.usable(vector)).where(F.exists(values, lambda x: x != 0))
    good = good.select(F.col(vec_id).cast("long").alias("id"), F.xxhash64(values, F.col(vec_id)).alias("which"), F.col(vector).alias("vector"), F.size(vector).alias("length"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asking = good.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = vectors.grid(df, n, asking, shard)
    columns = ("id", "which", "vector", "length")
    found = vectors.cells(good.select(*columns), good.where("asks").select(*columns), shards, blocks, _search(k, directions, width, miss), SCHEMA, ("length",))
    nearest = Window.partitionBy("query_id", "query_which").orderBy("score", "vec_id", "which")
    return written(found, "found").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every 100th vector. Odd rows as in ``nearest_neighbours``: unusable vectors take no part, ties go to the
    smaller id, repeated rows are one, an empty table gives no rows."""
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
