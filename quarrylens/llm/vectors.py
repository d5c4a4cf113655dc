"""Vectors in shards that meet queries in blocks: the frame of the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import tasks_for

#: Vectors of one shard, and the fewest and most queries of one block. A cell of the grid is one shard and one block.
SHARD, FEWEST, MOST = 32_768, 64, 4096


def usable(vector: str) -> Column:
    """Not null, not empty, all components there and finite."""
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    values = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(vector) > 0) & F.forall(values, finite), F.lit(False))


def grid(df: DataFrame, rows: int, queries: int, shard: int = SHARD) -> tuple[int, int]:
    """(shards, blocks): shards of some ``shard`` rows, and so many blocks of queries that all tasks have a cell."""
    shards = max(1, -(-rows // shard))
    blocks = max(-(-queries // MOST), min(-(-tasks_for(df.sparkSession) // shards), -(-queries // FEWEST)))
    return shards, max(1, blocks)


def cells(rows: DataFrame, queries: DataFrame, shards: int | Column, blocks: int, run, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``run(rows, queries)`` on the Arrow tables of every cell. Rows stand in the shard of their number ``which``, once for
    each block; queries in the block of theirs, once for each shard; ``keys`` split both further. So a task holds one
    bounded shard and one bounded block, whatever ids, labels or vectors recur. ``shards`` may be a column of both tables
    that depends on the keys."""
    shards = shards if isinstance(shards, Column) else F.lit(shards)
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "which"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.withColumn("shard", place(1, shards)).withColumn("block", every(F.lit(blocks)))
    right = queries.withColumn("block", place(2, F.lit(blocks))).withColumn("shard", every(shards))
    on = [*keys, "shard", "block"]
    right = right.toDF(*right.columns)  # columns of its own, as both may come from one table
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """The lists of a column, all of one length, as rows of doubles."""
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1).astype(np.float64))


def longs(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def once(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each different row, in the order of the columns."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order[new]
