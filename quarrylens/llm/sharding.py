"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

A uniform random permutation cut into shards fixes, for every source partition, how many of its rows go
to each shard: a matrix with given row sums (partition sizes) and column sums (shard sizes), distributed
multivariate-hypergeometrically. The matrix is drawn exactly, row by row, and written as a table a few
thousand rows at a time; each partition ranks its rows in random order, deals them by its row of the
matrix, and every shard is permuted again. All row work is DataFrame functions.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate, tee

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import written
from quarrylens.sources.shared import new_path

#: Partitions whose rows of the matrix are drawn, written and kept at once; a matrix of no more is broadcast.
MATRIX_ROWS = 4000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls drawn without replacement are good. Inversion that walks outwards
    from the mode, so sizes of any magnitude work and about a standard deviation of steps is taken."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    log_choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(total, draws))
    u = rng.random()
    if u < p:
        return mode
    u -= p
    up, down, pu, pd = mode, mode, p, p
    while up < high or down > low:
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if u < pu:
                return up
            u -= pu
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if u < pd:
                return down
            u -= pd
    return mode


def matrix_rows(partition_sizes, shard_sizes: list[int], seed: int):
    """Rows of a random matrix with these row and column sums, as a uniform shuffle of all rows gives it, one after another."""
    rng, left = random.Random(seed), list(shard_sizes)
    for size in partition_sizes:
        row, need, rest = [], size, sum(left)
        for room in left:
            rest -= room
            k = hypergeometric(rng, room, rest, need) if need else 0
            row.append(k)
            need -= k
        assert not need
        left = [a - b for a, b in zip(left, row, strict=True)]
        yield row
    assert not any(left)


def communication_matrix(sizes: DataFrame, shard_sizes: list[int], seed: int) -> DataFrame:
    """(__part, upto) for every row (__part, count) of ``sizes``: up to which rank rows go to shards 0, 1, ... of it.

    Sizes come to the driver as an iterator and leave it in blocks of ``MATRIX_ROWS`` as a table in the shared folder."""
    spark, path = sizes.sparkSession, new_path(sizes.sparkSession, "matrix")
    block: list[dict] = []

    def write() -> None:
        table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(block)), MATRIX)))
        table.write.mode("append").parquet(path)
        block.clear()

    ordered = sizes.orderBy("__part")
    parts, counts = tee(ordered.toLocalIterator())
    for r, row in zip(parts, matrix_rows((r["count"] for r in counts), shard_sizes, seed), strict=True):
        block.append({"__part": r["__part"], "upto": list(accumulate(row))})
        if len(block) == MATRIX_ROWS:
            write()
    write()
    return spark.read.parquet(path)


MATRIX = "array<struct<__part:int,upto:array<bigint>>>"


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 20, rows_per_part: int = 100_000, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (gapless from 0 in each
    shard), a uniform random arrangement of all rows.

    A row is told by its partition and its place there, so nulls and repeated rows are rows like others, each
    with a place of its own. The rows are written once with both, and all that follows reads that table: a task
    that runs again deals alike. The same input in the same partitions gives the same arrangement. An empty
    table gives an empty result. Parts of a shard grow in number with the rows. Other columns are kept, whatever
    they are called; ones named like the two new columns are replaced.
    """
    names = df.drop(shard, slot).columns
    df = df.drop(shard, slot).toDF(*[f"c{i}" for i in range(len(names))])  # no name of the input can clash with those below
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.withColumns({"__part": F.spark_partition_id(), "__at": place}), "placed")
    draw = lambda k: F.xxhash64(F.lit(seed * 31 + k), "__part", "__at")
    sizes = written(placed.groupBy("__part").count(), "partition-sizes")
    partitions, total = sizes.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    even = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(sizes, even, seed)
    local = Window.partitionBy("__part").orderBy(draw(2), "__at")
    parts = max(16, -(-total // (rows_per_part * shards)))
    dealt = (
        placed.withColumn("__rank", F.row_number().over(local))
        .join(F.broadcast(matrix) if partitions <= MATRIX_ROWS else matrix, "__part")
        .withColumn("__shard", F.size(F.filter("upto", lambda c: c < F.col("__rank"))).cast("int"))
        .withColumn("__bin", F.pmod(draw(3), F.lit(parts)).cast("int"))
        .drop("__rank", "upto")
    )
    dealt = written(dealt, "dealt")
    before = Window.partitionBy("__shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__shard", "__bin").count().select("__shard", "__bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__shard", "__bin").orderBy(draw(4), "__part", "__at")
    ranked = dealt.withColumn("__slot", F.row_number().over(within))
    out = ranked.join(F.broadcast(starts) if shards * parts <= 1_000_000 else starts, ["__shard", "__bin"])  # shards x parts numbers
    return out.select(*df.columns, "__shard", (F.col("__start") + F.col("__slot") - 1).cast("long")).toDF(*names, shard, slot)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one place of 24 shards. Null texts have no bytes, a very long text is a row like others, and so are
    repeated rows and null ids; an empty table gives no rows; other columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_into_shards(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
