"""Event logs: coalescing of repeats and the events that touch an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_events(df: DataFrame, actor: str, key: str, ts: str, row_id: str, gap_seconds: float, span_seconds: int = 86_400) -> DataFrame:
    """An event whose key is that of the actor's event just before, at most the gap later, replaces it; chains keep their last.

    Windows are by actor and span of time, at least the gap wide: what can follow an event within the gap is in its
    span or is the first event of the next one, which comes along. The log of a busy actor is thus many tasks.
    Events without a time replace none and stay.
    """
    gap = int(gap_seconds * 1_000_000)
    width = max(gap, span_seconds * 1_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    start = micros - F.pmod(micros, F.lit(width))
    first = F.min(F.struct(micros.alias("at"), F.col(row_id).alias("id"), F.col(ts).alias("ts"), F.col(key).alias("key"))).alias("__first")
    ahead = df.where(micros.isNotNull()).groupBy(actor, start.alias("__span")).agg(first)
    ahead = ahead.select(actor, (F.col("__span") - width).alias("__span"), F.lit(True).alias("__ahead"), F.col("__first.id").alias(row_id), F.col("__first.ts").alias(ts), F.col("__first.key").alias(key))
    rows = df.withColumns({"__span": F.coalesce(start, F.xxhash64(row_id)), "__ahead": F.lit(False)}).unionByName(ahead, allowMissingColumns=True)
    order = Window.partitionBy(actor, "__span").orderBy(micros, row_id)
    joined = (F.lead(key).over(order) == F.col(key)) & (F.lead(micros).over(order) - micros <= gap)
    out = rows.withColumn("__replaced", F.coalesce(joined, F.lit(False)))
    return out.where(~F.col("__replaced") & ~F.col("__ahead")).drop("__replaced", "__ahead", "__span")


def touching(df: DataFrame, entity: str, subject: str, used: str | None = None) -> DataFrame:
    """Events with the entity as subject or in the array column ``used``."""
    hit = F.col(subject).cast("string") == entity
    return df.where(hit | F.array_contains(used, entity)) if used else df.where(hit)
