"""The stateful stream across restarts, and sweeps in one scan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.plans.recipes import sweep_measures
from quarrylens.streaming.coalesce import coalesce_stateful

EVENTS = "id long, actor string, kind string, at timestamp_ntz, note string"
DAY = dt.datetime(2024, 1, 1)


def log(seed, n, first, start):
    rng, at, out = random.Random(seed), start, []
    for i in range(n):
        at += dt.timedelta(milliseconds=rng.choice([0, 400, 700, 701, 5000]))
        out.append((first + i, rng.choice(["a", "b", None]), rng.choice("xyy"), at, f"note {i}"))
    return out, at


def kept_by_hand(rows, gap):
    out = []
    for actor in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == actor), key=lambda r: (r[3], r[0]))
        out += [e[0] for e, n in zip(mine, [*mine[1:], None], strict=True) if n is None or n[2] != e[2] or n[3] - e[3] > gap]
    return sorted(out)


def test_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    """Two files read in two runs over one checkpoint, rows of each out of order within the lateness; a late row is dropped."""
    first, at = log(1, 300, 0, DAY)
    second, at = log(2, 300, 1000, at + dt.timedelta(milliseconds=300))
    random.Random(3).shuffle(first)
    late = (9999, "a", "x", DAY - dt.timedelta(days=2), "late")
    end = (5000, "z", "x", at + dt.timedelta(days=1), "moves the watermark on")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(EVENTS).parquet(source)
        settled = coalesce_stateful(events, "actor", "kind", "at", "id", 0.7, "30 minutes")
        assert settled.schema == spark.createDataFrame([], EVENTS).schema
        settled.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start().awaitTermination()

    run([*first, (777, "a", "x", None, "no time")])
    early = spark.read.schema(EVENTS).parquet(out).count()
    run([*second, late])
    run([end])
    got = spark.read.schema(EVENTS).parquet(out).collect()
    want = kept_by_hand(first + second, dt.timedelta(milliseconds=700))
    assert sorted(r.id for r in got) == want and early < len(want)
    notes = {r[0]: r for r in first + second}
    assert all(tuple(r) == notes[r.id] for r in got)


def test_sweep_in_one_scan(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("even")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    variants = {f"from {k}": {"least": k} for k in range(0, 9)} | {"bad": {"least": 1, "field": "missing"}, "odd": {"wrong": 1}, "text": {"least": None}}

    def condition(least, field="v"):
        return F.lit("no boolean") if least is None else F.col(field) >= least

    found, failed = sweep_measures(df, variants, condition, [{"fn": "count", "alias": "n"}, {"fn": "sum", "field": "v", "alias": "total"}])
    assert sorted(failed) == ["bad", "odd", "text"]
    got = {r.variant_id: (r.n, r.total) for r in found.collect()}
    values = [float(i % 7) for i in range(1000)]
    assert got == {f"from {k}": (sum(v >= k for v in values), sum(v for v in values if v >= k) if k < 7 else None) for k in range(9)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    by, _ = sweep_measures(df, {"all": {"least": 0}, "none": {"least": 99}}, condition, [{"fn": "count", "alias": "n"}], ["even"])
    assert sorted((r.variant_id, r.even, r.n) for r in by.collect()) == [("all", False, 500), ("all", True, 500)]
    assert sweep_measures(df, {"bad": variants["bad"]}, condition, [{"fn": "count"}])[0] is None
    with pytest.raises(ValueError):
        sweep_measures(df, {"all": {"least": 0}}, condition, [{"fn": "sum"}])
