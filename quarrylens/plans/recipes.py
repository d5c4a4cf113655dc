"""Pipelines of named steps, reusable recipes with typed parameters, and sweeps over parameter sets."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.summarise import measure
from quarrylens.sources.shared import written


@dataclass(frozen=True)
class Step:
    """``run`` takes the frames of ``inputs`` in order."""

    run: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()


class Pipeline:
    """A graph of steps, folded lazily: only what a result needs is built, and Spark plans it as one query."""

    def __init__(self, steps: dict[str, Step], sources: dict[str, DataFrame]):
        self.steps, self.sources = steps, sources

    def result(self, upto: str | None = None) -> DataFrame:
        """The last step's frame, or that of any step with its ancestors only."""
        return self._frame(upto or list(self.steps)[-1], ())

    def _frame(self, name: str, path: tuple[str, ...]) -> DataFrame:
        if name in path:
            raise ValueError(f"step {name!r} needs itself")
        if name in self.sources:
            return self.sources[name]
        if name not in self.steps:
            raise KeyError(f"step {(path or ('?',))[-1]!r} needs {name!r}, which is not loaded")
        step = self.steps[name]
        return step.run(*(self._frame(i, (*path, name)) for i in step.inputs))


@dataclass(frozen=True)
class Blank:
    """A parameter: number, field or choice."""

    kind: str
    default: object = None
    options: tuple = ()

    def check(self, name: str, value):
        value = self.default if value is None else value
        if self.kind == "number" and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value)):
            raise ValueError(f"{name} is no finite number")
        if self.kind == "field" and not (isinstance(value, str) and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", value)):
            raise ValueError(f"{name} is no field name")
        if self.kind == "choice" and value not in self.options:
            raise ValueError(f"{name} is none of its options")
        return value


def recipe(blanks: dict[str, Blank], build: Callable[..., DataFrame]) -> Callable[..., Callable[[DataFrame], DataFrame]]:
    """A function of parameters that gives a transform; values are checked before any plan is built."""

    def with_values(**values):
        if unknown := values.keys() - blanks.keys():
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        checked = {n: b.check(n, values.get(n)) for n, b in blanks.items()}
        return lambda df: build(df, **checked)

    return with_values


def sweep(variants: dict[str, dict], build: Callable[..., DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """The results of one pipeline for many parameter sets under one another with ``variant_id``. Each set is run and
    written by itself; one that fails, in building or in running, is reported and the others go on."""
    out, failed = None, {}
    for name, values in variants.items():
        try:
            part = written(build(**values).withColumn("variant_id", F.lit(name)), "variant")
        except Exception as e:  # noqa: BLE001 - a failing variant is a result
            failed[name] = str(e)
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, failed


def sweep_measures(df: DataFrame, variants: dict[str, dict], condition: Callable[..., Column], measures: list[dict], keys: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Measures {fn, field, alias} of the rows that meet ``condition(**values)``, for every parameter set and combination of the keys,
    with ``variant_id``; all sets in one scan and one grouping.

    Each row is told which sets it belongs to, and tasks sum up by set before anything is shuffled. A set whose condition
    cannot be built or does not fit the table is found by analysis, before anything runs, and reported; the others go
    on. Without keys a set without rows has a row, with 0 for counts; with keys it has none."""
    keys, good, failed = keys or [], {}, {}
    for name, values in variants.items():
        try:
            given = condition(**values)
            if df.select(given.alias("c")).dtypes[0][1] != "boolean":
                raise ValueError("the condition is no boolean")
            good[name] = given
        except Exception as e:  # noqa: BLE001 - a failing variant is a result
            failed[name] = str(e)
    if not good:
        return None, failed
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in good.items()]))
    rows = df.withColumn("variant_id", F.explode(inside))
    aliases = [m.get("alias") or m["fn"] for m in measures]
    found = rows.groupBy("variant_id", *keys).agg(*[measure(df, m["fn"], m.get("field")).alias(a) for m, a in zip(measures, aliases, strict=True)])
    if keys:
        return found, failed
    every = df.sparkSession.createDataFrame([(n,) for n in good], "variant_id string")
    whole = [F.coalesce(a, F.lit(0)).alias(a) if m["fn"] in ("count", "count_distinct") else F.col(a) for m, a in zip(measures, aliases, strict=True)]
    return every.join(F.broadcast(found), "variant_id", "left").select("variant_id", *whole), failed  # a row for each set


def computed(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """SQL expressions added in turn; each may use the ones before it."""
    for name, expression in fields:
        df = df.withColumn(name, F.expr(expression))
    return df


def attribute(df: DataFrame, expression: str, name: str = "new_value") -> DataFrame:
    return df.withColumn(name, F.expr(expression))


def set_value(df: DataFrame, field: str, value, where: Column) -> DataFrame:
    """A scenario: the field gets a value on the rows of a condition."""
    return df.withColumn(field, F.when(where, F.lit(value)).otherwise(F.col(field)))
