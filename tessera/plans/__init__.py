"""Prepared plans: bound once, run often, and several reductions in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.reduce import aggregate


@dataclass
class Prepared:
    """A function of named tables that is checked when it is bound; every run sees the tables' present rows."""

    build: Callable[..., DataFrame]
    paths: dict[str, str]
    schema: str = field(default="", init=False)

    def bind(self, spark: SparkSession) -> Prepared:
        self.schema = self._plan(spark).schema.simpleString()
        return self

    def _plan(self, spark: SparkSession) -> DataFrame:
        return self.build(**{name: spark.read.parquet(path) for name, path in self.paths.items()})

    def run(self, spark: SparkSession) -> DataFrame:
        df = self._plan(spark)
        if self.schema and df.schema.simpleString() != self.schema:
            raise ValueError("the tables no longer have the shape that the plan was bound to")
        return df


def batch(df: DataFrame, reductions: dict[str, tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Many reductions ``name: (op, expression)`` of one table in one scan and at most one shuffle."""
    columns = [aggregate(op, x).alias(name) for name, (op, x) in reductions.items()]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


@dataclass(frozen=True)
class Reduction:
    """One reduction of a mixed batch: what is reduced, and the axes that stay; none of them for a scalar."""

    op: str
    value: Column
    keep: tuple[str, ...] = ()


def mixed(df: DataFrame, reductions: dict[str, Reduction]) -> DataFrame:
    """Scalar and axis reductions of one table together: ``name, <axes>, v``, where axes that do not stay are null.

    One scan and one shuffle whatever the batch: grouping sets deal each row to every set of axes that some reduction
    keeps, tasks add up their own rows, and only these sums are shuffled.  Without axes an empty table gives each scalar's
    identity (a mean: null); with axes it gives no row.  An axis may hold nulls itself.
    """
    sets = list(dict.fromkeys(r.keep for r in reductions.values()))
    axes = list(dict.fromkeys(a for keep in sets for a in keep))
    if not axes:
        whole = df.agg(*(aggregate(r.op, r.value).alias(name) for name, r in reductions.items()))
        return whole.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("v")) for name in reductions))))
    # Bit k of the grouping id, from the left, is set where axis k is reduced.
    ids = {keep: sum((axis not in keep) << (len(axes) - 1 - k) for k, axis in enumerate(axes)) for keep in sets}
    columns = {name: f"_r{n}" for n, name in enumerate(reductions)}
    grouped = df.groupingSets([[F.col(a) for a in keep] for keep in sets], *(F.col(a) for a in axes))
    sums = grouped.agg(F.grouping_id().alias("_set"), *(aggregate(r.op, r.value).cast("double").alias(columns[name]) for name, r in reductions.items()))
    own = [F.when(F.col("_set") == ids[r.keep], F.struct(F.lit(name).alias("name"), F.col(columns[name]).alias("v"))) for name, r in reductions.items()]
    return sums.select(*axes, F.explode(F.array_compact(F.array(*own))).alias("_own")).select("_own.name", *axes, "_own.v")


def tagged(plans: dict[str, DataFrame]) -> DataFrame:
    """Plans of one schema as one job, their order kept in ``plan``."""
    parts = [df.select(F.lit(n).alias("plan"), F.lit(name).alias("name"), *df.columns) for n, (name, df) in enumerate(plans.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An ordered list of transformations as one lazy plan."""
    for step in steps:
        df = df.transform(step)
    return df
