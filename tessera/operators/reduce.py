"""Reductions: partial aggregates per task, then one small shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tensor import ShapeError, Tensor

# The value of an empty reduction: finite extremes, not infinities.
LARGEST = 1.7976931348623157e308
IDENTITY = {"sum": 0.0, "prod": 1.0, "min": LARGEST, "max": -LARGEST}
AGGREGATE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg}


def aggregate(op: str, x: Column) -> Column:
    """The aggregate with its identity instead of NULL for no rows."""
    found = AGGREGATE[op](x)
    return F.coalesce(found, F.lit(IDENTITY[op])) if op in IDENTITY else found


def full(t: Tensor | DataFrame, *ops: str, column: str = "v") -> DataFrame:
    """One row with a column per reduction: several reductions are one scan."""
    df = t.df if isinstance(t, Tensor) else t
    return df.agg(*(aggregate(op, F.col(column)).alias(op) for op in ops))


def axis(t: Tensor, dim: str, op: str) -> Tensor:
    """Reduces one axis; the other axes stay.  min, max and mean of an axis without entries are rejected."""
    n = t.shape[t.dims.index(dim)] if dim in t.dims else None
    if n is None:
        raise ShapeError(f"no axis {dim} in {t.dims}")
    rest = tuple(d for d in t.dims if d != dim)
    shape = tuple(m for d, m in zip(t.dims, t.shape, strict=True) if d != dim)
    if n == 0:
        if op not in ("sum", "prod"):
            raise ShapeError(f"{op} of an empty axis")
        return Tensor.full(t.df.sparkSession, shape, IDENTITY[op], rest)
    return Tensor(t.df.groupBy(*rest).agg(aggregate(op, F.col("v")).alias("v")), rest, shape)


def axis_with(t: Tensor, dim: str, combine: Callable[[Column, Column], Column], initial: float) -> Tensor:
    """Folds one axis with any function of two Columns, in index order along that axis.

    A fold that is not associative has to see its line at once, so a line must fit a task; associative functions take
    :func:`axis_combine`.
    """
    rest = tuple(d for d in t.dims if d != dim)
    shape = tuple(m for d, m in zip(t.dims, t.shape, strict=True) if d != dim)
    return Tensor(_folded(t.df, [*rest], dim, combine, initial), rest, shape)


def axis_combine(t: Tensor, dim: str, combine: Callable[[Column, Column], Column], initial: float, chunk: int = 4096) -> Tensor:
    """Reduces one axis with any associative function of two Columns, the earlier one first; ``initial`` is its identity.

    A line is folded in chunks of positions, and the chunks' values in chunks again, in as many levels as the length
    needs: no more than a chunk of a line ever meets in a task.
    """
    rest = tuple(d for d in t.dims if d != dim)
    shape = tuple(m for d, m in zip(t.dims, t.shape, strict=True) if d != dim)
    df, n = t.df.select(*rest, F.col(dim).alias("_at"), "v"), t.shape[t.dims.index(dim)]
    while n > chunk:
        df = _folded(df.withColumn("_chunk", F.floor(F.col("_at") / chunk)), [*rest, "_chunk"], "_at", combine, initial).withColumnRenamed("_chunk", "_at")
        n = -(-n // chunk)
    return Tensor(_folded(df, [*rest], "_at", combine, initial), rest, shape)


def _folded(df: DataFrame, lines: list[str], position: str, combine: Callable[[Column, Column], Column], initial: float) -> DataFrame:
    line = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col("v").alias("v"))))
    folded = F.aggregate("line", F.lit(float(initial)), lambda acc, x: combine(acc, x["v"]))
    return df.groupBy(*lines).agg(line.alias("line")).select(*lines, folded.alias("v"))


def dot(a: Tensor, b: Tensor) -> DataFrame:
    if a.shape != b.shape:
        raise ShapeError(f"{a.shape} and {b.shape}")
    return a.zip(b, lambda x, y: x * y).df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("dot"))


def trace(m: Tensor) -> DataFrame:
    if m.shape[0] != m.shape[1]:
        raise ShapeError(f"trace of {m.shape}")
    return m.diagonal().df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def norms(t: Tensor) -> DataFrame:
    """L1, L2 (Frobenius) and maximum norm in one scan."""
    v = F.col("v")
    return t.df.agg(
        F.coalesce(F.sum(F.abs(v)), F.lit(0.0)).alias("norm_l1"),
        F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0))).alias("norm_l2"),
        F.coalesce(F.max(F.abs(v)), F.lit(0.0)).alias("norm_max"),
    )
