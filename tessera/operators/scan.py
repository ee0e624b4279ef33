"""Inclusive prefix scans along an axis.

Lines of up to ``CHUNK`` positions are windows.  A longer line would be one large window, so lines are scanned in two
levels: chunks of positions by themselves, then the totals of the chunks before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.tensor import Tensor

COMBINE = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}
CHUNK = 1 << 16


def scan(df: DataFrame, lines: list[str], position: str, value: str = "v", op: str = "sum", reverse: bool = False) -> DataFrame:
    """Adds ``scan`` along each line; suffix scans read the line backwards, which keeps the frame growing."""
    order = F.col(position).desc() if reverse else F.col(position)
    window = Window.partitionBy(*lines).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("scan", COMBINE[op](value).over(window))


def scan_axis(t: Tensor, dim: str, op: str = "sum", reverse: bool = False) -> Tensor:
    rest = [d for d in t.dims if d != dim]
    short = rest and t.shape[t.dims.index(dim)] <= CHUNK
    found = scan(t.df, rest, dim, "v", op, reverse) if short else long_lines(t.df, rest, dim, "v", op, reverse)
    return Tensor(found.select(*t.dims, F.col("scan").alias("v")), t.dims, t.shape)


def cumsum(t: Tensor, dim: str) -> Tensor:
    return scan_axis(t, dim, "sum")


def suffix_sum(t: Tensor, dim: str) -> Tensor:
    return scan_axis(t, dim, "sum", reverse=True)


def cumprod(t: Tensor, dim: str) -> Tensor:
    return scan_axis(t, dim, "prod")


def suffix_prod(t: Tensor, dim: str) -> Tensor:
    return scan_axis(t, dim, "prod", reverse=True)


def long_line(df: DataFrame, position: str, value: str = "v", op: str = "sum", reverse: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One line of any length."""
    return long_lines(df, [], position, value, op, reverse, chunk)


def long_lines(df: DataFrame, lines: list[str], position: str, value: str = "v", op: str = "sum", reverse: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Lines of any length: a window per line and chunk of positions, and one over the chunks' totals.

    The totals are one row for ``chunk`` positions.  Beyond a few million chunks in a line they would need a third level.
    """
    join = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": F.least, "max": F.greatest}[op]
    parts = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    totals = parts.groupBy(*lines, "_chunk").agg(COMBINE[op](value).alias("_total"))
    order = F.col("_chunk").desc() if reverse else F.col("_chunk")
    before = Window.partitionBy(*(lines or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*lines, "_chunk", COMBINE[op]("_total").over(before).alias("_before"))
    inside = scan(parts, [*lines, "_chunk"], position, value, op, reverse)
    whole = F.when(F.col("_before").isNull(), F.col("scan")).otherwise(join(F.col("_before"), F.col("scan")))
    return inside.join(carried, [*lines, "_chunk"]).withColumn("scan", whole).drop("_chunk", "_before")


def scan_with(df: DataFrame, lines: list[str], position: str, combine: Callable[[Column, Column], Column], length: int, value: str = "v", chunk: int = 4096) -> DataFrame:
    """Adds ``scan`` along each line with any associative function of two Columns, the earlier one first; positions are
    the whole numbers below ``length``.

    Within a chunk the reach of a value doubles from step to step (Hillis and Steele), so a chunk of 4,096 takes twelve
    windows over one sort; the chunks' last values are scanned the same way, in as many levels as the length needs.
    """
    of = F.floor(F.col(position) / chunk).alias("_chunk")
    out = df.select("*", of, F.col(value).alias("scan"))
    line = Window.partitionBy(*lines, "_chunk").orderBy(position)
    reach = 1
    while reach < min(chunk, length):
        before = F.lag("scan", reach).over(line)
        out = out.withColumn("scan", F.when(before.isNull(), F.col("scan")).otherwise(combine(before, F.col("scan"))))
        reach *= 2
    if length <= chunk:
        return out.drop("_chunk")
    whole_line = Window.partitionBy(*(lines or [F.lit(0)])).orderBy("_chunk")
    last = out.groupBy(*lines, "_chunk").agg(F.max_by("scan", position).alias("v")).withColumn("_at", F.row_number().over(whole_line) - 1)
    ends = scan_with(last.withColumnRenamed("_chunk", "_of"), lines, "_at", combine, -(-length // chunk), "v", chunk)
    carried = ends.select(*lines, F.col("_of").alias("_chunk"), F.lag("scan").over(Window.partitionBy(*(lines or [F.lit(0)])).orderBy("_of")).alias("_carry"))
    whole = F.when(F.col("_carry").isNull(), F.col("scan")).otherwise(combine(F.col("_carry"), F.col("scan")))
    return out.join(carried, [*lines, "_chunk"]).withColumn("scan", whole).drop("_chunk", "_carry")
