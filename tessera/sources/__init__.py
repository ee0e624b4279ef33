"""Tensor tables in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tensor import Tensor


def from_table(df: DataFrame, dims: dict[str, Column | str], value: Column | str, shape: tuple[int, ...]) -> Tensor:
    """A tensor from any table; only the named columns reach the scan."""
    axes = [(F.col(c) if isinstance(c, str) else c).cast("long").alias(d) for d, c in dims.items()]
    return Tensor(df.select(*axes, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")), tuple(dims), shape)


def from_packed(df: DataFrame, key: str, column: str, shape: tuple[int, int]) -> Tensor:
    """A matrix from rows with one array each."""
    return Tensor(df.select(F.col(key).cast("long").alias("i"), F.posexplode(column).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), ("i", "j"), shape)


def read(spark: SparkSession, path: str, dims: tuple[str, ...], shape: tuple[int, ...]) -> Tensor:
    return Tensor(spark.read.parquet(path).select(*dims, "v"), dims, shape)


def write(t: Tensor, path: str, partition_by: str | None = None) -> None:
    writer = t.df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_range(spark: SparkSession, path: str, dims: tuple[str, ...], shape: tuple[int, ...], start: int, stop: int) -> Tensor:
    """A range of the first axis: the filter reaches the Parquet reader."""
    return read(spark, path, dims, shape).slice(dims[0], start, stop)


def overwrite(t: Tensor, part: Tensor) -> Tensor:
    """The tensor with the entries of another put over its own."""
    both = t.df.join(part.df.withColumnRenamed("v", "_new"), list(t.dims), "left")
    return Tensor(both.select(*t.dims, F.coalesce("_new", "v").alias("v")), t.dims, t.shape)
