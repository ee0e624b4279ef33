"""Seeded random tensors: a counter-based hash of (seed, index), so values do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.tensor import ShapeError, Tensor, ravel


def _unit(at: Column, seed: int, stream: int) -> Column:
    """A double in [0, 1) from the top 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.lit(stream).cast("long"), at.cast("long")), 11).cast("double") * F.lit(2.0**-53)


def uniform_column(at: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ValueError(f"bounds {low}, {high}")
    return F.lit(float(low)) + _unit(at, seed, 0) * F.lit(float(high) - float(low))


def normal_column(at: Column, seed: int, mean: float = 0.0, std: float = 1.0) -> Column:
    """Box-Muller over two streams."""
    if not std >= 0:
        raise ValueError(f"deviation {std}")
    radius = F.sqrt(-2 * F.log(1 - _unit(at, seed, 1)))
    return F.lit(float(mean)) + F.lit(float(std)) * radius * F.cos(2 * math.pi * _unit(at, seed, 2))


def _tensor(spark: SparkSession, shape: tuple[int, ...], value: Column) -> Tensor:
    if any(n < 0 for n in shape):
        raise ShapeError(f"shape {shape}")
    t = Tensor.full(spark, shape)
    return Tensor(t.df.withColumn("v", value), t.dims, t.shape)


def uniform(spark: SparkSession, shape: tuple[int, ...], low: float, high: float, seed: int) -> Tensor:
    dims = tuple("ijkl"[: len(shape)])
    return _tensor(spark, shape, uniform_column(ravel(dims, shape), seed, low, high))


def normal(spark: SparkSession, shape: tuple[int, ...], mean: float, std: float, seed: int) -> Tensor:
    dims = tuple("ijkl"[: len(shape)])
    return _tensor(spark, shape, normal_column(ravel(dims, shape), seed, mean, std))
