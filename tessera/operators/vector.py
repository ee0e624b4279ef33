"""Dense vector updates ``(i, v)``: what iterative solvers are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from tessera.functions import ieee_div
from tessera.tensor import ShapeError, Tensor


def _pair(a: Tensor, b: Tensor, fn: Callable[[Column, Column], Column]) -> Tensor:
    if a.shape != b.shape:
        raise ShapeError(f"{a.shape} and {b.shape}")
    return a.zip(b, fn)


def scale(t: Tensor, factor: float) -> Tensor:
    return t.map(lambda v: v * factor)


def axpy(factor: float, source: Tensor, target: Tensor) -> Tensor:
    """factor * source + target"""
    return _pair(source, target, lambda s, t: s * factor + t)


def xpay(factor: float, source: Tensor, target: Tensor) -> Tensor:
    """factor * target + source"""
    return _pair(source, target, lambda s, t: t * factor + s)


def add(a: Tensor, b: Tensor) -> Tensor:
    return _pair(a, b, lambda x, y: x + y)


def subtract(a: Tensor, b: Tensor) -> Tensor:
    return _pair(a, b, lambda x, y: x - y)


def multiply(a: Tensor, b: Tensor) -> Tensor:
    return _pair(a, b, lambda x, y: x * y)


def divide(a: Tensor, b: Tensor) -> Tensor:
    return _pair(a, b, ieee_div)
