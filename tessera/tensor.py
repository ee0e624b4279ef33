"""Relational tensors: a DataFrame with one long column per axis and one value column.

Views cost nothing: they rename, filter or shift index columns and leave the rest to Catalyst.  Entries that are not
there are not zero unless an operator says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SMALL = 1 << 20  # cells of a side that is broadcast, by its shape


class ShapeError(ValueError):
    """Shapes that do not go together."""


@dataclass(frozen=True)
class Tensor:
    """``df`` has the columns ``dims`` and ``v``; ``shape`` has one length per axis."""

    df: DataFrame
    dims: tuple[str, ...]
    shape: tuple[int, ...]

    def __post_init__(self):
        if len(self.dims) != len(self.shape) or len(set(self.dims)) != len(self.dims):
            raise ShapeError(f"axes {self.dims} do not fit the shape {self.shape}")
        if any(n < 0 for n in self.shape):
            raise ShapeError(f"negative length in {self.shape}")

    # -- in and out ----------------------------------------------------------------------------------------------

    @classmethod
    def from_numpy(cls, spark: SparkSession, a: np.ndarray, dims: tuple[str, ...] | None = None) -> Tensor:
        """A small local array; tables of any size come from :mod:`tessera.sources`."""
        a = np.asarray(a, dtype=float)
        dims = dims or tuple("ijkl"[: a.ndim])
        rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(a)]
        return cls(spark.createDataFrame(rows, ", ".join(f"{d} long" for d in dims) + (", " if dims else "") + "v double"), dims, a.shape)

    @classmethod
    def full(cls, spark: SparkSession, shape: tuple[int, ...], value: float = 0.0, dims: tuple[str, ...] | None = None) -> Tensor:
        """A constant tensor, made on the executors from one range."""
        dims = dims or tuple("ijkl"[: len(shape)])
        total = int(np.prod(shape, dtype=object)) if shape else 1
        return cls(spark.range(total).select(*unravel(F.col("id"), dims, shape), F.lit(float(value)).alias("v")), dims, tuple(shape))

    def to_numpy(self, missing: float = 0.0) -> np.ndarray:
        """To the driver: for results that are known to be small."""
        out = np.full(self.shape, missing)
        for row in self.df.collect():
            out[tuple(row[d] for d in self.dims)] = row["v"]
        return out

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def small(self) -> bool:
        """Whether every task may hold all of it.  An axis of length 0 is one whose length was not given: it may be long."""
        return 0 < math.prod(self.shape) <= SMALL

    # -- views ---------------------------------------------------------------------------------------------------

    def _axis(self, dim: str) -> int:
        if dim not in self.dims:
            raise ShapeError(f"no axis {dim} in {self.dims}")
        return self.dims.index(dim)

    def rename(self, **names: str) -> Tensor:
        dims = tuple(names.get(d, d) for d in self.dims)
        return Tensor(self.df.select(*(F.col(a).alias(b) for a, b in zip(self.dims, dims, strict=True)), "v"), dims, self.shape)

    def transpose(self, *dims: str) -> Tensor:
        """Axes in another order: only names move."""
        dims = dims or self.dims[::-1]
        if sorted(dims) != sorted(self.dims):
            raise ShapeError(f"{dims} is no order of {self.dims}")
        return Tensor(self.df.select(*dims, "v"), dims, tuple(self.shape[self._axis(d)] for d in dims))

    def slice(self, dim: str, start: int, stop: int, step: int = 1) -> Tensor:
        n = self.shape[self._axis(dim)]
        if not (0 <= start <= stop <= n and step >= 1):
            raise ShapeError(f"slice {start}:{stop}:{step} of {n}")
        i = F.col(dim)
        df = self.df.filter((i >= start) & (i < stop) & ((i - start) % step == 0)).withColumn(dim, F.floor((i - start) / step).cast("long"))
        shape = tuple(-(-(stop - start) // step) if d == dim else m for d, m in zip(self.dims, self.shape, strict=True))
        return Tensor(df.select(*self.dims, "v"), self.dims, shape)

    def diagonal(self) -> Tensor:
        i, j = self.dims
        return Tensor(self.df.filter(F.col(i) == F.col(j)).select(i, "v"), (i,), (min(self.shape),))

    def reshape(self, shape: tuple[int, ...], dims: tuple[str, ...] | None = None) -> Tensor:
        """Row-major order is kept; the index arithmetic is a projection."""
        if np.prod(shape, dtype=object) != np.prod(self.shape, dtype=object):
            raise ShapeError(f"{self.shape} is not {shape}")
        dims = dims or tuple("ijkl"[: len(shape)])
        return Tensor(self.df.select(*unravel(ravel(self.dims, self.shape), dims, shape), "v"), dims, tuple(shape))

    def expand(self, dim: str, n: int) -> Tensor:
        """A new axis along which everything repeats.  Joins broadcast without it: they leave the axis out of the key."""
        df = self.df.withColumn(dim, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))) if n else self.df.limit(0).withColumn(dim, F.lit(0).cast("long"))
        return Tensor(df.select(dim, *self.dims, "v"), (dim, *self.dims), (n, *self.shape))

    def densify(self, value: float = 0.0) -> Tensor:
        """Every index present, absent ones with the value."""
        grid = Tensor.full(self.df.sparkSession, self.shape, value, self.dims).df.withColumnRenamed("v", "_fill")
        return Tensor(grid.join(self.df, list(self.dims), "left").select(*self.dims, F.coalesce("v", "_fill").alias("v")), self.dims, self.shape)

    # -- elementwise ---------------------------------------------------------------------------------------------

    def map(self, fn) -> Tensor:
        """Any Column function of the value: a projection."""
        return Tensor(self.df.withColumn("v", fn(F.col("v"))), self.dims, self.shape)

    def zip(self, other: Tensor, fn) -> Tensor:
        """Any Column function of two values; axes that one side lacks are broadcast.

        A small side without some axes goes to every task, so that a tall matrix does not meet a row on a few hot keys."""
        shared = [d for d in self.dims if d in other.dims]
        for d in shared:
            if self.shape[self._axis(d)] != other.shape[other._axis(d)]:
                raise ShapeError(f"axis {d}: {self.shape} and {other.shape}")
        if not shared or not ({*other.dims} <= {*self.dims} or {*self.dims} <= {*other.dims}):
            raise ShapeError(f"axes {self.dims} and {other.dims} do not broadcast")
        dims, shape = (self.dims, self.shape) if len(self.dims) >= len(other.dims) else (other.dims, other.shape)
        left, right = self.df.withColumnRenamed("v", "_a"), other.df.withColumnRenamed("v", "_b")
        if len(self.dims) < len(other.dims):
            left = hinted(self, left)
        elif len(other.dims) < len(self.dims):
            right = hinted(other, right)
        joined = left.join(right, shared)
        return Tensor(joined.select(*dims, fn(F.col("_a"), F.col("_b")).alias("v")), dims, shape)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        from tessera.functions import ieee_div

        return self._with(o, ieee_div)

    def __pow__(self, o):
        return self._with(o, F.pow)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return self.map(lambda v: F.lit(float(o)) - v)

    def __rtruediv__(self, o):
        from tessera.functions import ieee_div

        return self.map(lambda v: ieee_div(F.lit(float(o)), v))

    def __rpow__(self, o):
        from tessera.functions import rpow

        return self.map(lambda v: rpow(float(o), v))

    def __neg__(self):
        return self.map(lambda v: -v)

    # -- products, norms and factors, one after the other ----------------------------------------------------------

    def __matmul__(self, other: Tensor) -> Tensor:
        from tessera.operators import linalg

        return linalg.batched_matmul(self, other) if len(self.shape) == 3 else linalg.matmul(self, other)

    matmul = __matmul__

    def kron(self, other: Tensor) -> Tensor:
        from tessera.operators import linalg

        return linalg.kron(self, other)

    def power(self, exponent: int) -> Tensor:
        from tessera.operators import linalg

        return linalg.matpow(self, exponent)

    def reduce(self, *ops: str) -> dict[str, float]:
        """Full reductions, in one job."""
        from tessera.operators import reduce

        return reduce.full(self, *ops).first().asDict()

    def along(self, dim: str, op: str) -> Tensor:
        """A reduction of one axis."""
        from tessera.operators import reduce

        return reduce.axis(self, dim, op)

    def norms(self) -> dict[str, float]:
        """The sum of magnitudes, the Euclidean norm and the largest magnitude, in one job."""
        from tessera.operators import reduce

        found = reduce.norms(self).first()
        return {name: found[f"norm_{name}"] for name in ("l1", "l2", "max")}

    def trace(self) -> float:
        from tessera.operators import reduce

        return reduce.trace(self).first()["trace"]

    def lu(self, width: int | None = None) -> DataFrame:
        """Rows of the factors of one large square matrix, see :func:`tessera.operators.blocked.lu`."""
        from tessera.operators import blocked

        return blocked.lu(blocked.rows_of(self), width)

    def cholesky(self, width: int | None = None) -> DataFrame:
        from tessera.operators import blocked

        return blocked.cholesky(blocked.rows_of(self), width)

    def solve(self, right: Tensor, tolerance: float = 1e-10) -> Tensor:
        """The x of ``A x = b`` for a symmetric, positive definite A, by conjugate gradients."""
        from tessera.operators import solve

        if len(self.shape) != 2 or self.shape[0] != self.shape[1] or right.shape != self.shape[:1]:
            raise ShapeError(f"{self.shape} and {right.shape}")
        found = solve.conjugate_gradients(self.df.toDF("i", "j", "v"), right.df.toDF("i", "v"), tolerance)
        return Tensor(found.x.toDF(right.dims[0], "v"), right.dims, right.shape)

    def _with(self, other, fn) -> Tensor:
        if isinstance(other, Tensor):
            return self.zip(other, fn)
        return self.map(lambda v: fn(v, F.lit(float(other))))


def hinted(t: Tensor, df: DataFrame) -> DataFrame:
    """A frame of a tensor's entries, to be broadcast in the next join if the tensor is small."""
    return F.broadcast(df) if t.small else df


def ravel(dims: tuple[str, ...], shape: tuple[int, ...]) -> Column:
    """The row-major position of an index."""
    at = F.lit(0).cast("long")
    for d, n in zip(dims, shape, strict=True):
        at = at * F.lit(n) + F.col(d)
    return at


def unravel(at: Column, dims: tuple[str, ...], shape: tuple[int, ...]) -> list[Column]:
    """The index columns of a row-major position."""
    out, stride = [], 1
    for d, n in zip(reversed(dims), reversed(shape), strict=True):
        out.append((F.floor(at / F.lit(stride)) % F.lit(max(n, 1))).cast("long").alias(d) if stride > 1 else (at % F.lit(max(n, 1))).cast("long").alias(d))
        stride *= max(n, 1)
    return out[::-1]
