"""Iterative solvers on tables: the vectors are columns of one table, and a step is one job.

:func:`conjugate_gradients` solves ``A x = b`` for a sparse, symmetric, positive definite matrix of cells ``(i, j, v)``.  It is
the form of Chronopoulos and Gear ("s-Step Iterative Methods for Symmetric Linear Systems") with a diagonal
preconditioner, in which both dot products of a step are of vectors that the step itself makes.  So one job updates all
vectors, multiplies the matrix with the new residual, writes the new state, and observes both dot products while
it is written; nothing else is read or reduced between steps.

The state ``(i, x, r, u, p, s, w)`` lies in the shared folder, in two tables that take turns, and a log there has the
scalars of each finished step.  A step reads the last table only: a lost executor repeats tasks of the present step, and
:func:`conjugate_gradients` with the same ``state`` folder goes on after the last finished step when the driver is lost.

The matrix is packed once and stays in its tasks (:class:`tessera.operators.sparse.Packed`); a step shuffles the state once, and
numbers for each unknown.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.sparse import Packed, packed
from tessera.session import cut_lineage, shared_dir
from tessera.tensor import ShapeError


@dataclass(frozen=True)
class Solution:
    """``x`` is ``(i, x)``; ``residual`` is the norm of ``b - A x`` over the norm of ``b``."""

    x: DataFrame
    steps: int
    residual: float
    converged: bool


_LOG = "step int, at int, gamma double, delta double, alpha double, beta double, rr double, bb double"


def _log(spark, folder: str) -> list:
    """The finished steps, in order; none if nothing has been written yet."""
    try:
        return sorted(spark.read.schema(_LOG).parquet(f"{folder}/log").collect(), key=lambda r: r["step"])
    except AnalysisException:
        return []


def conjugate_gradients(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 1000, state: str | None = None) -> Solution:
    """Solves ``A x = b`` for cells ``a`` ``(i, j, v)`` and ``b`` ``(i, v)``; unknowns are the ids of ``b``, absent cells 0.

    Stops when the residual's norm is at most ``tolerance`` times that of b, or after ``most`` steps.  Repeated cells add up.  A
    matrix with a diagonal that is not positive everywhere, and a step in a direction in which it is not positive
    definite, are errors.  A right side of zeros has the solution zero.
    """
    spark = a.sparkSession
    folder = state or f"{shared_dir(spark)}/solve-{uuid.uuid4().hex}"
    cells = a.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("a"))
    cells = cut_lineage(cells.groupBy("i", "j").agg(F.sum("a").alias("a")))
    matrix = packed(cells.withColumnRenamed("a", "v"))
    try:
        done = _log(spark, folder)
        if not done:
            done = [_begin(matrix, cells, b, folder)]
        while True:
            last = done[-1]
            if last["rr"] <= tolerance**2 * last["bb"] or last["step"] >= most:
                break
            done.append(_step(spark, matrix, folder, last))
        found = spark.read.parquet(f"{folder}/state-{last['at']}").select("i", "x")
        residual = (last["rr"] / last["bb"]) ** 0.5 if last["bb"] else 0.0
        return Solution(found, last["step"], residual, residual <= tolerance)
    finally:
        matrix.unpersist()


def _multiplied(state: DataFrame, matrix: Packed) -> DataFrame:
    """The state with w = A u."""
    product = matrix.times(state.select(F.col("i").alias("key"), F.array("u").alias("x"))).select(F.col("key").alias("i"), F.col("x")[0].alias("w"))
    return state.drop("w").join(product, "i", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def _written(state: DataFrame, path: str) -> dict:
    """Writes the state, and gives the sums that were observed as it was written."""
    seen = Observation()
    sums = [F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(name) for name, x, y in (("gamma", "r", "u"), ("delta", "w", "u"), ("rr", "r", "r"))]
    state.observe(seen, *sums).write.mode("overwrite").parquet(path)
    return seen.get


def _begin(matrix: Packed, cells: DataFrame, b: DataFrame, folder: str) -> dict:
    """Step 0: x = 0 and r = b."""
    right = b.select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("r"))
    diagonal = cells.filter("i = j").select("i", F.col("a").alias("d"))
    positive = F.when(F.col("d") > 0, F.col("d")).otherwise(F.raise_error(F.lit("the diagonal is not positive")).cast("double"))
    start = right.join(diagonal, "i", "left").withColumn("d", positive)
    start = start.select("i", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("u"), *(F.lit(0.0).alias(c) for c in "psw"))
    found = _written(_multiplied(cut_lineage(start), matrix), f"{folder}/state-0")
    return _logged(cells.sparkSession, folder, {"step": 0, "at": 0, "alpha": 0.0, "beta": 0.0, "bb": found["rr"], **found})


def _step(spark, matrix: Packed, folder: str, last: dict) -> dict:
    beta = last["beta"]
    below = last["delta"] - (beta * last["gamma"] / last["alpha"] if last["step"] else 0.0)
    if not below > 0:
        raise ShapeError("the matrix is not positive definite")
    alpha, at = last["gamma"] / below, 1 - last["at"]
    old = spark.read.parquet(f"{folder}/state-{last['at']}")
    moved = old.withColumns({"p": F.col("u") + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")})
    moved = moved.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("s")}).withColumn("u", F.col("r") / F.col("d"))
    found = _written(_multiplied(moved, matrix), f"{folder}/state-{at}")
    return _logged(spark, folder, {"step": last["step"] + 1, "at": at, "alpha": alpha, "beta": found["gamma"] / last["gamma"], "bb": last["bb"], **found})


def _logged(spark, folder: str, entry: dict) -> dict:
    """The step counts as finished once this row is there."""
    names = [c.split()[0] for c in _LOG.split(", ")]
    spark.createDataFrame([tuple(entry[c] for c in names)], _LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return entry
