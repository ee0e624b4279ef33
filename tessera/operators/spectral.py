"""Leading singular values and vectors of a sparse matrix, by subspace iteration (Halko, Martinsson and Tropp, "Finding
Structure with Randomness").

A block of vectors is a table of packed rows.  A step multiplies it with the matrix and with its transpose, whose entries are
packed once and stay in their tasks (:mod:`tessera.operators.sparse`), and orthonormalizes both products by a tree of triangles,
which does not lose small vectors beside large ones.  Only triangles as wide as the block reach the driver, where the singular
values of the last one are the estimates; the iteration stops when they stand still.

The vectors of the longer side, rows say, are never written while it runs: a task has whole rows, so the product with the block and its
factor Q are its own affair, and only its triangle leaves it.  Once the triangles are factored, the task makes its part of Q once
more and multiplies it with its part of the transpose.  What a step moves is partial sums of the shorter side.  Tasks read the block
from the shared folder, where two tables take turns.  A block of more than ``BLOCK`` numbers meets the matrix in groups of columns as
well (:class:`tessera.operators.sparse.Packed`), and :func:`tessera.operators.decomp.thin_q` factors both products.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.decomp import thin_q
from tessera.operators.linalg import matmul_rows
from tessera.operators.sparse import GROUPS, PIECE, Group, Packed, packed, whole_rows
from tessera.session import cut_lineage, shared_dir
from tessera.tensor import ShapeError, Tensor

BLOCK = 1 << 23  # numbers of a block that a task reads


@dataclass(frozen=True)
class SingularPairs:
    """Values from the largest down, and the vectors as packed rows ``(i, x)`` and ``(j, x)`` with a number for each value;
    rows and columns without entries are not there and would be 0."""

    values: np.ndarray
    left: DataFrame
    right: DataFrame
    steps: int
    converged: bool


def singular_pairs(cells: DataFrame, k: int, more: int = 8, tolerance: float = 1e-12, most: int = 100, seed: int = 0) -> SingularPairs:
    """The ``k`` largest singular values of cells ``(i, j, v)`` and their vectors, from a block of ``k + more`` vectors.

    Repeated cells add up.  A matrix of a smaller rank or fewer rows has fewer values than k; without cells it has none.
    Vectors are unique up to their sign, and only where values differ.
    """
    if k < 1:
        raise ShapeError(f"{k} singular values")
    spark, folder = cells.sparkSession, f"{shared_dir(cells.sparkSession)}/spectral-{uuid.uuid4().hex}"
    summed = cells.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    summed.filter("v <> 0").write.parquet(f"{folder}/cells")
    whole = spark.read.schema("i long, j long, v double").parquet(f"{folder}/cells")
    seen = whole.agg(F.count("*").alias("n"), F.approx_count_distinct("i").alias("i"), F.approx_count_distinct("j").alias("j")).first()
    if min(seen["i"], seen["j"]) * (k + more) > BLOCK:
        matrix = packed(whole)
        try:
            return _iterated(matrix, whole, k, more, tolerance, most, seed)
        finally:
            matrix.unpersist()
    flipped = seen["i"] < seen["j"]
    if flipped:
        whole = whole.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    matrix = packed(whole, max(1, min(GROUPS // 2, seen["n"] * 16 // PIECE)), whole=True)
    try:
        found = _by_rows(matrix, whole, folder, k, more, tolerance, most, seed)
    finally:
        matrix.unpersist()
    if not flipped:
        return found
    return replace(found, left=found.right.withColumnRenamed("j", "i"), right=found.left.withColumnRenamed("i", "j"))


def _start(whole: DataFrame, width: int, seed: int) -> DataFrame:
    """Random vectors."""

    def spread(t: int):
        return F.pmod(F.xxhash64("key", F.lit(t), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 39)) - 1

    return whole.select(F.col("j").alias("key")).distinct().select("key", F.array(*map(spread, range(width))).alias("x"))


def _settled(values: np.ndarray, before: np.ndarray, tolerance: float) -> bool:
    return len(values) == len(before) and bool((np.abs(values - before) <= tolerance * values[0]).all())


def _write(block: DataFrame, path: str) -> None:
    """Rows ``(key, x)`` as packed parts."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x")
                parts = batch.column("key").to_numpy().tobytes(), x.flatten().to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["keys", "x"])

    block.select(F.col("key").cast("long").alias("key"), "x").mapInArrow(pack, "keys binary, x binary").write.mode("overwrite").parquet(path)


def _read(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and their rows: in a task."""
    from pyarrow import dataset, fs

    store, top = fs.FileSystem.from_uri(path)
    parts = dataset.dataset(top, filesystem=store, format="parquet").to_table(columns=["keys", "x"]).to_pydict()
    keys, x = (np.concatenate([np.frombuffer(b, dtype=t) for b in parts[c]]) for c, t in (("keys", np.int64), ("x", np.float64)))
    order = np.argsort(keys)
    return keys[order], x.reshape(len(keys), -1)[order]


def _by_rows(matrix: Packed, whole: DataFrame, folder: str, k: int, more: int, tolerance: float, most: int, seed: int) -> SingularPairs:
    """Rows are whole in their tasks, and the block is that of the columns."""
    spark, buckets = whole.sparkSession, matrix.rows
    at, before, steps, converged = 0, np.zeros(0), 0, False
    _write(_start(whole, k + more, seed), f"{folder}/block-0")
    while steps < most and not converged:
        path = f"{folder}/block-{at}"

        def products(batches: Iterable[pd.DataFrame], path: str = path) -> Iterator[tuple[Group, np.ndarray]]:
            block = None
            for group in whole_rows(batches):
                keys, x = block = block or _read(path)
                yield group, group.times(x[np.searchsorted(keys, group.columns)])

        def triangles(batches: Iterable[pd.DataFrame], products=products) -> Iterator[pd.DataFrame]:
            for group, y in products(batches):
                yield pd.DataFrame({"g": [group.number], "r": [np.linalg.qr(y, mode="r").tobytes()], "n": [min(y.shape)]})

        seen = matrix.df.mapInPandas(triangles, "g int, r binary, n int").orderBy("g").collect()  # a triangle of each of at most GROUPS groups
        if not seen:
            none = spark.createDataFrame([], "i long, j long, x array<double>")
            return SingularPairs(np.zeros(0), none.select("i", "x"), none.select("j", "x"), 0, True)
        q = np.linalg.qr(np.vstack([np.frombuffer(s["r"], dtype=np.float64).reshape(s["n"], -1) for s in seen]))[0]
        parts = dict(zip([s["g"] for s in seen], np.split(q, np.cumsum([s["n"] for s in seen])[:-1]), strict=True))

        def partial(batches: Iterable[pd.DataFrame], products=products, parts=parts) -> Iterator[pd.DataFrame]:
            for group, y in products(batches):
                z = group.transposed(np.linalg.qr(y)[0] @ parts[group.number])
                own = (group.columns.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
                for b in np.unique(own):
                    yield pd.DataFrame({"b": [int(b)], "keys": [group.columns[own == b].tobytes()], "x": [z[own == b].tobytes()]})

        def added(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
            each = [np.frombuffer(b, dtype=np.int64) for b in sums["keys"]]
            keys, place = np.unique(np.concatenate(each), return_inverse=True)
            z = np.concatenate([np.frombuffer(b, dtype=np.float64).reshape(len(own), -1) for b, own in zip(sums["x"], each, strict=True)])
            return pd.DataFrame({"key": keys, "x": list(np.stack([np.bincount(place, weights=c, minlength=len(keys)) for c in z.T], axis=1))})

        sums = matrix.df.mapInPandas(partial, "b int, keys binary, x binary").groupBy("b").applyInPandas(added, "key long, x array<double>")
        found, r = thin_q(cut_lineage(sums), "key", "x")
        at = 1 - at
        _write(found.withColumnRenamed("q", "x"), f"{folder}/block-{at}")
        values = np.linalg.svd(r, compute_uv=False)[:k]
        converged = _settled(values, before, tolerance)
        before, steps = values, steps + 1
    u, s, wt = np.linalg.svd(r.T)  # A = Q R^T X^T
    there = min(k, int((s > 1e-14 * s[0]).sum()))

    def vectors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, y in products(batches):
            yield pd.DataFrame({"i": group.rows, "x": list(np.linalg.qr(y)[0] @ parts[group.number] @ u[:, :there])})

    def turned(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, x in zip(batch["keys"], batch["x"], strict=True):
                keys = np.frombuffer(keys, dtype=np.int64)
                yield pd.DataFrame({"j": keys, "x": list(np.frombuffer(x, dtype=np.float64).reshape(len(keys), -1) @ wt[:there].T)})

    left = cut_lineage(matrix.df.mapInPandas(vectors, "i long, x array<double>"))
    right = spark.read.schema("keys binary, x binary").parquet(f"{folder}/block-{at}").mapInPandas(turned, "j long, x array<double>")
    return SingularPairs(s[:there], left, right, steps, converged)


def _iterated(matrix: Packed, whole: DataFrame, k: int, more: int, tolerance: float, most: int, seed: int) -> SingularPairs:
    block, q, r = cut_lineage(_start(whole, k + more, seed)), None, np.zeros((0, 0))
    before, steps, converged = np.zeros(0), 0, False
    while steps < most and not converged:
        q, upper = thin_q(cut_lineage(matrix.times(block)), "key", "x")
        if not len(upper):
            return SingularPairs(np.zeros(0), q.select(F.col("key").alias("i"), F.col("q").alias("x")), q.select(F.col("key").alias("j"), F.col("q").alias("x")), 0, True)
        q = cut_lineage(q.withColumnRenamed("q", "x"))
        found, r = thin_q(cut_lineage(matrix.times(q, transposed=True)), "key", "x")
        block = cut_lineage(found.withColumnRenamed("q", "x"))
        values = np.linalg.svd(r, compute_uv=False)[:k]
        converged = _settled(values, before, tolerance)
        before, steps = values, steps + 1
    u, s, wt = np.linalg.svd(r.T)  # A = Q R^T X^T
    there = min(k, int((s > 1e-14 * s[0]).sum()))
    spark = whole.sparkSession
    left = matmul_rows(q.withColumnRenamed("key", "i"), "x", Tensor.from_numpy(spark, u[:, :there]))
    right = matmul_rows(block.withColumnRenamed("key", "j"), "x", Tensor.from_numpy(spark, wt[:there].T))
    return SingularPairs(s[:there], left, right, steps, converged)
