"""Sparse matrices: ``(i, j, v)`` without zeros, and a shape."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage
from tessera.tensor import SMALL, ShapeError, Tensor


def from_csr(spark: SparkSession, values: list[float], columns: list[int], row_ptr: list[int], shape: tuple[int, int]) -> Tensor:
    """A small local matrix in compressed rows; the structure is validated first."""
    if len(row_ptr) != shape[0] + 1 or row_ptr[0] != 0 or row_ptr[-1] != len(values) or len(columns) != len(values):
        raise ShapeError("row pointers, columns and values do not fit")
    if any(a > b for a, b in zip(row_ptr, row_ptr[1:], strict=False)):
        raise ShapeError("row pointers fall")
    rows = [(i, columns[k], float(values[k])) for i in range(shape[0]) for k in range(row_ptr[i], row_ptr[i + 1])]
    if any(not 0 <= j < shape[1] for _, j, _ in rows) or any(a[0] == b[0] and a[1] >= b[1] for a, b in zip(rows, rows[1:], strict=False)):
        raise ShapeError("columns must rise within each row and lie in the matrix")
    return Tensor(spark.createDataFrame(rows, "i long, j long, v double"), ("i", "j"), shape)


def violations(t: Tensor) -> DataFrame:
    """One row: entries out of bounds, repeated positions, stored zeros.  All must be 0 in a valid matrix."""
    i, j = (F.col(d) for d in t.dims)
    inside = (i >= 0) & (i < t.shape[0]) & (j >= 0) & (j < t.shape[1])
    per = t.df.groupBy(*t.dims).agg(F.count("*").alias("n"), F.sum((F.col("v") == 0).cast("long")).alias("zeros"))
    return per.agg(
        F.coalesce(F.sum(F.when(~inside, F.col("n")).otherwise(0)), F.lit(0)).cast("long").alias("out_of_bounds"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated"),
        F.coalesce(F.sum("zeros"), F.lit(0)).cast("long").alias("zeros"),
    )


def validate(t: Tensor) -> Tensor:
    found = violations(t).first()
    if any(found):
        raise ShapeError(f"not a sparse matrix: {found.asDict()}")
    return t


def from_dense(t: Tensor) -> Tensor:
    return Tensor(t.df.filter("v <> 0"), t.dims, t.shape)


def to_dense(t: Tensor) -> Tensor:
    return t.densify(0.0)


def nnz(t: Tensor) -> int:
    return t.df.count()


def to_csr(t: Tensor) -> DataFrame:
    """Packed rows ``(i, cols, vals)`` of the rows that have entries."""
    i, j = t.dims
    entry = F.array_sort(F.collect_list(F.struct(F.col(j).alias("j"), F.col("v").alias("v"))))
    return t.df.groupBy(F.col(i).alias("i")).agg(entry.alias("e")).select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))


HEAVY = 1 << 18  # entries of one column that meet in a task


def _met(left: DataFrame, right: Tensor, names: tuple[str, ...]) -> DataFrame:
    """Entries ``(i, _k, _a)`` with those of the dense side on ``_k``."""
    return joined(left, right.df.toDF("_k", *names, "_b"), right.small)


def joined(left: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    """Entries ``(i, _k, _a)`` with rows of a dense side that have their ``_k``.

    A small dense side goes to every task.  Otherwise a column of very many entries would meet in one task: such columns
    are dealt out over as many salts as they have times ``HEAVY`` entries, and their part of the dense side is repeated once
    for each salt.  All columns that are not heavy have one salt, so both kinds are one join.
    """
    if small:
        return left.join(F.broadcast(cells), "_k")
    sizes = left.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > HEAVY).select("_k", F.ceil(F.col("_n") / HEAVY).cast("int").alias("_salts"))
    # At most one heavy column for every HEAVY entries.  Few of them are broadcast, or else joined on keys that occur once.
    sizes = cut_lineage(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(sizes, "_k", "left").withColumn("_salt", F.pmod(F.xxhash64("i"), salts).cast("int")).drop("_salts")
    repeated = cells.join(sizes, "_k", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, ["_k", "_salt"])


def spmm(a: Tensor, b: Tensor, dense: bool = True) -> Tensor:
    """Sparse times dense ``[k, n]``.  Rows of a without entries give 0 in a dense result."""
    if a.shape[1] != b.shape[0]:
        raise ShapeError(f"{a.shape} x {b.shape}")
    met = _met(a.df.toDF("i", "_k", "_a"), b, ("j",))
    out = Tensor(met.groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v")), ("i", "j"), (a.shape[0], b.shape[1]))
    return out.densify() if dense else out


def spmv(a: Tensor, x: Tensor, dense: bool = True) -> Tensor:
    """Sparse times a vector."""
    if a.shape[1] != x.shape[0]:
        raise ShapeError(f"{a.shape} x {x.shape}")
    out = Tensor(_met(a.df.toDF("i", "_k", "_a"), x, ()).groupBy("i").agg(F.sum(F.col("_a") * F.col("_b")).alias("v")), ("i",), (a.shape[0],))
    return out.densify() if dense else out


def spmv_many(a: Tensor, xs: list[Tensor]) -> list[Tensor]:
    """Several vectors in one join and one aggregate: the vectors are the columns of a matrix."""
    tagged = [x.df.toDF("k", "v").select("k", F.lit(n).cast("long").alias("j"), "v") for n, x in enumerate(xs)]
    if not tagged:
        return []
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    out = spmm(a, Tensor(whole.select("k", "j", "v"), ("k", "j"), (a.shape[1], len(xs))))
    return [Tensor(out.df.filter(F.col("j") == n).select("i", "v"), ("i",), (a.shape[0],)) for n in range(len(xs))]


# -- many products with one matrix: its entries are packed once and stay where they are ---------------------------------

GROUPS = 64  # groups of rows times groups of columns
PIECE = 1 << 20  # entries that are packed together, and in one group at least


def _group(key: str, of: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(of)).cast("int")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their rows' sums, of several ``(keys, rows)``."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    x = np.concatenate([x for _, x in parts])
    return keys, np.stack([np.bincount(at, weights=column, minlength=len(keys)) for column in x.T], axis=1)


def _as_rows(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype=np.float64).reshape(n, -1)


@dataclass(frozen=True)
class Packed:
    """Entries dealt into groups of rows and of columns, at most ``GROUPS`` pairs of groups, in packed pieces that are kept by
    the executors.  A product moves each vector entry once for every group across, and as many partial sums, never an entry
    of the matrix; what it moves grows with the vectors, however many entries there are."""

    df: DataFrame
    rows: int
    columns: int

    def times(self, vectors: DataFrame, transposed: bool = False) -> DataFrame:
        """``key, x``: the matrix, or its transpose, times packed rows ``(key, x)`` with unique keys; rows without entries are
        left out."""
        own, across = (self.columns, self.rows) if transposed else (self.rows, self.columns)
        into, out_of = ("c", "r") if transposed else ("r", "c")
        id_into, id_out_of = ("j", "i") if transposed else ("i", "j")

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("key")
            return pd.DataFrame({"_across": [key[0]], "keys": [part["key"].to_numpy().tobytes()], "x": [np.stack(part["x"].to_numpy()).tobytes()]})

        def multiply(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            group, held = None, []

            def done() -> pd.DataFrame:
                keys, x = _added(held)
                return pd.DataFrame({"_own": [group], "keys": [keys.tobytes()], "x": [x.tobytes()]})

            for batch in batches:
                for g, to, of, r, c, v, keys, x in zip(*(batch[n] for n in ("_own", id_into, id_out_of, into, out_of, "v", "keys", "x")), strict=True):
                    to, of, keys = (np.frombuffer(b, dtype=np.int64) for b in (to, of, keys))
                    r, c, v = np.frombuffer(r, dtype=np.int32), np.frombuffer(c, dtype=np.int32), np.frombuffer(v, dtype=np.float64)
                    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
                    seen = np.where((keys[at] == of)[:, None], _as_rows(x, len(keys))[at], 0.0)
                    if held and g != group:
                        yield done()
                        held = []
                    group = g
                    part = np.stack([np.bincount(r, weights=v * column[c], minlength=len(to)) for column in np.ascontiguousarray(seen.T)], axis=1)
                    held = [_added([*held, (to, part)])]
            if held:
                yield done()

        def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            each = [(np.frombuffer(k, dtype=np.int64), x) for k, x in zip(parts["keys"], parts["x"], strict=True)]
            keys, x = _added([(k, _as_rows(x, len(k))) for k, x in each])
            return pd.DataFrame({"key": keys, "x": list(x)})

        typed = vectors.select(F.col("key").cast("long").alias("key"), F.col("x").cast("array<double>").alias("x"))
        chunks = typed.groupBy(_group("key", across).alias("_across")).applyInPandas(pack, "_across int, keys binary, x binary")
        pairs = chunks.withColumn("_own", F.explode(F.sequence(F.lit(0), F.lit(own - 1))))
        p, q = ("_across", "_own") if transposed else ("_own", "_across")
        pairs = pairs.select((F.col(p) * self.columns + F.col(q)).alias("g"), "_own", "keys", "x")
        met = self.df.join(pairs.hint("shuffle_hash"), "g")
        sums = met.select("_own", "i", "j", "r", "c", "v", "keys", "x").mapInPandas(multiply, "_own int, keys binary, x binary")
        return sums.groupBy("_own").applyInPandas(whole, "key long, x array<double>")

    def unpersist(self) -> None:
        self.df.unpersist()


@dataclass(frozen=True)
class Group:
    """The packed pieces of whole rows of a matrix, within a task."""

    number: int
    rows: np.ndarray
    columns: np.ndarray
    pieces: list[tuple[np.ndarray, ...]]

    def times(self, x: np.ndarray) -> np.ndarray:
        """A x, of a row for each of the columns."""
        return self._folded(x, len(self.rows), 0)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        """A^T y, of a row for each of the rows."""
        return self._folded(y, len(self.columns), 1)

    def _folded(self, x: np.ndarray, n: int, into: int) -> np.ndarray:
        out = np.zeros((x.shape[1], n))
        for v, *at in self.pieces:
            for own, column in zip(out, x.T, strict=True):
                own += np.bincount(at[into], weights=v * column[at[1 - into]], minlength=n)
        return out.T


def whole_rows(batches: Iterable[pd.DataFrame]) -> Iterator[Group]:
    """The groups in a partition of a matrix that was packed with one group of columns."""

    def group(g: int, held: list[tuple[np.ndarray, ...]]) -> Group:
        rows, columns = (np.unique(np.concatenate([h[n] for h in held])) for n in (0, 1))
        places = [(v, np.searchsorted(rows, i)[r], np.searchsorted(columns, j)[c]) for i, j, r, c, v in held]
        return Group(g, rows, columns, places)

    at, held = None, []
    for batch in batches:
        for g, *parts in zip(*(batch[n] for n in ("g", "i", "j", "r", "c", "v")), strict=True):
            if held and g != at:
                yield group(at, held)
                held = []
            at = g
            held.append(tuple(np.frombuffer(b, dtype=t) for b, t in zip(parts, (np.int64, np.int64, np.int32, np.int32, np.float64), strict=True)))
    if held:
        yield group(at, held)


def packed(cells: DataFrame, groups: int | None = None, whole: bool = False) -> Packed:
    """Entries ``(i, j, v)``, each position once, for many products.  There are the more groups of rows the more rows there are
    beside columns; ``whole``: there is one group of columns, and a partition has whole groups for :func:`whole_rows`.  Read
    twice: write the cells to the shared folder if they are not a table."""
    seen = cells.agg(F.count("*").alias("n"), F.approx_count_distinct("i").alias("i"), F.approx_count_distinct("j").alias("j")).first()
    groups = groups or max(1, min(GROUPS, seen["n"] * 16 // PIECE))
    rows = groups if whole else min(groups, max(1, round((groups * max(seen["i"], 1) / max(seen["j"], 1)) ** 0.5)))
    columns = max(1, groups // rows)
    dealt = cells.select((_group("i", rows) * columns + _group("j", columns)).alias("g"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    sizes = {r["g"]: -(-r["n"] // PIECE) for r in dealt.groupBy("g").agg(F.count("*").alias("n")).collect()}
    pieces = F.element_at(F.array(*(F.lit(sizes.get(g, 1)) for g in range(rows * columns))), F.col("g") + 1)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, r = np.unique(part["i"].to_numpy(), return_inverse=True)
        j, c = np.unique(part["j"].to_numpy(), return_inverse=True)
        own = {"i": i, "j": j, "r": r.astype(np.int32), "c": c.astype(np.int32), "v": part["v"].to_numpy()}
        return pd.DataFrame({"g": [key[0]], **{n: [x.tobytes()] for n, x in own.items()}})

    of = dealt.withColumn("piece", F.pmod(F.xxhash64("i", "j"), pieces).cast("int"))
    if whole:  # nothing is joined with them: one shuffle
        of = of.repartition(2 * rows, "g")
    each = of.groupBy("g", "piece").applyInPandas(pack, "g int, i binary, j binary, r binary, c binary, v binary")
    if not whole:
        each = each.repartition(2 * rows * columns, "g").sortWithinPartitions("g")
    return Packed(each.persist(StorageLevel.MEMORY_AND_DISK), rows, columns)
