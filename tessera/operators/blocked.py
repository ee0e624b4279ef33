"""LU and Cholesky factors of one large square matrix, tile by tile, and the products of the factors.

A matrix has tiles of ``edge`` x ``edge`` numbers.  It comes from packed rows ``(i, x)`` (:func:`stored`), or from a function
of two of them, whose tiles are made where they are needed and never kept (:func:`of_pairs`).

Factors are made column by column of tiles, "left-looking", as out-of-core solvers do (Toledo and Gustavson, "The Design
and Implementation of SOLAR"): a task owns one tile of the next column, subtracts the products of the tiles that are
finished, which it reads from the shared folder one after the other, and Spark writes it there.  A tile of a factor is so written
once and never moved again: what is kept is the factor and one column, and a task holds a few tiles.  LU makes the next row
of tiles in the same way, and finds its pivots by a tournament, ``FAN_IN`` tiles at a time, until one is left (Grigori, Demmel
and Xiang, "CALU: A Communication Optimal LU Factorization Algorithm").  Rows stay where they are; the driver has their order only.

A product of the factors is a task for every tile of the result, which reads the tiles that it needs, so nothing is shuffled.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.tensor import ShapeError, Tensor

FAN_IN = 8
EDGE = 1024  # of the tiles of a matrix of 8 times as many rows or more
FACTOR = "k long, i long, l array<double>, u array<double>"
_TILE = pa.schema([("i", pa.int64()), ("ids", pa.binary()), ("x", pa.binary())])
Made = tuple[np.ndarray, np.ndarray | None]
Pair = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def rows_of(t: Tensor) -> DataFrame:
    """Packed rows ``(i, x)`` of a matrix of cells; absent ones are 0, and so are rows without any."""
    i, j = t.dims
    n = t.shape[1]
    packs = t.df.groupBy(F.col(i).cast("long").alias("i")).agg(F.collect_list(F.struct(F.col(j).cast("long").alias("j"), F.col("v").cast("double").alias("v"))).alias("_e"))
    every = t.df.sparkSession.range(t.shape[0]).withColumnRenamed("id", "i").join(packs, "i", "left")

    def dense(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), n))
            for k, (at, v) in enumerate(zip(batch["j"], batch["v"], strict=True)):
                if at is not None:
                    x[k, at] = v
            yield pd.DataFrame({"i": batch["i"], "x": list(x)})

    return every.select("i", F.col("_e.j").alias("j"), F.col("_e.v").alias("v")).mapInPandas(dense, "i long, x array<double>")


# -- tiles in the shared folder -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Folder:
    """Tiles ``kind/j=../i=..`` below a URI that every executor reaches: the numbers of some rows and what these rows have."""

    uri: str

    def _at(self, *names: object):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.uri)
        return store, posixpath.join(top, *map(str, names))

    def read(self, kind: str, j: int, i: int, columns: int) -> tuple[np.ndarray, np.ndarray] | None:
        from pyarrow import fs, parquet

        store, path = self._at(kind, f"j={j}", f"i={i}")
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as source:
                    found = parquet.ParquetFile(source).read(columns=["ids", "x"])
                if len(found):
                    ids, x = (np.frombuffer(found[c][0].as_buffer(), dtype=t) for c, t in (("ids", np.int64), ("x", np.float64)))
                    return ids, x.reshape(len(ids), columns)
        return None

    def tile(self, kind: str, j: int, i: int, columns: int) -> np.ndarray:
        found = self.read(kind, j, i, columns)
        if found is None:
            raise FileNotFoundError(f"{self.uri}/{kind}/j={j}/i={i}")
        return found[1]

    def made(self, spark: SparkSession, kind: str, j: int, of: list[int], make: Callable[[int], Made | None]) -> bool:
        """Column j of a kind: a task for each tile.  False if one has no numbers."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    found = make(of[at])
                    if found is not None:
                        ids, x = found
                        own = [of[at]], [np.ascontiguousarray(ids, dtype=np.int64).tobytes()], [None if x is None else np.ascontiguousarray(x).tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(own, _TILE, strict=True)], schema=_TILE)

        seen = Observation()
        tiles = spark.range(0, len(of), 1, len(of)).mapInArrow(run, "i long, ids binary, x binary")
        tiles.observe(seen, F.count_if(F.col("x").isNull()).alias("none")).write.partitionBy("i").parquet(f"{self.uri}/{kind}/j={j}")
        return not seen.get["none"]

    def drop(self, *names: object) -> None:
        store, path = self._at(*names)
        store.delete_dir(path)


def _packed(rows: DataFrame, edge: int, pieces: int | None, upper: bool, width: int, path: str) -> None:
    """Writes packed rows as tiles, of ``edge`` rows and columns, or of whole rows if there are no pieces."""
    own = F.floor(F.col("i") / edge).cast("long")
    if pieces is None:
        each = rows.select(own.alias("b"), F.lit(0).cast("long").alias("j"), "i", "x")
    else:
        cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda c: F.slice("x", c * edge + 1, edge))
        each = rows.select(own.alias("b"), "i", F.posexplode(cut).alias("j", "x")).select("b", F.col("j").cast("long").alias("j"), "i", "x")
        each = each.filter("j >= b") if upper else each

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        return pd.DataFrame({"j": [key[0]], "i": [key[1]], "ids": [part["i"].to_numpy().tobytes()], "x": [np.stack(part["x"].to_numpy()).tobytes()]})

    each.groupBy("j", "b").applyInPandas(pack, "j long, i long, ids binary, x binary").write.partitionBy("j", "i").parquet(path)


# -- matrices -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Matrix:
    """A square matrix of ``n`` rows whose tiles a task can read, or make with ``pair`` from the packed rows in the folder."""

    folder: _Folder
    n: int
    edge: int
    width: int = 0
    pair: Pair | None = field(default=None, repr=False)

    @property
    def count(self) -> int:
        return -(-self.n // self.edge)

    def span(self, k: int) -> np.ndarray:
        return np.arange(k * self.edge, min(self.n, (k + 1) * self.edge))

    def picked(self, ids: np.ndarray, j: int) -> np.ndarray:
        """Rows of a column of tiles, in this order; they may lie in any tile."""
        columns = self.span(j)
        out = np.empty((len(ids), self.width if self.pair else len(columns)))
        for b in np.unique(ids // self.edge):
            at = ids // self.edge == b
            own = self.folder.tile("a", 0 if self.pair else j, b, out.shape[1])
            out[at] = own[ids[at] - b * self.edge]
        if self.pair:
            out = self.pair(ids, out, columns, self.folder.tile("a", 0, j, self.width))
        if not np.isfinite(out).all():
            raise ShapeError("the matrix has numbers that are not finite")
        return out


def _edge(n: int, width: int | None) -> int:
    return width or min(EDGE, max(64, -(-n // 8)))


def _checked(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Typed rows, their number and their length: rows 0 to n - 1 of finite numbers."""
    start = rows.select(F.col("i").cast("long").alias("i"), F.col("x").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    seen = start.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.coalesce(F.max(bad), F.lit(False)).alias("bad"), F.countDistinct("i").alias("ids"), F.count("x").alias("known"), F.min("i").alias("first"), F.max("i").alias("last")).first()
    n = seen["n"]
    if n and (seen["lo"] != seen["hi"] or seen["bad"] or seen["known"] < n or (seen["first"], seen["last"], seen["ids"]) != (0, n - 1, n)):
        raise ShapeError(f"not finite rows 0 to {n - 1} of one length: {seen.asDict()}")
    return start, n, seen["hi"] or 0


def _new(spark: SparkSession) -> _Folder:
    return _Folder(f"{shared_dir(spark)}/blocked-{uuid.uuid4().hex}")


def stored(rows: DataFrame, width: int | None = None, upper: bool = False) -> Matrix:
    """The matrix of packed rows ``(i, x)``, or its upper triangle."""
    start, n, columns = _checked(rows)
    if n != columns:
        raise ShapeError(f"not a square matrix: {n} rows of {columns}")
    m = Matrix(_new(rows.sparkSession), n, _edge(n, width))
    if n:
        _packed(start, m.edge, m.count, upper, n, f"{m.folder.uri}/a")
    return m


def of_pairs(rows: DataFrame, pair: Pair, width: int | None = None) -> Matrix:
    """The matrix with an entry for any two of n packed rows ``(i, x)``: ``pair`` takes the numbers and the values of some rows and
    of others, ``(i, x, j, y)``, and gives the entries between them.  Kept are the packed rows, and none of the entries."""
    start, n, columns = _checked(rows)
    m = Matrix(_new(rows.sparkSession), n, _edge(n, width), columns, pair)
    if n:
        _packed(start, m.edge, None, False, columns, f"{m.folder.uri}/a")
    return m


# -- factors ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Factors:
    """The factors of a matrix, as tiles in its folder.

    Cholesky has ``R^T`` below ``r``.  LU has the multipliers of the rows that are left after a column below ``l``, the rows of U
    right of the diagonal below ``u``, and below ``d`` each column's pivot rows with L and U in one square.  ``order``: LU's pivot
    rows in their order."""

    matrix: Matrix
    order: np.ndarray | None = field(default=None, repr=False)

    def rows(self, spark: SparkSession) -> DataFrame:
        """``k, i, l, u``: row i of the matrix is the k-th of ``P A = L U``, or of ``A = R^T R``, where l is empty.  Pieces of rows meet
        in one shuffle."""
        m, order, folder = self.matrix, self.order, self.matrix.folder
        if not m.n:
            return spark.createDataFrame([], FACTOR)
        schema = pa.schema([("k", pa.int64()), ("lower", pa.bool_()), ("at", pa.int64()), ("x", pa.list_(pa.float64()))])

        def pieces(j: int) -> Iterator[tuple[np.ndarray, bool, int, list[np.ndarray]]]:
            own = m.span(j)
            if order is None:
                for i in range(j, m.count):
                    x = folder.tile("r", j, i, len(own))
                    yield own, False, i, [x[p if i == j else 0 :, p] for p in range(len(own))]
                return
            place = np.empty(m.n, dtype=np.int64)
            place[order] = np.arange(m.n)
            d = folder.tile("d", j, 0, len(own))
            yield own, True, j, [d[p, :p] for p in range(len(own))]
            yield own, False, j, [d[p, p:] for p in range(len(own))]
            for i in range(m.count):
                if i > j:
                    yield own, False, i, list(folder.tile("u", j, i, len(m.span(i))))
                if (left := folder.read("l", j, i, len(own))) is not None:
                    yield place[left[0]], True, j, list(left[1])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in batch.column(0).to_pylist():
                    for k, lower, at, x in pieces(j):
                        for start in range(0, len(k), 256):
                            part = slice(start, start + 256)
                            size = len(k[part])
                            yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array([lower] * size), pa.array([at] * size, pa.int64()), pa.array(x[part], schema.field("x").type)], schema=schema)

        def joined(lower: bool):
            own = F.collect_list(F.when(F.col("lower") == lower, F.struct("at", "x")))
            return F.flatten(F.transform(F.array_sort(own), lambda p: p["x"]))

        each = spark.range(0, m.count, 1, m.count).mapInArrow(run, "k long, lower boolean, at long, x array<double>").groupBy("k").agg(joined(True).alias("l"), joined(False).alias("u"))
        if order is None:
            return each.select("k", F.col("k").alias("i"), "l", "u")
        return _with_ids(each, order)

    def product(self, spark: SparkSession) -> DataFrame:
        """``i, j, v``: every entry of ``R^T R``, of which one half is multiplied, or of ``L U`` with its rows put back."""
        m, order, folder = self.matrix, self.order, self.matrix.folder
        if not m.n:
            return spark.createDataFrame([], "i long, j long, v double")
        places = [(i, j) for i in range(m.count) for j in range(m.count if order is not None else i + 1)]
        tasks = min(len(places), 8 * spark.sparkContext.defaultParallelism)

        def whole(i: int, j: int) -> np.ndarray:
            own = m.span(i), m.span(j)
            out = np.zeros(tuple(map(len, own)))
            if order is None:
                for k in range(j + 1):
                    x = folder.tile("r", k, i, len(m.span(k)))
                    out += x @ (x if i == j else folder.tile("r", k, j, len(m.span(k)))).T
                return out
            for k in range(j + 1):
                pivots = m.span(k)
                at, left = np.flatnonzero(order[pivots] // m.edge == i), folder.read("l", k, i, len(pivots))
                d = folder.tile("d", k, 0, len(pivots))
                upper = np.triu(d) if k == j else folder.tile("u", k, j, len(own[1]))
                if left is not None:
                    out[left[0] - own[0][0]] += left[1] @ upper
                if len(at):
                    out[order[pivots][at] - own[0][0]] += (np.tril(d, -1) + np.eye(len(d)))[at] @ upper
            return out

        def cells(i: np.ndarray, j: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(i), 128):
                part = i[at : at + 128]
                own = np.repeat(part, len(j)), np.tile(j, len(part)), np.ascontiguousarray(x[at : at + 128]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in own], names=["i", "j", "v"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    for i, j in places[task::tasks]:
                        x = whole(i, j)
                        yield from cells(m.span(i), m.span(j), x)
                        if order is None and i != j:
                            yield from cells(m.span(j), m.span(i), x.T)

        return spark.range(0, tasks, 1, tasks).mapInArrow(run, "i long, j long, v double")


def lu(rows: DataFrame, width: int | None = None) -> DataFrame:
    """``k, i, l, u``: row i of the matrix is the k-th of ``P A = L U``; ``l`` has its k multipliers, ``u`` the n - k entries of
    its row of U from the diagonal on.  A singular matrix is an error."""
    return lu_factors(rows.sparkSession, stored(rows, width)).rows(rows.sparkSession)


def cholesky(rows: DataFrame, width: int | None = None) -> DataFrame:
    """``k, i, u``: row k, which is i, of the upper R with ``A = R^T R``, from the diagonal on.  Reads the upper triangle of a
    symmetric matrix; one that is not positive definite is an error."""
    return cholesky_factors(rows.sparkSession, stored(rows, width, upper=True)).rows(rows.sparkSession).select("k", "i", "u")


def cholesky_factors(spark: SparkSession, m: Matrix) -> Factors:
    """``A = R^T R``, from the upper triangle of a symmetric matrix."""
    folder = m.folder
    for k in range(m.count):
        own = m.span(k)

        def rest(i: int, k: int = k, own: np.ndarray = own) -> Made:
            x = m.picked(own, i).T.copy()
            for j in range(k):
                left = folder.tile("r", j, i, len(m.span(j)))
                x -= left @ (left if i == k else folder.tile("r", j, k, len(m.span(j)))).T
            return m.span(i), x

        def solved(i: int, k: int = k, own: np.ndarray = own) -> Made:
            try:  # what `rest` has of the diagonal is transposed
                lower = np.linalg.cholesky(np.tril(x := folder.tile("s", k, k, len(own))) + np.tril(x, -1).T)
            except np.linalg.LinAlgError:
                return m.span(i), None
            return m.span(i), lower if i == k else _substituted(lower, folder.tile("s", k, i, len(own)).T).T

        folder.made(spark, "s", k, list(range(k, m.count)), rest)
        if not folder.made(spark, "r", k, list(range(k, m.count)), solved):
            raise ShapeError("the matrix is not positive definite")
        folder.drop("s", f"j={k}")
    return Factors(m)


def lu_factors(spark: SparkSession, m: Matrix) -> Factors:
    """``P A = L U`` with pivots by a tournament."""
    folder, order = m.folder, np.empty(0, dtype=np.int64)
    left = np.ones(m.n, dtype=bool)
    for k in range(m.count):
        t = len(m.span(k))
        alive = np.unique(np.flatnonzero(left) // m.edge).tolist()

        def rest(i: int, k: int = k, left: np.ndarray = left.copy()) -> Made:
            ids = m.span(i)[left[m.span(i)]]
            x = m.picked(ids, k)
            for j in range(k):
                have, own = folder.read("l", j, i, len(m.span(j)))
                x -= own[np.searchsorted(have, ids)] @ folder.tile("u", j, k, x.shape[1])
            return ids, x

        folder.made(spark, "s", k, alive, rest)
        pivots = _tournament(spark, m, k, alive)
        order = np.concatenate([order, pivots])
        left[pivots] = False
        alive = np.unique(np.flatnonzero(left) // m.edge).tolist()
        if not alive:
            break

        def multipliers(i: int, k: int = k, t: int = t, left: np.ndarray = left.copy()) -> Made:
            ids, x = folder.read("s", k, i, t)
            upper = np.triu(folder.tile("d", k, 0, t))
            return ids[left[ids]], _substituted(upper.T, x[left[ids]].T).T

        def history(j: int, pivots: np.ndarray = pivots) -> Made:
            """What the pivot rows have in an earlier column."""
            out = np.empty((len(pivots), len(m.span(j))))
            for b in np.unique(pivots // m.edge):
                at = pivots // m.edge == b
                have, x = folder.read("l", j, int(b), out.shape[1])
                out[at] = x[np.searchsorted(have, pivots[at])]
            return pivots, out

        def upper(j: int, k: int = k, t: int = t, pivots: np.ndarray = pivots) -> Made:
            x = m.picked(pivots, j)
            for before in range(k):
                x -= folder.tile("h", k, before, len(m.span(before))) @ folder.tile("u", before, j, x.shape[1])
            return pivots, _substituted(np.tril(folder.tile("d", k, 0, t), -1) + np.eye(t), x)

        folder.made(spark, "l", k, alive, multipliers)
        folder.drop("s", f"j={k}")
        if k:
            folder.made(spark, "h", k, list(range(k)), history)
        folder.made(spark, "u", k, list(range(k + 1, m.count)), upper)
        if k:
            folder.drop("h", f"j={k}")
    return Factors(m, order)


def _tournament(spark: SparkSession, m: Matrix, k: int, alive: list[int]) -> np.ndarray:
    """The pivot rows of a column, in their order.  Their square, factored, is the column's tile of ``d``."""
    folder, t, kind, level = m.folder, len(m.span(k)), "s", 0

    def best(of: list[int], kind: str, last: bool) -> Made:
        found = [folder.read(kind, k, i, t) for i in of]
        ids, x = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        own = x.copy()
        first = _factored(own)[:t]
        if last:
            return ids[first], own[:t] if np.diag(own[:t]).all() else None
        return ids[first], x[first]

    while True:
        groups = [alive[at : at + FAN_IN] for at in range(0, len(alive), FAN_IN)]
        last, into = len(groups) == 1, "d" if len(groups) == 1 else f"t{level}"
        fine = folder.made(spark, into, k, list(range(len(groups))), lambda g, groups=groups, kind=kind, last=last: best(groups[g], kind, last))
        if not fine:
            raise ShapeError("the matrix is singular")
        if level:
            folder.drop(kind, f"j={k}")
        if last:
            break
        alive, kind, level = list(range(len(groups))), into, level + 1
    found = spark.read.parquet(f"{folder.uri}/d/j={k}").select("ids").first()["ids"]
    return np.frombuffer(bytes(found), dtype=np.int64)


def _factored(a: np.ndarray) -> np.ndarray:
    """L and U of a tall matrix, by halves of its columns, in its place; the order of its rows by partial pivoting."""
    m, t = a.shape
    if t <= 32:
        order = np.arange(m)
        for k in range(min(m, t)):
            best = k + int(np.abs(a[k:, k]).argmax())
            if best != k:
                a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if a[k, k]:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        return order
    h = t // 2
    order = _factored(a[:, :h])
    a[:, h:] = a[order, h:]
    if m <= h:
        a[:, h:] = _substituted(np.tril(a[:, :m], -1) + np.eye(m), a[:, h:])
        return order
    a[:h, h:] = _substituted(np.tril(a[:h, :h], -1) + np.eye(h), a[:h, h:])
    a[h:, h:] -= a[h:, :h] @ a[:h, h:]
    below = _factored(a[h:, h:])
    a[h:, :h] = a[h:, :h][below]
    return np.concatenate([order[:h], order[h:][below]])


def _substituted(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x of ``lower x = b`` by halves, and row by row.  A threaded LAPACK solve with many right sides can wait for ever in a
    process that has forked, as Spark's drivers and Python daemons have."""
    n = len(b)
    if n > 64:
        h = n // 2
        top = _substituted(lower[:h, :h], b[:h])
        return np.vstack([top, _substituted(lower[h:, h:], b[h:] - lower[h:, :h] @ top)])
    x = np.empty_like(b)
    for k in range(n):
        x[k] = (b[k] - lower[k, :k] @ x[:k]) / lower[k, k]
    return x


def _with_ids(each: DataFrame, order: np.ndarray) -> DataFrame:
    """The number of the row that is the k-th."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(order[batch.column("k").to_numpy()]), batch.column("l"), batch.column("u")], names=["k", "i", "l", "u"])

    return each.select("k", "l", "u").mapInArrow(run, FACTOR)
