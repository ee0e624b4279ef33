"""Dense products: a small side is broadcast, two large ones meet in blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import lines
from tessera.session import cut_lineage
from tessera.tensor import ShapeError, Tensor


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """``[m, k] x [k, n]``; absent entries are zero, and a contraction over nothing gives zeros.

    A side of at most ``SMALL`` cells by its shape is broadcast, and the lines of the other are shuffled and multiplied
    within their tasks; two larger sides go to :func:`matmul_blocked`.
    """
    (i, k), (k2, j) = a.dims, b.dims
    if a.shape[1] != b.shape[0]:
        raise ShapeError(f"{a.shape} x {b.shape}")
    shape = (a.shape[0], b.shape[1])
    if not a.shape[1]:
        return Tensor.full(a.df.sparkSession, shape, 0.0, ("i", "j"))
    if not a.small and not b.small:
        return matmul_blocked(a, b)
    one = F.lit(0).cast("long")
    left, right = a.df.select(one, i, k, "v"), b.df.select(one, k2, j, "v")
    return Tensor(_with_small(left, right, b.small, paired=False, spread=False).select("i", "j", "v"), ("i", "j"), shape)


def matmul_rows(rows: DataFrame, column: str, b: Tensor) -> DataFrame:
    """Packed rows times a small matrix: the rows with their product in that column, and no shuffle; null stays null."""
    if not b.small:
        raise ShapeError(f"{b.shape} is too large to be held by every task")
    shared = rows.sparkSession.sparkContext.broadcast(b.to_numpy())
    names = rows.columns

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch[column].notna().to_numpy()
            out = np.full(len(batch), None, dtype=object)
            if known.any():
                for i, row in zip(np.flatnonzero(known), np.stack(batch[column].to_numpy()[known]) @ shared.value, strict=True):
                    out[i] = row
            yield batch.assign(**{column: out})[names]

    typed = rows.withColumn(column, F.col(column).cast("array<double>"))
    return typed.mapInPandas(work, typed.schema)


def batched_matmul(a: Tensor, b: Tensor) -> Tensor:
    """``[batch, m, k] x [batch, k, n]``; a batch of one is broadcast by leaving it out of the key, a side of at most
    ``SMALL`` cells by its shape is broadcast to the tasks, and two larger ones meet in blocks.  Entries that are there twice
    add up where a side is broadcast."""
    if a.shape[2] != b.shape[1] or (a.shape[0] != b.shape[0] and 1 not in (a.shape[0], b.shape[0])):
        raise ShapeError(f"{a.shape} x {b.shape}")
    batch = max(a.shape[0], b.shape[0]) if a.shape[0] and b.shape[0] else 0
    if not a.small and not b.small:
        return _large_batches(a, b, batch)
    paired = a.shape[0] == b.shape[0]
    spread = (b if b.small else a).shape[0] == batch and not paired
    out = _with_small(a.df.select(*a.dims, "v"), b.df.select(*b.dims, "v"), b.small, paired, spread)
    return Tensor(out, ("b", "i", "j"), (batch, a.shape[1], b.shape[2]))


def _with_small(left: DataFrame, right: DataFrame, of_right: bool, paired: bool, spread: bool) -> DataFrame:
    """``b, i, j, v`` of ``(batch, i, k, v)`` and ``(batch, k, j, v)``; the right or the left one is small, see :func:`lines.times`."""
    if of_right:
        return lines.times(left.toDF("_p", "_line", "_k", "v"), right.toDF("_q", "_k", "_other", "v"), paired, spread).toDF("b", "i", "j", "v")
    turned = lines.times(right.toDF("_p", "_k", "_line", "v"), left.toDF("_q", "_other", "_k", "v"), paired, spread)
    return turned.toDF("b", "j", "i", "v").select("b", "i", "j", "v")


def _large_batches(a: Tensor, b: Tensor, batch: int) -> Tensor:
    """Batches in blocks; to a batch of one, the other side's batches are more rows or columns of one product."""
    m, n = a.shape[1], b.shape[2]
    left, right = a.df.toDF("_b", "i", "k", "v"), b.df.toDF("_b", "k", "j", "v")
    one = F.lit(0).cast("long")
    if a.shape[0] == b.shape[0]:
        out = _in_blocks(left, right, a.shape[2], 256, batch)
    elif b.shape[0] == 1:
        out = _in_blocks(left.withColumn("i", F.col("_b") * m + F.col("i")).withColumn("_b", one), right, a.shape[2], 256)
        out = out.withColumn("_b", F.floor(F.col("i") / m)).withColumn("i", F.col("i") % m)
    else:
        out = _in_blocks(left, right.withColumn("j", F.col("_b") * n + F.col("j")).withColumn("_b", one), a.shape[2], 256)
        out = out.withColumn("_b", F.floor(F.col("j") / n)).withColumn("j", F.col("j") % n)
    return Tensor(out.toDF("b", "i", "j", "v"), ("b", "i", "j"), (batch, m, n))


def kron(a: Tensor, b: Tensor) -> Tensor:
    """Kronecker product: every entry of a meets every entry of b, by index and not by a cross join."""
    (m, n), (p, q) = a.shape, b.shape
    at = F.explode(F.sequence(F.lit(0), F.lit(p * q - 1)).cast("array<long>"))
    left = a.df.toDF("_i", "_j", "_a").withColumn("_at", at).withColumn("_p", F.floor(F.col("_at") / q)).withColumn("_q", F.col("_at") % q)
    joined = left.join(b.df.toDF("_p", "_q", "_b"), ["_p", "_q"])
    out = joined.select((F.col("_i") * p + F.col("_p")).cast("long").alias("i"), (F.col("_j") * q + F.col("_q")).cast("long").alias("j"), (F.col("_a") * F.col("_b")).alias("v"))
    return Tensor(out, ("i", "j"), (m * p, n * q))


def eye(like: Tensor) -> Tensor:
    n = like.shape[0]
    ids = like.df.sparkSession.range(n)
    return Tensor(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), ("i", "j"), (n, n))


def matpow(a: Tensor, exponent: int) -> Tensor:
    """Non-negative powers by squaring; every square is written to the checkpoint folder."""
    if a.shape[0] != a.shape[1] or exponent < 0:
        raise ShapeError(f"power {exponent} of {a.shape}")
    base = Tensor(a.df.toDF("i", "j", "v"), ("i", "j"), a.shape)
    out: Tensor | None = None
    while exponent:
        if exponent & 1:
            out = base if out is None else matmul(out, base)
        exponent >>= 1
        if exponent:
            square = matmul(base, base)
            base = Tensor(cut_lineage(square.df), square.dims, square.shape)
    return out if out is not None else eye(a)


def grams(rows: DataFrame, column: str, held: int = 1024) -> DataFrame:
    """``m, i, j, v``: X^T X of the packed rows of every ``m``.  Each task sums its own rows, with at most ``held``
    matrices at once; what is shuffled is cells of partial sums, however many rows a matrix has.

    Null rows are left out.  Rows of one matrix that have different lengths are an error, whatever task they are in.
    """

    def cells(own: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
        at = [(np.full(g.size, m), np.full(g.size, n), *(k.ravel() for k in np.indices(g.shape)), g.ravel()) for (m, n), g in own.items()]
        return pd.DataFrame(dict(zip(("m", "n", "i", "j", "v"), map(np.concatenate, zip(*at, strict=True)), strict=True)))

    def local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at, part in batch.groupby(["m", batch["x"].map(len).rename("n")]):
                x = np.stack(part["x"].to_numpy())
                own[at] = own[at] + x.T @ x if at in own else x.T @ x
                if len(own) >= held:
                    yield cells(own)
                    own = {}
        if own:
            yield cells(own)

    packed = rows.select(F.col("m").cast("long").alias("m"), F.col(column).cast("array<double>").alias("x")).filter("x is not null")
    sums = packed.mapInPandas(local, "m long, n int, i long, j long, v double").groupBy("m", "i", "j").agg(F.sum("v").alias("v"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    wrong = F.raise_error(F.concat(F.lit("rows of different lengths in matrix "), F.col("m").cast("string"))).cast("double")
    return sums.select("m", "i", "j", F.when(F.col("lo") == F.col("hi"), F.col("v")).otherwise(wrong).alias("v"))


def gram(rows: DataFrame, column: str) -> Tensor:
    """``X^T X`` of packed rows (one array column) of one length: matrices summed per task, no join."""
    first = rows.select(F.size(column).alias("n")).filter("n >= 0").first()
    n = first["n"] if first else 0
    return Tensor(grams(rows.select(F.lit(0).alias("m"), F.col(column).alias("x")), "x").select("i", "j", "v"), ("i", "j"), (n, n))


def matmul_blocked(a: Tensor, b: Tensor, block: int = 256) -> Tensor:
    """The same product for two large operands: blocks are packed once, meet on the contracted block and are multiplied
    in numpy, so the shuffle carries each entry once per block row or column and not once per product.

    Like :func:`matmul` it has an entry wherever a row and a column have entries in common, be its sum zero or not.
    Few contracted blocks would be few join keys: the blocks of b are then dealt out, and those of a repeated, over as
    many salts as there are shuffle partitions for each key, 32 at most.
    """
    if a.shape[1] != b.shape[0]:
        raise ShapeError(f"{a.shape} x {b.shape}")
    left, right = (t.df.select(F.lit(0).cast("long").alias("_b"), F.col(t.dims[0]).alias(r), F.col(t.dims[1]).alias(c), "v") for t, r, c in ((a, "i", "k"), (b, "k", "j")))
    return Tensor(_in_blocks(left, right, a.shape[1], block).drop("_b"), ("i", "j"), (a.shape[0], b.shape[1]))


def _in_blocks(left: DataFrame, right: DataFrame, length: int, block: int, batches: int = 1) -> DataFrame:
    """``_b, i, j, v`` of the cells ``(_b, i, k, v)`` and ``(_b, k, j, v)`` with ``length`` values of k.

    Products that belong to one block of the result are added up as packed blocks, so 8 to 12 bytes of each are shuffled; with
    one contracted block there is nothing to add and no second shuffle."""
    keys = batches * max(1, -(-length // block))
    salts = max(1, min(32, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // keys))

    def packed(cells: DataFrame, own: str, r: str, c: str) -> DataFrame:
        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            x, there = np.zeros((block, block)), np.zeros((block, block), dtype=bool)
            at = part["r"].to_numpy(), part["c"].to_numpy()
            x[at], there[at] = part["v"].to_numpy(), True
            return pd.DataFrame({"_b": [key[0]], "_" + own: [key[1]], "_k": [key[2]], "_x" + own: [x.tobytes() + there.tobytes()]})

        names = ("_b", F.floor(F.col(own) / block).alias("_" + own), F.floor(F.col("k") / block).alias("_k"))
        dealt = cells.select(*names, (F.col(r) % block).cast("int").alias("r"), (F.col(c) % block).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
        return dealt.groupBy("_b", "_" + own, "_k").applyInPandas(pack, f"_b long, _{own} long, _k long, _x{own} binary")

    rows = packed(left, "i", "i", "k").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    columns = packed(right, "j", "k", "j").withColumn("_salt", F.pmod(F.xxhash64("_j"), F.lit(salts)).cast("int"))
    pairs = rows.join(columns, ["_b", "_k", "_salt"]).select("_b", "_i", "_j", "_xi", "_xj")

    def product(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions, row by row, where entries meet, and what the blocks' product has there."""
        u, w = (np.frombuffer(z, dtype=np.float64, count=block * block).reshape(block, block) for z in (x, y))
        here, there = (np.frombuffer(z, dtype=bool, offset=8 * block * block).reshape(block, block) for z in (x, y))
        at = np.flatnonzero(here.astype(np.float32) @ there.astype(np.float32))
        return at, (u @ w).ravel()[at]

    def cells(of: int, p: int, q: int, at: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"_b": of, "i": p * block + at // block, "j": q * block + at % block, "v": v})

    def alone(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for of, p, q, x, y in zip(batch["_b"], batch["_i"], batch["_j"], batch["_xi"], batch["_xj"], strict=True):
                yield cells(of, p, q, *product(x, y))

    def multiply(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for of, p, q, x, y in zip(batch["_b"], batch["_i"], batch["_j"], batch["_xi"], batch["_xj"], strict=True):
                at, v = product(x, y)
                if len(at):  # no positions: all of them
                    yield pd.DataFrame({"_b": [of], "_i": [p], "_j": [q], "at": [at.astype(np.int32).tobytes() if len(at) < block * block else b""], "v": [v.tobytes()]})

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        z, there = np.zeros(block * block), np.zeros(block * block, dtype=bool)
        for at, v in zip(parts["at"], parts["v"], strict=True):
            where = np.frombuffer(at, dtype=np.int32) if at else slice(None)
            z[where] += np.frombuffer(v, dtype=np.float64)
            there[where] = True
        at = np.flatnonzero(there)
        return cells(*key, at, z[at])

    schema = "_b long, i long, j long, v double"
    if 0 < length <= block:  # one contracted block: every product is whole
        return pairs.mapInPandas(alone, schema)
    return pairs.mapInPandas(multiply, "_b long, _i long, _j long, at binary, v binary").groupBy("_b", "_i", "_j").applyInPandas(added, schema)
