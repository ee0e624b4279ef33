"""Factorizations of many matrices at once, and of one tall one.

A table ``(m, i, j, v)`` holds any number of matrices; each is factored in the task that its key is dealt to, and the
factors come back as rows ``(m, part, i, j, v)``.  One matrix must fit a task, as it must fit one device elsewhere; what
Spark distributes is the number of matrices.  A tall matrix is different: its rows are distributed, and :func:`tsqr` and
:func:`tall_svd` reduce them to a small triangle without moving them.

numpy has the orthogonal and symmetric factorizations; the others are short eliminations below.  Non-finite entries and
matrices that a factorization does not take are rejected with the matrix's key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.operators.linalg import grams
from tessera.session import cut_lineage
from tessera.tensor import ShapeError

TOLERANCE = 1e-9
Factors = dict[str, np.ndarray]


def lu(a: np.ndarray) -> Factors:
    """P A = L U by partial pivoting: ``p`` is the row order."""
    u, n = a.copy(), len(a)
    p, sign = np.arange(n), 1.0
    for k in range(n):
        r = k + int(np.abs(u[k:, k]).argmax())
        if u[r, k] == 0:
            raise ValueError("the matrix is singular")
        if r != k:
            u[[k, r]], p[[k, r]], sign = u[[r, k]], p[[r, k]], -sign
        u[k + 1 :, k] /= u[k, k]
        u[k + 1 :, k + 1 :] -= np.outer(u[k + 1 :, k], u[k, k + 1 :])
    return {"l": np.tril(u, -1) + np.eye(n), "u": np.triu(u), "p": p[:, None], "det": np.array([[sign * np.diag(u).prod()]])}


def full_piv_lu(a: np.ndarray) -> Factors:
    """P A Q = L U; the rank is the number of pivots above the tolerance."""
    u = a.copy()
    m, n = u.shape
    p, q, rank, sign = np.arange(m), np.arange(n), 0, 1.0
    least = TOLERANCE * (np.abs(a).max() if a.size else 0)
    for k in range(min(m, n)):
        r, c = np.unravel_index(np.abs(u[k:, k:]).argmax(), (m - k, n - k))
        r, c = k + int(r), k + int(c)
        if np.abs(u[r, c]) <= least:
            break
        sign *= (-1.0) ** ((r != k) + (c != k))
        u[[k, r]], p[[k, r]] = u[[r, k]], p[[r, k]]
        u[:, [k, c]], q[[k, c]] = u[:, [c, k]], q[[c, k]]
        u[k + 1 :, k] /= u[k, k]
        u[k + 1 :, k + 1 :] -= np.outer(u[k + 1 :, k], u[k, k + 1 :])
        rank += 1
    s = min(m, n)
    lower, upper = np.tril(u[:, :s], -1) + np.eye(m, s), np.triu(u[:s])
    lower[rank:, rank:] = np.eye(m - rank, s - rank)
    upper[rank:] = 0
    det = sign * np.diag(u).prod() if m == n and rank == n else 0.0
    return {"l": lower, "u": upper, "p": p[:, None], "q": q[:, None], "rank": np.array([[rank]]), "det": np.array([[det]])}


def qr(a: np.ndarray) -> Factors:
    if a.shape[0] < a.shape[1]:
        raise ValueError("QR takes at least as many rows as columns")
    q, r = np.linalg.qr(a, mode="complete")
    return {"q": q, "r": r}


def col_piv_qr(a: np.ndarray) -> Factors:
    """A P = Q R with falling diagonal: Householder, the longest remaining column first."""
    r = a.copy()
    m, n = r.shape
    q, p = np.eye(m), np.arange(n)
    for k in range(min(m, n)):
        c = k + int((r[k:, k:] ** 2).sum(axis=0).argmax())
        r[:, [k, c]], p[[k, c]] = r[:, [c, k]], p[[c, k]]
        h = _householder(r[k:, k])
        r[k:], q[:, k:] = h @ r[k:], q[:, k:] @ h
    diagonal = np.abs(np.diag(r))
    rank = int((diagonal > TOLERANCE * (diagonal.max() if diagonal.size else 0)).sum())
    return {"q": q, "r": np.triu(r), "p": p[:, None], "rank": np.array([[rank]])}


def _householder(x: np.ndarray) -> np.ndarray:
    """The reflection that maps x to a multiple of the first unit vector."""
    v = x.astype(float).copy()
    v[0] += math.copysign(np.linalg.norm(x), x[0])
    size = v @ v
    return np.eye(len(x)) - (2 / size * np.outer(v, v) if size else 0)


def cholesky(a: np.ndarray) -> Factors:
    if not np.allclose(a, a.T):
        raise ValueError("the matrix is not symmetric")
    try:
        lower = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        raise ValueError("the matrix is not positive definite") from None
    return {"l": lower, "det": np.array([[np.diag(lower).prod() ** 2]])}


def udu(a: np.ndarray) -> Factors:
    """A = U D U^T with a unit upper U."""
    n, rest = len(a), a.astype(float).copy()
    u, d = np.eye(n), np.zeros(n)
    for k in range(n - 1, -1, -1):
        d[k] = rest[k, k]
        if d[k] == 0:
            raise ValueError("a pivot is zero")
        u[:k, k] = rest[:k, k] / d[k]
        rest[:k, :k] -= d[k] * np.outer(u[:k, k], u[:k, k])
    return {"u": u, "d": d[:, None], "det": np.array([[d.prod()]])}


def bunch_kaufman(a: np.ndarray) -> Factors:
    """P A P^T = L D L^T of a symmetric matrix, D with blocks of one or two: the largest diagonal or off-diagonal pivot."""
    n, rest = len(a), a.astype(float).copy()
    if not np.allclose(a, a.T):
        raise ValueError("the matrix is not symmetric")
    p, lower, d, k = np.arange(n), np.eye(n), np.zeros((n, n)), 0
    growth = (1 + math.sqrt(17)) / 8

    def swap(x: int, y: int) -> None:
        rest[[x, y]] = rest[[y, x]]
        rest[:, [x, y]] = rest[:, [y, x]]
        lower[[x, y], :k] = lower[[y, x], :k]
        p[[x, y]] = p[[y, x]]

    while k < n:
        part = np.abs(rest[k:, k:])
        r = int(np.diag(part).argmax())
        x, y = np.unravel_index((part - np.diag(np.diag(part))).argmax(), part.shape)
        size = 1 if part[r, r] >= growth * part[x, y] else 2
        if size == 1:
            swap(k, k + r)
        else:
            x, y = sorted((int(x), int(y)))
            swap(k, k + x)
            swap(k + 1, k + y)
        pivot = rest[k : k + size, k : k + size].copy()
        d[k : k + size, k : k + size] = pivot
        if np.any(pivot):
            own = rest[k + size :, k : k + size] @ np.linalg.inv(pivot)
            lower[k + size :, k : k + size] = own
            rest[k + size :, k + size :] -= own @ pivot @ own.T
        k += size
    return {"l": lower, "d": d, "p": p[:, None]}


def hessenberg(a: np.ndarray) -> Factors:
    """A = Q H Q^T"""
    h, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        r = _householder(h[k + 1 :, k])
        h[k + 1 :] = r @ h[k + 1 :]
        h[:, k + 1 :], q[:, k + 1 :] = h[:, k + 1 :] @ r.T, q[:, k + 1 :] @ r
        h[k + 2 :, k] = 0
    return {"q": q, "h": h}


def _turn(t: np.ndarray, q: np.ndarray, at: slice, z: np.ndarray) -> None:
    """The similarity transform of t by z in these rows and columns, gathered in q."""
    t[at] = z.T @ t[at]
    t[:, at], q[:, at] = t[:, at] @ z, q[:, at] @ z


def schur(a: np.ndarray, rounds: int = 200) -> Factors:
    """A = Q T Q^T with real, quasi-upper T: explicit double shifts and deflation."""
    first = hessenberg(a)
    t, q = first["h"], first["q"]
    hi, spent = len(a), 0
    while hi > 2:
        small = np.abs(np.diag(t, -1)) <= 1e-14 * (np.abs(np.diag(t))[:-1] + np.abs(np.diag(t))[1:])
        t[np.flatnonzero(small) + 1, np.flatnonzero(small)] = 0
        if t[hi - 1, hi - 2] == 0:
            hi, spent = hi - 1, 0
            continue
        if t[hi - 2, hi - 3] == 0:
            hi, spent = hi - 2, 0
            continue
        spent += 1
        if spent > rounds:
            raise ValueError("the QR iteration does not settle")
        lo = hi - 1
        while lo > 0 and t[lo, lo - 1] != 0:
            lo -= 1
        own = t[lo:hi, lo:hi]
        corner = own[-2:, -2:]
        s, d = (corner.trace(), np.linalg.det(corner)) if spent % 11 else (1.5 * np.abs(own[-1, -2]), own[-1, -2] ** 2)
        z, _ = np.linalg.qr(own @ own - s * own + d * np.eye(hi - lo))
        _turn(t, q, slice(lo, hi), z)
        part = hessenberg(t[lo:hi, lo:hi])
        _turn(t, q, slice(lo, hi), part["q"])
        t[lo:hi, lo:hi] = np.triu(t[lo:hi, lo:hi], -1)
    for k in range(len(a) - 1):  # 2 x 2 blocks with real eigenvalues become triangular
        b = t[k : k + 2, k : k + 2]
        gap = (b[0, 0] - b[1, 1]) ** 2 / 4 + b[0, 1] * b[1, 0]
        if b[1, 0] != 0 and gap >= 0:
            value = (b[0, 0] + b[1, 1]) / 2 + math.sqrt(gap)
            x = np.array([b[0, 1], value - b[0, 0]]) if abs(value - b[0, 0]) > abs(value - b[1, 1]) else np.array([value - b[1, 1], b[1, 0]])
            x /= np.linalg.norm(x)
            z = np.array([[x[0], -x[1]], [x[1], x[0]]])
            _turn(t, q, slice(k, k + 2), z)
            t[k + 1, k] = 0
    return {"q": q, "t": t}


def bidiagonal(a: np.ndarray) -> Factors:
    """A = U B V^T with an upper bidiagonal B."""
    b = a.astype(float).copy()
    m, n = b.shape
    if m < n:
        raise ValueError("bidiagonalization takes at least as many rows as columns")
    u, v = np.eye(m), np.eye(n)
    for k in range(n):
        h = _householder(b[k:, k])
        b[k:], u[:, k:] = h @ b[k:], u[:, k:] @ h
        if k < n - 2:
            h = _householder(b[k, k + 1 :])
            b[:, k + 1 :], v[:, k + 1 :] = b[:, k + 1 :] @ h, v[:, k + 1 :] @ h
    return {"u": u, "b": np.triu(np.tril(b, 1)), "v": v}


def svd(a: np.ndarray) -> Factors:
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    return {"u": u, "s": s[:, None], "v": vt.T}


def singular_values(a: np.ndarray) -> Factors:
    return {"s": np.linalg.svd(a, compute_uv=False)[:, None]}


def symmetric_eigen(a: np.ndarray) -> Factors:
    if not np.allclose(a, a.T):
        raise ValueError("the matrix is not symmetric")
    w, v = np.linalg.eigh(a)
    return {"w": w[:, None], "v": v}


def eigenvalues(a: np.ndarray) -> Factors:
    w = np.sort_complex(np.linalg.eigvals(a))
    return {"re": w.real[:, None], "im": w.imag[:, None]}


def inv(a: np.ndarray) -> Factors:
    f = lu(a)
    return {"inv": np.linalg.solve(f["u"], np.linalg.solve(f["l"], np.eye(len(a))[f["p"][:, 0]]))}


def det(a: np.ndarray) -> Factors:
    try:
        return {"det": lu(a)["det"]}
    except ValueError:
        return {"det": np.zeros((1, 1))}


def slogdet(a: np.ndarray) -> Factors:
    """Sign and logarithm of the determinant, which itself leaves the range of doubles for large matrices."""
    sign, log = np.linalg.slogdet(a)
    return {"sign": np.array([[sign]]), "log": np.array([[log]])}


def matrix_rank(a: np.ndarray) -> Factors:
    if not a.size:
        raise ValueError("the rank of an empty matrix")
    return {"rank": full_piv_lu(a)["rank"]}


def pinv(a: np.ndarray) -> Factors:
    return {"pinv": np.linalg.pinv(a)}


def matexp(a: np.ndarray) -> Factors:
    """Scaling to a norm below 1/2, a Taylor polynomial, and squaring."""
    halvings = max(0, math.ceil(math.log2(max(np.abs(a).sum(axis=1).max(), 1e-300))) + 1)
    x, term = a / 2.0**halvings, np.eye(len(a))
    out = term.copy()
    for k in range(1, 20):
        term = term @ x / k
        out += term
    for _ in range(halvings):
        out = out @ out
    return {"exp": out}


KERNELS: dict[str, Callable[[np.ndarray], Factors]] = {
    f.__name__: f
    for f in (lu, full_piv_lu, qr, col_piv_qr, cholesky, udu, bunch_kaufman, hessenberg, schur, bidiagonal, svd, singular_values, symmetric_eigen, eigenvalues, inv, det, slogdet, matrix_rank, pinv, matexp)
}
SQUARE = {"lu", "cholesky", "udu", "bunch_kaufman", "hessenberg", "schur", "symmetric_eigen", "eigenvalues", "inv", "det", "slogdet", "matexp"}


def _dense(rows: pd.DataFrame, shape: tuple[int, int] | None = None) -> np.ndarray:
    """Absent entries are zero if the shape is known; without one every entry must be there."""
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    if shape is None:
        shape = int(i.max()) + 1, int(j.max()) + 1
        if len(rows) != shape[0] * shape[1]:
            raise ValueError("entries are absent: the matrix needs its shape")
    a = np.zeros(shape)
    a[i, j] = rows["v"].to_numpy()
    return a


def factor(matrices: DataFrame, kind: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """``m, part, i, j, v`` of every matrix of ``(m, i, j, v)``; sparse ones need their shape."""
    kernel = KERNELS[kind]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = _dense(rows, shape)
        if not np.isfinite(a).all():
            raise ValueError(f"matrix {key[0]} has non-finite entries")
        if kind in SQUARE and a.shape[0] != a.shape[1]:
            raise ValueError(f"matrix {key[0]} is not square")
        out = []
        for part, values in kernel(a).items():
            i, j = np.indices(values.shape)
            out.append(pd.DataFrame({"m": key[0], "part": part, "i": i.ravel(), "j": j.ravel(), "v": values.ravel().astype(float)}))
        return pd.concat(out)

    return matrices.select(F.col("m").cast("long").alias("m"), "i", "j", F.col("v").cast("double").alias("v")).groupBy("m").applyInPandas(one, "m long, part string, i long, j long, v double")


def solve(matrices: DataFrame, right: DataFrame, least_squares: bool = False) -> DataFrame:
    """``m, i, v``: the solutions of A x = b for every key of ``(m, i, j, v)`` and ``(m, i, v)``.

    Absent entries are zero; the largest index on the right says how many equations there are.
    """

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            raise ValueError(f"system {key[0]} lacks a side")
        n = int(b["at"].max()) + 1
        y = np.zeros(n)
        y[b["at"].to_numpy()] = b["b"].to_numpy()
        x = _dense(a, (n, int(a["j"].max()) + 1 if least_squares else n))
        if least_squares:
            q, r = np.linalg.qr(x)
            z = np.linalg.solve(r, q.T @ y)
        else:
            f = lu(x)
            z = np.linalg.solve(f["u"], np.linalg.solve(f["l"], y[f["p"][:, 0]]))
        return pd.DataFrame({"m": key[0], "i": np.arange(len(z)), "v": z})

    # New names: both sides may come from one table.
    right = right.select(F.col("m").cast("long").alias("m"), F.col("i").alias("at"), F.col("v").alias("b"))
    return matrices.groupBy("m").cogroup(right.groupBy("m")).applyInPandas(one, "m long, i long, v double")


def least_squares_rows(rows: DataFrame, column: str, right: str) -> DataFrame:
    """``m, i, v``: the shortest x that minimizes |A x - b| over all rows ``(m, packed row of A, b)`` of every ``m``,
    from the normal equations: Spark sums A^T A and A^T b, and only they meet in a task."""
    both = grams(rows.select("m", F.concat(F.col(column).cast("array<double>"), F.array(F.col(right).cast("double"))).alias("x")), "x")

    def one(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        g = _dense(cells)
        if not np.isfinite(g).all():
            raise ValueError(f"system {key[0]} has non-finite entries")
        x = np.linalg.pinv(g[:-1, :-1], rcond=1e-12, hermitian=True) @ g[:-1, -1]
        return pd.DataFrame({"m": key[0], "i": np.arange(len(x)), "v": x})

    return both.groupBy("m").applyInPandas(one, "m long, i long, v double")


def tsqr(rows: DataFrame, column: str, fan_in: int = 64) -> np.ndarray:
    """R of a tall matrix of packed rows: a QR in every task, then QRs of stacked triangles in rounds, each with
    ``fan_in`` times fewer tasks, until one is left.  Nothing but triangles of the matrix's width is shuffled, and every
    round starts with a shuffle, so the scan keeps its own number of tasks."""

    def local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pd.DataFrame({"x": list(r)})

    triangles = rows.select(F.col(column).cast("array<double>").alias("x")).mapInPandas(local, "x array<double>")
    n = rows.sparkSession.sparkContext.defaultParallelism
    while n > 1:
        triangles = triangles.repartition(n).mapInPandas(local, "x array<double>")
        n //= fan_in
    found = triangles.repartition(1).mapInPandas(local, "x array<double>").collect()  # one triangle
    r = np.array([row["x"] for row in found])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) else r


def tall_svd(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall matrix, from its triangle."""
    _, s, vt = np.linalg.svd(tsqr(rows, column))
    return s, vt.T


def tall_least_squares(rows: DataFrame, column: str, right: str) -> np.ndarray:
    """The x that minimizes |A x - b| over rows of a packed row of A and b, from one pass: the triangle of (A b) has the
    triangle of A and, beside it, Q^T b.  Of a matrix without full column rank it is the shortest such x."""
    both = F.concat(F.col(column).cast("array<double>"), F.array(F.col(right).cast("double")))
    r = tsqr(rows.select(both.alias("x")), "x")
    n = r.shape[1] - 1
    return np.linalg.lstsq(r[:n, :n], r[:n, n], rcond=None)[0]


LEAF_ROWS = 4096


def _as_matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, columns)


def thin_q(rows: DataFrame, key: str, column: str, leaf_rows: int = LEAF_ROWS, fan_in: int = 64) -> tuple[DataFrame, np.ndarray]:
    """``(key, q)`` and R of a tall matrix of packed rows: A = Q R, Q with orthonormal columns, R with a diagonal that is
    not negative.

    The same tree as :func:`tsqr`, but every node keeps its small Q.  Leaves of at most ``leaf_rows`` rows are factored where
    they are read; ``fan_in`` triangles at a time are stacked and factored until one is left; then each node's Q, times
    what its parent has for it, goes down again, and a leaf's Q times what it gets is its part of the whole Q.  Nothing is
    divided by R, so Q is orthonormal whatever the condition of A.  Every level is written to the shared folder.

    Rows need not have different keys.  Rows of different lengths, null rows and entries that are null are errors.  A matrix
    with fewer rows than columns has as many columns of Q as rows; one without rows has an R without any.
    """
    kind = rows.schema[key].dataType.simpleString()
    packed = rows.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("x"))
    lengths = packed.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.count("*").alias("n"), F.coalesce(F.max(F.exists("x", lambda v: v.isNull() | F.isnan(v))), F.lit(False)).alias("bad"), F.count("x").alias("known")).first()
    if not lengths["n"]:
        return packed.select(F.col("key").alias(key), F.col("x").alias("q")), np.zeros((0, 0))
    if lengths["lo"] != lengths["hi"] or lengths["known"] < lengths["n"] or lengths["bad"]:
        raise ShapeError(f"rows of {lengths['lo']} to {lengths['hi']} entries, {lengths['n'] - lengths['known']} of them null")
    width = lengths["hi"]

    def leaves(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), leaf_rows):
                part = batch.iloc[at : at + leaf_rows]
                q, r = np.linalg.qr(np.stack(part["x"].to_numpy()))
                yield pd.DataFrame({"node": [(task << 32) + made], "keys": [[None if k is pd.NA else k for k in part["key"]]], "q": [q.tobytes()], "r": [r.tobytes()]})
                made += 1

    def stacked(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("node")
        triangles = [_as_matrix(r, width) for r in parts["r"]]
        q, r = np.linalg.qr(np.vstack(triangles))
        ends = np.cumsum([len(t) for t in triangles])
        blocks = [q[end - len(t) : end].tobytes() for t, end in zip(triangles, ends, strict=True)]
        return pd.DataFrame({"child": parts["node"], "node": int(key[0]), "columns": q.shape[1], "q": blocks, "r": [r.tobytes()] + [None] * (len(parts) - 1)})

    leaf = cut_lineage(map_batches(packed, leaves, f"node long, keys array<{kind}>, q binary, r binary"))
    up, levels, n = leaf.select("node", "r"), [], leaf.count()
    while n > 1:
        groups = -(-n // fan_in)
        level = up.withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups))).groupBy("group").applyInPandas(stacked, "child long, node long, columns int, q binary, r binary")
        levels.append(cut_lineage(level))
        up = levels[-1].filter("r is not null").select("node", "r")
        n = up.count()
    r = _as_matrix(up.first()["r"], width)
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    down = rows.sparkSession.createDataFrame([(int(up.first()["node"]), len(signs), np.diag(signs).tobytes())], "node long, columns int, m binary")

    def passed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = [(_as_matrix(q, k) @ _as_matrix(m, c)).tobytes() for q, k, m, c in zip(batch["q"], batch["columns"], batch["m"], batch["down_columns"], strict=True)]
            yield pd.DataFrame({"node": batch["child"], "columns": batch["down_columns"], "m": m})

    for level in reversed(levels):
        above = down.select("node", F.col("columns").alias("down_columns"), "m")
        down = cut_lineage(level.select("child", "node", "columns", "q").join(above, "node").mapInPandas(passed, "node long, columns int, m binary"))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a leaf at a time; its keys are passed on as they are
                keys, q, m, columns = (batch.column(c).slice(i, 1) for c in ("keys", "q", "m", "columns"))
                product = np.frombuffer(q[0].as_py(), dtype=np.float64).reshape(len(keys[0]), -1) @ _as_matrix(m[0].as_py(), columns[0].as_py())
                yield pa.RecordBatch.from_arrays([keys, pa.array([list(product)], pa.list_(pa.list_(pa.float64())))], ["keys", "q"])

    found = leaf.select("node", "keys", "q").join(down, "node").mapInArrow(whole, f"keys array<{kind}>, q array<array<double>>")
    each = found.select(F.explode(F.arrays_zip("keys", "q")).alias("row")).select(F.col("row.keys").alias(key), F.col("row.q").alias("q"))
    return each, r * signs[:, None]
