"""Solvers, blocked factors, thin Q, mixed batches and heavy columns against numpy and by their plans."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocked, decomp, linalg, nn, solve, sparse, spectral
from tessera.plans import Reduction, mixed
from tessera.queries import factors
from tessera.session import shared_dir
from tessera.tensor import ShapeError, Tensor


def sparse_system(n, seed=2):
    """A sparse, symmetric, positive definite matrix, scaled badly, and a right side."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < 0.1, rng.normal(size=(n, n)), 0)
    a = a + a.T
    a += np.diag(3 * np.abs(a).sum(axis=1) + 0.1)
    d = 10.0 ** rng.integers(-2, 3, n)
    return a * d[:, None] * d, rng.normal(size=n)


def cells(spark, a, ids=None):
    ids = np.arange(len(a)) if ids is None else ids
    return spark.createDataFrame([(int(ids[i]), int(ids[j]), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


def vector(spark, b, ids=None):
    ids = np.arange(len(b)) if ids is None else ids
    return spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, b, strict=True)], "i long, v double")


def test_conjugate_gradients(spark):
    a, b = sparse_system(40)
    ids = np.arange(len(b)) * 7 + (1 << 60)
    found = solve.conjugate_gradients(cells(spark, a, ids), vector(spark, b, ids), 1e-12)
    x = {r.i: r.x for r in found.x.collect()}
    want = np.linalg.solve(a, b)
    assert found.converged and found.steps <= 25 and found.residual <= 1e-12
    assert np.allclose([x[i] for i in ids.tolist()], want, rtol=1e-6, atol=1e-9 * np.abs(want).max())


def test_a_solver_goes_on_after_its_last_step(spark):
    """The same folder: steps that are done are not done again, and the result is that of an undisturbed run."""
    a, b = sparse_system(30)
    whole = solve.conjugate_gradients(cells(spark, a), vector(spark, b), 1e-10)
    state = f"{shared_dir(spark)}/resumed"
    first = solve.conjugate_gradients(cells(spark, a), vector(spark, b), 1e-10, most=4, state=state)
    assert (first.steps, first.converged) == (4, False)
    log = spark.read.parquet(f"{state}/log")
    assert log.count() == 5
    # What a lost driver leaves behind: a state that was being written when it was lost.
    spark.range(3).withColumn("x", F.lit(9.9)).write.mode("overwrite").parquet(f"{state}/state-{1 - log.orderBy(F.desc('step')).first()['at']}")
    second = solve.conjugate_gradients(cells(spark, a), vector(spark, b), 1e-10, state=state)
    assert second.converged and second.steps == whole.steps
    assert {r.i: round(r.x, 9) for r in second.x.collect()} == {r.i: round(r.x, 9) for r in whole.x.collect()}


def test_solver_rejects_and_trivial(spark):
    a, b = sparse_system(12)
    with pytest.raises(ShapeError):
        solve.conjugate_gradients(cells(spark, np.array([[1.0, 2.0], [2.0, 1.0]])), vector(spark, [1.0, -1.0]))
    with pytest.raises(Exception, match="diagonal"):
        solve.conjugate_gradients(cells(spark, np.array([[1.0, 0.5], [0.5, 0.0]])), vector(spark, [1.0, 1.0]))
    zero = solve.conjugate_gradients(cells(spark, a), vector(spark, b * 0))
    assert zero.steps == 0 and zero.converged and {r.x for r in zero.x.collect()} == {0.0}


def test_mixed_batch_is_one_scan_and_one_shuffle(spark, tmp_path):
    rows = [(i, j if (i, j) != (2, 1) else None, float(i * 10 + j) if (i, j) != (1, 1) else None) for i in range(4) for j in range(3)]
    spark.createDataFrame(rows, "i long, j long, v double").write.parquet(str(tmp_path / "cells"))
    df = spark.read.parquet(str(tmp_path / "cells"))
    v = F.col("v")
    batch = {"all": Reduction("sum", v), "most": Reduction("max", v), "by_row": Reduction("mean", v, ("i",)), "by_column": Reduction("sum", v * v, ("j",)), "each": Reduction("min", v, ("i", "j"))}
    found = mixed(df, batch)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall("Expand", plan)) == 1
    ready = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange ", ready)) == 1
    got = {(r.name, r.i, r.j): r.v for r in found.collect()}
    known = [r for r in rows if r[2] is not None]
    want = {("all", None, None): sum(r[2] for r in known), ("most", None, None): max(r[2] for r in known)}
    for i in range(4):
        own = [r[2] for r in known if r[0] == i]
        want["by_row", i, None] = sum(own) / len(own)
    for j in {r[1] for r in rows}:
        want["by_column", None, j] = sum(r[2] ** 2 for r in known if r[1] == j)
    want |= {("each", r[0], r[1]): r[2] for r in known}
    assert {k: want.get(k) for k in want} == {k: got[k] for k in want}
    alone = mixed(df, {"all": Reduction("sum", v), "n": Reduction("max", v)}).collect()
    assert {r.name: r.v for r in alone} == {"all": want["all", None, None], "n": want["most", None, None]}
    assert mixed(df.limit(0), batch).count() == 0
    assert [(r.name, r.v) for r in mixed(df.limit(0), {"all": Reduction("sum", v)}).collect()] == [("all", 0.0)]


@pytest.mark.parametrize("n,width", [(500, 7), (65, 64), (3, 5), (1, 1)])
def test_thin_q(spark, n, width):
    """Leaves of 16 rows, three at a time; columns that nearly depend on each other; keys beyond 2^53 beside a null."""
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, width))
    if width > 2:
        a[:, 1] = a[:, 0] + 1e-9 * a[:, 1]
    keys = [None if i == 0 else (1 << 60) + i for i in range(n)]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, a, strict=True)], "id long, x array<double>").repartition(3)
    found, r = decomp.thin_q(rows, "id", "x", leaf_rows=16, fan_in=3)
    got = {x.id: x.q for x in found.collect()}
    q = np.array([got[k] for k in keys])
    k = min(n, width)
    assert q.shape == (n, k) and np.allclose(q.T @ q, np.eye(k), atol=1e-12) and np.allclose(q @ r, a, atol=1e-12)
    assert np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()


def test_thin_q_rejects(spark):
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, 2.0], None], [[1.0, None], [1.0, 2.0]]):
        with pytest.raises(ShapeError):
            decomp.thin_q(spark.createDataFrame(list(enumerate(bad)), "id int, x array<double>"), "id", "x")
    none, r = decomp.thin_q(spark.createDataFrame([], "id int, x array<double>"), "id", "x")
    assert none.count() == 0 and r.shape == (0, 0)


def packed(spark, a, parts=4):
    return spark.createDataFrame(pa.table({"i": np.arange(len(a)), "x": pa.array(list(a), pa.list_(pa.float64()))})).repartition(parts)


@pytest.mark.parametrize("n,width", [(150, 16), (40, 64), (9, 1)])
def test_large_lu(spark, n, width):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n)) * (10.0 ** rng.integers(-3, 3, n))[:, None]
    a[0, 0] = 0
    found = sorted(blocked.lu(packed(spark, a), width).collect(), key=lambda r: r.k)
    lower, upper = np.eye(n), np.zeros((n, n))
    for r in found:
        lower[r.k, : r.k], upper[r.k, r.k :] = r.l, r.u
        assert len(r.l) == r.k
    assert sorted(r.i for r in found) == list(range(n))
    assert np.allclose(lower @ upper, a[[r.i for r in found]], rtol=1e-9, atol=1e-12 * np.abs(a).max())
    assert np.abs(lower).max() < 50  # pivots from a tournament keep multipliers small


@pytest.mark.parametrize("n,width", [(150, 16), (20, 64)])
def test_large_cholesky(spark, n, width):
    x = np.random.default_rng(n).normal(size=(n, n + 5))
    a = x @ x.T
    r = np.zeros((n, n))
    for row in blocked.cholesky(packed(spark, np.triu(a)), width).collect():  # only the upper triangle is read
        assert row.i == row.k
        r[row.k, row.k :] = row.u
    assert np.allclose(r, np.linalg.cholesky(a).T)


def test_large_factors_reject(spark):
    with pytest.raises(ShapeError, match="positive definite"):
        blocked.cholesky(packed(spark, np.array([[1.0, 2.0], [2.0, 1.0]])), 1)
    with pytest.raises(ShapeError, match="singular"):
        blocked.lu(packed(spark, np.array([[1.0, 2.0], [2.0, 4.0]])))
    with pytest.raises(ShapeError, match="square"):
        blocked.lu(packed(spark, np.ones((2, 3))))
    assert blocked.lu(packed(spark, np.ones((0, 0)))).count() == 0
    t = Tensor(spark.createDataFrame([(2, 0, 5.0), (0, 1, 4.0)], "i long, j long, v double"), ("i", "j"), (3, 3))
    assert sorted((r.i, r.x) for r in blocked.rows_of(t).collect()) == [(0, [0.0, 4.0, 0.0]), (1, [0.0] * 3), (2, [5.0, 0.0, 0.0])]


@pytest.mark.parametrize("name,kept", [("large_cholesky", 0.5), ("large_lu", 1.0)])
def test_large_factors_keep_their_tiles_only(spark, tmp_path, name, kept):
    """Of n^2 entries none is shuffled or written, but those of the factors, once."""
    n, rng = 300, np.random.default_rng(3)
    items = {"l_suppkey": rng.integers(0, n - 1, 4000), "l_partkey": rng.integers(0, 500, 4000), "l_quantity": rng.integers(1, 50, 4000).astype(float)}
    pq.write_table(pa.table({"s_suppkey": np.arange(n)}), tmp_path / "supplier.parquet")  # the last one has no line items
    pq.write_table(pa.table(items), tmp_path / "lineitem.parquet")

    def size():
        return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())

    before = size()
    found = factors.QUERIES[name](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert size() - before < 1.5 * kept * n * n * 8
    b = np.zeros((n, 97))
    np.add.at(b, (items["l_suppkey"], items["l_partkey"] % 97), items["l_quantity"] / 100)
    want = b @ b.T + np.diag(1.0 + np.arange(n) % 7)
    if name == "large_lu":
        want = np.tril(want, -1) * 2 + np.diag(np.diag(want) * 0.01234567) + np.triu(want, 1)
    got = found.toPandas()
    assert sorted(zip(got["i"], got["j"], strict=True)) == [(i, j) for i in range(n) for j in range(n)]
    assert np.allclose(got["v"], want[got["i"], got["j"]], atol=6e-5)


def test_singular_pairs(spark):
    """Against all of numpy's, with repeated cells, ids that are no small numbers, and a matrix of rank 2."""
    rng = np.random.default_rng(4)
    u, v = np.linalg.qr(rng.normal(size=(30, 20)))[0], np.linalg.qr(rng.normal(size=(20, 20)))[0]
    a = (u * 0.5 ** np.arange(20)) @ v.T * 8
    df = spark.createDataFrame([((1 << 40) + i, 3 * j, float(a[i, j]) / 2) for i in range(30) for j in range(20)] * 2, "i long, j long, v double")
    found = spectral.singular_pairs(df, 2, more=4)
    assert found.converged and np.allclose(found.values, np.linalg.svd(a, compute_uv=False)[:2])
    left = np.array([r.x for r in sorted(found.left.collect(), key=lambda r: r.i)])
    right = np.array([r.x for r in sorted(found.right.collect(), key=lambda r: r.j)])
    assert np.allclose(a @ right, left * found.values, atol=1e-5) and np.allclose(left.T @ left, np.eye(2)) and np.allclose(right.T @ right, np.eye(2))
    assert len(spectral.singular_pairs(df.limit(0), 2).values) == 0
    one = spectral.singular_pairs(spark.createDataFrame([(5, 7, -3.0)], "i long, j long, v double"), 2)
    assert np.allclose(one.values, [3.0])


def test_singular_pairs_leave_the_long_side_in_its_tasks(spark):
    """More steps write no more vectors of the longer side, be it rows or columns."""
    n, width = 3000, 4
    a = np.random.default_rng(8).normal(size=(n, 6))
    tall = cells(spark, a).persist()

    def size():
        return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())

    written = []
    for most in (1, 5):
        before = size()
        found = spectral.singular_pairs(tall, 1, more=width - 1, tolerance=0.0, most=most)
        assert found.steps == most
        written.append(size() - before)
    assert written[1] - written[0] < n * width * 8
    wide = spectral.singular_pairs(tall.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), 2, more=4)
    left = np.array([r.x for r in sorted(wide.left.collect(), key=lambda r: r.i)])
    right = np.array([r.x for r in sorted(wide.right.collect(), key=lambda r: r.j)])
    assert wide.converged and np.allclose(wide.values, np.linalg.svd(a, compute_uv=False)[:2])
    assert np.allclose(a.T @ right, left * wide.values, atol=1e-5) and np.allclose(right.T @ right, np.eye(2))


def test_singular_pairs_of_a_long_block(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 0)
    a = np.random.default_rng(9).normal(size=(30, 20))
    assert np.allclose(spectral.singular_pairs(cells(spark, a), 1, most=4, tolerance=0.0).values, np.linalg.svd(a, compute_uv=False)[:1], rtol=0.05)


def test_fluent(spark):
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    t, b = Tensor.from_numpy(spark, a), Tensor.from_numpy(spark, np.array([1.0, 2.0]), ("i",))
    assert np.allclose((t @ t.transpose()).to_numpy(), a @ a.T) and np.allclose(t.power(3).to_numpy(), a @ a @ a) and t.trace() == 7
    assert t.norms() == {"l1": 9.0, "l2": np.sqrt(27), "max": 4.0} and t.reduce("sum", "max") == {"sum": 9.0, "max": 4.0}
    assert np.allclose(t.solve(b).to_numpy(), np.linalg.solve(a, [1.0, 2.0])) and t.along("i", "max").to_numpy().tolist() == [4, 3]
    assert sorted((r.k, r.u) for r in t.cholesky().collect())[1][1] == [pytest.approx(np.sqrt(2.75))] and t.lu().count() == 2 and t.kron(t).shape == (4, 4)
    with pytest.raises(ShapeError):
        t.solve(Tensor.from_numpy(spark, np.zeros(3), ("i",)))


def test_only_wanted_gradients(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(0, p, *(rng.normal(size=2).tolist() for _ in range(4))) for p in range(5)], "b long, p long, q array<double>, k array<double>, v array<double>, g array<double>")
    every = {(r.part, r.p, r.d): r.v for r in nn.attention_blocked_backward(rows, 0.5).collect()}
    for wanted in ("v", "kq"):
        assert {(r.part, r.p, r.d): r.v for r in nn.attention_blocked_backward(rows, 0.5, wanted=wanted).collect()} == {k: v for k, v in every.items() if k[0] in wanted}
    with pytest.raises(ShapeError):
        nn.attention_blocked_backward(rows, 0.5, wanted="x")
    x, w = Tensor.from_numpy(spark, rng.normal(size=(1, 1, 4)), ("b", "c", "x")), Tensor.from_numpy(spark, rng.normal(size=(1, 1, 2)), ("o", "c", "k"))
    up = Tensor.from_numpy(spark, rng.normal(size=(1, 1, 3)), ("b", "o", "x"))
    assert list(nn.conv_backward(x, w, up, [1], [0], [1], wanted=("bias",))) == ["bias"]


def test_heavy_columns_are_parted(spark, monkeypatch):
    """A column with a third of all entries: the same product, and no key of the join with more than its share."""
    rng = np.random.default_rng(0)
    n = 3000
    at = sorted({(int(i), 7 if i % 3 == 0 else int(k)) for i, k in zip(rng.integers(0, 2000, n), rng.integers(0, 50, n), strict=True)})
    a = Tensor(spark.createDataFrame([(i, k, 1.0 + (i + k) % 5) for i, k in at], "i long, k long, v double"), ("i", "k"), (2000, 50))
    x = rng.normal(size=(50, 3))
    b = Tensor(spark.createDataFrame([(k, j, float(x[k, j])) for k in range(50) for j in range(3)], "k long, j long, v double"), ("k", "j"), (50, 3))
    dense = np.zeros((2000, 50))
    for i, k in at:
        dense[i, k] = 1.0 + (i + k) % 5
    monkeypatch.setattr("tessera.tensor.SMALL", 1)
    monkeypatch.setattr(sparse, "HEAVY", 64)
    met = sparse._met(a.df.toDF("i", "_k", "_a"), b, ("j",))
    most = met.groupBy("_k", "_salt").count().agg(F.max("count")).first()[0]
    assert most <= 3 * 2 * 64
    got = {(r.i, r.j): r.v for r in sparse.spmm(a, b, dense=False).df.collect()}
    want = dense @ x
    assert all(np.isclose(v, want[k]) for k, v in got.items()) and len(got) == 3 * len({i for i, _ in at})
    y = Tensor(b.df.filter("j = 0").select("k", "v"), ("k",), (50,))
    assert all(np.isclose(r.v, want[r.i, 0]) for r in sparse.spmv(a, y, dense=False).df.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_of_different_lengths_are_an_error(spark, parts):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0]), (1, [1.0]), (0, None)], "m int, x array<double>").repartition(parts)
    with pytest.raises(Exception, match="different lengths in matrix 0"):
        linalg.grams(rows, "x").collect()
    assert linalg.grams(rows.filter("m = 1 or x is null"), "x").collect()[0].v == 1.0


def test_momentum_fold_keeps_keys(spark):
    keys = [(1 << 60) + 1, (1 << 60) + 3, None]
    rows = spark.createDataFrame([(k, o, float(o)) for k in keys for o in range(3)], "k long, o int, g double").coalesce(1)
    got = nn.momentum_fold(rows, "k", "o", "g", 1.0, 0.1, 0.5).collect()
    assert sorted((r.k for r in got), key=str) == sorted(keys, key=str) and len({(round(r.p, 9), round(r.s, 9)) for r in got}) == 1
    names = spark.createDataFrame([(k, o, float(o)) for k in ("a", None) for o in range(3)], "k string, o int, g double").coalesce(1)
    assert sorted((r.k for r in nn.momentum_fold(names, "k", "o", "g", 1.0, 0.1, 0.5).collect()), key=str) == sorted([None, "a"], key=str)
