from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import tensor as tensors
from tessera.operators import decomp, field, linalg, nn, random, reduce, scan, sparse, vector
from tessera.plans import Prepared, batch, tagged
from tessera.tensor import ShapeError, Tensor


def tensor(spark, a, dims=None):
    return Tensor.from_numpy(spark, np.array(a, dtype=float), dims)


def test_views(spark):
    a = np.arange(24.0).reshape(4, 6)
    t = tensor(spark, a)
    assert np.array_equal(t.transpose().to_numpy(), a.T)
    assert np.array_equal(t.slice("j", 1, 6, 2).to_numpy(), a[:, 1:6:2])
    assert np.array_equal(t.reshape((3, 8)).to_numpy(), a.reshape(3, 8))
    assert np.array_equal(t.diagonal().to_numpy(), np.diag(a))
    assert np.array_equal(t.expand("b", 2).to_numpy(), np.stack([a, a]))
    assert np.array_equal((2 - t * 3).to_numpy(), 2 - a * 3)
    assert np.array_equal(Tensor.full(spark, (2, 3), 4.0).to_numpy(), np.full((2, 3), 4.0))
    with pytest.raises(ShapeError):
        t.reshape((5, 5))
    with pytest.raises(ShapeError):
        t + tensor(spark, np.ones((3, 6)))


def test_broadcast(spark):
    a, row = np.arange(6.0).reshape(2, 3), np.array([1.0, 2.0, 3.0])
    for both in (tensor(spark, a) + tensor(spark, row, ("j",)), tensor(spark, row, ("j",)) + tensor(spark, a)):
        assert np.array_equal(both.to_numpy(), a + row)
        assert "BroadcastHashJoin" in both.df._jdf.queryExecution().executedPlan().toString()


def test_reductions(spark):
    t = tensor(spark, [[1, 2, 3, 2]] * 3)
    assert reduce.full(t, "prod").first()["prod"] == 1728
    m = tensor(spark, np.arange(1, 13).reshape(3, 4))
    assert reduce.axis(m, "i", "prod").to_numpy().tolist() == [45, 120, 231, 384]
    assert reduce.axis(m, "j", "prod").to_numpy().tolist() == [24, 1680, 11880]
    assert reduce.axis(m.transpose(), "j", "prod").to_numpy().tolist() == [24, 1680, 11880]
    empty = Tensor(m.df.limit(0), m.dims, (0, 4))
    assert tuple(reduce.full(empty, "sum", "prod", "min", "max").first()) == (0, 1, reduce.LARGEST, -reduce.LARGEST)
    assert reduce.axis(empty, "i", "sum").to_numpy().tolist() == [0] * 4
    with pytest.raises(ShapeError):
        reduce.axis(empty, "i", "max")
    with pytest.raises(ShapeError):
        reduce.trace(m)
    assert reduce.trace(tensor(spark, [[1, 2], [3, 4]])).first()["trace"] == 5
    assert reduce.dot(tensor(spark, [1, 2, 3]), tensor(spark, [4, 5, 6])).first()["dot"] == 32
    assert tuple(reduce.norms(tensor(spark, [3, -4])).first()) == (7, 5, 4)


def test_scans(spark):
    t = tensor(spark, [[1, 2, 3, 2]] * 3)
    assert scan.cumsum(t, "j").to_numpy()[0].tolist() == [1, 3, 6, 8]
    assert scan.suffix_sum(t, "j").to_numpy()[0].tolist() == [8, 7, 5, 2]
    assert scan.cumsum(t, "i").to_numpy().tolist() == [[1, 2, 3, 2], [2, 4, 6, 4], [3, 6, 9, 6]]
    assert scan.cumprod(t, "j").to_numpy()[0].tolist() == [1, 2, 6, 12]
    assert scan.suffix_prod(t, "j").to_numpy()[0].tolist() == [12, 12, 6, 2]


def test_tall_lines(spark, monkeypatch):
    a = np.random.default_rng(4).integers(1, 9, size=(50, 3)).astype(float)
    monkeypatch.setattr(scan, "CHUNK", 8)
    assert np.array_equal(scan.cumsum(tensor(spark, a), "i").to_numpy(), a.cumsum(axis=0))
    assert np.array_equal(scan.suffix_sum(tensor(spark, a), "i").to_numpy(), a[::-1].cumsum(axis=0)[::-1])


def test_combine_in_order(spark):
    """x -> the right one unless it is 0: associative, but not commutative."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 4, size=(40, 2)).astype(float)
    want = a.copy()
    for i in range(1, 40):
        want[i] = np.where(a[i] == 0, want[i - 1], a[i])
    t = tensor(spark, a)
    last = lambda x, y: F.when(y == 0, x).otherwise(y)
    got = scan.scan_with(t.df.filter("i <> 7 or j <> 1"), ["j"], "i", last, 40, chunk=3)
    assert all(r["scan"] == want[r["i"], r["j"]] for r in got.collect() if (r["i"], r["j"]) != (8, 1) or a[8, 1]) and got.count() == 79
    assert np.array_equal(reduce.axis_combine(t, "i", last, 0.0, chunk=3).to_numpy(), want[-1])


@pytest.mark.parametrize("reverse", [False, True])
def test_long_line(spark, reverse):
    xs = np.random.default_rng(1).integers(1, 9, 1000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i long, v double")
    got = [r["scan"] for r in scan.long_line(df, "i", reverse=reverse, chunk=64).orderBy("i").collect()]
    assert got == (np.cumsum(xs[::-1])[::-1] if reverse else np.cumsum(xs)).tolist()


def test_vectors(spark):
    a, b = tensor(spark, [8, 6, 4, 2]), tensor(spark, [2, 4, 8, 0.5])
    assert vector.subtract(a, b).to_numpy().tolist() == [6, 2, -4, 1.5]
    assert vector.multiply(a, b).to_numpy().tolist() == [16, 24, 32, 1]
    assert vector.divide(a, b).to_numpy().tolist() == [4, 1.5, 0.5, 4]
    assert vector.axpy(2, a, b).to_numpy().tolist() == [18, 16, 16, 4.5]
    assert vector.xpay(2, a, b).to_numpy().tolist() == [12, 14, 20, 3]
    with pytest.raises(ShapeError):
        vector.add(a, tensor(spark, [1]))


def test_products(spark, monkeypatch):
    a, b = np.array([[1, 2], [3, 4.0]]), np.array([[5, 6], [7, 8.0]])
    x, y = tensor(spark, a), tensor(spark, b)
    assert linalg.matmul(x, y).to_numpy().tolist() == [[19, 22], [43, 50]]
    assert linalg.matmul(x.transpose(), y).to_numpy().tolist() == [[26, 30], [38, 44]]
    assert np.array_equal(linalg.kron(x, tensor(spark, [[0, 1], [1, 0]])).to_numpy(), np.kron(a, [[0, 1], [1, 0]]))
    assert np.array_equal(linalg.matpow(x, 5).to_numpy(), np.linalg.matrix_power(a, 5))
    assert np.array_equal(linalg.matpow(x, 0).to_numpy(), np.eye(2))
    both = tensor(spark, [np.eye(2), a], ("b", "i", "k"))
    one = tensor(spark, [b], ("b", "k", "j"))
    assert linalg.batched_matmul(both, one).to_numpy().ravel().tolist() == [5, 6, 7, 8, 19, 22, 43, 50]
    with monkeypatch.context() as large:
        large.setattr(tensors, "SMALL", 0)
        p, q = np.random.default_rng(8).normal(size=(3, 2, 5)), np.random.default_rng(9).normal(size=(3, 5, 4))
        for u, w in ((p, q), (p[:1], q), (p, q[:1])):
            assert np.allclose(linalg.batched_matmul(tensor(spark, u), tensor(spark, w)).to_numpy(), u @ w)
    assert linalg.matmul(tensor(spark, np.zeros((2, 0))), tensor(spark, np.zeros((0, 3)))).to_numpy().tolist() == [[0] * 3] * 2
    big = np.random.default_rng(2).normal(size=(30, 20))
    assert np.allclose(linalg.matmul_blocked(tensor(spark, big), tensor(spark, big.T), 8).to_numpy(), big @ big.T)
    holes = Tensor(tensor(spark, [[1, -1], [2, 0], [0, 3]]).df.filter("v <> 0"), ("i", "j"), (3, 2))
    other = tensor(spark, [[1, 2], [1, 5]])
    cells = [sorted(map(tuple, f(holes, other).df.collect())) for f in (linalg.matmul, linalg.matmul_blocked, lambda a, b: linalg.matmul_blocked(a, b, 1))]
    assert cells[0] == cells[1] == cells[2] and (0, 0, 0.0) in cells[0]  # a sum of zero is an entry
    packed = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])], "i long, x array<double>")
    assert [r.x for r in linalg.matmul_rows(packed, "x", y).orderBy("i").collect()] == [[19, 22], None, [43, 50]]
    wide = linalg.gram(packed, "x")
    assert np.array_equal(wide.to_numpy(), a.T @ a)
    with pytest.raises(ShapeError):
        linalg.matmul(x, tensor(spark, np.ones((3, 2))))


def test_sparse(spark):
    m = sparse.validate(sparse.from_csr(spark, [2, 1, 3, 4, 5], [0, 2, 1, 0, 2], [0, 2, 3, 5], (3, 3)))
    assert sparse.spmv(m, tensor(spark, [1, 2, 3], ("k",))).to_numpy().tolist() == [5, 6, 19]
    both = sparse.spmv_many(m, [tensor(spark, [1, 2, 3], ("k",)), tensor(spark, [2, 0, 1], ("k",))])
    assert [v.to_numpy().tolist() for v in both] == [[5, 6, 19], [5, 0, 13]]
    assert np.array_equal(sparse.from_dense(sparse.to_dense(m)).to_numpy(), m.to_numpy())
    with pytest.raises(ShapeError):
        sparse.from_csr(spark, [1, 1], [1, 0], [0, 2], (1, 2))
    with pytest.raises(ShapeError):
        sparse.validate(Tensor(m.df.unionByName(m.df), m.dims, m.shape))


def test_convolution(spark):
    x, w = tensor(spark, [[[1, 2, 3, 4]]], ("b", "c", "x")), tensor(spark, [[[2, -1]]], ("o", "c", "kx"))
    bias = spark.createDataFrame([(0, 1.0)], "o long, v double")
    assert nn.conv(x, w, bias, [1], [0], [1]).to_numpy().ravel().tolist() == [1, 2, 3]
    g = nn.conv_backward(x, w, tensor(spark, [[[1, -2, 3]]], ("b", "o", "x")), [1], [0], [1])
    assert [r["v"] for r in g["input"].orderBy("x").collect()] == [2, -5, 8, -3]
    assert [r["v"] for r in g["weight"].orderBy("kx").collect()] == [6, 8]
    assert g["bias"].first()["v"] == 2
    t = nn.conv(tensor(spark, [[[1, -2, 3]]], ("b", "c", "x")), tensor(spark, [[[1, 2]]], ("c", "o", "kx")), None, [2], [1], [1], True, [1])
    assert t.to_numpy().ravel().tolist() == [2, -2, -4, 3, 6]
    square = nn.conv(tensor(spark, np.arange(9).reshape(1, 1, 3, 3), ("b", "c", "x", "y")), tensor(spark, np.ones((1, 1, 2, 2)), ("o", "c", "kx", "ky")), None, [1, 1], [0, 0], [1, 1])
    assert square.to_numpy()[0, 0].tolist() == [[8, 12], [20, 24]]


def test_attention(spark):
    zero = tensor(spark, np.zeros((1, 2, 2)), ("b", "s", "d"))
    v = tensor(spark, [[[2, 4], [6, 10]]], ("b", "s", "e"))
    assert nn.attention(zero, zero, v, 1.0).to_numpy()[0].tolist() == [[4, 7], [4, 7]]
    assert nn.attention(zero, zero, v, 1.0, causal=True).to_numpy()[0].tolist() == [[2, 4], [4, 7]]
    wrong = tensor(spark, [[[2, float("inf")], [6, 10]]], ("b", "s", "e"))
    for args in ((zero, zero, wrong), (wrong, zero, v), (zero, wrong, v)):
        with pytest.raises(Exception, match="non-finite"):
            nn.attention(*args, 1.0).df.collect()
    rng = np.random.default_rng(8)
    q, k, e = rng.normal(size=(2, 5, 3)), rng.normal(size=(2, 7, 3)), rng.normal(size=(2, 7, 4))  # more keys than queries
    w = np.exp(q @ k.transpose(0, 2, 1) / 3**0.5)
    got = nn.attention(tensor(spark, q, ("b", "s", "d")), tensor(spark, k, ("b", "s", "d")), tensor(spark, e, ("b", "s", "e")), block=3).to_numpy()
    assert np.allclose(got, w / w.sum(axis=2, keepdims=True) @ e)
    none = spark.createDataFrame([], "b long, k long")
    assert nn.attention(zero, zero, v, 1.0, keep=none).to_numpy()[0].tolist() == [[0, 0], [0, 0]]


def test_attention_gradients_are_slopes(spark):
    rng = np.random.default_rng(3)
    q, k, v, g = (rng.normal(size=(1, 3, 2)) for _ in range(4))

    def loss(q, k, v):
        s = q[0] @ k[0].T * 0.5
        w = np.exp(s - s.max(1, keepdims=True))
        return ((w / w.sum(1, keepdims=True)) @ v[0] * g[0]).sum()

    got = nn.attention_backward(*(tensor(spark, a, ("b", "s", "d")) for a in (q, k, v, g)), 0.5)
    for at, name in enumerate("qkv"):
        for r in got[name].collect():
            args = [[a.copy() for a in (q, k, v)] for _ in range(2)]
            args[0][at][r[0], r[1], r[2]] -= 1e-6
            args[1][at][r[0], r[1], r[2]] += 1e-6
            assert abs((loss(*args[1]) - loss(*args[0])) / 2e-6 - r["v"]) < 1e-6


def test_cross_entropy(spark):
    x, t = np.array([[0, 2, 1], [-1, 3, 0.0]]), [2, 0]
    logits = tensor(spark, x).df
    targets = spark.createDataFrame(list(enumerate(t)), "n long, t long")
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    assert abs(nn.cross_entropy(logits, targets).first()["loss"] + np.log(p[[0, 1], t]).mean()) < 1e-12
    p[[0, 1], t] -= 1
    got = Tensor(nn.cross_entropy_backward(logits, targets, 2), ("n", "c"), (2, 3)).to_numpy()
    assert np.allclose(got, p / 2)
    packed = spark.createDataFrame([(i, r.tolist(), t[i], [1.0] * 3) for i, r in enumerate(x)], "n long, x array<double>, t long, into array<double>")
    rows = {r.n: r for r in nn.cross_entropy_rows(packed, 2).collect()}
    assert np.allclose([rows[i].g for i in range(2)], p / 2 + 1) and np.isclose(np.mean([r.loss for r in rows.values()]), nn.cross_entropy(logits, targets).first()["loss"])
    aims = {"out of range": [(0, 3), (1, 0)], "below": [(0, -1), (1, 0)], "missing": [(0, 1)], "null": [(0, 1), (1, None)], "twice": [(0, 1), (1, 0), (1, 2)], "of no row": [(0, 1), (1, 0), (2, 0)]}
    for bad in aims.values():
        with pytest.raises(Exception, match="target"):
            nn.cross_entropy(logits, spark.createDataFrame(bad, "n long, t long")).collect()
    for wrong in (float("nan"), float("inf"), None):
        odd = logits.withColumn("v", F.when(F.col("j") == 1, F.lit(wrong).cast("double")).otherwise(F.col("v")))
        with pytest.raises(Exception, match="non-finite"):
            nn.cross_entropy_backward(odd, targets, 2).collect()
    for column, value in (("x", F.array(F.lit(float("nan")))), ("t", F.lit(7)), ("t", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="non-finite logits or targets out of range"):
            nn.cross_entropy_rows(packed.withColumn(column, value)).collect()


def test_optimizers(spark):
    df = spark.createDataFrame([(1.0, 0.1, 0.5, 0.25)], "p double, g double, s0 double, s1 double")
    r = nn.sgd(0.05, 0.9).apply(df).first()
    assert (round(r.p, 12), round(r.s0, 12)) == (round(1 - 0.05 * 0.55, 12), 0.55)
    m, v = 0.5 * 0.9 + 0.01, 0.25 * 0.99 + 0.0001
    step = 0.01 * (m / (1 - 0.9**3)) / (math.sqrt(v / (1 - 0.99**3)) + 1e-6)
    assert abs(nn.adam(0.01, 0.9, 0.99, 1e-6, 3, 0.1).apply(df).first().p - (0.999 - step)) < 1e-12
    for bad in (lambda: nn.sgd(-1.0), lambda: nn.sgd(1.0, 1.0), lambda: nn.rmsprop(0.1, 0.9, 0.0), lambda: nn.adam(0.1, 0.9, 0.9, 1e-6, 0)):
        with pytest.raises(ValueError):
            bad()
    folded = nn.momentum_fold(spark.createDataFrame([(1, 2, 3.0), (1, 1, 1.0)], "k long, o long, g double"), "k", "o", "g", 1.0, 0.1, 0.9).first()
    assert abs(folded.p - 0.51) < 1e-12


def test_momentum_of_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(o), float(g)) for o, (k, g) in enumerate(zip(np.where(rng.random(900) < 0.9, 0, rng.integers(1, 9, 900)), rng.normal(size=900), strict=True))]
    want = {}
    for k, _, g in rows:
        p, s = want.get(k, (1.0, 0.0))
        s = s * 0.9 + g
        want[k] = p - 0.1 * s, s
    df = spark.createDataFrame([*rows, (None, 1, 2.0), (None, 2, None)], "k long, o long, g double").repartition(3)
    got = {r.k: (r.p, r.s) for r in nn.momentum_fold(df, "k", "o", "g", 1.0, 0.1, 0.9).collect()}
    assert np.allclose(got.pop(None), (1.0 - 0.2 - 0.18, 1.8))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert nn.momentum_fold(df.limit(0), "k", "o", "g", 1.0, 0.1, 0.9).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("boundary", ["dirichlet", "neumann", "periodic"])
def test_tiles_do_not_show(spark, monkeypatch, boundary):
    a = np.random.default_rng(5).normal(size=(13, 9))
    t = tensor(spark, a, ("x", "y"))
    one = field.laplacian(t, (0.5, 2.0), boundary)
    assert exchanges(one.df) == 1
    monkeypatch.setitem(field.TILES, 2, 4)
    many = field.laplacian(t, (0.5, 2.0), boundary)
    assert many.df.count() == a.size and np.allclose(one.to_numpy(np.nan), many.to_numpy(np.nan))


def test_tiles_of_time_steps_do_not_show(spark, monkeypatch):
    rng, shape = np.random.default_rng(7), (7, 5, 6)
    rows = [(*map(int, at), *map(float, rng.random(4)), 2.0, 1.5) for at in np.ndindex(shape)]
    cells = spark.createDataFrame(rows, "x long, y long, z long, p double, vx double, vy double, vz double, rho double, c double")
    one = field.fdtd_step(cells, shape, 0.1, 1.0)
    assert exchanges(one) == 1
    monkeypatch.setitem(field.TILES, 3, 3)
    many = field.fdtd_step(cells, shape, 0.1, 1.0)
    assert np.allclose(sorted(map(tuple, one.collect())), sorted(map(tuple, many.collect())))


def test_laplacian(spark):
    x, y = np.meshgrid(np.arange(4.0), np.arange(4.0), indexing="ij")
    t = tensor(spark, x**2 + y**2, ("x", "y"))
    assert (field.laplacian(t).to_numpy()[1:3, 1:3] == 4).all()
    assert (field.laplacian(t, boundary="neumann").to_numpy() == 4).all()
    a = np.random.default_rng(9).normal(size=(6, 5))
    a[-1], a[:, -1] = a[0], a[:, 0]
    a[-1, -1] = a[0, 0]
    want = sum(np.roll(a[:-1, :-1], d, axis) for d in (1, -1) for axis in (0, 1)) - 4 * a[:-1, :-1]
    assert np.allclose(field.laplacian(tensor(spark, a, ("x", "y")), boundary="periodic").to_numpy()[:-1, :-1], want)


def test_rays(spark):
    uniform = Tensor.full(spark, (9, 5, 5), 0.25, ("ix", "iy", "iz"))
    rays = spark.createDataFrame([(0, -10.0, 4.0, 4.0, 1.0, 0.0, 0.0), (1, -10.0, 100.0, 4.0, 1.0, 0.0, 0.0), (2, -1.0, -1.0, 4.0, 1.0, 1.0, 0.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.ray: r.v for r in field.ray_integrals(uniform.df, (9, 5, 5), (0.0, 0.0, 0.0), 2.0, rays, 0.5).collect()}
    assert abs(got[0] - 4.0) < 1e-9 and got[1] == 0 and abs(got[2] - 0.25 * 8 * math.sqrt(2)) < 1e-9


def test_random(spark):
    a, b = random.uniform(spark, (3, 4), -1, 2, 42).to_numpy(), random.uniform(spark, (3, 4), -1, 2, 43).to_numpy()
    assert ((a >= -1) & (a < 2)).all() and (a != b).any()
    assert np.array_equal(a, random.uniform(spark, (3, 4), -1, 2, 42).to_numpy())
    z = random.normal(spark, (5000,), 3, 2, 1).to_numpy()
    assert abs(z.mean() - 3) < 0.2 and abs(z.std() - 2) < 0.2
    with pytest.raises(ValueError):
        random.uniform(spark, (1,), 2, 1, 0)


def factors(spark, a, kind):
    df = tensor(spark, a).df.withColumn("m", F.lit(7))
    rows = decomp.factor(df, kind).collect()
    out = {}
    for part in {r.part for r in rows}:
        own = [r for r in rows if r.part == part]
        x = np.zeros((max(r.i for r in own) + 1, max(r.j for r in own) + 1))
        for r in own:
            x[r.i, r.j] = r.v
        out[part] = x
    return out


def test_decompositions_in_spark(spark):
    f = factors(spark, [[0, 2, 1], [1, 1, 1], [2, 4, 1]], "lu")
    assert abs(f["det"][0, 0] - 4) < 1e-12
    a = spark.createDataFrame([(0, i, j, float(v)) for i, row in enumerate([[0, 2, 1], [1, 1, 1], [2, 4, 1]]) for j, v in enumerate(row)], "m long, i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 3.0), (0, 1, 3.0), (0, 2, 7.0)], "m long, i long, v double")
    assert np.allclose([r.v for r in decomp.solve(a, b).orderBy("i").collect()], [1, 1, 1])
    one = spark.createDataFrame([(0, 0, 0, 1.0)], "m long, i long, j long, v double")
    assert decomp.factor(one, "det", (2, 2)).first().v == 0 and decomp.factor(one, "matrix_rank", (3, 2)).first().v == 1
    with pytest.raises(Exception, match="needs its shape"):
        decomp.factor(one.unionByName(one.withColumn("i", F.lit(1))).unionByName(one.withColumn("j", F.lit(1))), "det").collect()
    with pytest.raises(Exception, match="not positive definite"):
        factors(spark, [[1, 2], [2, 1]], "cholesky")
    with pytest.raises(Exception, match="singular"):
        factors(spark, [[1, 2], [2, 4]], "lu")


@pytest.mark.parametrize("seed", range(4))
def test_kernels(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(6, 6))
    s = a + a.T
    spd = a @ a.T + np.eye(6)
    eye = np.eye(6)
    f = decomp.lu(a)
    assert np.allclose(f["l"] @ f["u"], a[f["p"][:, 0]]) and np.isclose(f["det"], np.linalg.det(a)) and np.allclose(np.tril(f["u"], -1), 0)
    f = decomp.full_piv_lu(a)
    assert np.allclose(f["l"] @ f["u"], a[f["p"][:, 0]][:, f["q"][:, 0]]) and f["rank"] == 6 and np.isclose(f["det"], np.linalg.det(a))
    f = decomp.col_piv_qr(a)
    assert np.allclose(f["q"] @ f["r"], a[:, f["p"][:, 0]]) and np.allclose(f["q"].T @ f["q"], eye) and (np.diff(np.abs(np.diag(f["r"]))) <= 1e-9).all()
    f = decomp.cholesky(spd)
    assert np.allclose(f["l"] @ f["l"].T, spd) and np.allclose(np.triu(f["l"], 1), 0)
    f = decomp.udu(spd)
    assert np.allclose(f["u"] @ np.diag(f["d"][:, 0]) @ f["u"].T, spd) and np.allclose(np.tril(f["u"], -1), 0)
    f = decomp.bunch_kaufman(s)
    p = f["p"][:, 0]
    assert np.allclose(f["l"] @ f["d"] @ f["l"].T, s[p][:, p]) and np.allclose(np.triu(f["l"], 1), 0)
    f = decomp.hessenberg(a)
    assert np.allclose(f["q"] @ f["h"] @ f["q"].T, a) and np.allclose(np.tril(f["h"], -2), 0) and np.allclose(f["q"].T @ f["q"], eye)
    f = decomp.schur(a)
    assert np.allclose(f["q"] @ f["t"] @ f["q"].T, a) and np.allclose(np.tril(f["t"], -2), 0) and np.allclose(f["q"].T @ f["q"], eye)
    below = np.diag(f["t"], -1) != 0
    assert not (below[1:] & below[:-1]).any()
    f = decomp.bidiagonal(a[:, :4])
    assert np.allclose(f["u"] @ f["b"] @ f["v"].T, a[:, :4]) and np.allclose(f["b"], np.triu(np.tril(f["b"], 1)))
    assert np.allclose(decomp.inv(a)["inv"] @ a, eye)
    w = np.linalg.eigvals(a)
    got = decomp.eigenvalues(a)
    assert np.allclose(np.sort_complex(w), got["re"][:, 0] + 1j * got["im"][:, 0])
    v = np.linalg.eig(a)
    assert np.allclose(decomp.matexp(a)["exp"], (v[1] @ np.diag(np.exp(v[0])) @ np.linalg.inv(v[1])).real)


def test_ranks():
    assert decomp.matrix_rank(np.array([[1, 2], [2, 4], [3, 6.0]]))["rank"] == 1
    assert decomp.col_piv_qr(np.array([[1, 2, 3], [2, 4, 6], [1, 1, 1.0]]))["rank"] == 2
    f = decomp.full_piv_lu(np.array([[1, 2, 3], [2, 4, 6], [1, 1, 1.0]]))
    assert f["rank"] == 2 and f["det"] == 0
    with pytest.raises(ValueError):
        decomp.matrix_rank(np.zeros((0, 0)))


def test_tall(spark):
    a = np.random.default_rng(5).normal(size=(200, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in a], "x array<double>").repartition(4)
    r = decomp.tsqr(df, "x")
    assert np.allclose(r.T @ r, a.T @ a) and np.allclose(np.tril(r, -1), 0)
    assert np.allclose(decomp.tall_svd(df, "x")[0], np.linalg.svd(a, compute_uv=False))
    b = np.random.default_rng(6).normal(size=200)
    both = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(np.hstack([a, a[:, :1]]), b, strict=True)], "x array<double>, b double").repartition(3)
    assert np.allclose(decomp.tall_least_squares(both, "x", "b"), np.linalg.lstsq(np.hstack([a, a[:, :1]]), b, rcond=None)[0])


def test_plans(spark, tmp_path):
    path = str(tmp_path / "t")
    tensor(spark, [1, 2, 3]).df.write.parquet(path)
    plan = Prepared(lambda t: t.agg(F.sum("v").alias("v")), {"t": path}).bind(spark)
    assert plan.run(spark).first()["v"] == 6
    tensor(spark, [4, 5]).df.write.mode("append").parquet(path)
    assert plan.run(spark).first()["v"] == 15
    both = batch(spark.read.parquet(path), {"a": ("sum", F.col("v")), "b": ("max", F.col("v"))}).first()
    assert (both["a"], both["b"]) == (15, 5)
    assert [r["plan"] for r in tagged({"x": spark.range(1), "y": spark.range(1)}).orderBy("plan").collect()] == [0, 1]


def test_stream(spark, tmp_path):
    from tessera.streaming import sgd_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 1, 2.0)], "k long, o long, g double").coalesce(1).write.parquet(source)
    rows = spark.readStream.schema("k long, o long, g double").parquet(source)
    query = sgd_stream(rows, "k", "o", "g", 1.0, 0.1, 0.9).writeStream.outputMode("update").format("memory").queryName("sgd").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.k: (round(r.p, 9), r.steps) for r in spark.table("sgd").collect()}
    assert got == {1: (0.51, 2), 2: (0.8, 1)}


def test_running_sums(spark, tmp_path):
    from tessera.streaming import running_sums

    source, kind = str(tmp_path / "in"), "at timestamp, k long, x double"

    def put(n, rows):
        spark.createDataFrame(rows, "at string, k long, x double").selectExpr("cast(at as timestamp) at", "k", "x").coalesce(1).write.mode("append").parquet(source)
        query = running_sums(spark.readStream.schema(kind).parquet(source), "at", "k", "x", "10 minutes", "10 minutes").writeStream.outputMode("append")
        query = query.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return {(str(r.start)[11:16], r.k): (r.v, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if n else None

    put(0, [("2024-01-01 00:01:00", 1, 1.0), ("2024-01-01 00:09:00", 1, 2.0), ("2024-01-01 00:05:00", 2, 5.0)])
    put(0, [("2024-01-01 01:00:00", 1, 7.0)])
    got = put(1, [("2024-01-01 00:02:00", 1, 100.0), ("2024-01-01 02:00:00", 1, 1.0)])  # the first is too late
    assert got == {("00:00", 1): (3.0, 2), ("00:00", 2): (5.0, 1), ("01:00", 1): (7.0, 1)}


def test_fdtd_keeps_the_edges_at_zero(spark):
    cells = Tensor.full(spark, (5, 5, 5), 0.0, ("x", "y", "z")).df.select(
        "x", "y", "z", F.when((F.col("x") == 2) & (F.col("y") == 2) & (F.col("z") == 2), 1.0).otherwise(0.0).alias("p"), *(F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")), F.lit(1.0).alias("rho"), F.lit(1.0).alias("c")
    )
    out = field.fdtd(cells, (5, 5, 5), 0.1, 1.0, 1)
    assert out.filter("(x in (0, 4) or y in (0, 4) or z in (0, 4)) and (p <> 0 or vx <> 0)").count() == 0
    centre, side = (out.filter(f"x = {x} and y = 2 and z = 2").first() for x in (2, 1))
    assert side.vx == -0.05 and math.isclose(centre.p, 1 - 0.1 * 3 * 0.05)
    with pytest.raises(ShapeError):
        field.fdtd_step(cells, (2, 5, 5), 0.1, 1.0)


def test_tables(spark, tmp_path):
    from tessera import sources

    a = np.arange(12.0).reshape(4, 3)
    path = str(tmp_path / "m")
    sources.write(tensor(spark, a), path)
    assert np.array_equal(sources.read(spark, path, ("i", "j"), (4, 3)).to_numpy(), a)
    assert np.array_equal(sources.read_range(spark, path, ("i", "j"), (4, 3), 1, 3).to_numpy(), a[1:3])
    plan = sources.read_range(spark, path, ("i", "j"), (4, 3), 1, 3).df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(i), GreaterThanOrEqual(i,1), LessThan(i,3)]" in plan
    new = Tensor(tensor(spark, [[9.0, 9.0, 9.0]]).df.withColumn("i", F.lit(2).cast("long")), ("i", "j"), (4, 3))
    a[2] = 9
    assert np.array_equal(sources.overwrite(sources.read(spark, path, ("i", "j"), (4, 3)), new).to_numpy(), a)


def test_maps_stay_in_one_stage(spark):
    """Maps, reductions and slices: one scan, one exchange, no Python."""
    t = Tensor.full(spark, (100, 8), 1.0)
    plan = reduce.axis((t * 2 + 1).slice("i", 10, 20), "i", "sum").df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan


def test_whole_embeddings_are_factored(spark, tmp_path):
    from tessera.queries import factors as q

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64)).astype(np.float32)  # fewer rows than coordinates in one label, more in the other
    x = np.vstack([x, rng.normal(size=(90, 64)).astype(np.float32)])
    label = [0] * 40 + [1] * 90
    rows = [(i, v.tolist(), m) for i, (v, m) in enumerate(zip(x, label, strict=True))] + [(130, [0.5] * 64, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    own = {r["m"]: r for r in q.determinant_whole(spark, str(tmp_path)).collect()}
    xs = {r["m"]: dict(r["x"]) for r in decomp.least_squares_rows(q._labelled(spark, str(tmp_path)).withColumn("b", F.col("vec_id") % 7), "x", "b").groupBy("m").agg(F.collect_list(F.struct("i", "v")).alias("x")).collect()}
    for m, part in ((0, slice(0, 40)), (1, slice(40, 130))):
        a = x[part].astype(float)
        g = a.T @ a + np.eye(64)
        g = np.where(np.tri(64, k=-1) > 0, g / 2 + 0.25, g)
        sign, log = np.linalg.slogdet(g)
        assert own[m]["sign"] == sign and own[m]["log"] == pytest.approx(log, abs=2e-6)
        want = np.linalg.lstsq(a, np.arange(130)[part] % 7, rcond=None)[0]
        assert np.allclose([xs[m][i] for i in range(64)], want, atol=1e-8)


@pytest.mark.parametrize("causal", [False, True])
def test_blocked_attention(spark, causal):
    rng = np.random.default_rng(7)
    sizes = {0: 23, 3: 1, 12: 9}  # batches as the table has them, not the first ten; blocks of four rows
    rows, data = [], {}
    for b, n in sizes.items():
        q, k, v, g = (rng.normal(size=(n, d)) * 3 for d in (5, 5, 6, 6))
        keep = (np.arange(n) % 3 != 1) & (b != 12)
        data[b] = q, k, v, g, keep
        rows += [(b, p, q[p].tolist(), k[p].tolist(), v[p].tolist(), g[p].tolist(), bool(keep[p])) for p in range(n)]
    df = spark.createDataFrame(rows, "b long, p long, q array<double>, k array<double>, v array<double>, g array<double>, keep boolean")
    out = {(r["b"], r["q"], r["e"]): r["v"] for r in nn.attention_blocked(df.drop("g"), 0.7, causal, block=4).collect()}
    grads = {(r["part"], r["b"], r["p"], r["d"]): r["v"] for r in nn.attention_blocked_backward(df, 0.7, causal, block=4).collect()}
    assert len(out) == 6 * sum(sizes.values()) and len(grads) == 16 * sum(sizes.values())
    for b, (q, k, v, g, keep) in data.items():
        s = np.where(keep[None, :] & (np.tri(len(q)) > 0 if causal else True), q @ k.T * 0.7, -np.inf)
        x = np.exp(s - np.maximum(s.max(axis=1), -1e300)[:, None])
        w = x / np.maximum(x.sum(axis=1), 1e-300)[:, None]
        ds = w * (g @ v.T - (g * (w @ v)).sum(axis=1)[:, None]) * 0.7
        assert all(abs(out[b, i, e] - y) < 1e-9 for (i, e), y in np.ndenumerate(w @ v))
        for part, want in (("q", ds @ k), ("k", ds.T @ q), ("v", w.T @ g)):
            assert all(abs(grads[part, b, i, d] - y) < 1e-8 for (i, d), y in np.ndenumerate(want))
