"""Attention weights as tiles, and partial results that merge in levels, against whole matrices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nn
from tessera.tensor import Tensor
from tessera.tiles import Tiles


def heads(spark, n=23, d=3, batches=2, big=1 << 60):
    """Rows (b, p, q, k, v, keep) whose positions are no small numbers, and the matrices of each batch in their order."""
    rng = np.random.default_rng(5)
    rows, whole = [], {}
    for b in range(batches):
        q, k, v = rng.normal(size=(3, n, d))
        keep = rng.random(n) < (0.6 if b else 0.0)
        keep[0] = bool(b)
        p = np.sort(rng.choice(1000, n, replace=False)) + big
        whole[b] = (p, q, k, v, keep)
        rows += [(b, int(p[i]), q[i].tolist(), k[i].tolist(), v[i].tolist(), bool(keep[i])) for i in range(n)]
    return spark.createDataFrame(rows, "b long, p long, q array<double>, k array<double>, v array<double>, keep boolean"), whole


def softmaxed(q, k, keep, scale, causal):
    s = q @ k.T * scale
    s[:, ~keep] = -np.inf
    if causal:
        s[np.triu_indices(len(s), 1)] = -np.inf
    x = np.exp(s - np.where(np.isfinite(s.max(axis=1)), s.max(axis=1), 0)[:, None])
    return x / np.where(x.sum(axis=1) > 0, x.sum(axis=1), 1)[:, None]


@pytest.mark.parametrize("causal,masked", [(False, False), (True, False), (True, True)])
def test_weights(spark, monkeypatch, causal, masked):
    """Blocks of 4, of which two merge at a time; masked rows are zeros, all others sum to 1."""
    monkeypatch.setattr(nn, "MERGE", 2)
    df, whole = heads(spark)
    out, tiles = nn.attention_with_weights(df if masked else df.drop("keep"), 0.7, causal, block=4)
    cells = {(r.b, r.i, r.j): r.v for r in tiles.cells().collect()}
    got = {(r.b, r.p): r.o for r in out.collect()}
    sums = {(r.b, r.q): (r.total, r.mean) for r in tiles.row_sums("q", total=lambda k, w: w, mean=lambda k, w: (k - F.lit(1 << 60)) * w).collect()}
    assert tiles.df.count() > 2 * 16
    for b, (p, q, k, v, keep) in whole.items():
        want = softmaxed(q, k, keep if masked else np.ones(len(p), dtype=bool), 0.7, causal)
        assert np.allclose([[cells[b, i, j] for j in p.tolist()] for i in p.tolist()], want, atol=1e-12)
        assert np.allclose([got[b, i] for i in p.tolist()], want @ v)
        assert np.allclose([sums[b, i][0] for i in p.tolist()], want.sum(axis=1))
        assert np.allclose([sums[b, i][1] for i in p.tolist()], want @ (p - (1 << 60)))
        assert set(np.round(want.sum(axis=1), 9)) <= {0.0, 1.0}


def test_gradients_merge_in_levels(spark, monkeypatch):
    df, _ = heads(spark)
    df = df.drop("keep").withColumn("g", F.reverse("v"))
    one = {(r.part, r.b, r.p, r.d): r.v for r in nn.attention_blocked_backward(df, 0.5).collect()}
    monkeypatch.setattr(nn, "MERGE", 2)
    many = {(r.part, r.b, r.p, r.d): r.v for r in nn.attention_blocked_backward(df, 0.5, block=3).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_tiles_read_as_lines_and_cells(spark):
    t = Tiles(spark.createDataFrame([(7, [3, 1], [10, 20, 30], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (8, [2], [], [])], "m long, rows array<long>, columns array<long>, x array<double>"), ("m",))
    assert sorted(map(tuple, t.cells("r", "c").collect())) == [(7, 1, 10, 4.0), (7, 1, 20, 5.0), (7, 1, 30, 6.0), (7, 3, 10, 1.0), (7, 3, 20, 2.0), (7, 3, 30, 3.0)]
    assert sorted((r.m, r.i, r.x) for r in t.lines().collect()) == [(7, 1, [4.0, 5.0, 6.0]), (7, 3, [1.0, 2.0, 3.0]), (8, 2, [])]


@pytest.mark.parametrize("seed", range(6))
def test_convolution_in_tiles(spark, monkeypatch, seed):
    """Small tiles, one to three axes, any stride, padding and dilation: the same as the join of cells with taps."""
    rng = np.random.default_rng(seed)
    rank, transposed = 1 + seed % 3, seed >= 3
    monkeypatch.setitem(nn.CONV_SIDES, rank, 3)
    n, k = rng.integers(4, 9, rank), rng.integers(1, 4, rank)
    stride, pad, dilation = rng.integers(1, 4, rank), rng.integers(0, 3, rank), rng.integers(1, 3, rank)
    if not transposed:
        n = np.maximum(n, dilation * (k - 1) + 1)
    else:
        pad = np.minimum(pad, ((n - 1) * stride + dilation * (k - 1)) // 2)
    axes = "xyz"[:rank]
    x, w = rng.normal(size=(2, 2, *n)), rng.normal(size=(2, 3, *k) if transposed else (3, 2, *k))
    x[rng.random(x.shape) < 0.3] = 0
    t = Tensor.from_numpy(spark, x, ("b", "c", *axes))
    t = Tensor(t.df.filter("v <> 0"), t.dims, t.shape)
    kernel = Tensor.from_numpy(spark, w, (*(("c", "o") if transposed else ("o", "c")), *("k" + a for a in axes)))
    args = ([int(v) for v in stride], [int(v) for v in pad], [int(v) for v in dilation], transposed)
    got = nn.conv(t, kernel, None, *args)
    monkeypatch.setattr("tessera.tensor.SMALL", 1)
    want = nn.conv(t, kernel, None, *args)
    assert got.shape == want.shape and np.allclose(got.to_numpy(), want.to_numpy()) and np.abs(want.to_numpy()).max() > 0


@pytest.mark.parametrize("seed", range(6))
def test_gradients_in_tiles(spark, monkeypatch, seed):
    """Gradients of input and weight from small tiles: the same rows as the join of pairs with the upstream gradient."""
    rng = np.random.default_rng(10 + seed)
    rank, transposed = 1 + seed % 3, seed >= 3
    monkeypatch.setitem(nn.CONV_SIDES, rank, 3)
    n, k = rng.integers(4, 8, rank), rng.integers(1, 4, rank)
    stride, pad, dilation = rng.integers(1, 4, rank), rng.integers(0, 3, rank), rng.integers(1, 3, rank)
    if not transposed:
        n = np.maximum(n, dilation * (k - 1) + 1)
    else:
        pad = np.minimum(pad, ((n - 1) * stride + dilation * (k - 1)) // 2)
    args = [[int(v) for v in each] for each in (stride, pad, dilation)]
    extra = tuple(int(v) for v in rng.integers(0, 3, rank)) if transposed else ()
    out = nn.ConvPlan(tuple(map(int, n)), tuple(map(int, k)), *map(tuple, args), extra, transposed).out
    axes = tuple("xyz"[:rank])

    def sparse_cells(shape, dims):
        t = Tensor.from_numpy(spark, rng.normal(size=shape) * (rng.random(shape) > 0.3), dims)
        return Tensor(t.df.filter("v <> 0").repartition(3), t.dims, t.shape)

    x, up = sparse_cells((2, 2, *map(int, n)), ("b", "c", *axes)), sparse_cells((2, 3, *out), ("b", "o", *axes))
    lead = ("c", "o") if transposed else ("o", "c")
    w = Tensor.from_numpy(spark, rng.normal(size=(2, 3, *k) if transposed else (3, 2, *k)), (*lead, *("k" + a for a in axes)))

    def rows(wanted):
        got = nn.conv_backward(x, w, up, *args, transposed, extra, wanted)
        assert list(got) == list(wanted)
        return {part: (df.columns, {tuple(r)[:-1]: r.v for r in df.collect()}) for part, df in got.items()}

    tiles, alone = rows(("input", "weight", "bias")), rows(("input",)) | rows(("weight",))
    monkeypatch.setattr("tessera.tensor.SMALL", 1)
    joined = rows(("input", "weight", "bias"))
    for part, (columns, want) in joined.items():
        for at, got in (tiles.get(part), alone.get(part, tiles[part])):
            assert at == columns and got.keys() == want.keys() and np.allclose([got[key] for key in want], list(want.values()))
