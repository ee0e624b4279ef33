"""What a query moves and holds must not grow faster than its input."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.operators import field, linalg, lines, nn, sparse
from tessera.queries import fields, products
from tessera.session import cut_lineage
from tessera.streaming import _InOrder
from tessera.tensor import Tensor


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_products_meet_as_blocks(spark):
    """No product is a row of a shuffle, and one contracted block needs no sum at all."""
    rng = np.random.default_rng(3)
    for k, sums in ((4, 0), (11, 1)):
        a, b = rng.normal(size=(9, k)), rng.normal(size=(k, 10))
        x, y = (Tensor.from_numpy(spark, m) for m in (a, b))
        out = linalg.matmul_blocked(x, y, 4)
        assert "HashAggregate" not in plan(out.df) and plan(out.df).count("FlatMapGroupsInPandas") == 2 + sums
        assert np.allclose(out.to_numpy(), a @ b)
        holes = Tensor(x.df.filter((F.col("i") + F.col("j")) % 5 == 0), x.dims, x.shape)
        sparse = linalg.matmul_blocked(holes, y, 4)
        want = np.where((np.add.outer(np.arange(9), np.arange(k)) % 5 == 0), a, 0) @ b
        assert np.allclose(sparse.to_numpy(), want)


def test_equal_rays_are_walked_once(spark, monkeypatch):
    """What is walked and met grows with the different rays, and a ray that is there twice keeps its own integral."""
    cells = spark.range(40).select(F.col("id").alias("ix"), F.lit(0).alias("iy"), F.lit(0).alias("iz"), F.lit(2.0).alias("v"))
    rays = spark.createDataFrame([(k % 5, -1.0, 0.0, 0.0, 1.0 + k % 2, 0.0, 0.0) for k in range(60)] + [(9, -1.0, 5.0, 0.0, 1.0, 0.0, 0.0), (8, None, 0.0, 0.0, 1.0, 0.0, 0.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    written = []
    monkeypatch.setattr(field, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    got = [tuple(r) for r in field.ray_integrals(cells, (40, 1, 1), (0.0, 0.0, 0.0), 1.0, rays, 1.0).collect()]
    assert sorted(got) == sorted([(k % 5, 78.0) for k in range(60)] + [(9, 0.0), (8, 0.0)])
    assert written[-1].count() == 2 * 2  # two rays in two tiles


def test_packed_products_move_vectors_only(spark, monkeypatch):
    """Entries stay in their tasks: what a product shuffles does not grow with them."""
    rng = np.random.default_rng(5)
    a = np.where(rng.random((60, 20)) < 0.4, rng.normal(size=(60, 20)), 0)
    a[7] = a[:, 3] = 0
    cells = spark.createDataFrame([(int(i) - 30, int(j) * 1000, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")
    x, y = rng.normal(size=(20, 3)), rng.normal(size=(60, 2))
    monkeypatch.setattr(sparse, "PIECE", 10)
    for groups in (1, 7, None):
        matrix = sparse.packed(cells, groups)
        for m, v, into, of, back in ((a, x, lambda i: i - 30, lambda j: j * 1000, False), (a.T, y, lambda j: j * 1000, lambda i: i - 30, True)):
            out = matrix.times(spark.createDataFrame([(of(k), row.tolist()) for k, row in enumerate(v)], "key long, x array<double>"), back)
            assert plan(out).count("InMemoryTableScan") == 1 and plan(out).split("InMemoryRelation")[0].count("Exchange hashpartitioning(g") <= 1  # the vectors'
            got = {r.key: r.x for r in out.collect()}
            want = {into(k): row for k, row in enumerate(m @ v) if m[k].any()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        matrix.unpersist()


def test_one_timer_for_a_key_and_batch():
    """Timers are calls to the state server: gradients of a batch and what is left after a fold share one."""
    kept, waiting, timers = [], [], []
    now = SimpleNamespace(get=lambda: kept[-1], exists=lambda: bool(kept), update=kept.append)
    store = SimpleNamespace(get=lambda: iter(list(waiting)), appendList=waiting.extend, put=lambda rows: waiting.__setitem__(slice(None), rows), clear=waiting.clear)
    own = _InOrder(1.0, 0.1, 0.9)
    own.init(SimpleNamespace(getValueState=lambda *_: now, getListState=lambda *_: store, registerTimer=timers.append))
    list(own.handleInputRows((1,), iter([pd.DataFrame({"at": range(10, 110), "o": range(100), "g": 1.0})]), None))
    assert timers == [10]
    out = list(own.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 59), None))
    assert out[0]["steps"].tolist() == [50] and timers == [10, 60] and len(waiting) == 50


def test_random_contract_parts_grow_with_rows(spark, monkeypatch):
    """No task gets a fixed share of all rows."""
    monkeypatch.setattr(fields, "ROWS", 500)
    df = fields.random_contract(spark, "/root/testdata/sf0.001")
    rows = df.first().n // 2
    assert f"RoundRobinPartitioning({rows // 500})" in plan(df) and plan(df).count(f", {2 * rows // 500}), REPARTITION_BY_NUM") >= 3


def _attended(spark, n):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 4, 3))
    return spark.createDataFrame([(0, k, *(a.tolist() for a in r), k % 3 != 0) for k, r in enumerate(x)], "b long, p long, q array<double>, k array<double>, v array<double>, g array<double>, keep boolean")


def test_attention_repeats_rows_a_bounded_number_of_times(spark, monkeypatch):
    """Long sequences have larger blocks, not more of them; scores are still held a slice at a time."""
    rows = _attended(spark, 90)
    whole = {(r.part, r.p, r.d): r.v for r in nn.attention_blocked_backward(rows, 0.5, True).collect()}
    out = {(r.q, r.e): r.v for r in nn.attention_blocked(rows.drop("g"), 0.5, True).collect()}
    monkeypatch.setattr(nn, "SLICE", 7)
    dealt = nn._deal(rows.drop("q", "g"), 4, nn.ACROSS)
    assert dealt.most == nn.ACROSS and nn._deal(rows.drop("q", "g"), 4).most == 23
    got = {(r.part, r.p, r.d): r.v for r in nn.attention_blocked_backward(rows, 0.5, True, block=4).collect()}
    assert got.keys() == whole.keys() and np.allclose([got[k] for k in whole], list(whole.values()))
    parts = {(r.q, r.e): r.v for r in nn.attention_blocked(rows.drop("g"), 0.5, True, block=4).collect()}
    assert parts.keys() == out.keys() and np.allclose([parts[k] for k in out], list(out.values()))


def test_attention_row_sums_keep_weights_in_their_tasks(spark):
    rows = _attended(spark, 40).drop("g")
    out, tiles = nn.attention_with_weights(rows, 0.5, True, block=8)
    want = {r.q: (r.total, r.position) for r in tiles.row_sums("q", total=lambda k, w: w, position=lambda k, w: k * w).collect()}
    got = nn.attention_row_sums(rows, 0.5, True, block=8, total=lambda k, w: w, position=lambda k, w: k * w).collect()
    assert {r.p for r in got} == want.keys() and np.allclose([(r.total, r.position) for r in got], [want[r.p] for r in got])
    means = {r.p: r.o for r in out.collect()}
    assert all(np.allclose(r.o, means[r.p]) for r in got)


def test_batches_in_slices(spark):
    """An Arrow batch of long texts is taken some rows at a time, longs beside nulls exact."""
    df = spark.createDataFrame([(None if k == 3 else (1 << 60) + k, "x" * k) for k in range(25)], "a long, t string").coalesce(1)
    sized = lambda batches: (b.assign(n=len(b))[["a", "n"]] for b in batches)
    got = [(r.a, r.n) for r in map_batches(df, sized, "a long, n long", 10).collect()]
    assert got == [(None if k == 3 else (1 << 60) + k, 5 if k >= 20 else 10) for k in range(25)]


def test_grid_parts_grow_with_the_grid(spark, monkeypatch):
    monkeypatch.setattr(field, "PART", 100)
    cells = Tensor.full(spark, (20, 8, 5), 0.0, ("x", "y", "z")).df.select("x", "y", "z", *(F.lit(1.0).alias(c) for c in ("p", "vx", "vy", "vz", "rho", "c")))
    out = field.fdtd_steps(cells, (20, 8, 5), 0.1, 1.0, 1)
    assert ", 8), REPARTITION_BY_NUM" in plan(out) and out.count() == 800


def test_no_product_with_a_small_side_is_a_row_of_a_hash_table(spark):
    for query in (products.batched_matmul, products.matmul):
        out = plan(query(spark, "/root/testdata/sf0.001"))
        assert "HashAggregate" not in out and "BroadcastHashJoin" not in out and out.count("Exchange hashpartitioning") == 1


def _joined(left, right, paired, which):
    """Sums over k of (p, i, k, v) and (q, k, j, v): the join, written out."""
    sums = {}
    for p, i, k, v in left:
        for q, m, j, w in right:
            if k is not None and k == m and (not paired or (p is not None and p == q)):
                sums.setdefault((p if which == "p" else q, i, j), []).append(None if v is None or w is None else v * w)
    known = {at: [x for x in xs if x is not None] for at, xs in sums.items()}
    return {at: sum(xs) if xs else None for at, xs in known.items()}


def _same(got, want):
    return got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or np.isclose(got[k], want[k], equal_nan=True)) for k in want)


def test_lines_meet_a_small_side_as_in_a_join(spark, monkeypatch):
    """Holes, repeated and null entries, values that are not finite, and lines that go on from one step or batch to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    rng = np.random.default_rng(4)
    odd = [None, float("nan"), float("inf"), 0.0, 1.5, -2.0]

    def cells(batches, m, n):
        at = [(b, i, k) for b in range(batches) for i in range(m) for k in range(n) if rng.random() < 0.6]
        at += at[::7] + [(0, None, 1), (0, 1, None)]
        return [(*at[x], odd[rng.integers(6)] if rng.random() < 0.1 else float(rng.integers(-9, 9))) for x in rng.permutation(len(at))]

    for step in (1, 7, 1 << 18):
        monkeypatch.setattr(lines, "STEP", step)
        for p, q in ((3, 3), (3, 1), (1, 3)):
            left, right = cells(p, 9, 5), cells(q, 5, 6)
            a = Tensor(spark.createDataFrame(left, "b long, i long, k long, v double"), ("b", "i", "k"), (p, 9, 5))
            b = Tensor(spark.createDataFrame(right, "b long, k long, j long, v double"), ("b", "k", "j"), (q, 5, 6))
            want = _joined(left, right, p == q, "p" if p == 3 else "q")
            for x, y in ((a, b), (Tensor(a.df, a.dims, (p, 1 << 40, 5)), b), (a, Tensor(b.df, b.dims, (q, 5, 1 << 40)))):
                assert _same({(r.b, r.i, r.j): r.v for r in linalg.batched_matmul(x, y).df.collect()}, want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nothing = Tensor(b.df.filter("false"), b.dims, b.shape)
    assert linalg.batched_matmul(a, nothing).df.collect() == [] and linalg.batched_matmul(Tensor(a.df.filter("false"), a.dims, a.shape), b).df.collect() == []
    wide = Tensor(spark.createDataFrame([(0, 5000 * k, float(k)) for k in range(20)], "k long, j long, v double").select((F.col("j") / 5000).cast("long").alias("k"), "j", "v"), ("k", "j"), (20, 50000))
    line = Tensor.from_numpy(spark, np.ones((2, 20)))
    assert {(r.i, r.j): r.v for r in linalg.matmul(line, wide).df.collect()} == {(i, 5000 * k): float(k) for i in range(2) for k in range(20)}
