"""Time-tiled steps and rays through tiles against single steps and numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import field
from tessera.tensor import ShapeError, Tensor

FIELDS = ["p", "vx", "vy", "vz", "rho", "c"]


def acoustic(spark, shape, seed=0):
    rng = np.random.default_rng(seed)
    values = {f: rng.normal(size=shape) for f in FIELDS[:4]} | {f: 1 + rng.random(shape) for f in FIELDS[4:]}
    rows = [(*map(int, at), *(float(values[f][at]) for f in FIELDS)) for at in np.ndindex(*shape)]
    return spark.createDataFrame(rows, "x long, y long, z long, " + ", ".join(f"{f} double" for f in FIELDS)), values


def stepped(v, dt, d, steps):
    """Central differences over the whole grid."""
    v = {f: a.copy() for f, a in v.items()}
    inner = (slice(1, -1),) * 3

    def slope(a, k):
        return ((np.roll(a, -1, k) - np.roll(a, 1, k)) / (2 * d[k]))[inner]

    for _ in range(steps):
        new = {}
        for k, f in enumerate(("vx", "vy", "vz")):
            new[f] = np.zeros_like(v["p"])
            new[f][inner] = v[f][inner] - dt / v["rho"][inner] * slope(v["p"], k)
        p = np.zeros_like(v["p"])
        p[inner] = v["p"][inner] - dt * v["rho"][inner] * v["c"][inner] ** 2 * sum(slope(new[f], k) for k, f in enumerate(("vx", "vy", "vz")))
        v |= new | {"p": p}
    return v


@pytest.mark.parametrize("steps,at_once", [(4, 4), (5, 2), (1, 1)])
def test_several_steps_in_one_shuffle(spark, monkeypatch, steps, at_once):
    monkeypatch.setitem(field.TILES, 3, 8)
    shape, d = (19, 9, 8), (0.5, 1.0, 2.0)
    cells, values = acoustic(spark, shape)
    got = field.fdtd(cells, shape, 0.1, d, steps, at_once).toPandas()
    want = stepped(values, 0.1, d, steps)
    at = tuple(got[a].to_numpy() for a in "xyz")
    assert len(got) == np.prod(shape)
    for f in FIELDS:
        assert np.allclose(got[f].to_numpy(), want[f][at], rtol=1e-12, atol=1e-12), f
    once = field.fdtd_step(cells, shape, 0.1, d).toPandas()
    assert np.allclose(once["p"].to_numpy(), stepped(values, 0.1, d, 1)["p"][tuple(once[a].to_numpy() for a in "xyz")])
    plan = field.fdtd_steps(cells, shape, 0.1, d, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fdtd_rejects(spark):
    cells, _ = acoustic(spark, (4, 4, 4))
    for shape, dt, d in (((2, 4, 4), 0.1, 1.0), ((4, 4, 4), 0.0, 1.0), ((4, 4, 4), float("nan"), 1.0), ((4, 4, 4), 0.1, (1.0, -1.0, 1.0)), ((4, 4, 4), 0.1, (1.0, float("inf"), 1.0)), ((4, 4, 4), 0.1, (1.0, 1.0))):
        for run in (field.fdtd_step, lambda *a: field.fdtd_steps(*a, 2)):
            with pytest.raises(ShapeError):
                run(cells, shape, dt, d)
    with pytest.raises(ShapeError):
        field.fdtd_steps(cells, (4, 4, 4), 0.1, 1.0, 17)
    with pytest.raises(Exception, match="missing or repeated"):
        field.fdtd_steps(cells.filter("x + y + z > 0"), (4, 4, 4), 0.1, 1.0, 1).collect()


def integral(a, origin, d, o, u, step):
    """One ray by the definition."""
    u = u / np.linalg.norm(u)
    near, far = 0.0, np.inf
    for k in range(3):
        lo, hi = origin[k] - o[k], origin[k] + (a.shape[k] - 1) * d[k] - o[k]
        if u[k] == 0:
            if lo > 0 or hi < 0:
                return 0.0
            continue
        near, far = max(near, min(lo / u[k], hi / u[k])), min(far, max(lo / u[k], hi / u[k]))
    if far <= near:
        return 0.0
    n = max(1, int(np.ceil((far - near) / step)))
    dl, total = (far - near) / n, 0.0
    for s in range(n):
        g = np.clip((o + (near + (s + 0.5) * dl) * u - origin) / d, 0, np.array(a.shape) - 1)
        b = np.floor(g).astype(int)
        f = g - b
        for c in np.ndindex(2, 2, 2):
            w = np.prod([f[k] if c[k] else 1 - f[k] for k in range(3)])
            if w:
                total += w * a[tuple(b + c)] * dl
    return total


@pytest.mark.parametrize("at_once", [field.RAYS, 2])
def test_rays_through_tiles(spark, monkeypatch, at_once):
    """Rays in all directions through many tiles, some of which have more rays than meet in a task."""
    monkeypatch.setitem(field.TILES, 3, 4)
    monkeypatch.setattr(field, "RAYS", at_once)
    rng = np.random.default_rng(3)
    a, origin, d = rng.normal(size=(11, 6, 9)), np.array([1.0, -2.0, 0.5]), np.array([0.5, 1.0, 2.0])
    starts = rng.uniform(-12, 12, (30, 3))
    rays = [((1 << 60) + i, *o, *(origin + d * rng.uniform(0, 1, 3) * np.array(a.shape) - o)) for i, o in enumerate(starts)]
    rays += [(1, -9.0, 0.0, 4.5, 1.0, 0.0, 0.0), (2, 1.0, -2.0, 0.5, 1.0, 1.0, 1.0), (3, 3.0, 0.0, 100.0, 0.0, 0.0, -1.0), (4, 99.0, 0.0, 0.0, 1.0, 0.0, 0.0), (5, 6.0, 3.0, 16.5, -1.0, -1.0, -2.0)]
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rays], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    cells = Tensor.from_numpy(spark, a, ("ix", "iy", "iz")).df
    got = {r.ray: r.v for r in field.ray_integrals(cells, a.shape, tuple(origin), tuple(d), df, 0.3).collect()}
    want = {r[0]: integral(a, origin, d, np.array(r[1:4]), np.array(r[4:]), 0.3) for r in rays}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and sum(v != 0 for v in want.values()) > 10
    assert field.ray_integrals(cells, a.shape, tuple(origin), tuple(d), df.limit(0), 0.3).count() == 0
    sparse = field.ray_integrals(cells.filter("ix < 3"), a.shape, tuple(origin), tuple(d), df.filter("ray = 1"), 0.3).first().v
    assert abs(sparse - integral(np.where(np.arange(11)[:, None, None] < 3, a, 0), origin, d, np.array(rays[30][1:4]), np.array(rays[30][4:]), 0.3)) < 1e-9
    with pytest.raises(ShapeError):
        field.ray_integrals(cells, a.shape, tuple(origin), (1.0, 0.0, 1.0), df, 0.3)
