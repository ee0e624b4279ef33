"""Grid stencils, acoustic time steps and ray integrals."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.session import cut_lineage
from tessera.tensor import ShapeError, Tensor


AXES = ("x", "y", "z")
TILES = {2: 256, 3: 32}  # positions of a tile's side, by the number of axes


def _tiled(cells: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], halo: int, wrap: bool = False) -> tuple[DataFrame, list[str]]:
    """The cells in tiles, each with the ``halo`` cells beside it along every axis, and the names of the tiles' columns.

    One shuffle by tile serves all windows along all axes, and a line of any length is parted.  ``_own`` tells a tile's
    cells from those beside it.  With ``wrap`` the first and the last point of a line are the same one, so what lies
    beyond them are the points n - 2 and 1; they are put there under the positions -1 and n.
    """
    side = TILES[len(axes)]
    if halo >= side:
        raise ShapeError(f"{halo} cells beside tiles of {side}")

    def place(moved: int | None, tile: Column | None = None, position: Column | None = None) -> Column:
        parts = [(tile if k == moved else F.floor(F.col(a) / side)).cast("long").alias(f"t{k}") for k, a in enumerate(axes)]
        return F.struct(*parts, *((position if k == moved else F.col(a)).cast("long").alias(f"p{k}") for k, a in enumerate(axes)), F.lit(moved is None).alias("own"))

    places = [place(None)]
    for k, (a, n) in enumerate(zip(axes, shape, strict=True)):
        at, last = F.col(a), (n - 1) // side
        tile = F.floor(at / side)
        places.append(F.when((at % side < halo) & (tile > 0), place(k, tile - 1, at)))
        places.append(F.when((at % side >= side - halo) & (tile < last), place(k, tile + 1, at)))
        if wrap:
            places.append(F.when(at == n - 2, place(k, F.lit(0), F.lit(-1))))
            places.append(F.when(at == 1, place(k, F.lit(last), F.lit(n))))
    tiles = [f"_t{k}" for k in range(len(axes))]
    rest = [c for c in cells.columns if c not in axes]
    dealt = cells.select(*rest, F.explode(F.array_compact(F.array(*places))).alias("_at"))
    named = [F.col(f"_at.t{k}").alias(t) for k, t in enumerate(tiles)] + [F.col(f"_at.p{k}").alias(a) for k, a in enumerate(axes)]
    return dealt.select(*named, *rest, F.col("_at.own").alias("_own")).repartition(*tiles), tiles


def _second(value: Column, pos: str, other: list[str], n: int, spacing: float, boundary: str) -> Column:
    """The three-point second difference along one axis, by window over the lines of a tile."""
    line = Window.partitionBy(*other).orderBy(pos)
    before, after = F.lag(value, 1).over(line), F.lead(value, 1).over(line)
    at = F.col(pos)
    inner = before - 2 * value + after
    if boundary == "periodic":
        return inner / spacing**2
    if boundary == "dirichlet":  # the value beyond the edge is the edge's mirror image with the other sign: -2c there
        return F.when((at == 0) | (at == n - 1), -2 * value).otherwise(inner) / spacing**2
    if boundary == "neumann":  # one-sided, four points; a short axis is mirrored
        if n >= 4:
            first = 2 * value - 5 * after + 4 * F.lead(value, 2).over(line) - F.lead(value, 3).over(line)
            last = 2 * value - 5 * before + 4 * F.lag(value, 2).over(line) - F.lag(value, 3).over(line)
        else:
            first, last = 2 * (after - value), 2 * (before - value)
        return F.when(at == 0, first).when(at == n - 1, last).otherwise(inner) / spacing**2
    raise ValueError(f"boundary {boundary}")


def laplacian(t: Tensor, spacing: tuple[float, float] = (1.0, 1.0), boundary: str = "dirichlet", polarity: float = 1.0) -> Tensor:
    """Two-dimensional Laplacian of a full grid."""
    (x, y), (nx, ny) = t.dims, t.shape
    if min(nx, ny) < 2 or min(spacing) <= 0:
        raise ShapeError(f"a Laplacian of {t.shape} at {spacing}")
    cells, tiles = _tiled(t.df.select(x, y, "v"), t.dims, t.shape, 3 if boundary == "neumann" else 1, boundary == "periodic")
    v = F.col("v")
    along_x, along_y = _second(v, x, [*tiles, y], nx, spacing[0], boundary), _second(v, y, [*tiles, x], ny, spacing[1], boundary)
    found = cells.select("_own", x, y, (polarity * (along_x + along_y)).alias("v"))
    return Tensor(found.filter("_own").drop("_own"), t.dims, t.shape)


Spacing = float | tuple[float, float, float]


def _each(spacing: Spacing) -> tuple[float, float, float]:
    """The spacing of each axis; all must be positive and finite."""
    out = spacing if isinstance(spacing, tuple) else (spacing,) * 3
    if len(out) != 3 or not all(math.isfinite(d) and d > 0 for d in out):
        raise ShapeError(f"spacing {spacing}")
    return out


def _checked_step(shape: tuple[int, int, int], dt: float, spacing: Spacing) -> tuple[float, float, float]:
    if min(shape) < 3:
        raise ShapeError(f"a grid of {shape}")
    if not (math.isfinite(dt) and dt > 0):
        raise ShapeError(f"a step of {dt}")
    return _each(spacing)


def fdtd_step(cells: DataFrame, shape: tuple[int, int, int], dt: float, dx: Spacing) -> DataFrame:
    """One acoustic step of ``(x, y, z, p, vx, vy, vz, rho, c)``: velocity from the pressure, then pressure from the new
    velocity, central differences with a spacing for all axes or for each; boundary cells become 0.  New pressure reaches two
    cells, which is what tiles see of the tiles beside them, so a step is one shuffle."""
    spacing = dict(zip(AXES, _checked_step(shape, dt, dx), strict=True))
    moved, tiles = _tiled(cells.select(*AXES, "p", "vx", "vy", "vz", "rho", "c"), AXES, shape, 2)
    inside = F.lit(True)
    for a, n in zip(AXES, shape, strict=True):
        inside = inside & (F.col(a) > 0) & (F.col(a) < n - 1)

    def slope(column: str, a: str) -> Column:
        line = Window.partitionBy(*tiles, *(o for o in AXES if o != a)).orderBy(a)
        return (F.lead(column, 1).over(line) - F.lag(column, 1).over(line)) / (2 * spacing[a])

    for a in AXES:  # both windows of an axis in one sort: the pressure along it moves the velocity that flows along it
        moved = moved.withColumn("v" + a, F.when(inside, F.col("v" + a) - dt / F.col("rho") * slope("p", a)).otherwise(0.0)).withColumn("_s" + a, slope("v" + a, a))
    divergence = F.col("_sx") + F.col("_sy") + F.col("_sz")
    pressure = F.when(inside, F.col("p") - dt * F.col("rho") * F.col("c") * F.col("c") * divergence).otherwise(0.0)
    return moved.withColumn("p", pressure).filter("_own").select(*AXES, "p", "vx", "vy", "vz", "rho", "c")


def _dealt(cells: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], below: int, above: int) -> DataFrame:
    """The cells with the tiles ``t0, t1, ..`` that see them: their own, and those beside it on every side and corner, which
    see ``below`` cells before their first and ``above`` after their last."""
    side = TILES[len(axes)]
    if max(below, above) > side:
        raise ShapeError(f"{max(below, above)} cells beside tiles of {side}")
    for k, (a, n) in enumerate(zip(axes, shape, strict=True)):
        own, at = F.floor(F.col(a) / side).cast("long"), F.col(a) % side
        before = F.when((at < above) & (own > 0), own - 1)
        after = F.when((at >= side - below) & (own < (n - 1) // side), own + 1)
        cells = cells.withColumn(f"t{k}", F.explode(F.array_compact(F.array(own, before, after))))
    return cells


PART = 1 << 18  # cells of a grid that are sorted in one task


def parts_of(cells: DataFrame, shape: tuple[int, ...]) -> int:
    """A number of partitions that grows with the grid, so that what a task holds does not."""
    return max(cells.sparkSession.sparkContext.defaultParallelism, math.prod(shape) // PART)


def fdtd_steps(cells: DataFrame, shape: tuple[int, int, int], dt: float, dx: Spacing, steps: int) -> DataFrame:
    """Several steps in one shuffle: a tile takes as many cells of the tiles around it as the steps reach, two for each, does
    all steps in numpy, and returns its own cells.  At most 16 steps at once, as a tile sees no farther than its
    neighbours.  Every cell of the grid must be there once."""
    spacing = _checked_step(shape, dt, dx)
    side, halo, fields = TILES[3], 2 * steps, ("p", "vx", "vy", "vz", "rho", "c")
    if not steps:
        return cells.select(*AXES, *fields)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low = [max(0, t * side - halo) for t in key]
        size = [min(n, (t + 1) * side + halo) - lo for t, n, lo in zip(key, shape, low, strict=True)]
        at = tuple(rows[a].to_numpy() - lo for a, lo in zip(AXES, low, strict=True))
        if len(rows) != math.prod(size) or len(np.unique(np.ravel_multi_index(at, size))) != len(rows):
            raise ValueError(f"cells are missing or repeated in tile {key}")
        grid = {f: np.empty(size) for f in fields}
        for f in fields:
            grid[f][at] = rows[f].to_numpy()
        inside = np.ones(size, dtype=bool)
        for k, (lo, n, m) in enumerate(zip(low, shape, size, strict=True)):
            where = np.arange(lo, lo + m)
            inside &= ((where > 0) & (where < n - 1)).reshape([-1 if a == k else 1 for a in range(3)])

        def slope(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(size)
            middle, up, down = ([slice(None)] * 3 for _ in range(3))
            middle[k], up[k], down[k] = slice(1, -1), slice(2, None), slice(None, -2)
            out[tuple(middle)] = (x[tuple(up)] - x[tuple(down)]) / (2 * spacing[k])
            return out

        for _ in range(steps):
            for k, v in enumerate(("vx", "vy", "vz")):
                grid[v] = np.where(inside, grid[v] - dt / grid["rho"] * slope(grid["p"], k), 0.0)
            divergence = slope(grid["vx"], 0) + slope(grid["vy"], 1) + slope(grid["vz"], 2)
            grid["p"] = np.where(inside, grid["p"] - dt * grid["rho"] * grid["c"] * grid["c"] * divergence, 0.0)
        own = tuple(slice(t * side - lo, min(n, (t + 1) * side) - lo) for t, n, lo in zip(key, shape, low, strict=True))
        index = np.indices(grid["p"][own].shape)
        where = {a: (index[k] + key[k] * side).ravel() for k, a in enumerate(AXES)}
        return pd.DataFrame(where | {f: grid[f][own].ravel() for f in fields})

    typed = cells.select(*(F.col(a).cast("long").alias(a) for a in AXES), *(F.col(f).cast("double").alias(f) for f in fields))
    seen = _dealt(typed, AXES, shape, halo, halo).repartition(parts_of(typed, shape), "t0", "t1", "t2")
    return seen.groupBy("t0", "t1", "t2").applyInPandas(run, "x long, y long, z long, p double, vx double, vy double, vz double, rho double, c double")


def fdtd(cells: DataFrame, shape: tuple[int, int, int], dt: float, dx: Spacing, steps: int, at_once: int = 4) -> DataFrame:
    """Many steps, ``at_once`` of them in a shuffle; what they give is written to the checkpoint folder, so lineage does not
    grow."""
    for done in range(0, steps, at_once):
        cells = cut_lineage(fdtd_steps(cells, shape, dt, dx, min(at_once, steps - done)))
    return cells


RAYS = 8192  # rows of one tile that meet in a task
_SAMPLES = 1 << 16


def ray_integrals(field: DataFrame, shape: tuple[int, int, int], origin: tuple[float, float, float], spacing: Spacing, rays: DataFrame, step: float) -> DataFrame:
    """``ray, v``: line integrals of a field ``(ix, iy, iz, v)`` along rays ``(ray, ox, oy, oz, dx, dy, dz)``.

    A ray is clipped to the box of samples, cut into midpoints of at most the step, and sampled trilinearly; a miss, also by null, is
    0, and so are absent samples.  Rays with equal origins and directions have one integral, which is taken once.  It is walked through the tiles of the field: a row is a ray in a tile, with the
    midpoints that it has there, so what is shuffled is the field once and a row for each tile that a ray crosses.
    Samples are taken in numpy.  A tile that very many rays cross is repeated for every ``RAYS`` of them.
    """
    each = _each(spacing)
    if min(shape) < 1 or not (math.isfinite(step) and step > 0):
        raise ShapeError(f"rays through {shape} in steps of {step}")
    side, ends = TILES[3], [c + a for c in "od" for a in AXES]
    rays = rays.select("ray", *(F.col(c).cast("double").alias(c) for c in ends))
    # Different rays may be few and long: a number of partitions by name is not coalesced into one task.
    parts = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = cut_lineage(rays.select(*ends).dropna().distinct().repartition(parts, *ends).withColumn("ray", F.monotonically_increasing_id()))
    r = lines.withColumn("_len", F.sqrt(sum((F.col("d" + a) ** 2 for a in AXES), F.lit(0.0))))
    near, far, hit = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for a, n, o, d in zip(AXES, shape, origin, each, strict=True):
        r = r.withColumn("_u" + a, F.col("d" + a) / F.col("_len"))
        low, high = F.lit(float(o)) - F.col("o" + a), F.lit(float(o) + (n - 1) * d) - F.col("o" + a)
        flat = F.col("_u" + a) == 0
        slope = F.when(flat, F.lit(1.0)).otherwise(F.col("_u" + a))
        t0, t1 = low / slope, high / slope
        near = F.greatest(near, F.when(flat, F.lit(0.0)).otherwise(F.least(t0, t1)))
        far = F.least(far, F.when(flat, F.lit(float("inf"))).otherwise(F.greatest(t0, t1)))
        hit = hit & (~flat | ((low <= 0) & (high >= 0)))
    r = r.withColumn("_near", near).withColumn("_far", far).filter(hit & (F.col("_far") > F.col("_near")))
    n = F.greatest(F.ceil((F.col("_far") - F.col("_near")) / step), F.lit(1))
    # In units of cells: position of the first end, and what the midpoints are apart.
    through = r.withColumn("n", n.cast("long")).withColumn("dl", (F.col("_far") - F.col("_near")) / F.col("n"))
    start = [((F.col("o" + a) + F.col("_near") * F.col("_u" + a) - o) / d).alias("g" + a) for a, o, d in zip(AXES, origin, each, strict=True)]
    pace = [(F.col("dl") * F.col("_u" + a) / d).alias("h" + a) for a, d in zip(AXES, each, strict=True)]
    through = through.select("ray", "n", "dl", *start, *pace)

    def cells_of(rows: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        """The cell of each midpoint; rounding may not lead beyond the box."""
        g = np.stack([rows["g" + a] + (at + 0.5) * rows["h" + a] for a in AXES])
        return np.clip(g, 0, np.array(shape)[:, None] - 1.0)

    names = ["n", "dl", *("g" + a for a in AXES), *("h" + a for a in AXES)]

    def pieces(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, midpoint) of all midpoints of rows, at most ``_SAMPLES`` of a row and a bounded number in all at a time."""
        row = np.repeat(np.arange(len(first)), -(-(last - first) // _SAMPLES))
        part = np.arange(len(row)) - np.searchsorted(row, row)
        lo = first[row] + part * _SAMPLES
        count = np.minimum(last[row], lo + _SAMPLES) - lo
        ends = np.cumsum(count)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * _SAMPLES, side="right")))
            n = count[at:to]
            yield np.repeat(row[at:to], n), np.repeat(lo[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = to

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {c: batch[c].to_numpy(dtype=float) for c in names}
            total = rows["n"].astype(np.int64)
            for row, at in pieces(np.zeros_like(total), total):
                tile = np.floor(cells_of({c: x[row] for c, x in rows.items()}, at)).astype(np.int64) // side
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (tile[:, 1:] != tile[:, :-1]).any(axis=0)]))
                own = row[starts]
                found = {f"t{k}": t[starts] for k, t in enumerate(tile)} | {"s0": at[starts], "s1": at[np.append(starts[1:], len(at)) - 1] + 1}
                yield batch[["ray", *names]].iloc[own].reset_index(drop=True).assign(**found)

    numbers = ", ".join(f"{c} double" for c in names[1:])
    rows = cut_lineage(map_batches(through, walk, f"ray long, t0 long, t1 long, t2 long, s0 long, s1 long, n long, {numbers}"))
    tiles = ["t0", "t1", "t2"]
    salts = rows.groupBy(*tiles).agg(F.ceil(F.count("*") / RAYS).cast("int").alias("salts"))
    dealt = rows.join(salts, tiles).withColumn("salt", F.pmod(F.xxhash64("ray", "s0"), F.col("salts")).cast("int"))
    samples = field.select(*(F.col("i" + a).cast("long").alias("i" + a) for a in AXES), F.col("v").cast("double").alias("v"))
    copies = salts.select(*(F.col(t).alias("to_" + t) for t in tiles), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("copy"))
    of_tile = [F.col(t) == F.col("to_" + t) for t in tiles]
    seen = _dealt(samples, tuple("i" + a for a in AXES), shape, 0, 1).join(copies, of_tile).select("copy", *("to_" + t for t in tiles), *("i" + a for a in AXES), "v")

    def sample(key: tuple, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({"ray": own["ray"], "v": 0.0}) if len(own) else pd.DataFrame()
        low = np.array([t * side for t in key[:3]])
        box = np.zeros((side + 2,) * 3)
        box[tuple(held["i" + a].to_numpy() - lo for a, lo in zip(AXES, low, strict=True))] = held["v"].to_numpy()
        sums, rows = np.zeros(len(own)), {c: own[c].to_numpy() for c in names}
        for row, at in pieces(own["s0"].to_numpy(), own["s1"].to_numpy()):
            g = cells_of({c: x[row] for c, x in rows.items()}, at)
            b = np.floor(g).astype(np.int64)
            f, b = g - b, b - low[:, None]
            value = np.zeros(len(at))
            for corner in np.ndindex(2, 2, 2):
                weight = np.ones(len(at))
                for k, c in enumerate(corner):
                    weight *= f[k] if c else 1 - f[k]
                value += weight * box[tuple(b[k] + c for k, c in enumerate(corner))]
            sums += np.bincount(row, weights=value * rows["dl"][row], minlength=len(sums))
        return pd.DataFrame({"ray": own["ray"], "v": sums})

    met = dealt.groupBy(*tiles, "salt").cogroup(seen.groupBy(*("to_" + t for t in tiles), "copy")).applyInPandas(sample, "ray long, v double")
    sums = met.groupBy("ray").agg(F.sum("v").alias("v"))
    found = lines.join(sums, "ray").select(*ends, "v")
    return rays.join(found, ends, "left").select("ray", F.coalesce("v", F.lit(0.0)).alias("v"))
