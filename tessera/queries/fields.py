"""Stencils, time steps, ray integrals and random tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import field, random
from tessera.tensor import Tensor

NX, NY = 2600, 20
LEAST, BOX, SPACING = 40, (40, 36), (0.5, 1.0, 2.0)
FIRST_DAY = "1990-01-01"
ROWS = 1 << 20  # that meet in a task


def _grid(spark: SparkSession, sf_dir: str) -> Tensor:
    """Line items by day and supplier's group, counted: a full grid."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit(FIRST_DAY).cast("date")).cast("long") % NX
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(day.alias("x"), (F.col("l_suppkey") % NY).alias("y")).agg(F.count("*").cast("double").alias("v"))
    return Tensor(counts, ("x", "y"), (NX, NY)).densify()


def _laplacian(boundary: str, polarity: float = 1.0):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return field.laplacian(_grid(spark, sf_dir), (0.5, 2.0), boundary, polarity).df

    return query


def _box(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Line items' quantities on a grid that is the longer the more orders there are: only cells that have some."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = max(LEAST, items.agg(F.max("l_orderkey")).first()[0] // 500 + 3)
    place = (F.floor(F.col("l_orderkey") / 500).alias("x"), (F.col("l_partkey") % BOX[0]).alias("y"), (F.col("l_suppkey") % BOX[1]).alias("z"))
    return items.groupBy(*place).agg((F.sum("l_quantity") / 64).alias("p")), (n, *BOX)


def fdtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four acoustic steps in one shuffle, on a grid with a spacing of its own along each axis; pressure comes from line items."""
    p, shape = _box(spark, sf_dir)
    parts = field.parts_of(p, shape)
    box = Tensor.full(spark, shape, 0.0, ("x", "y", "z")).df.drop("v").repartition(parts, "x", "y", "z").join(p.repartition(parts, "x", "y", "z"), ["x", "y", "z"], "left")
    cells = box.select("x", "y", "z", F.coalesce("p", F.lit(0.0)).alias("p"), *(F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")), F.lit(2.0).alias("rho"), F.lit(1.5).alias("c"))
    return field.fdtd(cells, shape, 0.125, SPACING, 4).select("x", "y", "z", *((F.round(c, 6) + 0.0).alias(c) for c in ("p", "vx", "vy", "vz")))


def ray_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-parallel rays through an affine field, one for each customer: midpoints make the integral exact."""
    ramp = Tensor.full(spark, (65, 5, 5), 0.0, ("ix", "iy", "iz")).df.select("ix", "iy", "iz", (F.col("ix") * 0.01 + 0.02).alias("v"))
    rays = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("ray"), F.lit(-10.0).alias("ox"), (F.col("c_nationkey") * 0.5).alias("oy"), F.lit(4.0).alias("oz"),
        (F.lit(1.0) + F.col("c_custkey") % 3).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"),
    )
    return field.ray_integrals(ramp, (65, 5, 5), (0.0, 0.0, 0.0), 2.0, rays, 1.0).select("ray", F.round("v", 6).alias("v"))


def ray_integrals_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray along the orders for each customer, through line items on a grid whose axes have spacings of their own: with one
    midpoint between two samples the integral is the sum of their means."""
    p, shape = _box(spark, sf_dir)
    samples = p.select(*(F.col(a).alias("i" + a) for a in "xyz"), F.col("p").alias("v"))
    rays = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("ray"), F.lit(-1.0).alias("ox"), (F.col("c_custkey") % BOX[0] * SPACING[1]).alias("oy"), (F.col("c_nationkey") % BOX[1] * SPACING[2]).alias("oz"),
        F.lit(3.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"),
    )
    return field.ray_integrals(samples, shape, (0.0, 0.0, 0.0), SPACING, rays, SPACING[0]).select("ray", (F.round("v", 4) + 0.0).alias("v"))


def random_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for seeded tensors: ranges, repeatability whatever the partitions, seeds that differ, moments."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    u, again = random.uniform(spark, (rows, 2), -1.0, 2.0, 42), random.uniform(spark, (rows, 2), -1.0, 2.0, 42)
    other, z = random.uniform(spark, (rows, 2), -1.0, 2.0, 43), random.normal(spark, (rows, 2), 1.0, 2.0, 42)
    # The second copy in other partitions, more of them the more rows there are; all meet in as many as keep a task small.
    few, parts = max(3, rows // ROWS), max(4, 2 * rows // ROWS)
    again = again.df.repartition(few).withColumnRenamed("v", "w")
    one, two, three = (t.repartition(parts, "i", "j") for t in (u.df, other.df.withColumnRenamed("v", "x"), z.df.withColumnRenamed("v", "z")))
    same = one.join(again, ["i", "j"]).join(two, ["i", "j"]).join(three, ["i", "j"])
    return same.agg(
        F.count("*").alias("n"), F.min((F.col("v") >= -1) & (F.col("v") < 2)).alias("within"), F.min(F.col("v") == F.col("w")).alias("repeatable"),
        (F.avg((F.col("v") == F.col("x")).cast("int")) < 0.001).alias("seeded"), (F.abs(F.avg("v") - 0.5) < 0.05).alias("uniform_mean"),
        (F.abs(F.avg("z") - 1) < 0.1).alias("normal_mean"), (F.abs(F.stddev("z") - 2) < 0.1).alias("normal_deviation"),
    )


GRID = f"""g AS (SELECT x.range AS x, y.range AS y, coalesce(c.n, 0)::DOUBLE AS v FROM range({NX}) x CROSS JOIN range({NY}) y
    LEFT JOIN (SELECT date_diff('day', DATE '{FIRST_DAY}', l_shipdate::DATE) % {NX} AS x, l_suppkey % {NY} AS y, count(*) AS n FROM lineitem GROUP BY ALL) c ON c.x = x.range AND c.y = y.range)"""


def _second_sql(at: str, other: str, n: int, h2: float, boundary: str) -> str:
    w = f"OVER (PARTITION BY {other} ORDER BY {at})"
    lag, lead = f"lag(v) {w}", f"lead(v) {w}"
    inner = f"{lag} - 2 * v + {lead}"
    full = f"OVER (PARTITION BY {other} ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    first, last = {
        "dirichlet": ("-2 * v", "-2 * v"),
        "periodic": (f"nth_value(v, {n - 1}) {full} - 2 * v + {lead}", f"{lag} - 2 * v + nth_value(v, 2) {full}"),
        "neumann": (f"2 * v - 5 * {lead} + 4 * lead(v, 2) {w} - lead(v, 3) {w}", f"2 * v - 5 * {lag} + 4 * lag(v, 2) {w} - lag(v, 3) {w}"),
    }[boundary]
    return f"(CASE {at} WHEN 0 THEN {first} WHEN {n - 1} THEN {last} ELSE {inner} END) / {h2}"


def _laplacian_sql(boundary: str, polarity: int = 1) -> str:
    return f"WITH {GRID} SELECT x, y, {polarity} * ({_second_sql('x', 'y', NX, 0.25, boundary)} + {_second_sql('y', 'x', NY, 4.0, boundary)}) AS v FROM g"


_LENGTH = f"(SELECT greatest({LEAST}, max(l_orderkey) // 500 + 3) FROM lineitem)"
_ITEMS = f"q AS (SELECT l_orderkey // 500 AS x, l_partkey % {BOX[0]} AS y, l_suppkey % {BOX[1]} AS z, sum(l_quantity) / 64 AS p FROM lineitem GROUP BY ALL)"
_INSIDE = " AND ".join(f"{a} > 0 AND {a} < {n} - 1" for a, n in zip("xyz", (_LENGTH, *BOX), strict=True))


def _slope(column: str, a: str) -> str:
    rest = ", ".join(o for o in "xyz" if o != a)
    w = f"OVER (PARTITION BY {rest} ORDER BY {a})"
    return f"(lead({column}) {w} - lag({column}) {w}) / {2 * SPACING['xyz'.index(a)]}::DOUBLE"


def _step_sql(n: int) -> str:
    velocity = ", ".join(f"CASE WHEN {_INSIDE} THEN v{a} - 0.0625 * {_slope('p', a)} ELSE 0 END AS v{a}" for a in "xyz")
    return f"""v{n} AS (SELECT x, y, z, p, {velocity} FROM s{n - 1}),
        s{n} AS (SELECT x, y, z, CASE WHEN {_INSIDE} THEN p - 0.125 * 2 * 2.25 * ({' + '.join(_slope('v' + a, a) for a in 'xyz')}) ELSE 0 END AS p, vx, vy, vz FROM v{n})"""


QUERIES = {
    "laplacian_dirichlet": _laplacian("dirichlet"), "laplacian_periodic": _laplacian("periodic"), "laplacian_neumann": _laplacian("neumann", -1.0),
    **{f.__name__: f for f in (fdtd, ray_integrals, ray_integrals_items, random_contract)},
}
ORACLES = {
    "laplacian_dirichlet": _laplacian_sql("dirichlet"),
    "laplacian_periodic": _laplacian_sql("periodic"),
    "laplacian_neumann": _laplacian_sql("neumann", -1),
    "fdtd": f"""WITH {_ITEMS}, s0 AS (SELECT x.range AS x, y.range AS y, z.range AS z, coalesce(q.p, 0)::DOUBLE AS p, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 0::DOUBLE AS vz
            FROM range({_LENGTH}) x CROSS JOIN range({BOX[0]}) y CROSS JOIN range({BOX[1]}) z LEFT JOIN q ON q.x = x.range AND q.y = y.range AND q.z = z.range),
        {", ".join(map(_step_sql, range(1, 5)))} SELECT x, y, z, round(p, 6) + 0 AS p, round(vx, 6) + 0 AS vx, round(vy, 6) + 0 AS vy, round(vz, 6) + 0 AS vz FROM s4""",
    "ray_integrals_items": f"""WITH {_ITEMS}, w AS (SELECT y, z, sum(CASE WHEN x = 0 OR x = {_LENGTH} - 1 THEN p / 2 ELSE p END) * {SPACING[0]} AS v FROM q GROUP BY ALL)
        SELECT c_custkey AS ray, round(coalesce(w.v, 0)::DOUBLE, 4) + 0 AS v FROM customer LEFT JOIN w ON w.y = c_custkey % {BOX[0]} AND w.z = c_nationkey % {BOX[1]}""",
    "ray_integrals": "SELECT c_custkey AS ray, CASE WHEN c_nationkey * 0.5 <= 8 THEN 43.52 ELSE 0 END::DOUBLE AS v FROM customer",
    "random_contract": "SELECT 2 * count(*) AS n, true AS within, true AS repeatable, true AS seeded, true AS uniform_mean, true AS normal_mean, true AS normal_deviation FROM lineitem",
}
