"""Iterative solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import solve, spectral
from tessera.session import cut_lineage

PARTS = 1 << 40  # suppliers are numbered from here


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers as nodes of a graph with line items as edges: the cells of twice its degrees less its weights, which
    is symmetric and positive definite, and the quantity of each node."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + PARTS).alias("b"), "l_quantity")
    both = items.unionByName(items.select(F.col("b").alias("a"), F.col("a").alias("b"), "l_quantity"))
    edges = both.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg((-F.count("*")).cast("double").alias("v"))
    nodes = both.groupBy(F.col("a").alias("i")).agg((2 * F.count("*")).cast("double").alias("v"), F.sum("l_quantity").alias("q"))
    return edges.unionByName(nodes.select("i", F.col("i").alias("j"), "v")), nodes.select("i", F.col("q").alias("v"))


def conjugate_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A x of the x that solves A x = b, at every node: SQL has b."""
    a, b = _graph(spark, sf_dir)
    a = cut_lineage(a)
    found = solve.conjugate_gradients(a, b, 1e-11)
    product = a.join(found.x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return product.select("i", (F.round("v", 3) + 0.0).alias("v"), F.lit(found.converged).alias("converged"))


def singular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest singular value of the parts' and suppliers' counts, and its right vector: SQL has power iteration."""
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.count("*").cast("double").alias("v"))
    found = spectral.singular_pairs(counts, 1, tolerance=1e-10)
    return found.right.select("j", F.round(F.abs(F.col("x")[0]), 5).alias("v"), F.lit(round(float(found.values[0]), 5)).alias("largest"))


_POWERS = 40
QUERIES = {"conjugate_gradients": conjugate_gradients, "singular_pairs": singular_pairs}
ORACLES = {
    "conjugate_gradients": f"""SELECT i, round(sum(q), 3) + 0 AS v, true AS converged FROM (
        SELECT l_partkey AS i, l_quantity AS q FROM lineitem UNION ALL SELECT l_suppkey + {PARTS}, l_quantity FROM lineitem) GROUP BY i""",
    "singular_pairs": """WITH a AS (SELECT l_partkey AS i, l_suppkey AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL),
        b AS MATERIALIZED (SELECT x.j AS i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y USING (i) GROUP BY ALL), x0 AS (SELECT DISTINCT j, 1::DOUBLE AS x, 1::DOUBLE AS norm FROM a), """
    + ", ".join(
        f"y{n} AS MATERIALIZED (SELECT b.i AS j, sum(b.v * x.x) AS x FROM b JOIN x{n - 1} x USING (j) GROUP BY b.i), x{n} AS MATERIALIZED (SELECT j, x / sqrt(sum(x * x) OVER ()) AS x, sqrt(sum(x * x) OVER ()) AS norm FROM y{n})"
        for n in range(1, _POWERS + 1)
    )
    + f" SELECT j, round(x, 5) AS v, round(sqrt(norm), 5) AS largest FROM x{_POWERS}",
}
