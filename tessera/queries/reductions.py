"""Reductions, norms and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import linalg, reduce, scan
from tessera.plans import Reduction, batch, mixed, stream
from tessera.queries.elementwise import CELLS
from tessera.sources import from_packed, from_table
from tessera.tensor import Tensor


def _embeddings(spark: SparkSession, sf_dir: str) -> Tensor:
    return from_packed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", (1 << 40, 64))


def full_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {"i": "l_orderkey"}, F.col("l_quantity"), (0,))
    return reduce.full(t, "sum", "min", "max", "mean").select("sum", "min", "max", F.round("mean", 6).alias("mean"))


def full_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors near one, so that the product stays finite: the log of it is compared."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((1 + F.col("o_totalprice") / 1e12).alias("v"))
    return reduce.full(rows, "prod").select(F.round("prod", 6).alias("prod"))


def empty_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reductions of nothing give the identities."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size < 0").select(F.col("p_retailprice").alias("v"))
    return reduce.full(rows, "sum", "prod", "min", "max")


def axis_reduction_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _embeddings(spark, sf_dir)
    return batch(t.df, {op: (op, F.col("v")) for op in ("sum", "min", "max", "mean")}, ["j"]).select("j", *((F.round(op, 6) + 0.0).alias(op) for op in ("sum", "min", "max", "mean")))


def axis_reduction_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are packed, so the reduction is a fold within the row and needs no shuffle."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    product = F.aggregate(x, F.lit(1.0), lambda a, v: a * (1 + v / 10))
    return rows.select(F.col("vec_id").alias("i"), F.round(total, 6).alias("sum"), F.round(product, 6).alias("prod"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), F.round(total / F.size("embedding"), 6).alias("mean"))


def grouped_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity")
    return batch(rows, {"sum": ("sum", q), "min": ("min", q), "max": ("max", q), "mean": ("mean", q)}, ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "sum", "min", "max", F.round("mean", 6).alias("mean"))


def generic_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis reduced with a function of the caller's: the alternating fold a -> x - a."""
    return reduce.axis_with(_embeddings(spark, sf_dir), "j", lambda a, x: x - a, 0.0).df.select("i", (F.round("v", 6) + 0.0).alias("v"))


def _joint(a, b):
    """(1 + a)(1 + b) - 1: associative."""
    return a + b + a * b


def associative_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long axis reduced with an associative function of the caller's, in chunks."""
    small = _embeddings(spark, sf_dir).map(lambda v: v / 1000)
    return reduce.axis_combine(small, "i", _joint, 0.0).df.select("j", (F.round("v", 6) + 0.0).alias("v"))


def associative_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one line, scanned with an associative function of the caller's."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1e10).alias("v"))
    length = (rows.agg(F.max("i")).first()[0] or 0) + 1
    return scan.scan_with(rows, [], "i", _joint, length).select("i", (F.round("scan", 6) + 0.0).alias("v"))


def tall_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix sums down every column of the embeddings: each column is one long line in chunks."""
    return scan.cumsum(_embeddings(spark, sf_dir), "i").df.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two axes sums of the same index, multiplied and summed."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").alias("n"))
    a, b = (from_table(rows, {"i": "l_orderkey"}, c, (0,)) for c in ("q", "n"))
    return reduce.dot(a, b)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), {"i": "c_custkey"}, "c_acctbal", (0,))
    return reduce.norms(t).select(*(F.round(c, 4).alias(c) for c in ("norm_l1", "norm_l2", "norm_max")))


def matrix_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the Gram matrix of all vectors."""
    square = linalg.gram(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    return reduce.trace(square).select(F.round("trace", 6).alias("trace"))


def mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many reductions of one table, prepared together: one scan and one shuffle."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = batch(rows, {"gross": ("sum", price), "net": ("sum", price * (1 - discount)), "squares": ("sum", discount * discount), "largest": ("max", price)}, ["l_returnflag"])
    return out.select("l_returnflag", *(F.round(c, 2).alias(c) for c in ("gross", "net", "squares", "largest")))


def flagship_axis_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unary and a binary map, then an axis sum."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stream(
        rows,
        lambda d: d.select("l_returnflag", (F.exp(-F.col("l_discount")) * F.col("l_extendedprice")).alias("v")),
        lambda d: batch(d, {"v": ("sum", F.col("v"))}, ["l_returnflag"]),
        lambda d: d.select("l_returnflag", F.round("v", 2).alias("v")),
    )


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy("l_returnflag", F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("day")).agg(F.sum("l_quantity").alias("v"))


def mixed_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar, two axes of each kind and a pair of axes from one scan of the embeddings' cells."""
    v = F.col("v")
    cells = _embeddings(spark, sf_dir).df
    found = mixed(cells, {
        "total": Reduction("sum", v), "largest": Reduction("max", F.abs(v)), "column_mean": Reduction("mean", v, ("j",)), "column_squares": Reduction("sum", v * v, ("j",)),
        "row_least": Reduction("min", v, ("i",)), "row_squares": Reduction("sum", v * v, ("i",)),
    })
    return found.select("name", F.coalesce("i", F.lit(-1)).cast("long").alias("i"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


def cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(_daily(spark, sf_dir), ["l_returnflag"], "day").select("l_returnflag", "day", "scan")


def suffix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(_daily(spark, sf_dir), ["l_returnflag"], "day", reverse=True).select("l_returnflag", "day", "scan")


def cumprod(spark: SparkSession, sf_dir: str) -> DataFrame:
    near_one = _daily(spark, sf_dir).withColumn("v", 1 + F.col("v") / 1e6)
    return scan.scan(near_one, ["l_returnflag"], "day", op="prod").select("l_returnflag", "day", F.round("scan", 6).alias("scan"))


def suffix_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    near_one = _daily(spark, sf_dir).withColumn("v", 1 + F.col("v") / 1e6)
    return scan.scan(near_one, ["l_returnflag"], "day", op="prod", reverse=True).select("l_returnflag", "day", F.round("scan", 6).alias("scan"))


def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(_daily(spark, sf_dir), ["l_returnflag"], "day", op="max").select("l_returnflag", "day", "scan")


def long_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line over all orders, scanned in two levels of chunks."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).alias("v"))
    return scan.long_line(rows, "i", chunk=1 << 12).select("i", F.col("scan").alias("v"))


def long_line_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).alias("v"))
    return scan.long_line(rows, "i", reverse=True, chunk=1 << 12).select("i", F.col("scan").alias("v"))


DAILY = "SELECT l_returnflag, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


def _scan_sql(fn: str, value: str, order: str, digits: bool = False) -> str:
    found = f"{fn}({value}) OVER (PARTITION BY l_returnflag ORDER BY day{order} ROWS UNBOUNDED PRECEDING)"
    return f"WITH d AS ({DAILY}) SELECT l_returnflag, day, {f'round({found}, 6)' if digits else found} AS scan FROM d"


QUERIES = {
    f.__name__: f
    for f in (flagship_axis_sum, full_reduction, full_product, empty_reduction, axis_reduction_0, axis_reduction_1, grouped_axis, generic_axis, dot_product, vector_norms,
              matrix_trace, mixed_batch, mixed_axes, cumsum, suffix_sum, cumprod, suffix_prod, running_max, long_line_scan, long_line_suffix, associative_axis,
              associative_scan, tall_scan)
}
ORACLES = {
    "flagship_axis_sum": "SELECT l_returnflag, round(sum(exp(-l_discount) * l_extendedprice), 2) AS v FROM lineitem GROUP BY l_returnflag",
    "full_reduction": "SELECT sum(l_quantity) AS sum, min(l_quantity + 0) AS min, max(l_quantity + 0) AS max, round(avg(l_quantity), 6) AS mean FROM lineitem",
    "full_product": "SELECT round(product(1 + o_totalprice / 1e12), 6) AS prod FROM orders",
    "empty_reduction": "SELECT 0::DOUBLE AS sum, 1::DOUBLE AS prod, 1.7976931348623157e308::DOUBLE AS min, -1.7976931348623157e308::DOUBLE AS max",
    "axis_reduction_0": f"SELECT j, round(sum(v), 6) + 0 AS sum, round(min(v), 6) + 0 AS min, round(max(v), 6) + 0 AS max, round(avg(v), 6) + 0 AS mean FROM ({CELLS}) GROUP BY j",
    "axis_reduction_1": f"SELECT i, round(sum(v), 6) AS sum, round(product(1 + v / 10), 6) AS prod, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM ({CELLS}) GROUP BY i",
    "grouped_axis": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL",
    "generic_axis": f"SELECT i, round(sum(CASE WHEN j % 2 = 1 THEN v ELSE -v END), 6) + 0 AS v FROM ({CELLS}) GROUP BY i",
    "dot_product": "SELECT sum(q * n)::DOUBLE AS dot FROM (SELECT sum(l_quantity) AS q, sum(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)",
    "vector_norms": "SELECT round(sum(abs(c_acctbal)), 4) AS norm_l1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS norm_l2, round(max(abs(c_acctbal)), 4) AS norm_max FROM customer",
    "matrix_trace": f"SELECT round(sum(v * v), 6) AS trace FROM ({CELLS})",
    "mixed_axes": """WITH e AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT 'total' AS name, -1::BIGINT AS i, -1::BIGINT AS j, round(sum(v), 6) + 0 AS v FROM e UNION ALL SELECT 'largest', -1, -1, round(max(abs(v)), 6) + 0 FROM e
        UNION ALL SELECT 'column_mean', -1, j, round(avg(v), 6) + 0 FROM e GROUP BY j UNION ALL SELECT 'column_squares', -1, j, round(sum(v * v), 6) + 0 FROM e GROUP BY j
        UNION ALL SELECT 'row_least', i, -1, round(min(v), 6) + 0 FROM e GROUP BY i UNION ALL SELECT 'row_squares', i, -1, round(sum(v * v), 6) + 0 FROM e GROUP BY i""",
    "mixed_batch": "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS gross, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_discount * l_discount), 2) AS squares, round(max(l_extendedprice), 2) AS largest FROM lineitem GROUP BY l_returnflag",
    "cumsum": _scan_sql("sum", "v", ""),
    "suffix_sum": _scan_sql("sum", "v", " DESC"),
    "cumprod": _scan_sql("product", "1 + v / 1e6", "", True),
    "suffix_prod": _scan_sql("product", "1 + v / 1e6", " DESC", True),
    "associative_axis": f"SELECT j, round(product(1 + v / 1000) - 1, 6) + 0 AS v FROM ({CELLS}) GROUP BY j",
    "associative_scan": "SELECT o_orderkey AS i, round(product(1 + o_totalprice / 1e10) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1, 6) + 0 AS v FROM orders",
    "tall_scan": f"SELECT i, j, round(sum(v) OVER (PARTITION BY j ORDER BY i ROWS UNBOUNDED PRECEDING), 6) + 0 AS v FROM ({CELLS})",
    "running_max": _scan_sql("max", "v", ""),
    "long_line_scan": "SELECT o_orderkey AS i, sum(round(o_totalprice * 100)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS v FROM orders",
    "long_line_suffix": "SELECT o_orderkey AS i, sum(round(o_totalprice * 100)) OVER (ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS v FROM orders",
}
