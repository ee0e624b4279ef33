"""Elementwise maps, comparisons, broadcasts and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ACTIVATIONS, BINARY, COMPARE, PARAMETERIZED, UNARY
from tessera.operators.reduce import axis
from tessera.plans import tagged
from tessera.sources import from_packed, from_table

# erf by its power series without cancellation, 2 x exp(-x^2) / sqrt(pi) (1 + 2x^2/3 (1 + 2x^2/5 (...))), from the inside.
ERF = "(1.1283791670955126::DOUBLE * ({x}) * exp(-({x}) * ({x})) * list_reduce(list_prepend(1::DOUBLE, list_reverse(range(1, 400))), lambda s, n: 1 + s * 2 * ({x}) * ({x}) / (2 * n + 1)))"


def erf_sql(x: str) -> str:
    return ERF.format(x=x)


# operator -> (argument, SQL); x is about -1 to 10, u within (0, 1)
MATH = {
    "exp": ("x", "exp(x)"), "exp_neg": ("x", "exp(-x)"), "ln": ("u", "ln(u)"), "sin": ("x", "sin(x)"), "cos": ("x", "cos(x)"),
    "tan": ("u", "tan(u)"), "asin": ("u", "asin(u)"), "acos": ("u", "acos(u)"), "atan": ("x", "atan(x)"), "sinh": ("u", "sinh(u)"),
    "cosh": ("u", "cosh(u)"), "asinh": ("x", "asinh(x)"), "acosh": ("w", "acosh(w)"), "atanh": ("h", "atanh(h)"), "sqrt": ("u", "sqrt(u)"),
    "abs": ("x", "abs(x)"), "neg": ("x", "-x"), "recip": ("w", "1 / w"), "identity": ("x", "x"), "log2": ("u", "log2(u)"), "log10": ("u", "log10(u)"),
    "exp2": ("x", "pow(2, x)"), "expm1": ("u", "exp(u) - 1"), "log1p": ("u", "ln(1 + u)"), "sign": ("x", "sign(x)::DOUBLE"), "floor": ("x", "floor(x)"),
    "ceil": ("x", "ceil(x)"), "round": ("x", "round_even(x, 0)"), "trunc": ("x", "trunc(x)"), "erf": ("x", erf_sql("x")),
    "erfc": ("x", f"1 - {erf_sql('x')}"), "lgamma": ("w", "lgamma(w)"),
}


def unary_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, u = F.col("c_acctbal") / 1000, (F.col("c_acctbal") + 1000) / 11001
    at = {"x": x, "u": u, "w": u + 1, "h": u * 0.9}
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", *((F.round(UNARY[op](at[arg]), 6) + 0.0).alias(op) for op, (arg, _) in MATH.items()))


UNARY_SQL = (
    "WITH t AS (SELECT c_custkey, c_acctbal / 1000 AS x, (c_acctbal + 1000) / 11001 AS u, (c_acctbal + 1000) / 11001 + 1 AS w, (c_acctbal + 1000) / 11001 * 0.9::DOUBLE AS h FROM customer) SELECT c_custkey, "
    + ", ".join(f'round({sql}, 6) + 0 AS "{op}"' for op, (_, sql) in MATH.items())
    + " FROM t"
)

SIGMOID, SOFTPLUS = "(1 / (1 + exp(-x)))", "ln(1 + exp(x))"
TANH_INNER = "tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x))"
NORMAL_CDF = f"(0.5 * (1 + {erf_sql('(x / 1.4142135623730951::DOUBLE)')}))"
ACTIVATION_SQL = {
    "gelu": f"x * {NORMAL_CDF}", "gelu_grad": f"{NORMAL_CDF} + x * exp(-x * x / 2) / 2.5066282746310002::DOUBLE",
    "gelu_tanh": f"0.5 * x * (1 + {TANH_INNER})",
    "gelu_tanh_grad": f"0.5 * (1 + {TANH_INNER}) + 0.5 * x * (1 - {TANH_INNER} * {TANH_INNER}) * 0.7978845608028654::DOUBLE * (1 + 0.134145::DOUBLE * x * x)",
    "relu": "greatest(x, 0)", "relu_grad": "(x > 0)::INT::DOUBLE", "sigmoid": SIGMOID, "sigmoid_grad": "x * (1 - x)", "tanh": "tanh(x)", "tanh_grad": "1 - x * x",
    "silu": f"x * {SIGMOID}", "silu_grad": f"{SIGMOID} * (1 + x * (1 - {SIGMOID}))", "softplus": SOFTPLUS, "softplus_grad": SIGMOID,
    "mish": f"x * tanh({SOFTPLUS})", "mish_grad": f"tanh({SOFTPLUS}) + x * {SIGMOID} * (1 - tanh({SOFTPLUS}) * tanh({SOFTPLUS}))",
    "elu": "CASE WHEN x >= 0 THEN x ELSE exp(x) - 1 END", "elu_grad": "CASE WHEN x >= 0 THEN 1::DOUBLE ELSE exp(x) END",
}


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = (F.col("l_discount") - F.col("l_tax")) * 10
    return rows.select("l_orderkey", "l_linenumber", *((F.round(ACTIVATIONS[op](x), 6) + 0.0).alias(op) for op in ACTIVATION_SQL))


ACTIVATIONS_SQL = (
    "WITH t AS (SELECT l_orderkey, l_linenumber, (l_discount - l_tax) * 10 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f'round({sql}, 6) + 0 AS "{op}"' for op, sql in ACTIVATION_SQL.items())
    + " FROM t"
)


def parameterized(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", *(PARAMETERIZED[op](x, 100.0, 5000.0).alias(op) for op in PARAMETERIZED))


def binary_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_extendedprice") / 1000, F.col("l_quantity") / 10
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", *(F.round(BINARY[op](a, b) if op != "pow" else F.pow(b, F.col("l_discount")), 9).alias(op) for op in BINARY))


def scalar_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar forms on either side, each a map of the same tensor."""
    t = from_table(spark.read.parquet(f"{sf_dir}/part.parquet"), {"i": "p_partkey"}, "p_size", (0,))
    forms = {"add": t + 3, "radd": 3 + t, "sub": t - 3, "rsub": 3 - t, "mul": t * 3, "div": t / 4, "rdiv": 4 / t, "pow": t**2, "rpow": 1.1**t, "neg": -t}
    return tagged({name: f.df.select("i", (F.round("v", 6) + 0.0).alias("v")) for name, f in forms.items()}).select("name", "i", "v")


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity"), F.col("l_linenumber").cast("double") * 7
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy("l_linenumber").agg(*(F.sum(COMPARE[op](a, b)).alias(op) for op in COMPARE))


def masked_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison mask as a filter, pushed to the scan."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter((F.col("l_quantity") >= 49) & (F.col("l_discount") < 0.03))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


def broadcast_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix minus its row means: the mean has one axis less and is broadcast by the join key."""
    m = from_packed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", (1 << 40, 64))
    return (m - axis(m, "j", "mean")).df.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transpose, slice with a step, and reshape of the same matrix, as one table."""
    m = from_packed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", (1 << 40, 64))
    parts = {"transpose": m.transpose("j", "i").df.toDF("a", "b", "v"), "slice": m.slice("j", 4, 60, 7).df.toDF("a", "b", "v"), "reshape": m.reshape((1 << 42, 16), ("a", "b")).df}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("view"), "a", "b", (F.round("v", 6) + 0.0).alias("v"))
        out = df if out is None else out.unionByName(df)
    return out


CELLS = "SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"
QUERIES = {f.__name__: f for f in (unary_math, activations, parameterized, binary_arithmetic, scalar_arithmetic, comparisons, masked_filter, broadcast_subtract, views)}
ORACLES = {
    "unary_math": UNARY_SQL,
    "activations": ACTIVATIONS_SQL,
    "parameterized": """SELECT c_custkey, CASE WHEN c_acctbal < 100 THEN 100 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END AS hardtanh,
        (c_acctbal > 100 AND c_acctbal < 5000)::INT::DOUBLE AS hardtanh_grad, CASE WHEN c_acctbal > 100 THEN c_acctbal ELSE 5000 END AS threshold,
        (c_acctbal > 100)::INT::DOUBLE AS threshold_grad FROM customer""",
    "binary_arithmetic": """SELECT l_orderkey, l_linenumber, round(a + b, 9) AS add, round(a - b, 9) AS sub, round(a * b, 9) AS mul, round(a / b, 9) AS div,
        round(pow(b, l_discount), 9) AS pow FROM (SELECT *, l_extendedprice / 1000 AS a, l_quantity / 10 AS b FROM lineitem)""",
    "scalar_arithmetic": " UNION ALL ".join(
        f"SELECT '{name}' AS name, p_partkey AS i, round({sql}, 6) + 0 AS v FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)"
        for name, sql in {"add": "x + 3", "radd": "x + 3", "sub": "x - 3", "rsub": "3 - x", "mul": "x * 3", "div": "x / 4", "rdiv": "4 / x", "pow": "x * x", "rpow": "pow(1.1::DOUBLE, x)", "neg": "-x"}.items()
    ),
    "comparisons": "SELECT l_linenumber, "
    + ", ".join(f"sum((l_quantity {op} l_linenumber * 7)::INT)::DOUBLE AS {name}" for name, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")))
    + " FROM lineitem GROUP BY l_linenumber",
    "masked_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.03",
    "broadcast_subtract": f"WITH m AS ({CELLS}) SELECT i, j, round(v - avg(v) OVER (PARTITION BY i), 6) + 0 AS v FROM m",
    "views": f"""WITH m AS ({CELLS})
        SELECT 'transpose' AS view, j AS a, i AS b, round(v, 6) + 0 AS v FROM m
        UNION ALL SELECT 'slice', i, (j - 4) // 7, round(v, 6) + 0 FROM m WHERE j >= 4 AND j < 60 AND (j - 4) % 7 = 0
        UNION ALL SELECT 'reshape', (i * 64 + j) // 16, (i * 64 + j) % 16, round(v, 6) + 0 FROM m""",
}
