"""Dense and sparse products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import linalg, sparse, vector
from tessera.plans import tagged
from tessera.queries.elementwise import CELLS
from tessera.sources import from_packed, from_table
from tessera.tensor import Tensor


def _embeddings(spark: SparkSession, sf_dir: str) -> Tensor:
    return from_packed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", (1 << 40, 64))


def _regions(spark: SparkSession, sf_dir: str) -> Tensor:
    """Region by region: nations of one times those of the other, scaled."""
    m = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("i"), (F.col("n_nationkey") % 5).alias("j")).groupBy("i", "j").agg((F.count("*") / 4).alias("v"))
    return from_table(m, {"i": "i", "j": "j"}, "v", (5, 5))


def _by_segment(spark: SparkSession, sf_dir: str) -> Tensor:
    """Nation by market segment: customers."""
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("i"), segment.alias("j")).agg(F.count("*").alias("v"))
    return from_table(m.filter("j >= 0"), {"i": "i", "j": "j"}, "v", (25, 5))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.gram(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding"), "embedding").df.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def _square(spark: SparkSession, sf_dir: str) -> Tensor:
    """The Gram matrix of all embeddings, divided by 100."""
    return linalg.gram(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").map(lambda v: v / 100).rename(i="k", j="c")


def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings times a square matrix, which is small and broadcast."""
    return linalg.matmul(_embeddings(spark, sf_dir), _square(spark, sf_dir)).df.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def matmul_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in packed rows, without a shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), "embedding")
    out = linalg.matmul_rows(rows, "embedding", _square(spark, sf_dir))
    return out.select("i", F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


def matmul_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _by_segment(spark, sf_dir)
    return linalg.matmul(m.transpose("j", "i"), m).df


def matmul_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linalg.matmul_blocked(_embeddings(spark, sf_dir), _square(spark, sf_dir), block=64).df
    return out.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def batched_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of matrices, one per label, times a single broadcast matrix.  Vectors of one label and row add up in the product."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label is not null")
    cells = rows.select("label", F.expr("vec_id div 10").alias("i"), F.posexplode("embedding").alias("k", "v"))
    a = from_table(cells, {"b": "label", "i": "i", "k": "k"}, "v", (10, 1 << 40, 64))
    one = Tensor(_square(spark, sf_dir).df.select(F.lit(0).cast("long").alias("b"), "k", "c", "v"), ("b", "k", "c"), (1, 64, 64))
    return linalg.batched_matmul(a, one).df.select("b", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


def kron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.kron(_by_segment(spark, sf_dir), _regions(spark, sf_dir)).df


def matpow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.matpow(_regions(spark, sf_dir), 5).df


def _events(spark: SparkSession, sf_dir: str) -> Tensor:
    """User by event type: how many events of a large value.  Some users have none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    kinds = events.filter("value > 150").groupBy(F.col("user_id").alias("i"), (F.length("event_type") % 7).alias("j")).agg(F.count("*").alias("v"))
    return from_table(kinds, {"i": "i", "j": "j"}, "v", (users, 7))


def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an entry give 0."""
    x = Tensor(spark.range(7).select(F.col("id").alias("k"), (F.col("id") + 0.5).alias("v")), ("k",), (7,))
    return sparse.spmv(_events(spark, sf_dir), x).df


def spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Tensor.full(spark, (7, 3), 0.0, ("k", "j")).df.select("k", "j", (F.col("k") * 3 + F.col("j")).cast("double").alias("v"))
    return sparse.spmm(_events(spark, sf_dir), Tensor(b, ("k", "j"), (7, 3))).df


def spmv_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors in one join, and beside them the plain product, in this order, as one batch."""
    m = _events(spark, sf_dir)
    xs = [Tensor(spark.range(7).select(F.col("id").alias("k"), (F.col("id") * n + 1.0).alias("v")), ("k",), (7,)) for n in range(3)]
    plans = {f"many{n}": y.df for n, y in enumerate(sparse.spmv_many(m, xs))} | {"one": sparse.spmv(m, xs[2]).df}
    return tagged(plans).select("plan", "name", "i", "v")


def sparse_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by (order, line) are not a valid matrix: positions repeat."""
    t = from_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {"i": "l_orderkey", "j": "l_linenumber"}, "l_discount", (1 << 40, 7))
    return sparse.violations(t)


def csr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows, unpacked again."""
    packed = sparse.to_csr(_events(spark, sf_dir))
    return packed.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))


def to_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.to_dense(_events(spark, sf_dir)).df


def vector_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector updates over one pair of vectors, kept apart by name."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    a, b = from_table(rows, {"i": "p_partkey"}, "p_size", (0,)), from_table(rows, {"i": "p_partkey"}, "p_retailprice", (0,))
    made = {"axpy": vector.axpy(2.0, a, b), "xpay": vector.xpay(2.0, a, b), "add": vector.add(a, b), "sub": vector.subtract(a, b), "mul": vector.multiply(a, b), "div": vector.divide(a, b), "scale": vector.scale(a, 2.0)}
    return tagged({k: t.df.select("i", (F.round("v", 4) + 0.0).alias("v")) for k, t in made.items()}).select("name", "i", "v")


REGIONS = "SELECT n_regionkey AS i, n_nationkey % 5 AS j, count(*) / 4 AS v FROM nation GROUP BY ALL"
SEGMENT = f"SELECT c_nationkey AS i, list_position({list(SEGMENTS)}, c_mktsegment) - 1 AS j, count(*)::DOUBLE AS v FROM customer WHERE list_contains({list(SEGMENTS)}, c_mktsegment) GROUP BY ALL"
EVENTS = "SELECT user_id AS i, length(event_type) % 7 AS j, count(*)::DOUBLE AS v FROM events WHERE value > 150 GROUP BY ALL"
USERS = "(SELECT unnest(range((SELECT max(user_id) + 1 FROM events))) AS i)"
SQUARE = f"m AS ({CELLS}), g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / 100 AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL)"
BY_SQUARE = f"WITH {SQUARE} SELECT m.i, g.j, round(sum(m.v * g.v), 6) + 0 AS v FROM m JOIN g ON m.j = g.i GROUP BY ALL"
_SQUARE = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {0} a JOIN {1} b ON a.j = b.i GROUP BY ALL"
def fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred embeddings, their product with themselves, its trace and norms, one after the other."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = from_packed(rows, "vec_id", "embedding", (1 << 40, 64))
    gram = linalg.gram(rows.filter("embedding is not null"), "embedding")
    sums = x.along("i", "sum")
    both = (sums * 2 - sums).norms()
    found = {"trace": gram.trace(), **{f"gram_{k}": v for k, v in gram.norms().items()}, **{f"sums_{k}": v for k, v in both.items()}, "squares": (x * x).reduce("sum")["sum"]}
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in found.items()], "name string, v double")


QUERIES = {
    f.__name__: f
    for f in (gram, matmul, matmul_rows, matmul_transposed, matmul_blocked, batched_matmul, kron, matpow, spmv, spmm, spmv_many, sparse_violations, csr_rows, to_dense, vector_updates, fluent)
}
ORACLES = {
    "fluent": """WITH e AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
        g AS (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL), s AS (SELECT j, sum(v) AS v FROM e GROUP BY j)
        SELECT 'trace' AS name, round(sum(v), 4) AS v FROM g WHERE i = j UNION ALL SELECT 'gram_l1', round(sum(abs(v)), 4) FROM g UNION ALL SELECT 'gram_l2', round(sqrt(sum(v * v)), 4) FROM g
        UNION ALL SELECT 'gram_max', round(max(abs(v)), 4) FROM g UNION ALL SELECT 'sums_l1', round(sum(abs(v)), 4) FROM s UNION ALL SELECT 'sums_l2', round(sqrt(sum(v * v)), 4) FROM s
        UNION ALL SELECT 'sums_max', round(max(abs(v)), 4) FROM s UNION ALL SELECT 'squares', round(sum(v * v), 4) FROM e""",
    "gram": f"WITH m AS ({CELLS}) SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0 AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL",
    "matmul": BY_SQUARE,
    "matmul_rows": BY_SQUARE,
    "matmul_blocked": BY_SQUARE,
    "matmul_transposed": f"WITH m AS ({SEGMENT}) SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL",
    "batched_matmul": f"""WITH {SQUARE}, a AS (SELECT label AS b, m.i // 10 AS i, j AS k, sum(v) AS v FROM m JOIN embeddings e ON e.vec_id = m.i
        WHERE label IS NOT NULL GROUP BY ALL)
        SELECT a.b, a.i, g.j, round(sum(a.v * g.v), 6) + 0 AS v FROM a JOIN g ON a.k = g.i GROUP BY ALL""",
    "kron": f"WITH a AS ({SEGMENT}), b AS ({REGIONS}) SELECT a.i * 5 + b.i AS i, a.j * 5 + b.j AS j, a.v * b.v AS v FROM a, b",
    "matpow": f"WITH m AS ({REGIONS}), m2 AS ({_SQUARE.format('m', 'm')}), m4 AS ({_SQUARE.format('m2', 'm2')}) {_SQUARE.format('m', 'm4')}",
    "spmv": f"WITH m AS ({EVENTS}) SELECT r.i, coalesce(sum(m.v * (m.j + 0.5)), 0)::DOUBLE AS v FROM {USERS} r LEFT JOIN m ON m.i = r.i GROUP BY r.i",
    "spmm": f"""WITH m AS ({EVENTS}) SELECT r.i, c.j, coalesce(sum(m.v * (m.j * 3 + c.j)), 0)::DOUBLE AS v
        FROM {USERS} r CROSS JOIN (SELECT range AS j FROM range(3)) c LEFT JOIN m ON m.i = r.i GROUP BY r.i, c.j""",
    "spmv_many": f"""WITH m AS ({EVENTS}), x AS (SELECT 0 AS plan, 'many0' AS name, 0 AS f UNION ALL SELECT 1, 'many1', 1 UNION ALL SELECT 2, 'many2', 2 UNION ALL SELECT 3, 'one', 2)
        SELECT x.plan, x.name, r.i, coalesce(sum(m.v * (m.j * x.f + 1)), 0)::DOUBLE AS v FROM {USERS} r CROSS JOIN x LEFT JOIN m ON m.i = r.i GROUP BY ALL""",
    "sparse_violations": """SELECT sum(CASE WHEN l_linenumber >= 7 THEN n ELSE 0 END)::BIGINT AS out_of_bounds, sum(n - 1)::BIGINT AS repeated, sum(z)::BIGINT AS zeros
        FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, sum((l_discount = 0)::INT) AS z FROM lineitem GROUP BY ALL)""",
    "csr_rows": EVENTS,
    "to_dense": f"WITH m AS ({EVENTS}) SELECT r.i, c.j, coalesce(m.v, 0) AS v FROM {USERS} r CROSS JOIN (SELECT range AS j FROM range(7)) c LEFT JOIN m ON m.i = r.i AND m.j = c.j",
    "vector_updates": " UNION ALL ".join(
        f"SELECT '{n}' AS name, p_partkey AS i, round({x}, 4) + 0 AS v FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)"
        for n, x in {"axpy": "2 * a + b", "xpay": "a + 2 * b", "add": "a + b", "sub": "a - b", "mul": "a * b", "div": "a / b", "scale": "2 * a"}.items()
    ),
}
