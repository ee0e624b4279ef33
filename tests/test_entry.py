from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_is_known():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def text(value):
    return "nan" if value != value else repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, db, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    found = db.execute(catalog.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    assert got == sorted(tuple(text(r[order.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def test_batches_have_the_rows_of_whole_number_division(spark, tmp_path):
    """Ids below zero and beyond 2^53."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CASE WHEN vec_id < 40 THEN -vec_id WHEN vec_id < 80 THEN vec_id + 9007199254740993 ELSE vec_id END AS vec_id, embedding, label FROM '{DATA}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = sorted((r.b, r.i, r.j, text(r.v)) for r in __spark_entry__.queries()["batched_matmul"](spark, str(tmp_path)).collect())
    assert got == sorted((b, i, j, text(v)) for b, i, j, v in con.execute(catalog.ORACLES["batched_matmul"]).fetchall())
