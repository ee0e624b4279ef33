"""Ordered optimizer steps over a stream whose rows come late, against a fold in order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming import ordered_sgd_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(CONF)
    spark.conf.set(CONF, ROCKS)
    yield spark
    spark.conf.set(CONF, before)


def test_late_gradients_are_folded_in_order(rocks, tmp_path):
    """Four files, one to a micro-batch: within the delay rows come in any order, across batches too."""
    spark, rng, start = rocks, random.Random(1), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=10 * i), i * 3 + k, None if (i, k) == (5, 1) else rng.uniform(-1, 1)) for i in range(40) for k in range(3)]
    late = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 50)))
    assert late != sorted(rows, key=lambda r: r[1])
    schema = "k long, t timestamp, o long, g double"
    for n in range(4):
        spark.createDataFrame(late[n * 30 : (n + 1) * 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ordered_sgd_stream(stream, "k", "t", "o", "g", 1.0, 0.1, 0.9, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    passed = max(r[1] for r in rows) - timedelta(hours=1)
    for k in range(3):
        p, s, n = 1.0, 0.0, 0
        for _, _, _, g in sorted((r for r in rows if r[0] == k and r[1] <= passed), key=lambda r: (r[1], r[2])):
            s = s * 0.9 + (g or 0.0)
            p -= 0.1 * s
            n += 1
        last = max((r for r in out if r.k == k), key=lambda r: r.steps)
        assert last.steps == n and abs(last.p - p) < 1e-12 and abs(last.s - s) < 1e-12
    assert len({r.steps for r in out if r.k == 0}) > 1  # state went on from batch to batch
