"""Streams that are run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.streaming import ordered_sgd_stream

STORE = "spark.sql.streaming.stateStore.providerClass"


def ordered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of gradients of their users, folded in order behind a watermark of an hour, state and results in
    the shared folder: what each user has at the end."""
    path, folder, before = f"{sf_dir}/events.parquet", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # A pattern, as the table may be one file or a folder of them.
        events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
        gradients = events.select("user_id", "ts", "event_id", (F.col("value") / 100).alias("g"))
        steps = ordered_sgd_stream(gradients, "user_id", "ts", "event_id", "g", 1.0, 0.1, 0.9, "1 hour")
        out = steps.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    last = spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.max_by(F.struct("p", "s", "steps"), "steps").alias("last"))
    return last.select("user_id", (F.round("last.p", 6) + 0.0).alias("p"), (F.round("last.s", 6) + 0.0).alias("s"), "last.steps")


QUERIES = {"ordered_stream": ordered_stream}
ORACLES = {
    "ordered_stream": """WITH e AS (SELECT user_id, value / 100 AS g, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) - 1 AS after,
            count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events))
        SELECT user_id, round(1 - 0.1::DOUBLE * sum(coalesce(g, 0) * (1 - pow(0.9::DOUBLE, after + 1)) / 0.1::DOUBLE), 6) + 0 AS p, round(sum(coalesce(g, 0) * pow(0.9::DOUBLE, after)), 6) + 0 AS s, max(n) AS steps
        FROM e GROUP BY user_id""",
}
