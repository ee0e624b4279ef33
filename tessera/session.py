"""Sessions: how this package reaches Spark's Python workers."""

from __future__ import annotations

import functools
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package.

    A cluster gets it with ``--py-files`` or an installed wheel; this only adds the folder that the driver uses.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a session on this machine names none (tests, a trial) does a temporary folder take its place.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_dir()
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder: later jobs read it again instead of recomputing it, and losing an
    executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
