"""Batches of rows in pandas whose whole numbers stay exact.

``mapInPandas`` turns a column of longs with a null into floating point, so one null changes the other numbers of its
batch beyond 2^53.  Here such columns have the nullable types of pandas, on the way in and on the way out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_EXACT = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def longs(values: Iterable[int | None]) -> pd.Series:
    """A column of longs with missing ones, none of them rounded."""
    return pd.Series(pd.array([None if v is None or v is pd.NA else int(v) for v in values], dtype="Int64"))


def map_batches(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, at_once: int | None = None) -> DataFrame:
    """``df.mapInPandas(work, schema)`` in which longs are exact beside nulls, at most ``at_once`` rows in a batch: an Arrow
    batch of long texts or arrays is then never wholly in Python objects."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in work(b.slice(at, step).to_pandas(types_mapper=_EXACT.get) for b in batches for step in [at_once or max(1, b.num_rows)] for at in range(0, b.num_rows, step)):
            yield pa.RecordBatch.from_pandas(frame, schema=made, preserve_index=False)

    return df.mapInArrow(rows, schema)
