"""Optimizer state per key over a stream of gradients."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def sgd_stream(gradients: DataFrame, key: str, order: str, gradient: str, start: float, lr: float, momentum: float) -> DataFrame:
    """``key, p, s, steps`` after each micro-batch: SGD with momentum, each key's gradients in order within a batch.

    The state of a key is three numbers, whatever has passed.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, s, n = state.get if state.exists else (start, 0.0, 0)
        rows = pd.concat(batches).sort_values(order, kind="stable")
        for g in rows[gradient]:
            s = s * momentum + g
            p -= lr * s
        n += len(rows)
        state.update((float(p), float(s), int(n)))
        yield pd.DataFrame({key: [k[0]], "p": [p], "s": [s], "steps": [n]})

    kind = gradients.schema[key].dataType.simpleString()
    return gradients.select(key, order, gradient).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, p double, s double, steps long", "p double, s double, n long", "update", GroupStateTimeout.NoTimeout
    )


def running_sums(events: DataFrame, time: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Axis sums per key and event-time window; rows later than the watermark are dropped, as a stream must."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.sum(value).alias("v"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "v", "n")


class _InOrder(StatefulProcessor):
    """Gradients of a key wait until the watermark has passed them, and are folded by event time and number.

    A timer stands at the earliest of a batch and, when some are left, at the earliest of those: one for each key and batch,
    not one for each gradient."""

    def __init__(self, start: float, lr: float, momentum: float):
        self._start, self._lr, self._momentum = start, lr, momentum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._now = handle.getValueState("now", "p double, s double, n long")
        self._waiting = handle.getListState("waiting", "at long, o long, g double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        found = pd.concat(list(rows))
        self._waiting.appendList([(int(a), int(o), float(g)) for a, o, g in zip(found["at"], found["o"], found["g"], strict=True)])
        self._handle.registerTimer(int(found["at"].min()))  # the first that is due; it sees to the others
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        rows = list(self._waiting.get())
        due = sorted(r for r in rows if r[0] <= passed)
        if not due:  # an earlier timer of this batch has folded them
            return
        p, s, n = self._now.get() if self._now.exists() else (self._start, 0.0, 0)
        for _, _, g in due:
            s = s * self._momentum + g
            p -= self._lr * s
        self._now.update((p, s, n + len(due)))
        rest = [r for r in rows if r[0] > passed]
        self._waiting.put(rest) if rest else self._waiting.clear()
        if rest:
            self._handle.registerTimer(min(r[0] for r in rest))
        yield pd.DataFrame({"k": [key[0]], "p": [p], "s": [s], "steps": [n + len(due)]})

    def close(self) -> None:
        pass


def ordered_sgd_stream(gradients: DataFrame, key: str, time: str, order: str, gradient: str, start: float, lr: float, momentum: float, late: str) -> DataFrame:
    """``key, p, s, steps`` whenever gradients of a key are folded: SGD with momentum over a stream, in the order of event
    time and number, also of gradients that arrive late and in another micro-batch.

    A gradient waits in the key's list until the watermark, ``late`` behind the latest time seen, has passed it; then no
    earlier one can come.  Those that come later than that are dropped, as a stream must.  The state of a key is three
    numbers and the gradients within the watermark's delay; a null gradient is a step of zero.  Needs the RocksDB state store.
    """
    from pyspark.sql import functions as F

    at = F.col(time).cast("timestamp")
    rows = gradients.select(F.col(key).alias("k"), at.alias("t"), F.unix_millis(at).alias("at"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(gradient).cast("double"), F.lit(0.0)).alias("g"))
    kind = gradients.schema[key].dataType.simpleString()
    folded = rows.withWatermark("t", late).groupBy("k").transformWithStateInPandas(_InOrder(start, lr, momentum), f"k {kind}, p double, s double, steps long", "Append", "EventTime")
    return folded.withColumnRenamed("k", key)
