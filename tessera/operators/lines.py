"""Products of a large side with a small one: lines of the large side meet in a task, and no product is a row.

A sum of products per cell would be a hash table with every cell of the result that a task sees, and products that are
dealt by cells of the large side hardly add up before they are shuffled.  Here the lines of the large side are packed and
sorted, and a task works them off in order with at most ``STEP`` products at once (or those of one entry).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 1 << 18
NONE = -(1 << 63)  # stands for a position that is null


@dataclass(frozen=True)
class Side:
    """The small side: entries sorted by key (batch and contracted position), and where those of a key begin and end."""

    batches: np.ndarray  # the key's values, each sorted
    contracted: np.ndarray
    keys: np.ndarray  # of all entries, without repeats: rank of the batch times the number of contracted values plus their rank
    begin: np.ndarray
    end: np.ndarray
    slot: np.ndarray  # of an entry: its position in the other axes
    value: np.ndarray
    known: np.ndarray  # False for a null
    slots: np.ndarray  # batch and position of a slot

    @classmethod
    def of(cls, df: DataFrame, paired: bool, spread: bool) -> Side:
        """``_q, _k, _other, v``, collected as a broadcast join would.  Batches are part of the key if ``paired``, and of the
        result's position if ``spread``."""
        table = df.filter("_k is not null").toArrow()
        q, k, other = (table[c].to_numpy().astype(np.int64) for c in ("_q", "_k", "_other"))
        v = table["v"]
        key_q, out_q = q if paired else np.zeros_like(q), q if spread else np.zeros_like(q)
        if paired:
            keep = q != NONE  # null is no batch
            key_q, out_q, k, other, v = key_q[keep], out_q[keep], k[keep], other[keep], v.filter(pa.array(keep))
        batches, contracted = np.unique(key_q), np.unique(k)
        key = np.searchsorted(batches, key_q) * len(contracted) + np.searchsorted(contracted, k)
        order = np.argsort(key, kind="stable")
        keys, begin, n = np.unique(key[order], return_index=True, return_counts=True)
        slots, slot = np.unique(np.stack([out_q, other], axis=1), axis=0, return_inverse=True)
        return cls(batches, contracted, keys, begin, begin + n, slot.reshape(-1)[order], v.fill_null(0.0).to_numpy()[order], v.is_valid().to_numpy()[order], slots)

    def find(self, p: np.ndarray | None, k: np.ndarray) -> np.ndarray:
        """Where the keys of entries of the large side are in ``keys``; -1 if nowhere."""
        if not len(self.keys):
            return np.full(len(k), -1)
        at = np.searchsorted(self.contracted, k).clip(max=len(self.contracted) - 1)
        met = self.contracted[at] == k
        if p is not None:
            of = np.searchsorted(self.batches, p).clip(max=len(self.batches) - 1)
            met &= self.batches[of] == p
            at = of * len(self.contracted) + at
        found = np.searchsorted(self.keys, at).clip(max=len(self.keys) - 1)
        return np.where(met & (self.keys[found] == at), found, -1)


def _starts(p: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether an entry is of another line than the one before it."""
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (line[1:] != line[:-1])
    return new


def times(large: DataFrame, small: DataFrame, paired: bool, spread: bool) -> DataFrame:
    """``_b, _line, _other, v``: sums over ``_k`` of ``(_p, _line, _k, v)`` times ``(_q, _k, _other, v)``, where entries meet.

    ``paired``: batches ``_p`` and ``_q`` must be equal.  ``_b`` is ``_q`` if ``spread``, else ``_p``.  Entries that are there twice
    add up, null values add nothing, and a sum of nothing but nulls is null.
    """

    def typed(df: DataFrame, *names: str) -> DataFrame:
        whole = {n: F.col(n).cast("long") for n in names}
        return df.select(*((c if n == "_k" else F.coalesce(c, F.lit(NONE))).alias(n) for n, c in whole.items()), F.col("v").cast("double").alias("v"))

    shared = large.sparkSession.sparkContext.broadcast(Side.of(typed(small, "_q", "_k", "_other"), paired, spread))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring entries of a line as one row."""
        for batch in batches:
            p, line, k = (batch.column(c).to_numpy() for c in ("_p", "_line", "_k"))
            found = shared.value.find(p if paired else None, k)
            met = found >= 0
            p, line = p[met], line[met]
            first = np.flatnonzero(_starts(p, line))
            to = pa.array(np.append(first, len(p)).astype(np.int32))
            values = batch.column("v").filter(pa.array(met))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[first]), pa.array(line[first]), pa.ListArray.from_arrays(to, pa.array(found[met].astype(np.int32))), pa.ListArray.from_arrays(to, values)],
                names=["_p", "_line", "at", "x"],
            )

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        width, held = max(1, len(side.slots)), None  # held: the last line, which may go on, and its slots, sums and nulls

        def cells(p: np.ndarray, line: np.ndarray, slot: np.ndarray, total: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
            b, other = side.slots[slot].T
            null = lambda x: pa.array(x, mask=x == NONE)
            return pa.RecordBatch.from_arrays([null(b if spread else p), null(line), null(other), pa.array(total, mask=~known)], names=["_b", "_line", "_other", "v"])

        def ended(of: tuple) -> pa.RecordBatch:
            p, line, slot, total, known = of
            return cells(np.full(len(slot), p), np.full(len(slot), line), slot, total, known)

        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch.column("at")
            sizes = pieces.value_lengths().to_numpy()
            p, line = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("_p", "_line"))
            at, values = pieces.flatten().to_numpy(), batch.column("x").flatten()
            v, known = values.fill_null(0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
            count = side.end[at] - side.begin[at]
            upto = np.cumsum(count)
            s = 0
            while s < len(at):
                e = max(s + 1, int(np.searchsorted(upto, upto[s] - count[s] + STEP, "right")))
                n = count[s:e]
                if held and (held[0], held[1]) != (p[s], line[s]):
                    yield ended(held)
                    held = None
                new = _starts(p[s:e], line[s:e])
                first, run = s + np.flatnonzero(new), np.cumsum(new) - 1
                own = np.repeat(np.arange(e - s), n)
                take = np.arange(len(own)) + np.repeat(side.begin[at[s:e]] - (np.cumsum(n) - n), n)
                code = run[own] * width + side.slot[take]
                good = known[s:e][own] & side.known[take]
                product = v[s:e][own] * side.value[take]
                if not good.all():
                    product[~good] = 0.0
                if held:
                    code, product, good = np.concatenate([held[2], code]), np.concatenate([held[3], product]), np.concatenate([held[4], good])
                # sums by code: a dense array of all cells of these lines, unless few of them are met
                cell, where = (None, code) if len(first) * width <= 4 * len(code) else np.unique(code, return_inverse=True)
                there = np.bincount(where)
                total = np.bincount(where, weights=product)
                sure = there if good.all() else np.bincount(where, weights=good)
                if cell is None:
                    cell = np.flatnonzero(there)
                    total, sure = total[cell], sure[cell]
                of, slot, sure = cell // width, cell % width, sure > 0
                done = int(np.searchsorted(of, len(first) - 1))  # cells before the last line
                if done:
                    yield cells(p[first[of[:done]]], line[first[of[:done]]], slot[:done], total[:done], sure[:done])
                held = p[first[-1]], line[first[-1]], slot[done:], total[done:], sure[done:]
                s = e
        if held:
            yield ended(held)

    entries = typed(large, "_p", "_line", "_k").filter("_k is not null")
    packed = entries.mapInArrow(pack, "_p long, _line long, at array<int>, x array<double>")
    met = packed.repartition("_p", "_line").sortWithinPartitions("_p", "_line")
    return met.mapInArrow(multiply, "_b long, _line long, _other long, v double")
