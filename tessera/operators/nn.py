"""Convolution, attention, cross-entropy and optimizer steps over relational tensors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.session import cut_lineage
from tessera.tensor import SMALL, ShapeError, Tensor
from tessera.tiles import Tiles

AXES = ("x", "y", "z")

# -- convolution: input (b, c, x...), weight (o, c, kx...), output (b, o, x...) ----------------------------------------


@dataclass(frozen=True)
class ConvPlan:
    """Lengths of every spatial axis; ``out`` follows from the others."""

    n: tuple[int, ...]
    k: tuple[int, ...]
    stride: tuple[int, ...]
    pad: tuple[int, ...]
    dilation: tuple[int, ...]
    extra: tuple[int, ...] = ()
    transposed: bool = False

    def __post_init__(self):
        if not len(self.n) == len(self.k) == len(self.stride) == len(self.pad) == len(self.dilation) or min(*self.stride, *self.dilation) < 1:
            raise ShapeError("convolution parameters do not fit")
        if any(m < 1 for m in self.out):
            raise ShapeError("the kernel is larger than the padded input")

    @property
    def out(self) -> tuple[int, ...]:
        if self.transposed:
            extra = self.extra or (0,) * len(self.n)
            return tuple((n - 1) * s - 2 * p + d * (k - 1) + 1 + e for n, k, s, p, d, e in zip(self.n, self.k, self.stride, self.pad, self.dilation, extra, strict=True))
        return tuple((n + 2 * p - d * (k - 1) - 1) // s + 1 for n, k, s, p, d in zip(self.n, self.k, self.stride, self.pad, self.dilation, strict=True))


def _met(plan: ConvPlan, inputs: DataFrame, weight: DataFrame) -> DataFrame:
    """Every (input, weight) pair with the output it adds to: ``b, c, o, x.., k.., q.., _in, _w``.

    One row of input meets one row per tap of its channel: for weights too large to go to all tasks.
    """
    met = inputs.withColumnRenamed("v", "_in").join(weight.withColumnRenamed("v", "_w"), "c")
    for a, n, k, s, p, d, m in zip(AXES, plan.n, plan.k, plan.stride, plan.pad, plan.dilation, plan.out, strict=False):
        x, tap = F.col(a), F.col("k" + a)
        if plan.transposed:
            met = met.withColumn("q" + a, x * s - p + tap * d)
        else:
            over = x + p - tap * d
            met = met.filter(over % s == 0).withColumn("q" + a, (over / s).cast("long")).filter(over >= 0)
        met = met.filter((F.col("q" + a) >= 0) & (F.col("q" + a) < m))
    return met


CONV_SIDES = {1: 4096, 2: 64, 3: 16}  # positions of an output tile's side, by the number of axes


def _dealt(plan: ConvPlan, inputs: DataFrame, side: int) -> DataFrame:
    """Input cells with the output tiles ``tx..`` that see them, once for each."""
    for a, k, s, p, d, m in zip(AXES, plan.k, plan.stride, plan.pad, plan.dilation, plan.out, strict=False):
        x = F.col(a)
        if plan.transposed:
            lo, hi = x * s - p, x * s - p + d * (k - 1)
        else:
            lo, hi = F.ceil((x + p - d * (k - 1)) / s), F.floor((x + p) / s)
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(m - 1))
        inputs = inputs.filter(lo <= hi).withColumn("t" + a, F.explode(F.sequence(F.floor(lo / side).cast("long"), F.floor(hi / side).cast("long"))))
    return inputs


def _window(plan: ConvPlan, first: list[int], size: list[int]) -> tuple[list[int], list[int]]:
    """First and length of the inputs that a tile of outputs sees, along each axis."""
    low, high = [], []
    for q, n, k, s, p, d in zip(first, size, plan.k, plan.stride, plan.pad, plan.dilation, strict=True):
        low.append(-(-(q + p - d * (k - 1)) // s) if plan.transposed else q * s - p)
        high.append((q + n - 1 + p) // s if plan.transposed else (q + n - 1) * s - p + d * (k - 1))
    return low, [b - a + 1 for a, b in zip(low, high, strict=True)]


def _taps(plan: ConvPlan, first: list[int], size: list[int], low: list[int]) -> Iterator[tuple[tuple, tuple, tuple]]:
    """Each tap, the inputs that it reads and the outputs that it adds to, all channels of both."""
    for tap in np.ndindex(*plan.k):
        source, target = [slice(None)], [slice(None)]
        for i, (k, s, p, d) in enumerate(zip(tap, plan.stride, plan.pad, plan.dilation, strict=True)):
            if plan.transposed:
                base = low[i] * s - p + d * k - first[i]  # where the first input goes
                start, stop = max(0, -(base // s)), (size[i] - 1 - base) // s + 1
                source.append(slice(start, max(start, stop)))
                target.append(slice(base + start * s, base + max(start, stop) * s, s))
            else:
                source.append(slice(d * k, d * k + (size[i] - 1) * s + 1, s))
                target.append(slice(None))
        yield tap, tuple(source), tuple(target)


def _placed(rows: pd.DataFrame, channel: str, axes: tuple[str, ...], low: list[int], shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Cells as an array, and where there are any."""
    at = (rows[channel].to_numpy(), *(rows[a].to_numpy() - lo for a, lo in zip(axes, low, strict=True)))
    x, there = np.zeros(shape), np.zeros(shape, bool)
    np.add.at(x, at, rows["v"].to_numpy())
    there[at] = True
    return x, there


def _in_tiles(plan: ConvPlan, inputs: DataFrame, weight: np.ndarray) -> DataFrame:
    """``b, o, q.., v`` of cells ``(b, c, x.., v)`` and a weight ``[o, c, k..]``: output tiles, each with all channels of the cells
    that it sees.  A cell is shuffled once for each tile that sees it, and a tile is a matrix product for each tap."""
    axes = AXES[: len(plan.n)]
    side = CONV_SIDES[len(axes)]
    shared = inputs.sparkSession.sparkContext.broadcast(weight)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = shared.value
        first = [t * side for t in key[1:]]  # of the outputs
        size = [min(side, m - q) for q, m in zip(first, plan.out, strict=True)]
        low, seen = _window(plan, first, size)
        x, _ = _placed(rows, "c", axes, low, (w.shape[1], *seen))
        out = np.zeros((w.shape[0], *size))
        for tap, source, target in _taps(plan, first, size, low):
            out[target] += np.tensordot(w[(slice(None), slice(None), *tap)], x[source], axes=(1, 0))
        at = np.indices(out.shape)
        place = {"b": key[0], "o": at[0].ravel()} | {"q" + a: (at[i + 1] + q).ravel() for i, (a, q) in enumerate(zip(axes, first, strict=True))}
        return pd.DataFrame(place | {"v": out.ravel()})

    return _dealt(plan, inputs, side).groupBy("b", *("t" + a for a in axes)).applyInPandas(run, "b long, o long, " + ", ".join(f"q{a} long" for a in axes) + ", v double")


def _gradients_in_tiles(plan: ConvPlan, inputs: DataFrame, upstream: DataFrame, weight: np.ndarray, wanted: set[str]) -> DataFrame:
    """``part, n, m, x.., v``: gradients of input cells as ``b, c, x..`` and of the weight as ``o, c, k..``.

    An output tile holds its upstream gradient, once, and the input cells that it sees.  It adds a share to each of these and to
    the weight, so what is shuffled again is one row for an input cell and tile, and the small weight once for each tile."""
    axes = AXES[: len(plan.n)]
    side = CONV_SIDES[len(axes)]
    shared = inputs.sparkSession.sparkContext.broadcast(weight)
    tiles = [F.floor(F.col(a) / side).cast("long").alias("t" + a) for a in axes]
    above = upstream.select("b", F.col("o").alias("c"), *axes, "v", *tiles, F.lit(True).alias("_up"))
    met = _dealt(plan, inputs, side).withColumn("_up", F.lit(False)).unionByName(above)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = shared.value
        first = [t * side for t in key[1:]]
        size = [min(side, m - q) for q, m in zip(first, plan.out, strict=True)]
        low, seen = _window(plan, first, size)
        up = rows["_up"].to_numpy()
        x, held = _placed(rows[~up], "c", axes, low, (w.shape[1], *seen))
        g, given = _placed(rows[up], "c", axes, first, (w.shape[0], *size))
        given_any, spatial = given.any(axis=0, keepdims=True), tuple(range(1, len(axes) + 1))
        dx, touched, dw, pairs = np.zeros(x.shape), np.zeros((1, *seen), bool), np.zeros(w.shape), np.zeros(w.shape)
        for tap, source, target in _taps(plan, first, size, low):
            at = (slice(None), slice(None), *tap)
            if "input" in wanted:
                dx[source] += np.tensordot(w[at], g[target], axes=(0, 0))
                touched[source] |= given_any[target]
            if "weight" in wanted:
                dw[at] = np.tensordot(g[target], x[source], axes=(spatial, spatial))
                pairs[at] = np.tensordot(given[target].astype(float), held[source].astype(float), axes=(spatial, spatial))
        found = []
        for part, values, there, start in (("input", dx, held & touched, low), ("weight", dw, pairs > 0, [0] * len(axes))):
            at = np.nonzero(there)
            if part == "input":
                lead = {"n": key[0], "m": at[0]}
            else:
                lead = {"n": at[0], "m": at[1]}
            place = {a: at[len(at) - len(axes) + i] + lo for i, (a, lo) in enumerate(zip(axes, start, strict=True))}
            found.append(pd.DataFrame({"part": part} | lead | place | {"v": values[at]}))
        return pd.concat(found, ignore_index=True)

    schema = "part string, n long, m long, " + ", ".join(f"{a} long" for a in axes) + ", v double"
    return met.groupBy("b", *("t" + a for a in axes)).applyInPandas(run, schema).groupBy("part", "n", "m", *axes).agg(F.sum("v").alias("v"))


def _typed(df: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    return df.toDF(*dims, "v").select(*(F.col(d).cast("long").alias(d) for d in dims), F.col("v").cast("double").alias("v"))


def _held(weight: Tensor, transposed: bool) -> np.ndarray:
    """A small weight as ``[o, c, k..]``."""
    w = Tensor(weight.df.toDF(*weight.dims, "v"), weight.dims, weight.shape).to_numpy()  # columns count by their order
    return w.swapaxes(0, 1) if transposed else w


def conv(inputs: Tensor, weight: Tensor, bias: DataFrame | None, stride, pad, dilation, transposed: bool = False, extra=()) -> Tensor:
    """Forward convolution; the transposed one takes weights ``[c, o, k..]``.

    A weight of at most ``SMALL`` cells goes to all tasks, and the input in tiles; a larger one is joined with the input.
    """
    rank = len(inputs.shape) - 2
    axes = AXES[:rank]
    plan = ConvPlan(inputs.shape[2:], weight.shape[2:], tuple(stride), tuple(pad), tuple(dilation), tuple(extra), transposed)
    o, c = ("c", "o") if transposed else ("o", "c")
    if inputs.shape[1] != weight.shape[0 if transposed else 1]:
        raise ShapeError("channels do not fit")
    out_channels = weight.shape[1 if transposed else 0]
    if weight.small:
        sums = _in_tiles(plan, _typed(inputs.df, ("b", "c", *axes)), _held(weight, transposed))
    else:
        met = _met(plan, inputs.df.toDF("b", "c", *axes, "v"), weight.df.toDF(o, c, *("k" + a for a in axes), "v"))
        sums = met.groupBy("b", "o", *("q" + a for a in axes)).agg(F.sum(F.col("_in") * F.col("_w")).alias("v"))
    out = Tensor(sums.toDF("b", "o", *axes, "v"), ("b", "o", *axes), (inputs.shape[0], out_channels, *plan.out)).densify()
    if bias is None:
        return out
    each = bias.toDF("o", "_bias")
    return Tensor(out.df.join(F.broadcast(each) if out_channels <= SMALL else each, "o").select("b", "o", *axes, (F.col("v") + F.col("_bias")).alias("v")), out.dims, out.shape)


def conv_backward(inputs: Tensor, weight: Tensor, upstream: Tensor, stride, pad, dilation, transposed: bool = False, extra=(), wanted: tuple[str, ...] = ("input", "weight", "bias")) -> dict[str, DataFrame]:
    """Gradients for those of input, weight and bias that are wanted: of the input's cells that are there, and of the weight's
    that any pair of an input cell and an upstream one meets.

    With a weight of at most ``SMALL`` cells the pairs meet in output tiles; with a larger one, the pairs of the forward pass are
    joined with the upstream gradient.  The bias needs no pairs.
    """
    axes = AXES[: len(inputs.shape) - 2]
    plan = ConvPlan(inputs.shape[2:], weight.shape[2:], tuple(stride), tuple(pad), tuple(dilation), tuple(extra), transposed)
    if upstream.shape[2:] != plan.out:
        raise ShapeError(f"gradient {upstream.shape[2:]} for an output of {plan.out}")
    if not wanted or set(wanted) - {"input", "weight", "bias"}:
        raise ShapeError(f"gradients of {wanted}")
    o, c = ("c", "o") if transposed else ("o", "c")
    outputs, taps = ["q" + a for a in axes], ["k" + a for a in axes]
    found = {"bias": upstream.df.toDF("b", "o", *outputs, "_g").groupBy("o").agg(F.sum("_g").alias("v"))}
    paired = set(wanted) - {"bias"}
    if paired and weight.small:
        sums = _gradients_in_tiles(plan, _typed(inputs.df, ("b", "c", *axes)), _typed(upstream.df, ("b", "o", *axes)), _held(weight, transposed), paired)
        sums = cut_lineage(sums) if len(paired) > 1 else sums
        found["input"] = sums.filter("part = 'input'").select(F.col("n").alias("b"), F.col("m").alias("c"), *axes, "v")
        of_weight = sums.filter("part = 'weight'").select(F.col("n").alias("o"), F.col("m").alias("c"), *(F.col(a).alias(k) for a, k in zip(axes, taps, strict=True)), "v")
        found["weight"] = of_weight.select(o, c, *taps, "v")
    elif paired:
        met = _met(plan, inputs.df.toDF("b", "c", *axes, "v"), weight.df.toDF(o, c, *taps, "v"))
        pairs = met.join(upstream.df.toDF("b", "o", *outputs, "_g"), ["b", "o", *outputs])
        found["input"] = pairs.groupBy("b", "c", *axes).agg(F.sum(F.col("_g") * F.col("_w")).alias("v"))
        found["weight"] = pairs.groupBy(o, c, *taps).agg(F.sum(F.col("_g") * F.col("_in")).alias("v"))
    return {part: found[part] for part in wanted}


def accumulate(target: DataFrame, gradient: DataFrame, keys: list[str]) -> DataFrame:
    """Gradients are added to what the destination holds."""
    return target.join(gradient.withColumnRenamed("v", "_g"), keys, "left").select(*keys, (F.col("v") + F.coalesce("_g", F.lit(0.0))).alias("v"))


# -- attention: blocks of queries meet blocks of keys -------------------------------------------------------------------


def grouped_mask(mask: DataFrame, heads: int) -> DataFrame:
    """A keep mask ``(m, k, v)`` shared by groups of ``heads`` batches, as the (b, k) that stay."""
    return mask.toDF("m", "k", "v").filter("v <> 0").select(F.explode(F.sequence(F.col("m") * heads, F.col("m") * heads + heads - 1)).alias("b"), "k")


def _packed(t: Tensor, name: str) -> DataFrame:
    """``b, p`` and the features of each position as one array, absent ones 0."""
    n = t.shape[2]
    cells = t.df.toDF("b", "p", "d", "v").groupBy("b", "p").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("_m"))
    at = F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")
    return cells.select("b", "p", F.transform(at, lambda d: F.coalesce(F.try_element_at("_m", d), F.lit(0.0))).alias(name))


def _sides(q: Tensor, k: Tensor, v: Tensor, keep: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Packed rows of the queries and of the keys with their values."""
    if q.shape[0] != k.shape[0] or q.shape[2] != k.shape[2] or k.shape[:2] != v.shape[:2]:
        raise ShapeError(f"{q.shape}, {k.shape}, {v.shape}")
    keys = _packed(k, "k").join(_packed(v, "v"), ["b", "p"])
    if keep is not None:  # (b, k) of the keys that stay
        stay = keep.select("b", F.col("k").alias("p"), F.lit(True).alias("keep")).distinct()
        keys = keys.join(stay, ["b", "p"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    return _packed(q, "q"), keys


def attention(q: Tensor, k: Tensor, v: Tensor, scale: float | None = None, causal: bool = False, keep: DataFrame | None = None, block: int = 1024) -> Tensor:
    """Weighted values of Q (b, q, d), K (b, k, d) and V (b, k, e); a fully masked row is zeros, non-finite input an error."""
    queries, keys = _sides(q, k, v, keep)
    cells = _cells(_block_sums(_deal(queries, block, ACROSS), _deal(keys, block, ACROSS), 1 / math.sqrt(q.shape[2]) if scale is None else scale, causal))
    return Tensor(cells, ("b", "q", "e"), (q.shape[0], q.shape[1], v.shape[2])).densify()


def attention_backward(q: Tensor, k: Tensor, v: Tensor, upstream: Tensor, scale: float, causal: bool = False, keep: DataFrame | None = None, block: int = 1024, wanted: str = "qkv") -> dict[str, DataFrame]:
    """Gradients ``b, p, d, v`` for those of Q, K and V that are wanted; the others are not computed."""
    queries, keys = _sides(q, k, v, keep)
    found = cut_lineage(_gradients(queries.join(_packed(upstream, "g"), ["b", "p"]), keys, scale, causal, block, wanted))
    return {part: found.filter(F.col("part") == part).drop("part") for part in wanted}


MERGE = 32  # partial results of one block that meet in a task
ACROSS = 8  # blocks of a sequence, so a row is repeated as often, until blocks have LONGEST rows
LONGEST = 1 << 16
SLICE = 1024  # queries, and keys, whose scores are held at once


@dataclass(frozen=True)
class _Dealt:
    """Rows in blocks: their table, the number of blocks of each batch, and the largest of these numbers."""

    blocks: DataFrame
    counts: DataFrame
    most: int


def _blocks_of(n: Column, block: int, across: int | None) -> Column:
    many = F.ceil(n / block)
    return (many if across is None else F.greatest(F.least(many, F.lit(across)), F.ceil(n / LONGEST))).cast("int")


def _deal(rows: DataFrame, block: int, across: int | None = None) -> _Dealt:
    """``b, own`` and the columns of all rows of a block as one row each.  Blocks of about ``block`` rows are picked by a
    hash of the position, so a sequence of any length is dealt out evenly.  The rows are counted once.  With ``across`` a
    longer sequence has that many larger blocks, up to ``LONGEST`` rows each: what is repeated then grows with the rows."""
    names = [c for c in rows.columns if c != "b"]
    packs = {c for c, t in rows.dtypes if t.startswith("array")}

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p")
        out = {c: np.concatenate(part[c].to_numpy()) if c in packs else part[c].to_numpy() for c in names}
        if not all(np.isfinite(out[c]).all() for c in packs):
            raise ValueError(f"batch {key[0]} has non-finite entries")
        return pd.DataFrame({"b": [key[0]], "own": [key[1]], **{c: [x] for c, x in out.items()}})

    counts = cut_lineage(rows.groupBy("b").agg(_blocks_of(F.count("*"), block, across).alias("_n")))
    batches, most = counts.agg(F.count("*"), F.max("_n")).first()
    counts = F.broadcast(counts) if batches <= SMALL else counts  # batches are few, and so hot keys, or many
    dealt = rows.join(counts, "b").withColumn("_own", F.pmod(F.xxhash64("p"), F.col("_n")).cast("int"))
    schema = "b long, own int, " + ", ".join(f"{c} array<{'long' if c == 'p' else 'boolean' if c == 'keep' else 'double'}>" for c in names)
    return _Dealt(dealt.groupBy("b", "_own").applyInPandas(pack, schema), counts, most or 1)


def _met_blocks(queries: _Dealt, keys: _Dealt) -> tuple[GroupedData, GroupedData]:
    """Queries and keys dealt to (b, query block, key block): a block is one row, so only blocks are repeated."""
    others = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = queries.blocks.join(keys.counts, "b").withColumn("kb", others).drop("_n").withColumnRenamed("own", "qb")
    right = keys.blocks.join(queries.counts, "b").withColumn("qb", others).drop("_n").withColumnRenamed("own", "kb")
    right = right.select(*(F.col(c).alias("key_" + c) for c in right.columns))  # new names: both sides may come from one table
    return left.groupBy("b", "qb", "kb"), right.groupBy("key_b", "key_qb", "key_kb")


def _in_levels(parts: DataFrame, keys: list[str], part: str, most: int, merge: Callable[[tuple, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Partial results, numbered from 0 by ``part``, merged until every key has one; at most ``MERGE`` meet at once."""
    while most > 1:
        parts = parts.withColumn(part, F.floor(F.col(part) / MERGE).cast("int")).groupBy(*keys, part).applyInPandas(merge, parts.schema)
        most = -(-most // MERGE)
    return parts


def _where_both(one: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Leaves out what meets nothing: the hash may have picked no row for a block."""
    return lambda key, left, right: one(key, left, right) if len(left) and len(right) else pd.DataFrame()


def _of_block(side: pd.DataFrame, name: str, rows: str = "p"):
    """A matrix of the one block of a group, one row per position."""
    return side[name].iloc[0].reshape(len(side[rows].iloc[0]), -1)


def _slices(side: pd.DataFrame, rows: str) -> Iterator[tuple[slice, pd.DataFrame]]:
    """The one block of a group, ``SLICE`` rows at a time."""
    n = len(side[rows].iloc[0])
    packs = [c for c in side.columns if isinstance(side[c].iloc[0], np.ndarray)]
    for at in range(0, n, SLICE):
        own = slice(at, min(n, at + SLICE))
        yield own, side.assign(**{c: [side[c].iloc[0].reshape(n, -1)[own].ravel()] for c in packs})


def _scores(left: pd.DataFrame, right: pd.DataFrame, scale: float, causal: bool):
    """Scaled products of a block of queries and one of keys; -inf where the key does not count."""
    s = _of_block(left, "q") @ _of_block(right, "key_k", "key_p").T * scale
    if causal:
        s[right["key_p"].iloc[0][None, :] > left["p"].iloc[0][:, None]] = -np.inf
    if "key_keep" in right:
        s[:, ~right["key_keep"].iloc[0].astype(bool)] = -np.inf
    return s


def _block_sums(queries: _Dealt, keys: _Dealt, scale: float, causal: bool) -> DataFrame:
    """``b, p, top, total, o``: of every query the maximum, the sum and the weighted mean of the values over all keys."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n, width = len(left["p"].iloc[0]), _of_block(right, "key_v", "key_p").shape[1]
        top, total, out = np.full(n, -np.inf), np.zeros(n), np.zeros((n, width))
        for own, q in _slices(left, "p"):
            for _, k in _slices(right, "key_p"):
                s = _scores(q, k, scale, causal)
                m = np.maximum(top[own], s.max(axis=1))
                base = np.where(np.isfinite(m), m, 0)
                x, f = np.exp(s - base[:, None]), np.exp(top[own] - base)
                total[own] = total[own] * f + x.sum(axis=1)
                out[own] = out[own] * f[:, None] + x @ _of_block(k, "key_v", "key_p")
                top[own] = m
        return pd.DataFrame({"b": [key[0]], "qb": [key[1]], "kb": [key[2]], "p": [left["p"].iloc[0]], "m": [top], "s": [total], "o": [out.ravel()]})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        top = np.max(np.stack(parts["m"].to_numpy()), axis=0)
        total, out = 0.0, 0.0
        for m, s, o in zip(parts["m"], parts["s"], parts["o"], strict=True):
            f = np.exp(m - np.where(np.isfinite(top), top, 0))
            total, out = total + s * f, out + o.reshape(len(m), -1) * f[:, None]
        return pd.DataFrame({"b": [key[0]], "qb": [key[1]], "kb": [key[2]], "p": [parts["p"].iloc[0]], "m": [top], "s": [total], "o": [out.ravel()]})

    def means(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, p, m, s, o in zip(batch["b"], batch["p"], batch["m"], batch["s"], batch["o"], strict=True):
                yield pd.DataFrame({"b": b, "p": p, "top": m, "total": s, "o": list(o.reshape(len(p), -1) / np.where(s > 0, s, 1)[:, None])})

    left, right = _met_blocks(queries, keys)
    met = left.cogroup(right).applyInPandas(_where_both(one), "b long, qb int, kb int, p array<long>, m array<double>, s array<double>, o array<double>")
    whole = _in_levels(met, ["b", "qb"], "kb", keys.most, merge)
    return whole.select("b", "p", "m", "s", "o").mapInPandas(means, "b long, p long, top double, total double, o array<double>")


def _weights(left: pd.DataFrame, right: pd.DataFrame, scale: float, causal: bool) -> np.ndarray:
    """The weights of a block of queries whose maxima and sums are known; a fully masked row is zeros."""
    top, total = left["top"].iloc[0], left["total"].iloc[0]
    return np.exp(_scores(left, right, scale, causal) - np.where(np.isfinite(top), top, 0)[:, None]) / np.where(total > 0, total, 1)[:, None]


def _ready(queries: DataFrame, sums: DataFrame) -> DataFrame:
    """Queries with their maxima and sums.  Maxima of fully masked rows are -inf, which blocks of finite numbers may not hold:
    their sums are 0."""
    return queries.join(sums.select("b", "p", "top", "total"), ["b", "p"]).withColumn("top", F.when(F.col("total") > 0, F.col("top")).otherwise(0.0))


def _weight_tiles(queries: DataFrame, keys: _Dealt, sums: DataFrame, scale: float, causal: bool, block: int) -> Tiles:
    """The second pass: maxima and sums are known, so every block yields its weights as they are."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        w = _weights(left, right, scale, causal)
        return pd.DataFrame({"b": [key[0]], "qb": [key[1]], "kb": [key[2]], "rows": [left["p"].iloc[0]], "columns": [right["key_p"].iloc[0]], "x": [w.ravel()]})

    left, right = _met_blocks(_deal(_ready(queries, sums), block), keys)
    return Tiles(left.cogroup(right).applyInPandas(_where_both(one), "b long, qb int, kb int, rows array<long>, columns array<long>, x array<double>"), ("b",))


def _cells(sums: DataFrame) -> DataFrame:
    return sums.select("b", F.col("p").alias("q"), F.posexplode("o").alias("e", "v")).select("b", "q", F.col("e").cast("long").alias("e"), "v")


def _gradients(queries: DataFrame, keys: DataFrame, scale: float, causal: bool, block: int, wanted: str = "qkv") -> DataFrame:
    """``part, b, p, d, v`` of queries ``(b, p, q, g)`` and keys ``(b, p, k, v)``."""
    if not wanted or set(wanted) - set("qkv"):
        raise ShapeError(f"gradients of {wanted}")
    queries, dealt = cut_lineage(queries), _deal(cut_lineage(keys), block, ACROSS)
    dot = F.aggregate(F.zip_with("g", "o", lambda g, o: g * o), F.lit(0.0), lambda s, t: s + t)
    sums = _block_sums(_deal(queries.drop("g"), block, ACROSS), dealt, scale, causal)
    ready = _deal(cut_lineage(queries.join(sums, ["b", "p"]).withColumn("mean", dot).drop("o")), block, ACROSS)

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = {"q": (left, "p", "q"), "k": (right, "key_p", "key_k"), "v": (right, "key_p", "key_v")}
        sums = {part: np.zeros_like(_of_block(side, name, rows)) for part, (side, rows, name) in sides.items() if part in wanted}
        for at, queries in _slices(left, "p"):
            q, g = _of_block(queries, "q"), _of_block(queries, "g")
            for to, keys in _slices(right, "key_p"):
                w = _weights(queries, keys, scale, causal)
                if "v" in sums:
                    sums["v"][to] += w.T @ g
                if wanted != "v":
                    ds = w * (g @ _of_block(keys, "key_v", "key_p").T - queries["mean"].iloc[0][:, None]) * scale
                    if "q" in sums:
                        sums["q"][at] += ds @ _of_block(keys, "key_k", "key_p")
                    if "k" in sums:
                        sums["k"][to] += ds.T @ q
        own = {"q": (*key[1:], left["p"].iloc[0]), "k": (*key[:0:-1], right["key_p"].iloc[0]), "v": (*key[:0:-1], right["key_p"].iloc[0])}
        return pd.DataFrame([(part, key[0], *own[part], sums[part].ravel()) for part in wanted], columns=["part", "b", "own", "other", "p", "x"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "b": [key[1]], "own": [key[2]], "other": [key[3]], "p": [parts["p"].iloc[0]], "x": [sum(parts["x"])]})

    def apart(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, b, p, x in zip(batch["part"], batch["b"], batch["p"], batch["x"], strict=True):
                yield pd.DataFrame({"part": part, "b": b, "p": p, "x": list(x.reshape(len(p), -1))})

    left, right = _met_blocks(ready, dealt)
    met = left.cogroup(right).applyInPandas(_where_both(one), "part string, b long, own int, other int, p array<long>, x array<double>")
    sums = _in_levels(met, ["part", "b", "own"], "other", max(ready.most, dealt.most), merge)
    sums = sums.select("part", "b", "p", "x").mapInPandas(apart, "part string, b long, p long, x array<double>")
    return sums.select("part", "b", "p", F.posexplode("x").alias("d", "v")).select("part", "b", "p", F.col("d").cast("long").alias("d"), "v")


def attention_blocked(rows: DataFrame, scale: float, causal: bool = False, block: int = 1024) -> DataFrame:
    """``b, q, e, v`` of rows ``(b, p, q, k, v)`` with packed heads, and ``keep`` where keys are masked; (b, p) is unique.

    No score is ever a row: a block of queries and a block of keys are multiplied in numpy, and the blocks of one query
    are joined by their maxima and sums.  The batches are those of the table; a fully masked row is zeros, non-finite
    input an error."""
    return _cells(_block_sums(_deal(rows.select("b", "p", "q"), block, ACROSS), _deal(rows.drop("q"), block, ACROSS), scale, causal))


def attention_with_weights(rows: DataFrame, scale: float, causal: bool = False, block: int = 1024) -> tuple[DataFrame, Tiles]:
    """The output ``b, p, o`` of :func:`attention_blocked` as packed rows, and the post-softmax weights.

    The weights are tiles of a block of queries and a block of keys, by batch; no weight is a row.  They are made in a
    second pass over the same blocks, with the maxima and sums of the first, which is written to the shared folder.  Every row
    of weights sums to 1, a fully masked one to 0."""
    queries, keys = rows.select("b", "p", "q"), _deal(rows.drop("q"), block)
    sums = cut_lineage(_block_sums(_deal(queries, block), keys, scale, causal))
    return sums.select("b", "p", "o"), _weight_tiles(queries, keys, sums, scale, causal, block)


def attention_row_sums(rows: DataFrame, scale: float, causal: bool = False, block: int = 1024, **sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``b, p, o`` of :func:`attention_with_weights` and, for each ``name=f`` of ``sums``, the sum of ``f(key positions, weights)``
    along a query's weights; ``f`` takes numpy arrays and is applied where the weights are made, so they never leave the task."""
    queries, keys = rows.select("b", "p", "q"), _deal(rows.drop("q"), block, ACROSS)
    found = cut_lineage(_block_sums(_deal(queries, block, ACROSS), keys, scale, causal))
    names = list(sums)

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(names), len(left["p"].iloc[0])))
        for own, q in _slices(left, "p"):
            for _, k in _slices(right, "key_p"):
                w, at = _weights(q, k, scale, causal), k["key_p"].iloc[0][None, :]
                for n, name in enumerate(names):
                    out[n, own] += sums[name](at, w).sum(axis=1)
        return pd.DataFrame({"b": [key[0]], "p": [left["p"].iloc[0]], **{name: [x] for name, x in zip(names, out, strict=True)}})

    left, right = _met_blocks(_deal(_ready(queries, found), block, ACROSS), keys)
    parts = left.cogroup(right).applyInPandas(_where_both(one), "b long, p array<long>, " + ", ".join(f"{name} array<double>" for name in names))
    each = parts.select("b", F.explode(F.arrays_zip("p", *names)).alias("_e")).select("b", "_e.*")
    return found.select("b", "p", "o").join(each.groupBy("b", "p").agg(*(F.sum(name).alias(name) for name in names)), ["b", "p"])


def attention_blocked_backward(rows: DataFrame, scale: float, causal: bool = False, block: int = 1024, wanted: str = "qkv") -> DataFrame:
    """``part, b, p, d, v``: gradients for those of Q, K and V that are wanted, of rows that also have their packed upstream
    gradient ``g``."""
    return _gradients(rows.select("b", "p", "q", "g"), rows.drop("q", "g"), scale, causal, block, wanted)


# -- cross-entropy ------------------------------------------------------------------------------------------------------


def cross_entropy_rows(rows: DataFrame, count: int | None = None, upstream: float = 1.0) -> DataFrame:
    """``n, loss, p, g`` of packed rows ``(n, x, t)`` of logits and a target: the loss of the row, its probabilities, and
    ``upstream * (p - onehot) / count``, the gradient of the mean over ``count`` rows (null without one).  A column
    ``into`` is a gradient that this one is added to.

    All in the row: nothing is shuffled.  Non-finite logits, missing targets and targets out of range are errors.
    """

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, t = np.stack(batch["x"].to_numpy()), batch["t"].to_numpy(dtype=float, na_value=np.nan)
            if not np.isfinite(x).all() or not ((t >= 0) & (t < x.shape[1])).all():
                raise ValueError("non-finite logits or targets out of range")
            at = np.arange(len(x)), t.astype(int)
            top = x.max(axis=1)
            e = np.exp(x - top[:, None])
            total = e.sum(axis=1)
            p = e / total[:, None]
            g: list | None = None
            if count is not None:
                slope = p.copy()
                slope[at] -= 1
                slope *= upstream / count
                g = list(slope + np.stack(batch["into"].to_numpy()) if "into" in batch else slope)
            yield pd.DataFrame({"n": batch["n"], "loss": np.log(total) + top - x[at], "p": list(p), "g": g})

    names = ["n", F.col("x").cast("array<double>").alias("x"), F.col("t").cast("long").alias("t"), *(["into"] if "into" in rows.columns else [])]
    return rows.select(*names).mapInPandas(work, f"n {rows.schema['n'].dataType.simpleString()}, loss double, p array<double>, g array<double>")


def softmax(logits: DataFrame) -> DataFrame:
    """``n, c, p`` of logits ``(n, c, v)`` and the row's log-sum-exp."""
    row = Window.partitionBy("n")
    top = logits.toDF("n", "c", "v").withColumn("_m", F.max("v").over(row))
    total = top.withColumn("_x", F.exp(F.col("v") - F.col("_m"))).withColumn("_s", F.sum("_x").over(row))
    return total.select("n", "c", "v", (F.col("_x") / F.col("_s")).alias("p"), (F.log("_s") + F.col("_m")).alias("lse"))


def _aimed(logits: DataFrame, targets: DataFrame) -> DataFrame:
    """``n, c, v, p, lse, t``; non-finite logits, missing and repeated targets and targets out of range are errors."""
    v = F.col("v")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    checked = logits.toDF("n", "c", "v").withColumn("v", F.when(bad, F.raise_error(F.lit("non-finite logits")).cast("double")).otherwise(v))
    aims = targets.toDF("n", "t").groupBy("n").agg(F.max("t").alias("t"), F.count("t").alias("_aims"))
    met = softmax(checked).join(aims, "n", "full_outer")
    hit = F.coalesce(F.sum((F.col("c") == F.col("t")).cast("long")).over(Window.partitionBy("n")), F.lit(0)) == 1
    return met.withColumn("t", F.when(hit & (F.col("_aims") == 1), F.col("t")).otherwise(F.raise_error(F.lit("a row needs one target in range")).cast("long"))).drop("_aims")


def cross_entropy(logits: DataFrame, targets: DataFrame) -> DataFrame:
    """The mean loss of logits ``(n, c, v)`` and targets ``(n, t)``, one row."""
    own = F.when(F.col("c") == F.col("t"), F.col("lse") - F.col("v"))  # no filter, which would drop rows before they are seen to be wrong
    return _aimed(logits, targets).agg(F.avg(own).alias("loss"))


def cross_entropy_backward(logits: DataFrame, targets: DataFrame, rows: int, upstream: float = 1.0) -> DataFrame:
    """``n, c, v``: upstream * (p - onehot) / rows"""
    return _aimed(logits, targets).select("n", "c", (upstream * (F.col("p") - (F.col("c") == F.col("t")).cast("double")) / rows).alias("v"))


# -- optimizer steps: one projection ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Columns of the next parameter and states from (p, g, s0, s1)."""

    step: Callable[[Column, Column, Column, Column], tuple[Column, Column, Column]]

    def apply(self, df: DataFrame) -> DataFrame:
        p, s0, s1 = self.step(*(F.col(c) for c in ("p", "g", "s0", "s1")))
        return df.withColumns({"p": p, "s0": s0, "s1": s1})


def _checked(lr: float, unit: dict[str, float], eps: float | None = None) -> None:
    if not (math.isfinite(lr) and lr >= 0) or any(not 0 <= x < 1 for x in unit.values()) or (eps is not None and not eps > 0):
        raise ValueError(f"lr {lr}, {unit}, eps {eps}")


def sgd(lr: float, momentum: float = 0.0) -> Rule:
    _checked(lr, {"momentum": momentum})

    def step(p, g, s0, s1):
        s = s0 * momentum + g
        return p - lr * s, s, s1

    return Rule(step)


def adam(lr: float, beta1: float, beta2: float, eps: float, step_number: int, decay: float = 0.0) -> Rule:
    """With a decay it is AdamW: the parameter shrinks first."""
    _checked(lr, {"beta1": beta1, "beta2": beta2}, eps)
    if step_number < 1:
        raise ValueError("steps count from 1")
    bc1, bc2 = 1 - beta1**step_number, 1 - beta2**step_number

    def step(p, g, s0, s1):
        m, v = s0 * beta1 + (1 - beta1) * g, s1 * beta2 + (1 - beta2) * g * g
        return p * (1 - lr * decay) - lr * (m / bc1) / (F.sqrt(v / bc2) + eps), m, v

    return Rule(step)


def rmsprop(lr: float, alpha: float, eps: float) -> Rule:
    _checked(lr, {"alpha": alpha}, eps)

    def step(p, g, s0, s1):
        s = s0 * alpha + (1 - alpha) * g * g
        return p - lr * g / (F.sqrt(s) + eps), s, s1

    return Rule(step)


def adagrad(lr: float, eps: float) -> Rule:
    _checked(lr, {}, eps)

    def step(p, g, s0, s1):
        s = s0 + g * g
        return p - lr * g / (F.sqrt(s) + eps), s, s1

    return Rule(step)


def momentum_fold(df: DataFrame, key: str, order: str, gradient: str, start: float, lr: float, momentum: float) -> DataFrame:
    """Many ordered SGD steps per key: ``key, p, s`` after the last one; a null gradient is a step of zero.

    The steps are linear in the gradients, so the gradient with k steps after it has the weight momentum^k in the state
    and their geometric sum in the parameter.  Rows are sorted in ranges of (key, order), which part a key of any number
    of gradients.  A range gives three numbers for each run of a key in a batch: its steps, its gradients' sum and their
    weighted sum; the runs of a key are then joined by the number of steps after them.
    """
    _checked(lr, {"momentum": momentum})

    def runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys, g = batch["k"], batch["g"].to_numpy()
            before = keys.shift()
            same = (keys == before).fillna(False).to_numpy(dtype=bool) | (keys.isna() & before.isna()).to_numpy()
            starts = np.flatnonzero(~same | (np.arange(len(batch)) == 0))
            steps = np.diff(starts, append=len(batch))
            after = np.repeat(starts + steps, steps) - 1 - np.arange(len(batch))
            sums = {"total": np.add.reduceat(g, starts), "state": np.add.reduceat(g * float(momentum) ** after, starts)}
            yield pd.DataFrame({"k": keys.iloc[starts], "first": batch["o"].iloc[starts], "n": steps, **sums})

    k, o = (df.schema[c].dataType.simpleString() for c in (key, order))
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(gradient).cast("double"), F.lit(0.0)).alias("g"))
    found = map_batches(rows.repartitionByRange("k", "o").sortWithinPartitions("k", "o"), runs, f"k {k}, first {o}, n long, total double, state double")
    later = Window.partitionBy("k").orderBy(F.col("first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.pow(F.lit(float(momentum)), F.coalesce(F.sum("n").over(later), F.lit(0)))
    parts = found.withColumn("_w", weight).groupBy("k").agg(
        (F.lit(float(start)) - lr * F.sum((F.col("total") - F.col("state") * F.col("_w") * momentum) / (1 - momentum))).alias("p"), F.sum(F.col("state") * F.col("_w")).alias("s")
    )
    return parts.withColumnRenamed("k", key)
