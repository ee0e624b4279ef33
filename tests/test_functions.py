from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import ACTIVATIONS, COMPARE, PARAMETERIZED, UNARY, as_u32, erf, erfc, ieee_div, lgamma, ln, rpow

NAN, INF = float("nan"), float("inf")


def values(spark, xs, *columns):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(xs)], "i long, a double" + (", b double" if xs and isinstance(xs[0], tuple) else ""))
    out = df.orderBy("i").select(*columns).collect()
    return [list(c) for c in zip(*out, strict=True)]


def same(got, want, tolerance=0.0):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (math.isnan(g) and math.isnan(w)) or g == w or abs(g - w) <= tolerance, (g, w)


def test_unary_fixture(spark):
    neg, absolute = values(spark, [1.5, -2.0, 0.0, -0.25], UNARY["neg"](F.col("a")), UNARY["abs"](F.col("a")))
    same(neg, [-1.5, 2, 0, 0.25])
    same(absolute, [1.5, 2, 0, 0.25])
    same(values(spark, [4.0, 9.0, 0.25, 1.0], UNARY["sqrt"](F.col("a")))[0], [2, 3, 0.5, 1])


def test_rounding_is_half_to_even(spark):
    same(values(spark, [0.5, 1.5, 2.5, -0.5, -1.5], UNARY["round"](F.col("a")))[0], [0, 2, 2, 0, -2])
    same(values(spark, [1.7, -1.7], UNARY["trunc"](F.col("a")))[0], [1, -1])


def test_ieee_edges(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 0.0), (6.0, 3.0), (1.0, NAN)]
    same(values(spark, pairs, ieee_div(F.col("a"), F.col("b")))[0], [INF, -INF, NAN, NAN, 2.0, NAN])
    same(values(spark, [1.0, 0.0, -1.0, NAN, INF], ln(F.col("a")))[0], [0, -INF, NAN, NAN, INF])


def test_comparisons_are_unordered_for_nan(spark):
    pairs = [(1.0, 1.0), (-0.0, 0.0), (2.5, 2.0), (-3.0, -3.0), (0.25, 0.5), (16777216.0, 16777215.0), (NAN, NAN), (NAN, INF)]
    eq, lt, ne, ge = values(spark, pairs, *(COMPARE[o](F.col("a"), F.col("b")) for o in ("eq", "lt", "ne", "ge")))
    assert eq == [1, 1, 0, 1, 0, 0, 0, 0]
    assert lt == [0, 0, 0, 0, 1, 0, 0, 0]
    assert ne == [0, 0, 1, 0, 1, 1, 1, 1]
    assert ge == [1, 1, 1, 1, 0, 1, 0, 0]


def test_special_functions(spark):
    xs = [-2.5, -0.5, 0.1, 0.9, 1.0, 3.7, 12.0]
    wide = [*xs, 0.0, -0.4, 0.46875, 0.46876, 2.2, 3.999, 4.001, 5.0, -5.0, 9.5, 26.0, 28.0, -28.0, INF, -INF, NAN]
    own, complement = values(spark, wide, erf(F.col("a")), erfc(F.col("a")))
    same(own, [math.erf(x) for x in wide], 1e-15)
    same([c and math.log(c) for c in complement], [math.erfc(x) and math.log(math.erfc(x)) for x in wide], 1e-12)
    same(values(spark, xs, lgamma(F.col("a")))[0], [math.lgamma(x) for x in xs], 1e-12)
    same(values(spark, [0.0, -1.0, -2.0], lgamma(F.col("a")))[0], [INF] * 3)


def test_parameterized_fixture(spark):
    xs = [-2, -0.75, -0.25, 0.5, 1.25, 2]
    x = F.col("a")
    clip, slope = values(spark, [float(v) for v in xs], PARAMETERIZED["hardtanh"](x, -0.75, 1.25), PARAMETERIZED["hardtanh_grad"](x, -0.75, 1.25))
    assert clip == [-0.75, -0.75, -0.25, 0.5, 1.25, 1.25]
    assert slope == [0, 0, 1, 1, 0, 0]
    over, step = values(spark, [float(v) for v in xs], PARAMETERIZED["threshold"](x, 0.5, -3.25), PARAMETERIZED["threshold_grad"](x, 0.5, 0.0))
    assert over == [-3.25] * 4 + [1.25, 2]
    assert step == [0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("name", ["gelu", "gelu_tanh", "silu", "softplus", "mish", "elu"])
def test_gradients_are_slopes(spark, name):
    h = 1e-5
    xs = [-2.0, -0.3, 0.4, 1.9]
    low, high = (values(spark, [x + d for x in xs], ACTIVATIONS[name](F.col("a")))[0] for d in (-h, h))
    same(values(spark, xs, ACTIVATIONS[f"{name}_grad"](F.col("a")))[0], [(b - a) / (2 * h) for a, b in zip(low, high, strict=True)], 2e-4)


def test_power_of_a_constant(spark):
    same(values(spark, [0.0, 2.0], rpow(3.0, F.col("a")))[0], [1, 9], 1e-12)
    with pytest.raises(ValueError):
        rpow(0.0, F.lit(1.0))


def test_unsigned(spark):
    assert values(spark, [0.0, 4294967295.0], as_u32(F.col("a")))[0] == [0, 4294967295]
    with pytest.raises(Exception, match="unsigned"):
        values(spark, [-1.0], as_u32(F.col("a")))
    with pytest.raises(Exception, match="unsigned"):
        values(spark, [4294967296.0], as_u32(F.col("a")))


def test_unsigned_and_signed_comparisons(spark):
    pairs = [(0.0, 0.0), (1.0, 2.0), (7.0, 7.0), (7.0, 3.0), (4294967295.0, 0.0)]
    got = values(spark, pairs, *(COMPARE[o](F.col("a").cast("long"), F.col("b").cast("long")) for o in ("eq", "ne", "lt", "le", "gt", "ge")))
    assert got == [[1, 0, 1, 0, 0], [0, 1, 0, 1, 1], [0, 1, 0, 0, 0], [1, 1, 1, 0, 0], [0, 0, 0, 1, 1], [1, 0, 1, 1, 1]]
    got = values(spark, [(-5.0, 2.0), (-1.0, -1.0), (0.0, 0.0), (3.0, -3.0), (-2147483648.0, 2147483647.0)], *(COMPARE[o](F.col("a").cast("int"), F.col("b").cast("int")) for o in ("lt", "gt")))
    assert got == [[1, 0, 0, 0, 1], [0, 0, 0, 1, 0]]
