"""Column functions: everything that maps one row to one value, all inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _f(x: float) -> Column:
    return F.lit(float(x))


# -- IEEE helpers: Spark gives NULL or an error where floating point has inf and nan --------------------------------


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with inf and nan as in IEEE 754; the sign of a zero divisor is not seen."""
    safe = a / F.when(b != 0, b)
    return F.when(b != 0, safe).when(F.isnan(a) | F.isnan(b) | (a == 0), _f(NAN)).otherwise(F.signum(a) * _f(INF))


def _guarded(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A logarithm with -inf at 0 and nan below."""
    return lambda x: F.when(x > 0, fn(x)).when(x == 0, _f(-INF)).when(x.isNull(), F.lit(None)).otherwise(_f(NAN))


ln = _guarded(F.log)
log2 = _guarded(F.log2)
log10 = _guarded(F.log10)


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).when(x == -1, _f(-INF)).when(x.isNull(), F.lit(None)).otherwise(_f(NAN))


def recip(x: Column) -> Column:
    return ieee_div(_f(1), x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


# The rational approximations of the error function by Cody (1969), numerator and denominator, highest
# power first: of erf for |x| up to 0.46875, and of erfc for |x| up to 4 and beyond.
_ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(at: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def polynomial(powers: tuple[float, ...]) -> Column:
        out = _f(powers[0])
        for c in powers[1:]:
            out = out * at + c
        return out

    return polynomial(parts[0]) / polynomial(parts[1])


def _erfc_of_positive(a: Column) -> Column:
    """erfc(a) for a above 0.46875, with full relative precision: exp(-a^2) in two factors that lose no digits."""
    near = F.floor(a * 16) / 16
    decay = F.exp(-near * near) * F.exp(-(a - near) * (a + near))
    square = 1 / (a * a)
    large = (1 / math.sqrt(math.pi) - square * _ratio(square, _ERFC_LARGE)) / a
    return F.when(a > 27, _f(0)).otherwise(decay * F.when(a <= 4, _ratio(a, _ERFC_MIDDLE)).otherwise(large))


def erf(x: Column) -> Column:
    """The error function to double precision; nan stays nan."""
    a = F.abs(x)
    return F.when(F.isnan(x), x).when(a <= 0.46875, x * _ratio(x * x, _ERF_SMALL)).otherwise(F.signum(x) * (1 - _erfc_of_positive(a)))


def erfc(x: Column) -> Column:
    """1 - erf(x), also where that is too small to be seen beside 1."""
    a = F.abs(x)
    small, side = 1 - x * _ratio(x * x, _ERF_SMALL), F.signum(x)
    return F.when(F.isnan(x), x).when(a <= 0.46875, small).otherwise((1 - side) + side * _erfc_of_positive(a))


# Lanczos approximation of the gamma function, g = 7, nine terms.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """ln |gamma(x)|, with reflection below 0.5 and inf at the poles."""

    def right(z: Column) -> Column:
        z = z - 1
        series = _f(_LANCZOS[0])
        for i, c in enumerate(_LANCZOS[1:], 1):
            series = series + c / (z + i)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)

    known = right(F.greatest(x, 1 - x))  # one of the two is at least 0.5; written once, as branches are not shared in generated code
    mirror = F.when(x < 0.5, math.log(math.pi) - F.log(F.abs(F.sin(math.pi * x)))).otherwise(_f(0))
    return F.when((x <= 0) & (x == F.floor(x)), _f(INF)).otherwise(mirror + F.when(x < 0.5, _f(-1)).otherwise(_f(1)) * known)


UNARY: dict[str, Callable[[Column], Column]] = {
    "exp": F.exp, "exp_neg": lambda x: F.exp(-x), "ln": ln, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos,
    "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "sqrt": F.sqrt, "abs": F.abs,
    "neg": lambda x: -x, "recip": recip, "identity": lambda x: x, "log2": log2, "log10": log10, "exp2": lambda x: F.pow(_f(2), x),
    "expm1": F.expm1, "log1p": log1p, "sign": lambda x: F.signum(x) + 0.0, "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"), "round": F.rint, "trunc": trunc, "erf": erf, "erfc": erfc, "lgamma": lgamma,
}

# -- activations and their gradients; a gradient marked "of the output" takes the activated value ----------------------


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _gelu_tanh(x: Column) -> tuple[Column, Column]:
    inner = math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)
    return F.tanh(inner), math.sqrt(2 / math.pi) * (1 + 3 * 0.044715 * x * x)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def gelu_grad(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def gelu_tanh(x: Column) -> Column:
    return 0.5 * x * (1 + _gelu_tanh(x)[0])


def gelu_tanh_grad(x: Column) -> Column:
    t, slope = _gelu_tanh(x)
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * slope


def softplus(x: Column) -> Column:
    return F.greatest(x, _f(0)) + F.log1p(F.exp(-F.abs(x)))  # does not overflow


def silu_grad(x: Column) -> Column:
    s = sigmoid(x)
    return s * (1 + x * (1 - s))


def mish_grad(x: Column) -> Column:
    t = F.tanh(softplus(x))
    return t + x * sigmoid(x) * (1 - t * t)


ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "gelu": gelu, "gelu_grad": gelu_grad, "gelu_tanh": gelu_tanh, "gelu_tanh_grad": gelu_tanh_grad,
    "relu": lambda x: F.greatest(x, _f(0)), "relu_grad": lambda x: (x > 0).cast("double"),
    "sigmoid": sigmoid, "sigmoid_grad": lambda y: y * (1 - y),  # of the output
    "tanh": F.tanh, "tanh_grad": lambda y: 1 - y * y,  # of the output
    "silu": lambda x: x * sigmoid(x), "silu_grad": silu_grad, "softplus": softplus, "softplus_grad": sigmoid,
    "mish": lambda x: x * F.tanh(softplus(x)), "mish_grad": mish_grad,
    "elu": lambda x: F.when(x >= 0, x).otherwise(F.expm1(x)), "elu_grad": lambda x: F.when(x >= 0, _f(1)).otherwise(F.exp(x)),
}

PARAMETERIZED: dict[str, Callable[[Column, float, float], Column]] = {
    "hardtanh": lambda x, lo, hi: F.when(x < lo, _f(lo)).when(x > hi, _f(hi)).otherwise(x),
    "hardtanh_grad": lambda x, lo, hi: ((x > lo) & (x < hi)).cast("double"),
    "threshold": lambda x, t, other: F.when(x > t, x).otherwise(_f(other)),
    "threshold_grad": lambda x, t, other: (x > t).cast("double"),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": ieee_div, "pow": F.pow,
}


def _ordered(test: Callable[[Column, Column], Column], unordered: bool) -> Callable[[Column, Column], Column]:
    """A comparison as 0 or 1 in which nan is unordered: only "ne" holds for it."""
    return lambda a, b: F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(unordered)).otherwise(test(a, b)).cast("double")


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": _ordered(lambda a, b: a == b, False), "ne": _ordered(lambda a, b: a != b, True), "lt": _ordered(lambda a, b: a < b, False),
    "gt": _ordered(lambda a, b: a > b, False), "le": _ordered(lambda a, b: a <= b, False), "ge": _ordered(lambda a, b: a >= b, False),
}


def as_u32(x: Column) -> Column:
    """An unsigned 32-bit value in a long; anything else is an error, as Spark has no unsigned type."""
    return F.when(x.isNull() | x.between(0, (1 << 32) - 1), x.cast("long")).otherwise(F.raise_error(F.lit("not an unsigned 32-bit value")).cast("long"))


def rpow(base: float, x: Column) -> Column:
    """base ** x for a positive constant base."""
    if not base > 0:
        raise ValueError("the base must be positive")
    return F.exp(x * math.log(base))
