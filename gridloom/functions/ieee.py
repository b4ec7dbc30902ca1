"""IEEE-754 arithmetic, comparison and mathematics as columns.

Spark returns NULL or raises where IEEE has NaN or infinity, and takes NaN as
equal to itself; each function here guards the cases that differ. All compute in double.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def divide(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.nullif(b, zero))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(math.nan)).otherwise(a % F.nullif(b, F.lit(0.0)))


def floor(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double"))


def ceiling(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.ceil(x).cast("double"))


def trunc(x: Column) -> Column:
    return F.signum(x) * floor(F.abs(x))


def modulo(a: Column, b: Column) -> Column:
    """The remainder of a floored division."""
    rest, quotient = remainder(a, b), divide(a, b)
    return rest + F.when(~F.isnan(quotient) & (quotient < 0) & (rest != 0), b).otherwise(F.lit(0.0))


def integer_divide(a: Column, b: Column) -> Column:
    return floor(divide(a, b))


def power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | ((a == -1) & (F.abs(b) == INF)), F.lit(1.0)).otherwise(F.pow(a, b))


def ln(x: Column) -> Column:
    return _guarded(x, 0.0, F.ln(x))


def log2(x: Column) -> Column:
    """Exact for powers of two."""
    near = F.rint(F.log2(x))
    return _guarded(x, 0.0, F.when(F.pow(F.lit(2.0), near) == x, near).otherwise(F.log2(x)))


def log10(x: Column) -> Column:
    return _guarded(x, 0.0, F.log10(x))


def log1p(x: Column) -> Column:
    return _guarded(x, -1.0, F.log1p(x))


def asinh(x: Column) -> Column:
    """By log1p of the magnitude, so that small arguments keep all their digits and -0.0 its sign."""
    a = F.abs(x)
    small = F.log1p(a + a * a / (F.sqrt(a * a + 1.0) + 1.0))
    return F.when(F.isnan(x) | (x == 0), x).otherwise(F.signum(x) * F.when(a < 2.0**28, small).otherwise(F.ln(a) + math.log(2.0)))


def acosh(x: Column) -> Column:
    """By log1p of the distance from one, so that arguments near one keep their digits; NaN below one."""
    t = x - 1.0
    near = F.log1p(t + F.sqrt(t * (t + 2.0)))
    return F.when(F.isnan(x), x).when(x < 1.0, F.lit(math.nan)).when(x < 2.0**28, near).otherwise(F.ln(x) + math.log(2.0))


def _guarded(x: Column, pole: float, value: Column) -> Column:
    return F.when(F.isnan(x), x).when(x > pole, value).when(x == pole, F.lit(-INF)).otherwise(F.lit(math.nan))


def both(a: Column, b: Column) -> Column:
    """Neither is NaN."""
    return ~F.isnan(a) & ~F.isnan(b)


def truth(x: Column) -> Column:
    return F.isnan(x) | (x != 0)


def is_inf(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) == INF)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


ARITHMETIC = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "power": power,
    "modulo": modulo,
    "integer_divide": integer_divide,
}
COMPARE = {
    "equal": lambda a, b: both(a, b) & (a == b),
    "greater": lambda a, b: both(a, b) & (a > b),
    "less": lambda a, b: both(a, b) & (a < b),
    "greater_or_equal": lambda a, b: both(a, b) & (a >= b),
    "less_or_equal": lambda a, b: both(a, b) & (a <= b),
    "not_equal": lambda a, b: ~both(a, b) | (a != b),
}
BOOLEAN = {
    "and": lambda a, b: truth(a) & truth(b),
    "or": lambda a, b: truth(a) | truth(b),
    "xor": lambda a, b: truth(a) != truth(b),
    "equal": lambda a, b: truth(a) == truth(b),
}
SPECIAL = {"isnan": F.isnan, "isinf": is_inf, "isfinite": is_finite}


def _zeta_less_one(k: int) -> float:
    """The sum of n ** -k from n = 2 on: directly to 50, then by the Euler-Maclaurin formula."""
    n = 50.0
    return math.fsum([*(i**-k for i in range(2, 50)), n ** (1 - k) / (k - 1), n**-k / 2, k * n ** (-k - 1) / 12, -k * (k + 1) * (k + 2) * n ** (-k - 3) / 720])


#: Of the logarithm of the gamma function: its power series about two, from the square on, and the series for large arguments (Bernoulli numbers).
_ABOUT_TWO = [(-1) ** k * _zeta_less_one(k) / k for k in range(2, 34)]
_LARGE = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
_EULER = 0.57721566490153286
#: Factorials that a double holds; gamma(n) is the one of n - 1.
_FACTORIALS = np.array([float(math.factorial(n)) for n in range(171)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the magnitude of gamma: a power series near one and two, else a series for large arguments after some steps up; mirrored below one half."""
    with np.errstate(all="ignore"):
        left = x < 0.5
        y = np.where(left, 1.0 - x, x)
        z = np.where(y < 1.5, y - 1.0, y - 2.0)
        near = z * z * np.polynomial.polynomial.polyval(z, _ABOUT_TWO) + z * (1.0 - _EULER) - np.where(y < 1.5, np.log1p(z), 0.0)
        up = np.where(np.isfinite(y), y, 20.0)
        product = np.ones_like(up)
        for _ in range(12):
            low = up < 14.0
            product = np.where(low, product * up, product)
            up = np.where(low, up + 1.0, up)
        far = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + np.polynomial.polynomial.polyval(1 / (up * up), _LARGE) / up - np.log(product)
        out = np.where(y < 2.5, near, far)
        out = np.where(np.isposinf(y), INF, out)
        part = np.abs(x - np.rint(x))
        mirrored = np.where(part == 0, INF, math.log(math.pi) - np.log(np.sin(math.pi * part)) - out)
        tiny = np.abs(x) < 1e-10  # the mirror would lose 1 - x
        out = np.where(left, np.where(tiny, -np.log(np.abs(x)) - _EULER * x, mirrored), out)
        return np.where(np.isnan(x), x, np.where(np.isinf(x), INF, out))


def _gamma(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        whole = np.rint(x)
        negative = (x < 0) & (np.mod(np.floor(x), 2) == 1)
        out = np.where(negative, -1.0, 1.0) * np.exp(_lgamma(x))
        n = np.clip(np.where(np.isfinite(x), whole, 1.0), 1, 171).astype(np.int64)
        out = np.where((x == whole) & (x >= 1) & (x <= 171), _FACTORIALS[n - 1], out)
        out = np.where((x < 0) & (x == whole), math.nan, out)
        out = np.where(x == 0, np.copysign(INF, x), out)
        return np.where(np.isnan(x), x, np.where(np.isposinf(x), INF, out))


def _vectorised(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """Spark has no gamma functions: a function of whole Arrow batches, made when it is first used with a session."""

    def apply(x: Column) -> Column:
        def batch(s: pd.Series) -> pd.Series:
            return pd.Series(f(s.to_numpy(dtype=float)))

        return F.when(x.isNotNull(), F.coalesce(F.pandas_udf(batch, "double")(x), F.lit(math.nan)))  # NaN comes back as null

    return apply


gamma, lgamma = _vectorised(_gamma), _vectorised(_lgamma)


#: Mathematical functions, and whether they keep zero.
MATH = {
    "abs": (F.abs, True),
    "sign": (F.signum, True),
    "log": (ln, False),
    "log2": (log2, False),
    "log10": (log10, False),
    "sqrt": (F.sqrt, True),
    "ceiling": (ceiling, True),
    "floor": (floor, True),
    "trunc": (trunc, True),
    "log1p": (log1p, True),
    "round": (F.round, True),
    "exp": (F.exp, False),
    "expm1": (F.expm1, True),
    "acos": (F.acos, False),
    "acosh": (acosh, False),
    "asin": (F.asin, True),
    "asinh": (asinh, True),
    "atan": (F.atan, True),
    "atanh": (F.atanh, True),
    "cos": (F.cos, False),
    "cosh": (F.cosh, False),
    "sin": (F.sin, True),
    "sinh": (F.sinh, True),
    "tan": (F.tan, True),
    "tanh": (F.tanh, True),
    "gamma": (gamma, False),
    "lgamma": (lgamma, False),
}
