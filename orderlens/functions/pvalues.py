"""Tail probabilities of the t, F, chi-square and normal distributions, as column expressions.

The incomplete beta and gamma functions are continued fractions and a series, evaluated from their
last term inwards by a fold over a fixed number of terms.  Half the terms are folded as well: where
the two do not agree the fraction has not converged and the probability is null.  Null goes in and
out.  Everything is built-in expressions, so finished statistics never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 10_000
_PRECISION = 1e-9
# From these degrees of freedom on, expansions about the limit are exact to double precision, while
# continued fractions would need about the square root of them in terms.
_MANY_T, _MANY_F = 1e5, 1e7
# Stirling's series of log(gamma).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_HALF_LOG_2PI = 0.9189385332046727


def _number(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of named values that are computed once."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(one, body), F.lit(0))


def _folded(term: Callable[[Column, Column], Column], last: Column, terms: int) -> Column:
    """`term(value, k)` for k from `terms` down to 1, starting from `last`."""
    ks = F.sequence(F.lit(terms), F.lit(1), F.lit(-1))
    return F.aggregate(ks, last, lambda value, k: term(value, k.cast("double")))


def _converged(term, last: Callable[[int], Column], terms: int | None) -> Column:
    terms = TERMS if terms is None else terms
    both = {"whole": _folded(term, last(terms), terms), "half": _folded(term, last(terms // 2), terms // 2)}
    return _let(both, lambda v: F.when(F.abs(v["whole"] - v["half"]) <= _PRECISION * F.abs(v["whole"]), v["whole"]))


def log_gamma(z: Column) -> Column:
    """By Stirling's series at z + 10, stepped back by the product of what lies between."""
    z = _number(z)
    high = z + 10
    series = F.lit(0.0)
    for power, c in enumerate(_STIRLING):
        series = series + F.lit(c) / F.pow(high, F.lit(2.0 * power + 1))
    between = F.ln(z)
    for k in range(1, 10):
        between = between + F.ln(z + k)
    return (high - 0.5) * F.ln(high) - high + _HALF_LOG_2PI + series - between


def _log_gamma_ratio(a: Column, b: Column) -> Column:
    """log(gamma(a + b) / gamma(a)); for large a by Stirling's series, which does not cancel."""
    series = lambda z: 1 / (12 * z) - 1 / (360 * z * z * z)
    large = (a + b - 0.5) * F.log1p(b / a) + b * F.ln(a) - b + series(a + b) - series(a)
    return F.when(a < 1e3, log_gamma(a + b) - log_gamma(a)).otherwise(large)


def _beta_fraction(a: Column, b: Column, x: Column, terms: int | None) -> Column:
    def coefficient(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return 1 / _converged(lambda f, k: 1 + coefficient(k) / f, lambda _: F.lit(1.0), terms)


def incomplete_beta(a, b, x, rest, terms: int | None = None) -> Column:
    """Regularised incomplete beta function I_x(a, b); `rest` is 1 - x, given as exactly as known."""

    def of(v: Column) -> Column:
        a, b, x, rest = (v[n] for n in ("a", "b", "x", "rest"))
        log_x = F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.ln(x))
        log_rest = F.when(rest < 0.5, F.ln(rest)).otherwise(F.log1p(-x))
        small, large = F.least(a, b), F.greatest(a, b)
        front = F.exp(_log_gamma_ratio(large, small) - log_gamma(small) + a * log_x + b * log_rest)
        lower = front * _beta_fraction(a, b, x, terms) / a
        upper = 1 - front * _beta_fraction(b, a, rest, terms) / b
        inside = F.when(x < (a + 1) / (a + b + 2), lower).otherwise(upper)
        return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(inside)

    return _let({"a": _number(a), "b": _number(b), "x": _number(x), "rest": _number(rest)}, of)


def upper_gamma(a, x, terms: int | None = None) -> Column:
    """Regularised upper incomplete gamma function Q(a, x)."""

    def of(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.ln(x) - x - log_gamma(a))
        series = _converged(lambda f, k: 1 + x / (a + k) * f, lambda _: F.lit(1.0), terms)
        below = 1 - front * series / a
        fraction = _converged(
            lambda f, k: x + 2 * k - 1 - a + k * (a - k) / f, lambda n: x + 2 * n + 1 - a, terms
        )
        return F.when(x <= 0, 1.0).when(x < a + 1, below).otherwise(front / fraction)

    return _let({"a": _number(a), "x": _number(x)}, of)


def p_t(t: Column, df: Column, terms: int | None = None) -> Column:
    """P(|T| > t); for many degrees of freedom by the normal value of equal tail (an expansion in
    1 / df about sqrt(df * log(1 + t**2 / df)))."""

    def of(v: Column) -> Column:
        square, df = v["square"], v["df"]
        few = incomplete_beta(df / 2, 0.5, df / (df + square), square / (df + square), terms)
        a = df - 0.5
        w = F.sqrt(a * F.log1p(square / df))
        many = _doubled_normal(w + (w * w * w + 3 * w) / (48 * a * a), terms)
        return F.when(df < _MANY_T, few).otherwise(many)

    return _let({"square": _number(t) * _number(t), "df": _number(df)}, of)


def p_f(f: Column, df1: Column, df2: Column, terms: int | None = None) -> Column:
    """P(F > f); for a large `df2` the mean of the chi-square tail over the denominator, by its
    moments up to the order 1 / df2**2."""

    def of(v: Column) -> Column:
        f, df1, df2 = v["f"], v["df1"], v["df2"]
        few = incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f), terms)
        a, y = df1 / 2, df1 * f / 2
        density = F.exp((a - 1) * F.ln(y) - y - log_gamma(a))
        r, r1, r2 = (a - 1) / y - 1, (1 - a) / (y * y), 2 * (a - 1) / (y * y * y)
        second, third, fourth = -density * r, -density * (r * r + r1), -density * (r * r * r + 3 * r * r1 + r2)
        first_order = y * y * second / df2
        second_order = (y * y * y * third * (8 / 6) + y * y * y * y * fourth / 2) / (df2 * df2)
        many = upper_gamma(a, y, terms) + first_order + second_order
        return F.when(f <= 0, 1.0).when(df2 < _MANY_F, few).otherwise(many)

    return _let({"f": _number(f), "df1": _number(df1), "df2": _number(df2)}, of)


def p_chi2(x: Column, df: Column, terms: int | None = None) -> Column:
    return upper_gamma(_number(df) / 2, _number(x) / 2, terms)


def _doubled_normal(z: Column, terms: int | None) -> Column:
    return upper_gamma(0.5, z * z / 2, terms)


def p_normal(z: Column, terms: int | None = None) -> Column:
    """Twice the upper tail, at most one (z comes from the larger of two statistics)."""
    return F.when(_number(z) <= 0, 1.0).otherwise(_doubled_normal(_number(z), terms))
