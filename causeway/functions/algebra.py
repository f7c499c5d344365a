"""Closed forms over anything that adds and multiplies: Spark columns, SQL text or plain numbers.

Least squares on up to three regressors, 2 x 2 complex matrices and the spectral formulas on
top of them stay inside whole-stage code generation this way; larger systems are solved by
:mod:`causeway.functions.matrices` on one row per series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Sql:
    """A scalar SQL expression as text."""

    def __init__(self, text):
        self.text = text.text if isinstance(text, Sql) else repr(float(text)) if isinstance(text, float) else str(text)

    def __str__(self) -> str:
        return self.text

    def _with(self, sign: str, other, turned: bool = False) -> Sql:
        a, b = (Sql(other), self) if turned else (self, Sql(other))
        return Sql(f"({a} {sign} {b})")

    def __add__(self, o):
        return self._with("+", o)

    def __radd__(self, o):
        return self._with("+", o, True)

    def __sub__(self, o):
        return self._with("-", o)

    def __rsub__(self, o):
        return self._with("-", o, True)

    def __mul__(self, o):
        return self._with("*", o)

    def __rmul__(self, o):
        return self._with("*", o, True)

    def __truediv__(self, o):
        return self._with("/", o)

    def __rtruediv__(self, o):
        return self._with("/", o, True)

    def __neg__(self):
        return Sql(f"(-{self})")


def _call(name: str, spark: Callable, plain: Callable) -> Callable:
    def call(*args):
        if any(isinstance(a, Sql) for a in args):
            return Sql(f"{name}({', '.join(str(Sql(a)) for a in args)})")
        if any(isinstance(a, Column) for a in args):
            return spark(*(a if isinstance(a, Column) else F.lit(a) for a in args))
        return plain(*args)

    return call


ln = _call("ln", F.log, math.log)
sqrt = _call("sqrt", F.sqrt, math.sqrt)
cos = _call("cos", F.cos, math.cos)
sin = _call("sin", F.sin, math.sin)
absolute = _call("abs", F.abs, abs)
greatest = _call("greatest", F.greatest, max)
least = _call("least", F.least, min)


def det(m: Sequence[Sequence]):
    """Determinant of a small matrix, along its first row."""
    if len(m) == 1:
        return m[0][0]
    out = None
    for k, head in enumerate(m[0]):
        part = head * det([[*row[:k], *row[k + 1 :]] for row in m[1:]])
        out = part if out is None else out - part if k % 2 else out + part
    return out


def solve(g: Sequence[Sequence], c: Sequence) -> list:
    """The solution of a few linear equations, by Cramer's rule."""
    whole = det(g)
    return [det([[c[r] if k == j else g[r][k] for k in range(len(c))] for r in range(len(c))]) / whole for j in range(len(c))]


def choose(condition, yes, no):
    """``yes`` where the condition holds, else ``no``, which alone is evaluated there."""
    if isinstance(condition, Sql):
        return Sql(f"CASE WHEN {condition} THEN {Sql(yes)} ELSE {Sql(no)} END")
    if isinstance(condition, Column):
        return F.when(condition, yes).otherwise(no)
    return yes if condition else no


def above(a, b):
    return Sql(f"({a} > {b})") if isinstance(a, Sql) else a > b


#: A regressor of which less than this share is left besides those before it is redundant; a variance of less than ``NOTHING`` of a target's mean square is none.
REDUNDANT, NOTHING = 1e-10, 1e-12


def elimination(moment: Callable[[str, str], object], y: str, regressors: Sequence[str], named: Callable[[str], object], out: str, ridge: float = 0.0) -> list[dict]:
    """Steps (name to expression, each on those before it by ``named``) to the residual variance ``out`` of a least-squares fit without an intercept.

    Regressors are eliminated one after another; a redundant one (zero, or a combination of those before it) gets no
    weight, which leaves the fitted values those of any least-squares solution. Coefficients are ``out``_b0, ...
    """
    n, steps = len(regressors), []
    d, l, z = (lambda j: named(f"{out}_d{j}")), (lambda i, j: named(f"{out}_l{i}_{j}")), (lambda j: named(f"{out}_z{j}"))  # noqa: E741
    g = lambda i, j: moment(regressors[i], regressors[j]) + ridge if ridge and i == j else moment(regressors[i], regressors[j])

    def less(value, parts):
        for part in parts:
            value = value - part
        return value

    for j in range(n):
        steps.append({f"{out}_d{j}": less(g(j, j), (l(j, i) * l(j, i) * d(i) for i in range(j)))})
        some = above(d(j), g(j, j) * REDUNDANT)
        step = {f"{out}_l{m}_{j}": choose(some, less(g(m, j), (l(m, i) * l(j, i) * d(i) for i in range(j))) / d(j), 0.0) for m in range(j + 1, n)}
        steps.append(step | {f"{out}_z{j}": choose(some, less(moment(regressors[j], y), (l(j, i) * d(i) * z(i) for i in range(j))) / d(j), 0.0)})
    for j in reversed(range(n)):
        steps.append({f"{out}_b{j}": less(z(j), (l(m, j) * named(f"{out}_b{m}") for m in range(j + 1, n)))})
    b = [named(f"{out}_b{j}") for j in range(n)]
    steps.append({f"{out}_all": residual_covariance(moment, y, y, regressors, b, b)})
    steps.append({out: choose(above(named(f"{out}_all"), moment(y, y) / moment("1", "1") * NOTHING), named(f"{out}_all"), 0.0)})
    return steps


def fit(moment: Callable[[str, str], object], y: str, regressors: Sequence[str], ridge: float = 0.0) -> list:
    """Least-squares coefficients without an intercept; ``moment(a, b)`` is the sum of a * b over the rows, "1" the constant."""
    g = [[moment(a, b) + ridge if ridge and a == b else moment(a, b) for b in regressors] for a in regressors]
    return solve(g, [moment(a, y) for a in regressors])


def residual_covariance(moment: Callable[[str, str], object], y: str, z: str, regressors: Sequence[str], by: Sequence, bz: Sequence):
    """Covariance of the residuals of y and z about their own means, divided by the number of rows.

    The models have no intercept, so the residuals' means aren't zero and their product counts.
    """
    products = moment(y, z)
    for k, a in enumerate(regressors):
        products = products - by[k] * moment(a, z) - bz[k] * moment(a, y)
        for j, other in enumerate(regressors):
            products = products + by[k] * (bz[j] * moment(a, other))
    sums = []
    for target, b in ((y, by), (z, bz)):
        total = moment("1", target)
        for k, a in enumerate(regressors):
            total = total - b[k] * moment("1", a)
        sums.append(total)
    n = moment("1", "1")
    return products / n - (sums[0] / n) * (sums[1] / n)


def residual_variance(moment: Callable[[str, str], object], y: str, regressors: Sequence[str], ridge: float = 0.0):
    """The variance of the residuals of a fit about their mean."""
    b = fit(moment, y, regressors, ridge)
    return residual_covariance(moment, y, y, regressors, b, b)


@dataclass
class Complex:
    """A complex number as two reals."""

    re: object
    im: object

    def __add__(self, o):
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o):
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __neg__(self):
        return Complex(-self.re, -self.im)

    def conj(self):
        return Complex(self.re, -self.im)

    def times(self, real):
        return Complex(self.re * real, self.im * real)

    def square(self):
        """The squared modulus."""
        return self.re * self.re + self.im * self.im

    def over(self, o):
        size = o.square()
        top = self * o.conj()
        return Complex(top.re / size, top.im / size)


def lag_polynomial(coef: Callable[[int, int, int], object], order: int, omega) -> list[list[Complex]]:
    """A(w) = I - sum of A_k exp(-iwk), for two channels; ``coef(k, row, column)``."""
    out = []
    for r in range(2):
        row = []
        for c in range(2):
            re, im = 1.0 if r == c else 0.0, 0.0
            for k in range(1, order + 1):
                re = re - coef(k, r, c) * cos(omega * float(k))
                im = im + coef(k, r, c) * sin(omega * float(k))
            row.append(Complex(re, im))
        out.append(row)
    return out


def inverse(m: list[list[Complex]]) -> list[list[Complex]]:
    """The inverse of a complex 2 x 2 matrix."""
    d = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return [[m[1][1].over(d), (-m[0][1]).over(d)], [(-m[1][0]).over(d), m[0][0].over(d)]]


def density(h: list[list[Complex]], sigma: Callable[[int, int], object]) -> list[list[Complex]]:
    """S = H Sigma H*, for two channels."""
    half = [[h[r][0].times(sigma(0, c)) + h[r][1].times(sigma(1, c)) for c in range(2)] for r in range(2)]
    return [[half[r][0] * h[c][0].conj() + half[r][1] * h[c][1].conj() for c in range(2)] for r in range(2)]


def plain_spectral_gc(h: list[list[Complex]], sigma: Callable[[int, int], object]):
    """Channel 1 to channel 0 as if the innovations were uncorrelated."""
    own, other = h[0][0].square() * sigma(0, 0), h[0][1].square() * sigma(1, 1)
    return ln((own + other) / own)


def geweke_gc(h: list[list[Complex]], sigma: Callable[[int, int], object]):
    """Geweke's measure (1982) of channel 1 to channel 0: the innovations' correlation goes to the target's own part."""
    cross = (h[0][0] * h[0][1].conj()).re
    whole = h[0][0].square() * sigma(0, 0) + h[0][1].square() * sigma(1, 1) + 2.0 * (sigma(0, 1) * cross)
    own = h[0][0] + h[0][1].times(sigma(0, 1) / sigma(0, 0))
    return ln(whole / (own.square() * sigma(0, 0)))


def stationary_2x2(a: Callable[[int, int], object], q: Callable[[int, int], object]) -> tuple:
    """P = A P A' + Q for two states: (P00, P01, P11)."""
    a00, a01, a10, a11 = a(0, 0), a(0, 1), a(1, 0), a(1, 1)
    rows = [
        [1.0 - a00 * a00, -2.0 * (a00 * a01), -(a01 * a01)],
        [-(a00 * a10), 1.0 - (a00 * a11 + a01 * a10), -(a01 * a11)],
        [-(a10 * a10), -2.0 * (a10 * a11), 1.0 - a11 * a11],
    ]
    return tuple(solve(rows, [q(0, 0), q(0, 1), q(1, 1)]))


def eigen_hermitian(s00, s11, re01, im01) -> tuple:
    """The eigenvalues of a Hermitian 2 x 2 matrix, the smaller one first."""
    middle, half = (s00 + s11) / 2.0, (s00 - s11) / 2.0
    spread = sqrt(half * half + re01 * re01 + im01 * im01)
    return middle - spread, middle + spread


def spectral_radius_2x2(a, b, c, d):
    """The largest modulus of the eigenvalues of [[a, b], [c, d]]."""
    half, product = (a + d) / 2.0, a * d - b * c
    under = half * half - product
    real = absolute(half) + sqrt(greatest(under, 0.0))
    turning = sqrt(greatest(product, 0.0))
    if isinstance(under, Sql):
        return Sql(f"CASE WHEN {under} >= 0 THEN {real} ELSE {turning} END")
    if isinstance(under, Column):
        return F.when(under >= 0, real).otherwise(turning)
    return real if under >= 0 else turning
