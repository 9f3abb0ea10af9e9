"""Pure Column expressions: no UDFs, so everything stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bound ``c``; NULL stays NULL (least/greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def log2p1(c: Column) -> Column:
    return F.log2(c + F.lit(1.0))


def log2_ratio(a: Column, b: Column, offset: float = 1.0) -> Column:
    return F.log2((a + F.lit(offset)) / (b + F.lit(offset)))


def direction(c: Column, threshold: float = 1.0, up: str = "up", down: str = "down", flat: str = "stable") -> Column:
    return F.when(c >= threshold, up).when(c <= -threshold, down).otherwise(flat)


def tier(c: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound ``c`` reaches; ``steps`` run from high to low."""
    out = None
    for bound, label in steps:
        out = F.when(c >= bound, label) if out is None else out.when(c >= bound, label)
    return out.otherwise(otherwise)


def labels(*pairs: tuple[Column, str]) -> Column:
    """``;``-joined labels of the conditions that hold, ``none`` when none does."""
    joined = F.concat_ws(";", *[F.when(cond, F.lit(text)) for cond, text in pairs])
    return F.when(joined == "", "none").otherwise(joined)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 when the denominator is absent or not positive."""
    return F.coalesce(F.try_divide(a.cast("double"), F.when(b > 0, b).cast("double")), F.lit(0.0))


def text(name: str) -> Column:
    return F.col(name).cast("string")


def present(df: DataFrame, name: str, default: Column) -> Column:
    """The column when the table has it, else ``default``."""
    return F.col(name) if name in df.columns else default.alias(name)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column of a published table."""
    return df.select(
        *[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    )


def neglog10_score(q: Column, full_at: float = 10.0) -> Column:
    """-log10 of a q-value scaled so that ``full_at`` decades score 1."""
    return clip(-F.log10(clip(q, 1e-300, 1.0)) / full_at)


# Rational Chebyshev coefficients for the error function
# (W. J. Cody, Math. Comp. 23, 1969), lowest interval first.
ERF_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERF_C = (
    5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
ERF_D = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
    3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)
ERF_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
ERF_Q = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _rational(y: Column, num: Sequence[float], den: Sequence[float]) -> Column:
    """Horner form with the leading numerator coefficient stored last."""
    top, bottom = F.lit(num[-1]) * y, y
    for a, b in zip(num[:-2], den[:-1]):
        top, bottom = (top + F.lit(a)) * y, (bottom + F.lit(b)) * y
    return (top + F.lit(num[-2])) / (bottom + F.lit(den[-1]))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    sq = x * x
    low = F.lit(1.0) - x * _rational(sq, ERF_A, ERF_B)
    mid = F.exp(-sq) * _rational(x, ERF_C, ERF_D)
    inv = F.lit(1.0) / sq
    tail = inv * _rational(inv, ERF_P, ERF_Q)
    high = F.exp(-sq) * (F.lit(1.0 / math.sqrt(math.pi)) - tail) / x
    return F.when(x <= 0.46875, low).when(x <= 4.0, mid).otherwise(high)


def two_sided_normal_p(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series after shifting the argument up by ten."""
    x = n.cast("double") + F.lit(11.0)
    shift = F.lit(0.0)
    for step in range(1, 11):
        shift = shift + F.log(n.cast("double") + F.lit(float(step)))
    inv = F.lit(1.0) / x
    series = inv / 12.0 - inv * inv * inv / 360.0 + F.pow(inv, F.lit(5.0)) / 1260.0
    return (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2.0 * math.pi)) + series - shift


def hypergeometric_tail(overlap: Column, background: Column, set_size: Column, drawn: Column) -> Column:
    """P(X >= overlap) for a draw of ``drawn`` from ``background`` holding ``set_size`` hits.

    Terms are summed from their logarithms along the recurrence, so a first term
    far below the mode cannot underflow the whole sum.
    """
    k, n, big_n, m = (c.cast("double") for c in (overlap, drawn, background, set_size))
    first = (
        log_factorial(m) - log_factorial(k) - log_factorial(m - k)
        + log_factorial(big_n - m) - log_factorial(n - k) - log_factorial(big_n - m - n + k)
        - log_factorial(big_n) + log_factorial(n) + log_factorial(big_n - n)
    )
    last = F.least(drawn, set_size).cast("long")

    def step(acc: Column, i: Column) -> Column:
        j = i.cast("double")
        gain = F.log((m - j) * (n - j) / ((j + 1.0) * (big_n - m - n + j + 1.0)))
        return F.struct((acc["term"] + gain).alias("term"), (acc["total"] + F.exp(acc["term"] + gain)).alias("total"))

    start = F.struct(first.alias("term"), F.exp(first).alias("total"))
    steps = F.when(overlap < last, F.sequence(overlap.cast("long"), last - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, step)["total"]
    # below the smallest attainable overlap the tail is the whole distribution
    certain = (overlap <= 0) | (k <= n + m - big_n)
    return F.when(certain, 1.0).otherwise(clip(tail, 1e-300, 1.0))


def draw(n: Column, *parts: Column) -> Column:
    """Reproducible draw in [0, n): a hash of its coordinates, independent of partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long"))


def shuffle_key(*parts: Column) -> Column:
    """Reproducible random order: sort by this hash."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def student_t_quantile(degrees: Column, level: float = 0.95, steps: int = 60) -> Column:
    """Two-sided Student-t quantile for any whole number of degrees; NULL below one.

    With t = sqrt(n) tan(a) the probability of |T| <= t is a finite series in cos(a); the
    angle is found by halving its range.
    """
    n = degrees.cast("int")
    odd = n % 2 == 1

    def probability(angle: Column) -> Column:
        square = F.cos(angle) * F.cos(angle)

        def add(state: Column, j: Column) -> Column:
            ratio = F.when(odd, 2.0 * j / (2.0 * j + 1.0)).otherwise((2.0 * j - 1.0) / (2.0 * j))
            term = state["term"] * square * ratio
            return F.struct((state["total"] + term).alias("total"), term.alias("term"))

        first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
        terms = F.greatest(F.floor((n - 2) / 2).cast("int"), F.lit(0))
        series = F.aggregate(F.slice(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), F.lit(1), terms), F.struct(first.alias("total"), first.alias("term")), add, lambda s: s["total"])
        return F.when(n == 1, angle * (2.0 / math.pi)).when(odd, (angle + F.sin(angle) * series) * (2.0 / math.pi)).otherwise(F.sin(angle) * series)

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2.0
        below = probability(middle) < level
        return F.struct(F.when(below, middle).otherwise(state["low"]).alias("low"), F.when(below, state["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    angle = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2.0)
    return F.when(n >= 1, F.sqrt(n.cast("double")) * F.tan(angle))
