"""Column expressions that stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(ident: Column | str, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and the salt alone: 48 bits of an MD5."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    text = F.concat(ident.cast("string"), F.lit("|" + salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(281474976710656.0)


def normal(ident: Column | str, salt: str) -> Column:
    """A standard normal number by Box and Muller from two hash uniforms."""
    radius = F.sqrt(-2 * F.log(1 - uniform(ident, salt + "/r")))
    return radius * F.cos(2 * F.pi() * uniform(ident, salt + "/a"))


def seed_of(*parts: Column | str) -> Column:
    """A whole number that follows from the parts alone: the CRC-32 of their text with / between."""
    return F.crc32(F.concat_ws("/", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def divide(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b as double; `otherwise` where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(otherwise).cast("double"))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def aipw(mu0: Column, mu1: Column, e: Column, t: Column, y: Column) -> Column:
    """The doubly robust pseudo-outcome."""
    return mu1 - mu0 + t * (y - mu1) / e - (1 - t) * (y - mu0) / (1 - e)


def aipw_outcomes(mu0: Column, mu1: Column, e: Column, t: Column, y: Column) -> tuple[Column, Column]:
    """The doubly robust signals of both potential outcomes; their difference is `aipw`."""
    return mu0 + (1 - t) * (y - mu0) / (1 - e), mu1 + t * (y - mu1) / e


def q_means(e: Column, p: Column, m: Column) -> tuple[Column, Column]:
    """(mu1, mu0) from the treatment propensity e, that among converters p, and the outcome mean m, clipped to [0, 1]."""
    return clip(m * p / e, 0.0, 1.0), clip(m * (1 - p) / (1 - e), 0.0, 1.0)


def q_ratio(e: Column, p: Column) -> Column:
    """Ratio of the outcome means by odds, clipped to [0.01, 100]."""
    return clip(p / (1 - p) * (1 - e) / e, 0.01, 100.0)


def stratum(*columns: str) -> Column:
    return F.concat_ws("_", *(F.col(c).cast("string") for c in columns))


def base_model(series: Column) -> Column:
    """Of a series id model#variant."""
    return F.split(series, "#")[0]


def hparam_tag(series: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(series, "#"), F.lit(2)), F.lit("default"))


def fisher_z(r: Column, n: Column) -> Column:
    return F.atanh(F.abs(clip(r, -0.999999, 0.999999))) * F.sqrt(n - 3)


#: Coefficients of the normal upper tail by Abramowitz and Stegun 26.2.17 (fixed values).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, absolute error under 1e-7."""
    k = 1 / (1 + 0.2316419 * z)
    poly = reduce(lambda acc, c: acc * k + c, reversed(TAIL[:-1]), F.lit(TAIL[-1])) * k
    return F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * poly
