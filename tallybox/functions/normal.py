"""The normal distribution in closed forms that every engine has the parts for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun 7.1.26 and 26.2.23.
CDF = (0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592))
QUANTILE = ((0.010328, 0.802853, 2.515517), (0.001308, 0.189269, 1.432788, 1.0))


def _horner(t: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * t + c
    return total


def normal_cdf(x: Column) -> Column:
    """Within 1.5e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + CDF[0] * z)
    return 0.5 * (1 + F.signum(x) * (1 - _horner(t, CDF[1]) * t * F.exp(-z * z)))


def normal_quantile(p: Column) -> Column:
    """Within 4.5e-4."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - _horner(t, QUANTILE[0]) / _horner(t, QUANTILE[1])
    return F.when(p < 0.5, -z).otherwise(z)


def _horner_sql(t: str, coefficients: tuple[float, ...]) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {t} + ({c!r})::DOUBLE)"
    return total


def normal_cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {CDF[0]!r}::DOUBLE * {z}))"
    return f"(0.5 * (1 + sign({x}) * (1 - {_horner_sql(t, CDF[1])} * {t} * exp(-{z} * {z}))))"


def normal_quantile_sql(p: str) -> str:
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    z = f"({t} - {_horner_sql(t, QUANTILE[0])} / {_horner_sql(t, QUANTILE[1])})"
    return f"(CASE WHEN {p} < 0.5 THEN -{z} ELSE {z} END)"
