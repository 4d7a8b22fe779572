"""Energies, probabilities and angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant in kJ/mol/K, kJ per kcal, temperature assumed where none is given.
R, KCAL, ROOM = 0.008314462618, 4.184, 300.0


def kt(temperature: Column, unit: str = "kJ/mol", override: float | None = None) -> Column:
    """kT in unit: a positive override wins, the unit kT is 1, temperatures under 1 count as 1; null counts as ROOM."""
    if override is not None and override > 0:
        return F.lit(float(override))
    if unit == "kT":
        return F.lit(1.0)
    per = KCAL if unit == "kcal/mol" else 1.0
    return F.greatest(F.coalesce(temperature, F.lit(ROOM)), F.lit(1.0)) * F.lit(R / per)


def unit_factor(unit: str, temperature: float = ROOM) -> float:
    """What kJ/mol are multiplied by to be in unit."""
    return {"kJ/mol": 1.0, "kcal/mol": 1 / KCAL, "kT": 1 / (R * temperature)}[unit]


def boltzmann(f: Column, f_min: Column, kt_: Column) -> Column:
    """exp(-(F - min)/kT), the exponent held within 0 and 700."""
    return F.exp(-F.least(F.greatest((f - f_min) / kt_, F.lit(0.0)), F.lit(700.0)))


def free_energy(p: Column, kt_: Column, floor: float = 1e-300) -> Column:
    """-kT ln P, not shifted."""
    return -kt_ * F.ln(F.greatest(p, F.lit(floor)))


def wrap180(angle: Column) -> Column:
    """The angle in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def js_term(p: Column, q: Column) -> Column:
    """One cell's share of the Jensen-Shannon divergence of two distributions, natural logarithm."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)) / 2


def _log_gamma(x: float) -> float:
    return math.lgamma(x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_of_r(r: float | None, n: int | None) -> float | None:
    """Two-sided p value of a correlation r over n pairs, by the t distribution with max(n - 2, 1) degrees of freedom."""
    if r is None or n is None or math.isnan(r):
        return None
    free = max(n - 2, 1)
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta(free / 2, 0.5, 1 - r * r)
