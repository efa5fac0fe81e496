"""Inverse of the standard normal distribution as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's published rational approximation.
CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL_BELOW = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + c
    return value


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal for 0 < p < 1."""
    centred = p - 0.5
    square = centred * centred
    centre = _horner(CENTRE_NUM, square) * centred / _horner(CENTRE_DEN, square)

    def tail(q: Column) -> Column:
        root = F.sqrt(-2 * F.log(q))
        return _horner(TAIL_NUM, root) / _horner(TAIL_DEN, root)

    return F.when(p < TAIL_BELOW, tail(p)).when(p > 1 - TAIL_BELOW, -tail(1 - p)).otherwise(centre)


def inverse_normal_sql(p: str) -> str:
    """The same expression as SQL text, for checking against another engine."""

    def horner(coefficients: tuple[float, ...], x: str) -> str:
        value = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            value = f"({value} * {x} + CAST({c!r} AS DOUBLE))"
        return value

    def tail(q: str) -> str:
        root = f"sqrt(-2 * ln({q}))"
        return f"{horner(TAIL_NUM, root)} / {horner(TAIL_DEN, root)}"

    centred = f"({p} - 0.5)"
    square = f"({centred} * {centred})"
    centre = f"{horner(CENTRE_NUM, square)} * {centred} / {horner(CENTRE_DEN, square)}"
    low, high = f"CAST({TAIL_BELOW} AS DOUBLE)", f"(1 - CAST({TAIL_BELOW} AS DOUBLE))"
    return f"CASE WHEN {p} < {low} THEN {tail(p)} WHEN {p} > {high} THEN -({tail(f'(1 - {p})')}) ELSE {centre} END"
