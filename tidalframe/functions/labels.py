"""Labels, class decisions, probabilities and risk texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTHY = "healthy"
BLEACHED = "bleached"

# Class numbers of the training target.
LABEL_CODES = {HEALTHY: 0, BLEACHED: 1}

# Percent limits of the risk levels.
HIGH_RISK_ABOVE = 70
MODERATE_RISK_ABOVE = 40


def bleach_class(percent: Column) -> Column:
    """Zero percent is healthy, any other known percent is bleached."""
    return F.when(percent.isNull(), None).when(percent == 0, HEALTHY).otherwise(BLEACHED)


def encode_label(name: Column) -> Column:
    """Class name to class number."""
    code = F.when(name == HEALTHY, LABEL_CODES[HEALTHY])
    return code.when(name == BLEACHED, LABEL_CODES[BLEACHED]).cast("double")


def binary_prediction(p: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """1 when p reaches the threshold; ``inclusive=False`` wants strictly more."""
    hit = p >= threshold if inclusive else p > threshold
    return hit.cast("int")


def bleached_probability(p: Column, bleached_index: int) -> Column:
    """p is the probability of class 1; give that of the bleached class."""
    return p if bleached_index == 1 else 1 - p


def class_probabilities(p: Column, bleached_index: int) -> Column:
    """Both class probabilities as one struct."""
    bleached = bleached_probability(p, bleached_index)
    return F.struct(bleached.alias("probability_bleached"), (1 - bleached).alias("probability_unbleached"))


def confidence(p: Column) -> Column:
    """Probability of the more likely class."""
    return F.greatest(p, 1 - p)


def risk_level(percent: Column) -> Column:
    """Risk text of a 0..100 percent."""
    level = F.when(percent > HIGH_RISK_ABOVE, "High Risk")
    level = level.when(percent > MODERATE_RISK_ABOVE, "Moderate Risk")
    return level.when(percent.isNotNull(), "Low Risk")


def risk_label(percent: Column) -> Column:
    """Percent with one decimal as text."""
    return F.format_string("%.1f%%", percent.cast("double"))


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def grid_date_text(d: Column) -> Column:
    """Day as the timestamp text the ocean grid uses."""
    return F.date_format(d, "yyyy-MM-dd'T'00:00:00'Z'")
