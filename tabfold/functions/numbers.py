"""Clamping and class probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp_int(value: Column, low: int, high: int, default: int | None) -> Column:
    """Whole number inside the bounds, else the default (not the nearer bound).

    ``value`` is text: digits only, as a decimal in text form is no whole number.
    """
    text = F.trim(value)
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("decimal(38,0)"))
    inside = (number >= F.lit(low)) & (number <= F.lit(high))
    return F.when(inside, number.cast("int")).otherwise(F.lit(default).cast("int"))


def clamp_float(value: Column, low: float, high: float, default: float) -> Column:
    """Number inside the bounds, else the default; NaN is below and above nothing and is kept."""
    number = F.trim(value).try_cast("double")
    outside = ~F.isnan(number) & ((number < F.lit(low)) | (number > F.lit(high)))
    return F.when(number.isNull() | outside, F.lit(default)).otherwise(number)


def none_text(value: Column) -> Column:
    """The words none and null stand for a missing value."""
    return F.when(~F.lower(F.trim(value)).isin("none", "null"), value)


def align_probabilities(probabilities: Column, classes: Column, labels: Column) -> Column:
    """Probabilities in the order of ``labels``: absent classes 0, clipped to [1e-12, 1], sum 1."""
    picked = F.transform(
        labels,
        lambda c: F.when(
            F.array_contains(classes, c), F.get(probabilities, F.array_position(classes, c).cast("int") - 1)
        ).otherwise(0.0),
    )
    clipped = F.transform(picked, lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, p: a + p)
    return F.transform(clipped, lambda p: p / total)


def argmax_label(probabilities: Column, labels: Column) -> Column:
    """Label of the largest probability, the first of equals."""
    place = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.get(labels, place - 1)
