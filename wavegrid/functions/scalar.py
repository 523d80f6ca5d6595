"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are clipped to this distance from 0 before the sigmoid scales them.
CLIP = 15.0


def flat_sigmoid(x: Column, sensitivity: float = 1.0) -> Column:
    """1 / (1 + exp(-sensitivity * clip(x))), as a double; NaN stays NaN."""
    x = x.cast("double")
    clipped = F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(sensitivity)) * clipped))


def logit(x: Column) -> Column:
    """ln(x / (1 - x)): -inf at 0, inf at 1, NaN outside [0, 1]."""
    x = x.cast("double")
    inside = F.ln(x / F.when(x != 1, F.lit(1.0) - x))
    return F.when(F.isnan(x) | (x < 0) | (x > 1), F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).when(x == 1, F.lit(float("inf"))).otherwise(inside)


def frame_at(seconds: Column, rate: Column | int) -> Column:
    """Nearest frame, halves to the even one."""
    return F.rint(seconds * rate).cast("long")


def resampled_length(n: Column, rate: Column | float, target: float) -> Column:
    """Samples after resampling, halves to the even number."""
    return F.rint(n / rate * target).cast("long")


def passes(score: Column, least: float) -> Column:
    """score >= least, compared as doubles; false for NaN."""
    wide = score.cast("double")
    return ~F.isnan(wide) & (wide >= F.lit(float(least)))


def padded(samples: Column, size: int) -> Column:
    """``samples`` with zeros up to ``size``; a longer array is an error."""
    missing = F.lit(size) - F.size(samples)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), missing)
    return F.when(missing >= 0, F.concat(samples, zeros)).otherwise(F.raise_error(F.lit("a chunk is longer than the model's")))


def band_action(fmin: Column, fmax: Column, low: Column | float, high: Column | float) -> Column:
    """Which filter a pass band asks for within the model's band: highpass,
    lowpass, bandpass or none."""
    return F.when((fmin > low) & (fmax == high), "highpass").when((fmin == low) & (fmax < high), "lowpass").when((fmin > low) & (fmax < high), "bandpass").otherwise("none")


def week_or_none(week: Column) -> Column:
    """The scorer's code for a week: -1 if there is none."""
    return F.coalesce(week.cast("int"), F.lit(-1))


def week48(date: Column) -> Column:
    """Week of a 48-week year: four to a month."""
    return ((F.month(date) - 1) * 4 + F.least(F.lit(4), F.floor((F.dayofmonth(date) - 1) / F.lit(7.0)).cast("int") + 1)).cast("int")
