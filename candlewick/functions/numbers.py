"""Rounding and small numeric helpers."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half-even decimal rounding."""
    return F.bround(x, digits)


def rounded_array(x: np.ndarray, digits: int) -> np.ndarray:
    """``rounded`` of the doubles of an array, for use in tasks; NaN and infinities stay.

    Half-even rounding of the shortest decimal that tells a double: whatever lies near a half, or is too large
    to be scaled safely, goes through decimals; the rest cannot fall on the other side.
    """
    power = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = x * power
        size = np.abs(scaled)
        near = np.abs(size - np.floor(size) - 0.5) <= 1e-6 + 4 * np.spacing(size)
        out = np.where(np.isfinite(x), np.rint(scaled) / power + 0.0, x)  # no negative zero
        unsafe = np.flatnonzero(np.isfinite(x) & (near | ~(size < 2.0**50)))
    context, unit = Context(prec=800), Decimal(1).scaleb(-digits)
    out[unsafe] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_EVEN, context)) + 0.0 for v in x[unsafe].tolist()]
    return out


def whole_even(x: Column) -> Column:
    """Half-even rounding to a whole number, kept as double."""
    return F.rint(x)


def is_true(flag: Column) -> Column:
    """A predicate whose null counts as false."""
    return F.coalesce(flag, F.lit(False))


def count_true(*flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [is_true(f).cast("int") for f in flags])


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, whose filters stay above the step that computes it.

    Pushing a filter down copies the whole expression into it; for long chains of
    derived columns the copies multiply. The value comes out of a generator of one row,
    which filters on other columns pass and those on the value do not.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
