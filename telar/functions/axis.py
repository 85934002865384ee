"""Chart axes: nice steps, marks and linear scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nice_step(span: Column, marks: int = 4) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that parts the span into so many marks at most; 1 for no span."""
    rough = span / F.lit(float(marks))
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    part = F.round(rough / power, 9)
    nice = F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 2.5, 2.5).when(part <= 5, 5.0).otherwise(10.0)
    return F.when(span > 0, nice * power).otherwise(1.0)


def bounds(low: Column, high: Column, from_zero: bool = False) -> tuple[Column, Column]:
    """What an axis has to span. Bars begin at zero; equal bounds are moved apart by five per cent (of one, for zero), those of bars upwards only."""
    low = F.lit(0.0) if from_zero else low
    by = F.when(low == high, F.when(high == 0, 1.0).otherwise(F.abs(high) * 0.05)).otherwise(0.0)
    return low if from_zero else low - by, high + by


def marks(low: Column, high: Column, step: Column, from_zero: bool = False) -> Column:
    """Multiples of the step up to the high bound or just above it: from zero for bars, for lines from a whole step below the low bound's."""
    first = F.lit(0) if from_zero else F.floor(low / step).cast("int") - 1
    return F.transform(F.sequence(first, F.ceil(high / step).cast("int")), lambda i: i * step)


def scaled(v: Column, low: Column, high: Column, from_: float, to: float) -> Column:
    """Linear map of low..high to from_..to; the middle where there is no span."""
    return F.when(high > low, F.lit(from_) + (v - low) / (high - low) * (to - from_)).otherwise((from_ + to) / 2)
