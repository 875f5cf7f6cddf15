"""The six aggregates, with exact integer sums, as built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowql.sources.catalog import kind_of, width_of

OVERFLOW = "integer overflow in sum()"


def exact_sum(x: Column, data_type: T.DataType) -> Column:
    """The sum of an integer column as decimal(38, 0); null without rows.

    The numbers are cut into limbs of 16 or 21 bits, which are summed as longs:
    that stays in primitive arithmetic and is exact up to 2**42 rows.
    """
    limb, count = (16, 2) if width_of(data_type) <= 32 else (21, 3)
    x = x.cast("long")
    total = None
    for k in range(count):
        part = F.shiftright(x, limb * k)
        if k < count - 1:
            part = part.bitwiseAND((1 << limb) - 1)
        # a limb's sum has 63 bits and its weight 42 at most: 105 bits fit 38 digits
        scaled = F.sum(part).cast("decimal(20,0)") * F.lit(1 << limb * k).cast("decimal(14,0)")
        total = scaled if total is None else total + scaled
    return total.cast("decimal(38,0)")  # type: ignore[union-attr]


def aggregate(func: str, x: Column | None, data_type: T.DataType | None) -> Column:
    """``func`` of a column of this type; ``count`` of no column counts rows."""
    if x is None or data_type is None:
        return F.count(F.lit(1))
    integer = kind_of(data_type) == "int"
    if func == "count":
        return F.count(x)
    if func in ("min", "max"):
        return F.min(x) if func == "min" else F.max(x)
    if func == "avg":
        return exact_sum(x, data_type).cast("double") / F.count(x) if integer else F.avg(x)
    if func == "total":
        return F.coalesce((exact_sum(x, data_type) if integer else F.sum(x)).cast("double"), F.lit(0.0))
    if not integer:
        return F.sum(x).cast("double")
    total = exact_sum(x, data_type)
    fits = total.isNull() | total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return F.when(fits, total.cast("long")).otherwise(F.raise_error(F.lit(OVERFLOW)).cast("long"))
