"""Filters, joins, groups and sorts as compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowql.plans.binder import INT32_MAX, Interval
from sparrowql.sources.catalog import quoted, width_of


def full_range(data_type: T.DataType) -> Interval:
    half = 1 << width_of(data_type) - 1
    return Interval(-half, half - 1)


def within(x: Column, data_type: T.DataType, interval: Interval) -> Column:
    """The interval as comparisons with literals of the column's own type, which reach the scan."""
    whole = full_range(data_type)
    literal = lambda v: F.lit(v).cast(data_type)
    if interval.low == interval.high:
        return x == literal(interval.low)
    out = x.isNotNull()
    if interval.low > whole.low:
        out = out & (x >= literal(interval.low))
    if interval.high < whole.high:
        out = out & (x <= literal(interval.high))
    for hole in sorted(interval.holes):
        if interval.low < hole < interval.high:
            out = out & (x != literal(hole))
    return out


def keep(df: DataFrame, intervals: Mapping[str, tuple[T.DataType, Interval]]) -> DataFrame:
    """Rows whose columns lie in their intervals; a contradiction leaves an empty relation without a scan."""
    if any(i.empty for _, i in intervals.values()):
        return df.where(F.lit(False))
    parts = [within(quoted(name), data_type, interval) for name, (data_type, interval) in intervals.items()]
    return df.where(reduce(and_, parts)) if parts else df


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join; Spark chooses the strategy and splits skewed keys at run time."""
    return left.join(right, quoted(left_key) == quoted(right_key), "inner")


def ordered(keys: Sequence[tuple[Column, bool]]) -> list[Column]:
    """Sort columns with nulls as the least values."""
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c, descending in keys]


def take(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    if limit is not None and limit <= INT32_MAX:
        df = df.limit(limit)
    return df
