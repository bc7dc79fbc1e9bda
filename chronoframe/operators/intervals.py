"""Interval-overlap joins by buckets whose width follows the intervals' lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[str, str]


def _bucket(value: Column, level: Column, width: int, whole: bool) -> Column:
    """Number of the bucket: ``width`` wide on level 0, its cube on level 1."""
    wide = F.when(level == 0, F.lit(width)).otherwise(F.lit(width**3))
    if whole:
        return F.floor((value.cast("long") - F.pmod(value.cast("long"), wide)) / wide).cast("long")
    return F.floor(value.cast("double") / wide).cast("long")


def _dealt(rows: DataFrame, span: Span, width: int, whole: bool) -> DataFrame:
    """Each sound row in the buckets that it touches, on its own level and on the longer one."""
    start, end = F.col(span[0]), F.col(span[1])
    length = end.cast("double") - start.cast("double")
    rows = rows.filter(start <= end).withColumn("own_", (length > float(width) ** 2).cast("int"))
    on = rows.withColumn("level_", F.explode(F.sequence(F.col("own_"), F.lit(1))))
    first, last = (_bucket(c, F.col("level_"), width, whole) for c in (start, end))
    return on.withColumn("bucket_", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], own: Span, other: Span, width: int = 256) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys whose closed intervals have a point in common; each pair once.

    ``own`` and ``other`` name the interval's two columns on either side; a column named twice is a point. Intervals up to ``width`` squared
    long lie in buckets of ``width``, longer ones on a level of their own in buckets of its cube, where the short ones
    are too. A pair meets on the level of its longer interval, in the bucket that holds the later start. So rows with
    the same keys are dealt out over time, and rows far apart never meet. ``width`` should be some times a usual
    interval's length; it bears on the cost alone. Intervals with a null end or a null key, and those that end before they
    start, meet nothing. Columns but the keys must have different names.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df, span in ((left, own), (right, other)) for c in span)
    a = _dealt(left, own, width, whole)
    b = _dealt(right, other, width, whole).withColumnRenamed("own_", "r_own_")
    pairs = a.join(b, [*keys, "level_", "bucket_"])
    met = (F.col(own[0]) <= F.col(other[1])) & (F.col(other[0]) <= F.col(own[1])) & (F.col("level_") == F.greatest("own_", "r_own_"))
    start = _bucket(F.greatest(F.col(own[0]), F.col(other[0])), F.col("level_"), width, whole)
    return pairs.filter(met & (F.col("bucket_") == start)).drop("own_", "r_own_", "level_", "bucket_")
