"""Operators that sample, densify, chunk and stack series of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def linspace_sample(df: DataFrame, part: str, order: str, n: int) -> DataFrame:
    """At most n rows of each part, evenly spaced from the first to the last (orders from 0 without gaps)."""
    last = F.max(order).over(Window.partitionBy(part))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("last_") / float(n - 1)).cast("int"))
    return df.withColumn("last_", last).filter(F.array_contains(wanted, F.col(order))).drop("last_")


def scheduled(order: Column, every: int, take: int) -> Column:
    """The first ``take`` of every ``every`` frames."""
    return F.pmod(order, F.lit(every)) < take


def batch_of(order: Column, size: int) -> Column:
    return F.floor(order / F.lit(size)).cast("int")


def dense(df: DataFrame, part: str, order: str, object_: str, values: list[str]) -> DataFrame:
    """A row for each frame and each object of its part; values are null and ``seen`` false where the frame shows another object.

    The distinct objects of a part are a small set, so they are gathered and exploded next to the
    frames: one shuffle, no cross join.
    """
    objects = F.collect_set(object_).over(Window.partitionBy(part))
    shown = df.select(part, order, object_, *values).withColumn("objects_", objects)
    grid = shown.select(part, order, F.col(object_).alias("shown_"), *values, F.explode("objects_").alias(object_))
    seen = F.col("shown_") == F.col(object_)
    return grid.select(part, object_, order, *(F.when(seen, F.col(v)).alias(v) for v in values), seen.alias("seen"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those done already."""
    return todo.join(done, keys, "left_anti")


def chunks(df: DataFrame, part: str, order: str, most: int, size: int) -> DataFrame:
    """Parts with more than ``most`` rows in chunks of ``size``, orders counted from each chunk's start."""
    n = F.count("*").over(Window.partitionBy(part))
    chunk = F.when(n > most, F.floor(F.col(order) / F.lit(size))).otherwise(F.lit(0)).cast("int")
    cut = df.withColumn("chunk", chunk)
    return cut.withColumn("frame_in_chunk", (F.col(order) - F.min(order).over(Window.partitionBy(part, "chunk"))).cast("int"))


def stacked(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row for each key with an array of each value, in order."""
    steps = F.sort_array(F.collect_list(F.struct(order, *values)))
    grouped = df.groupBy(*keys).agg(steps.alias("steps_"))
    return grouped.select(*keys, *(F.col(f"steps_.{v}").alias(v) for v in values))


def moved_to_samples(df: DataFrame, order: str, first: int, last: int, every: int, out: str) -> DataFrame:
    """Rows from ``first`` to ``last`` with the sampled place, a multiple of ``every``, that is next."""
    inside = df.filter(F.col(order).between(first, last))
    return inside.withColumn(out, (F.ceil(F.col(order) / F.lit(float(every))) * every).cast("int"))


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two aligned arrays, without those that lack a side."""
    return F.filter(F.arrays_zip(a.alias("0"), b.alias("1")), lambda p: p["0"].isNotNull() & p["1"].isNotNull())


def shard_of(row: Column, rows: int, workers: int) -> Column:
    """The worker of a row (counted from 0) when rows are dealt in stretches of equal length."""
    return F.floor(row / F.lit(max(1, -(-rows // workers)))).cast("int")


def shard_bounds(spark: SparkSession, rows: int, workers: int, offset: int = 0) -> DataFrame:
    """(worker, start, end): each worker's stretch, moved by ``offset``."""
    each = -(-rows // workers)
    return spark.createDataFrame([(w, w * each + offset, min((w + 1) * each, rows) + offset) for w in range(workers)], "worker int, start long, end long")


def flat_columns(df: DataFrame, separator: str = ".") -> list[Column]:
    """All leaves of nested structs, named by their path."""
    from pyspark.sql import types as T

    def walk(schema: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return walk(df.schema, [])
