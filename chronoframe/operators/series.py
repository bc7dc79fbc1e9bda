"""Operators on ordered series: islands, fills, runs, smoothing, nearest known values.

All take the window that partitions and orders the series. Every step is a window over
the series' own partition, so one shuffle by the partition key serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BEFORE, AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def upto(series: WindowSpec) -> WindowSpec:
    return series.rowsBetween(BEFORE, 0)


def earlier(series: WindowSpec) -> WindowSpec:
    return series.rowsBetween(BEFORE, -1)


def onward(series: WindowSpec) -> WindowSpec:
    return series.rowsBetween(0, AFTER)


def last_known(value: Column, series: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(upto(series))


def next_known(value: Column, series: WindowSpec) -> Column:
    return F.first(value, ignorenulls=True).over(onward(series))


def with_islands(df: DataFrame, value: Column, series: WindowSpec, name: str = "island") -> DataFrame:
    """Adds the number of the run of equal values that a row is in (null equals null)."""
    changed = F.when(value.eqNullSafe(F.lag(value).over(series)) & (F.row_number().over(series) > 1), 0).otherwise(1)
    return df.withColumn("changed_", changed).withColumn(name, F.sum("changed_").over(upto(series))).drop("changed_")


def run_lengths(df: DataFrame, keys: list[str], value: str, order: str, series: WindowSpec) -> DataFrame:
    """(keys, island, value, start, end, length) of every run."""
    return (
        with_islands(df, F.col(value), series)
        .groupBy(*keys, "island", value)
        .agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))
    )


def fill_false_runs(df: DataFrame, flag: str, n: int, keys: list[str], series: WindowSpec, out: str) -> DataFrame:
    """False runs shorter than n become true where a true comes before them."""
    run = Window.partitionBy(*keys, "island_")
    marked = with_islands(df, F.col(flag), series, "island_")
    marked = marked.withColumn("length_", F.count("*").over(run)).withColumn("led_", F.coalesce(F.max(F.col(flag).cast("int")).over(upto(series)), F.lit(0)))
    filled = F.col(flag) | ((F.col("length_") < n) & (F.col("led_") == 1))
    return marked.withColumn(out, F.coalesce(filled, F.lit(False))).drop("island_", "length_", "led_")


def keep_true_runs(df: DataFrame, flag: str, n: int, keys: list[str], series: WindowSpec, out: str) -> DataFrame:
    """True runs shorter than n become false."""
    run = Window.partitionBy(*keys, "island_")
    marked = with_islands(df, F.col(flag), series, "island_").withColumn("length_", F.count("*").over(run))
    return marked.withColumn(out, F.coalesce(F.col(flag) & (F.col("length_") >= n), F.lit(False))).drop("island_", "length_")


def smooth_labels(df: DataFrame, label: str, tolerance: int, least: int, keys: list[str], order: str, out: str) -> DataFrame:
    """Runs of at most ``tolerance`` rows between two runs of one label take that label; then runs shorter
    than ``least``, but the first and the last, take the label of what stands before them."""
    series = Window.partitionBy(*keys).orderBy(order)
    marked = with_islands(df, F.col(label), series, "island_")
    runs = marked.groupBy(*keys, "island_").agg(F.first(label).alias("label_"), F.count("*").alias("n_"))
    by_run = Window.partitionBy(*keys).orderBy("island_")
    around = F.lag("label_").over(by_run).eqNullSafe(F.lead("label_").over(by_run)) & F.lead("island_").over(by_run).isNotNull() & F.lag("island_").over(by_run).isNotNull()
    runs = runs.withColumn("filled_", F.when((F.col("n_") <= tolerance) & around, F.lag("label_").over(by_run)).otherwise(F.col("label_")))
    # Neighbouring runs of one label are one run now.
    runs = with_islands(runs, F.col("filled_"), by_run, "joined_")
    group, all_runs = Window.partitionBy(*keys, "joined_"), Window.partitionBy(*keys)
    runs = runs.withColumn("length_", F.sum("n_").over(group)).withColumn("final_", F.max("joined_").over(all_runs))
    firm = (F.col("length_") >= least) | (F.col("joined_") == 1) | (F.col("joined_") == F.col("final_"))
    runs = runs.withColumn("firm_", F.when(firm, F.col("filled_"))).withColumn("kept_", last_known(F.col("firm_"), by_run))
    chosen = runs.select(*keys, "island_", F.col("kept_").alias(out))
    return marked.join(chosen, [*keys, "island_"]).drop("island_")


def interpolated(df: DataFrame, value: str, order: str, series: WindowSpec, limit: int, out: str) -> DataFrame:
    """Linear between known rows for the first ``limit`` rows of a gap; a gap at the end repeats the last value that far; one at the start stays null."""
    known = F.col(value).isNotNull()
    df = df.withColumn("b_at_", last_known(F.when(known, F.col(order)), series)).withColumn("b_", last_known(F.col(value), series))
    df = df.withColumn("a_at_", next_known(F.when(known, F.col(order)), series)).withColumn("a_", next_known(F.col(value), series))
    step = F.col(order) - F.col("b_at_")
    between = F.when(F.col("a_at_").isNull(), F.col("b_")).otherwise(F.col("b_") + (F.col("a_") - F.col("b_")) * step / (F.col("a_at_") - F.col("b_at_")))
    return df.withColumn(out, F.when(known, F.col(value)).when(step <= limit, between)).drop("b_at_", "b_", "a_at_", "a_")


def rolling_mean(value: Column, series: WindowSpec, before: int, after: int) -> Column:
    return F.avg(value).over(series.rowsBetween(-before, after))


def zscore(value: Column, part: WindowSpec) -> Column:
    """Null where the spread is zero."""
    return F.try_divide(value - F.avg(value).over(part), F.stddev_pop(value).over(part))


def minmax(value: Column, part: WindowSpec) -> Column:
    """0 to 1 over the partition; null where all values are equal."""
    return F.try_divide(value - F.min(value).over(part), F.max(value).over(part) - F.min(value).over(part))


def nearest_known(df: DataFrame, value: str, order: str, series: WindowSpec, out: str, reach: int | None = None) -> DataFrame:
    """The known value nearest in order, the earlier one on ties, null beyond ``reach``."""
    known = F.col(value).isNotNull()
    df = df.withColumn("b_at_", last_known(F.when(known, F.col(order)), series)).withColumn("b_", last_known(F.col(value), series))
    df = df.withColumn("a_at_", next_known(F.when(known, F.col(order)), series)).withColumn("a_", next_known(F.col(value), series))
    back, ahead = F.col(order) - F.col("b_at_"), F.col("a_at_") - F.col(order)
    choice = F.when(ahead.isNull() | (back <= ahead), F.col("b_")).otherwise(F.col("a_"))
    if reach is not None:
        choice = F.when(F.least(back, ahead) <= reach, choice)
    return df.withColumn(out, choice).drop("b_at_", "b_", "a_at_", "a_")


def spaced(df: DataFrame, part: str, order: str, gap: int) -> DataFrame:
    """(part, order): the first row of each part, and every row more than ``gap`` after the last one kept.

    Rows more than ``gap`` after their own predecessor are always kept, so a part falls into chains
    that are folded one by one.
    """
    w = Window.partitionBy(part).orderBy(order)
    cut = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    chains = df.select(part, F.col(order).cast("long").alias(order)).withColumn("cut_", cut).withColumn("chain_", F.sum("cut_").over(upto(w)))
    listed = chains.groupBy(part, "chain_").agg(F.sort_array(F.collect_list(order)).alias("all_"))
    none = F.expr("cast(array() as array<bigint>)")
    kept = F.aggregate("all_", none, lambda k, x: F.when((F.size(k) == 0) | (x - F.try_element_at(k, F.lit(-1)) > gap), F.concat(k, F.array(x))).otherwise(k))
    return listed.select(part, F.explode(kept).alias("kept_")).select(part, F.col("kept_").cast("int").alias(order))
