"""Run lengths of masks: the compressed text of the public mask format both ways, and crops put into whole pictures, without any pixels.

Run lengths count zeros, ones, zeros ... down the columns, one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: bits of a character, the bit that says that more follow, and the first character.
BITS, MORE, FIRST = 5, 32, 48
#: Characters that a long can need.
LONGEST = 13


def _told(x: Column) -> Column:
    """A whole number in characters of five bits, the lowest first, as few as hold it with its sign."""
    beyond = [((x < -(1 << BITS * n - 1)) | (x >= (1 << BITS * n - 1))).cast("int") for n in range(1, LONGEST)]
    size = sum(beyond[1:], beyond[0]) + 1
    bits = lambda k: F.call_function("shiftright", x, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: F.char(bits(k - 1) + F.when(k < size, MORE).otherwise(0) + FIRST)), "")


def compressed(counts: Column) -> Column:
    """Text of run lengths: from the fourth on, each is told by how much it differs from the one two before. Null stays null, no runs are an empty text."""
    counts = counts.cast("array<long>")
    return F.array_join(F.transform(counts, lambda n, i: _told(F.when(i > 2, n - F.get(counts, i - 2)).otherwise(n))), "")


def _number(text: Column) -> Column:
    """The whole number of one number's characters."""
    code = lambda k: (F.ascii(F.substring(text, k, F.lit(1))) - FIRST).cast("long")
    low = F.aggregate(
        F.sequence(F.lit(1), F.length(text)), F.lit(0).cast("long"), lambda s, k: s + F.call_function("shiftleft", code(k).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")), (k - 1) * BITS)
    )
    sign = code(F.length(text)).bitwiseAND(F.lit(1 << BITS - 1).cast("long"))
    return F.when(sign != 0, low - F.call_function("shiftleft", F.lit(1).cast("long"), F.length(text) * BITS)).otherwise(low)


def decompressed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, counts): the run lengths of a text for each key; every second difference adds up, in one window. Keys without runs are left out."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit("[P-o]*[0-O]"), F.lit(0)), _number)
    each = df.select(*keys, F.posexplode(numbers).alias("i_", "d_"))
    # The first number stands alone; those after it add up with every second one.
    chain = F.when(F.col("i_") == 0, -1).otherwise(F.col("i_") % 2)
    along = Window.partitionBy(*keys, chain).orderBy("i_").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.withColumn("n_", F.sum("d_").over(along))
    listed = summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i_", "n_"))).alias("l_"))
    return listed.select(*keys, F.transform("l_", lambda r: r.n_).alias("counts"))


def uncropped(df: DataFrame, keys: list[str], counts: str, crop: tuple[Column, Column, Column, Column], width: Column, height: Column) -> DataFrame:
    """(keys, counts): the run lengths of a crop (x0, y0, x1, y1) in the whole picture, zeros around it.

    Each run of ones is cut at its columns' ends, and pieces that touch in the whole are put together again; there are no more of them than runs and columns.
    A key is one mask; a crop without ones is one run of zeros.
    """
    x0, y0, _, y1 = crop
    base = df.select(*keys, F.col(counts).alias("counts_"), x0.alias("x_"), y0.alias("y_"), (y1 - y0).alias("h_"), height.alias("tall_"), (width * height).cast("long").alias("all_"))
    along = Window.partitionBy(*keys).orderBy("i_")
    runs = base.select(*keys, "x_", "y_", "h_", "tall_", F.posexplode("counts_").alias("i_", "n_"))
    runs = runs.withColumn("to_", F.sum("n_").over(along)).filter((F.col("i_") % 2 == 1) & (F.col("n_") > 0)).withColumn("from_", F.col("to_") - F.col("n_"))
    column = F.explode(F.sequence(F.floor(F.col("from_") / F.col("h_")), F.floor((F.col("to_") - 1) / F.col("h_"))))
    pieces = runs.withColumn("c_", column)
    top, low = F.greatest("from_", F.col("c_") * F.col("h_")), F.least("to_", (F.col("c_") + 1) * F.col("h_"))
    start = (F.col("x_") + F.col("c_")) * F.col("tall_") + F.col("y_") + top - F.col("c_") * F.col("h_")
    pieces = pieces.select(*keys, start.alias("s_"), (start + low - top).alias("e_"))
    ahead = Window.partitionBy(*keys).orderBy("s_")
    apart = (F.col("s_") != F.lag("e_").over(ahead)) | F.lag("e_").over(ahead).isNull()
    pieces = pieces.withColumn("new_", apart.cast("int")).withColumn("p_", F.sum("new_").over(ahead)).groupBy(*keys, "p_").agg(F.min("s_").alias("s_"), F.max("e_").alias("e_"))
    gaps = pieces.withColumn("gap_", F.col("s_") - F.coalesce(F.lag("e_").over(ahead), F.lit(0)))
    listed = gaps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s_", "gap_", (F.col("e_") - F.col("s_")).alias("n_")))).alias("l_"), F.max("e_").alias("end_"))
    whole = base.select(*keys, "all_").join(listed, keys, "left")
    inner = F.flatten(F.transform("l_", lambda r: F.array(r.gap_, r.n_)))
    rest = F.when(F.col("end_") < F.col("all_"), F.array(F.col("all_") - F.col("end_"))).otherwise(F.array().cast("array<long>"))
    return whole.select(*keys, F.when(F.col("l_").isNull(), F.array("all_")).otherwise(F.concat(inner.cast("array<long>"), rest)).alias("counts"))
