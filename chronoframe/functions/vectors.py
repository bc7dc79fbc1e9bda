"""Vectors as array columns: products, norms, similarities, softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), length(a) * length(b))


def normalised(a: Column) -> Column:
    return F.transform(a.cast("array<double>"), lambda v: F.try_divide(v, length(a)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """The mean vector of each key, place by place: summed before the shuffle, never gathered."""
    places = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("place_", "v_"))
    means = places.groupBy(*keys, "place_").agg(F.avg("v_").alias("v_"))
    listed = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place_", "v_"))).alias("l_"))
    return listed.select(*keys, F.transform("l_", lambda s: s.v_).alias(out))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column, part: list[str]) -> Column:
    w = Window.partitionBy(*part)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


#: Classes that are broadcast at once.
CLASS_BLOCK = 10_000


def _blocks(classes: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``classes`` in parts of about ``most`` at most, each small enough to broadcast."""
    n = classes.count()
    parts = -(-n // most) if n > most else 1
    if parts == 1:
        return [classes]
    block = F.pmod(F.xxhash64(key), F.lit(parts))
    return [classes.filter(block == b) for b in range(parts)]


def similarities(queries: DataFrame, classes: DataFrame, key: str, vector: str, class_vector: str, most: int = CLASS_BLOCK) -> DataFrame:
    """Each query with each class (``key``) and their cosine. Classes are a vocabulary; they are broadcast in blocks of about ``most``."""
    pairs = None
    for block in _blocks(classes, key, most):
        part = queries.join(F.broadcast(block)).withColumn("cosine", cosine(F.col(vector), F.col(class_vector)))
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs


def nearest_classes(queries: DataFrame, classes: DataFrame, key: str, vector: str, class_vector: str, k: int, most: int = CLASS_BLOCK) -> DataFrame:
    """``queries`` with ``nearest``: the k classes of the greatest cosine (to nine places; the smaller key on ties), as an array of (cosine, key).

    A row's similarities are taken where it lies, next to one broadcast list of classes, and only the best k go on from
    one block of classes to the next; nothing is shuffled by query.
    """
    kind = classes.schema[key].dataType.simpleString()
    empty = F.array().cast(f"array<struct<minus: double, key: {kind}, cosine: double>>")
    found = queries.withColumn("best_", empty)
    for block in _blocks(classes, key, most):
        listed = block.agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(class_vector).alias("v"))).alias("classes_"))
        told = F.transform("classes_", lambda c: F.struct(cosine(F.col(vector), c.v).alias("s"), c.key.alias("key")))
        near = F.transform(told, lambda c: F.struct((-F.round(c.s, 9)).alias("minus"), c.key.alias("key"), c.s.alias("cosine")))
        found = found.join(F.broadcast(listed)).withColumn("best_", F.slice(F.array_sort(F.concat("best_", near)), 1, k)).drop("classes_")
    return found.withColumn("nearest", F.transform("best_", lambda b: F.struct(b.cosine.alias("cosine"), b.key.alias("key")))).drop("best_")
