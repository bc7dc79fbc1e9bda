"""Sources and sinks of annotation runs: vocabularies, frame folders, task lists, labels, segments.

All read and write through Spark, so any store that it reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.text import padded_labels, vocabulary_entry
from chronoframe.operators.grids import not_done
from chronoframe.operators.intervals import overlap_join


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a file of ``id:name,synonyms`` lines."""
    return spark.read.text(path).select(vocabulary_entry(F.col("value")).alias("name")).filter("name <> ''")


def predefined_objects(spark: SparkSession, path: str) -> DataFrame:
    """(name, colour) of a file of ``name:colour`` lines; the colour is null where a line has none."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim(parts[0]).alias("name"), F.trim(F.get(parts, 1)).alias("colour"))


def frame_files(spark: SparkSession, path: str, glob: str = "*.jpg", content: bool = True) -> DataFrame:
    """(episode, frame_no, path, length, content) of all frame files below ``path``.

    The episode is the folder above the frames' own; the frame number is the last one in the file's name, so
    that frame 10 comes after frame 9.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    steps = F.split("path", "/")
    number = F.regexp_extract(F.element_at(steps, -1), r"(\d+)\D*$", 1).try_cast("long")
    found = files.select(F.element_at(steps, -3).alias("episode"), number.alias("frame_no"), "path", "length", "content")
    return found if content else found.drop("content")


def strided(df: DataFrame, part: str, order: str, rate: int) -> DataFrame:
    """Every ``rate``-th row of each episode from its first on."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return df.withColumn("place_", place).filter(F.col("place_") % rate == 0).drop("place_")


def first_given(*lists: DataFrame) -> DataFrame:
    """(task): the rows of the first list that is not empty; the literal ``Undefined`` where all are."""
    spark = lists[0].sparkSession
    ranked = spark.createDataFrame([("Undefined", len(lists))], "task string, rank_ int")
    for rank, tasks in enumerate(lists):
        ranked = ranked.unionByName(tasks.select("task").withColumn("rank_", F.lit(rank)))
    best = ranked.agg(F.min("rank_").alias("rank_"))
    return ranked.join(F.broadcast(best), "rank_").select("task")


def with_fields(df: DataFrame, column: str, names: list[str], value: Column | None = None) -> DataFrame:
    """Schema evolution: fields added to a struct column, empty strings unless a value is given."""
    changed = F.col(column)
    for name in names:
        changed = changed.withField(name, F.lit("") if value is None else value)
    return df.withColumn(column, changed)


def paraphrased(predictions: DataFrame, paraphrases: DataFrame, label: str = "label") -> DataFrame:
    """Labels replaced by their paraphrase (label, paraphrase); unknown labels and ``None`` stay. The last paraphrase by text counts."""
    chosen = paraphrases.filter(F.col(label) != "None").groupBy(label).agg(F.max("paraphrase").alias("paraphrase_"))
    joined = predictions.join(chosen, label, "left")
    return joined.withColumn(label, F.coalesce("paraphrase_", label)).select(*predictions.columns)


def segments_of(frames: DataFrame, segments: DataFrame, part: str, order: str) -> DataFrame:
    """Frames with the columns of the segment [start, end) that they lie in, once for each segment."""
    met = overlap_join(frames, segments, [part], (order, order), ("start", "end"))
    return met.filter(F.col(order) < F.col("end")).select(*frames.columns, *(c for c in segments.columns if c != part))


def save_labels(predictions: DataFrame, path: str, part: str, n: int = 3) -> None:
    """One row a segment with exactly ``n`` labels, missing ones empty; a folder for each batch of episodes that can be written again."""
    predictions.withColumn("labels", padded_labels(F.col("labels"), n)).write.mode("overwrite").parquet(path)


def save_segments(frames: DataFrame, segments: DataFrame, part: str, order: str, path: str, folders: int = 64) -> None:
    """The frames of all segments, in ``folders`` folders by a hash of the episode, each in order: their number doesn't grow with the episodes."""
    rows = segments_of(frames, segments, part, order).withColumn("folder", F.pmod(F.xxhash64(part), F.lit(folders)).cast("int"))
    rows.repartition(folders, "folder").sortWithinPartitions("folder", part, "start", order).write.mode("overwrite").partitionBy("folder").parquet(path)


def remaining(todo: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Resume: rows whose keys the output at ``path`` does not have yet; all of them where there is no output."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return todo
    return not_done(todo, spark.read.parquet(path).select(*keys), keys)
