"""Files of one JSON record a line, read in byte ranges; bad records go to a quarantine with their place and reason, and end nothing."""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


class Piece(InputPartition):
    """The lines of a file that begin in [start, end)."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__(None)
        self.file, self.start, self.end = file, start, end


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    return pafs.FileSystem.from_uri(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split", 64 << 20))
        if self.size < 1:
            raise ValueError("split must be a positive number of bytes")

    def partitions(self) -> list[Piece]:
        store, at = _store(self.path)
        info = store.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
        names = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
        return [Piece(name, start, min(start + self.size, size)) for name, size in names for start in range(0, size, self.size)] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        with _store(self.path)[0].open_input_file(piece.file) as raw:
            # A line belongs to the range that its first byte lies in, so one that begins before is passed over.
            raw.seek(max(0, piece.start - 1))
            file = io.BufferedReader(raw, 1 << 20)
            at = piece.start if piece.start == 0 else piece.start - 1 + len(file.readline())
            places, lines, held = [], [], 0
            while at < piece.end and (line := file.readline()):
                places.append(at)
                lines.append(line.rstrip(b"\r\n"))
                at, held = at + len(line), held + len(line)
                if len(lines) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield self._batch(piece.file, places, lines)
                    places, lines, held = [], [], 0
            if lines:
                yield self._batch(piece.file, places, lines)

    @staticmethod
    def _batch(file: str, places: list[int], lines: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([file] * len(lines)), pa.array(places, pa.int64()), pa.array(lines, pa.binary())], names=["file", "at", "line"])


class PlacedLines(DataSource):
    """``spark.read.format("placed_lines")``: (file, at, line), each line as bytes with the place of its first byte.

    Options: path (a file, or a folder with all below it but names that begin with a point or an underscore), split (bytes of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return "file string, at long, line binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def placed_lines(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(file, at, line) of all lines below ``path``, in tasks of ``split`` bytes."""
    spark.dataSource.register(PlacedLines)
    return spark.read.format("placed_lines").option("path", path).option("split", split).load()


def routed(lines: DataFrame, line: str, schema: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """``lines`` with ``record`` (a struct of ``schema``) and ``reason``: null for a sound record, else why it is none.

    Lines are bytes or text. Reasons, the first that holds: ``empty`` (null or blank), ``not UTF-8``, ``not JSON``, ``not of the schema`` (a field
    of another type), then those of ``rules``, named conditions on ``record`` for a bad one; a condition that is null counts as bad, so that a missing
    field does. Every line comes out once.
    """
    text = F.try_validate_utf8(F.col(line).cast("string"))
    marked = lines.withColumn("text_", text).withColumn("all_", F.from_json("text_", f"{schema}, bad_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_"}))
    names = [f.name for f in marked.schema["all_"].dataType.fields if f.name != "bad_"]
    marked = marked.withColumn("record", F.struct(*(F.col(f"all_.{n}").alias(n) for n in names)))
    whole = F.try_parse_json(F.col("text_"))
    reason = (
        F.when(F.col(line).isNull() | (F.trim(F.col("text_"), F.lit(" \t\r\n")) == ""), "empty")
        .when(F.col("text_").isNull(), "not UTF-8")
        .when(whole.isNull(), "not JSON")
        .when(F.col("all_").isNull() | F.col("all_.bad_").isNotNull(), "not of the schema")
    )
    for name, bad in (rules or {}).items():
        reason = reason.when(F.coalesce(bad, F.lit(True)), name)
    return marked.withColumn("reason", reason).drop("text_", "all_")


def write_routed(found: DataFrame, path: str) -> None:
    """Writes sound and bad records in one pass over the input; ``sound`` and ``quarantine`` read them."""
    found.withColumn("sound", F.col("reason").isNull()).write.mode("overwrite").parquet(path)


def sound(spark: SparkSession, path: str) -> DataFrame:
    """The fields of the sound records."""
    return spark.read.parquet(path).filter("sound").select("record.*")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Bad records as they were read, with place and reason."""
    return spark.read.parquet(path).filter("not sound").drop("record", "sound")
