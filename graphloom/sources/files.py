"""Source files as rows: path, language, text."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values.
SKIPPED = ("node_modules", ".git", "dist", "build", ".turbo", ".next", "coverage", ".venv", "__pycache__")


_ENDINGS = tuple(f".{e}" for endings in S.LANGUAGES.values() for e in endings)


def _listed(spark: SparkSession, root: str) -> tuple[str, list[str], list[str]]:
    """The root's full name, the source files that Spark reads, and those that its readers pass over (``_`` names)."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        raise FileNotFoundError(root)
    top = fs.makeQualified(top)
    local = top.toUri().getScheme() == "file"  # whose listing follows links
    ordinary, hidden, open_ = [], [], [top]
    while open_:
        try:
            entries = fs.listStatus(open_.pop())
        except Py4JJavaError:  # a folder that can't be read has no files
            continue
        for entry in entries:
            name = entry.getPath().getName()
            link = os.path.islink(entry.getPath().toUri().getPath()) if local else entry.isSymlink()
            if name.startswith(".") or name in SKIPPED or link:
                continue
            if entry.isDirectory():
                open_.append(entry.getPath())
            elif name.lower().endswith(_ENDINGS):
                (hidden if name.startswith("_") else ordinary).append(entry.getPath().toString())
    return top.toString(), ordinary, hidden


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            scheme, _, rest = path.partition(":")
            store, name = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
            with store.open_input_stream(name) as file:
                yield pa.record_batch({"path": pa.array([path]), "content": pa.array([file.read()], pa.binary())})


def walked(spark: SparkSession, root: str) -> DataFrame:
    """Files of known languages below root, with ``/`` paths relative to it; hidden entries, links and the skipped folders are left out.

    Folders are listed once, on the driver; the files are read by the executors, whole, as UTF-8 (bytes that
    aren't become U+FFFD).  Spark's readers pass over names that start with ``_``, so those files are opened by
    name.  A missing root is an error.
    """
    top, ordinary, hidden = _listed(spark, root)
    rows = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(max(1, min(len(hidden) // 64, 1024))).mapInArrow(_opened, "path string, content binary")
    if ordinary:  # names are names, not patterns or partitions
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", False)
        rows = rows.union(reader.load(ordinary).select("path", "content"))
    rows = rows.select(F.substring("path", F.lit(len(top.rstrip("/")) + 2), F.length("path")).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.withColumn("language", S.language_of("path")).filter("language IS NOT NULL").select("path", "language", "text")


def read_ranges(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """ranges(path, start, end) with the lines' text; a missing file has empty text."""
    return ranges.join(files.select("path", F.col("text").alias("_text")), "path", "left").withColumn("text", S.line_range("_text", "start", "end")).drop("_text")


def mock_ranges(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("text", F.format_string("<mock source: %s:%d-%d>", "path", "start", "end"))
