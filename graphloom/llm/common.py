"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes, whatever an Arrow batch holds.
SLICE_BYTES = 1 << 20


#: Rows of whole texts in an Arrow batch, of which the JVM and a Python worker hold some at once (Spark's default is 10,000).
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  From now on the session's Arrow batches are of a size for texts, unless the session has its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under the checkpoint folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and all runs in one process
    (``local[...]``, as in tests), a local folder takes its place; elsewhere that is an error, since other
    machines could not see such a folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        set_here = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_here.isDefined():
            root = set_here.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="shared-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: its lineage is cut.

    ``done`` are stored frames that nothing reads from now on: their folders go.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for old in done:
        if at := getattr(old, "_stored_at", None):
            folder = spark._jvm.org.apache.hadoop.fs.Path(at)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def trim() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A table function after which the worker, which waits for its next task, keeps no memory that it doesn't need."""

    @wraps(run)
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


_worker: dict[str, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: the state of one operator at a time.

    A worker lives on from query to query and from stage to stage of a pipeline.  When another key comes,
    the state before it goes, and its memory goes back to the system.
    """
    if _worker.get("key") != key:
        _worker.clear()
        trim()
        _worker.update(key=key, value=make())
    return _worker["value"]


class Remembered(dict):
    """Values that ``make`` has for bytes, up to ``bound`` bytes of memory in each of two generations: what is asked for again moves on."""

    #: What an entry takes besides its bytes, about.
    ENTRY = 170

    def __init__(self, make: Callable[[bytes], bytes], bound: int):
        super().__init__()
        self.make, self.bound, self.size, self.older = make, bound, 0, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.size += len(key) + len(value) + self.ENTRY
        if self.size > self.bound:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder with its partitions as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text (null: empty) and the named columns; other columns don't matter."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that one slice holds about ``budget`` bytes of the column (a longer value stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + budget, "right")))
            yield batch.slice(at, end - at)
            at = end


def workers(spark: SparkSession) -> int:
    """How many tasks a shuffle has, as the session says."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
