"""A store of tables below one root: every commit is one new file of the log, which names the folders that are valid.

    root/log/00000000000000000003.json   {"tables": {"nodes": {"7": "nodes/<id>/part=7", ...}, ...}, "identity": {...}, "batches": 3}
    root/nodes/<id>/part=7/...           rows whose key falls into part 7

A commit writes its folders first and the log file last, so readers see all of it or nothing, and a commit
that dies leaves only folders that no log names.  Only the parts of a table that a batch touches are
written again.  Two commits at once: the second one's log file exists already, and it fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of each table; a batch rewrites those that its keys fall into.
PARTS = 32
KEYS = {"nodes": ["id"], "edges": ["src"], "vectors": ["node_id"]}


class StoreConflictError(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self) -> list[str]:
        folder = self._path(f"{self.root}/log")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def current(self) -> dict:
        """What the last commit says."""
        names = self._log()
        if not names:
            return {"tables": {}, "identity": None, "batches": 0}
        stream = self._fs.open(self._path(f"{self.root}/log/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, before: dict, after: dict) -> None:
        """The new state, if the one that it was made from is still the last."""
        names = self._log()
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        if before != self.current():
            raise StoreConflictError(f"{self.root} has changed")
        at = self._path(f"{self.root}/log/{number:020d}.json")
        staged = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(staged, at):
            self._fs.delete(staged, False)
            raise StoreConflictError(f"{at} is there already")

    def read(self, name: str, parts: set[int] | None = None) -> DataFrame | None:
        """The table as the last commit has it (or some parts of it); None if there is none."""
        folders = self.current()["tables"].get(name, {})
        wanted = [f"{self.root}/{x}" for k, x in folders.items() if parts is None or int(k) in parts]
        return self.spark.read.parquet(*wanted) if wanted else None

    def merged(self, state: dict, name: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """Writes the parts of the table that the new rows touch, merged with the rows there, and returns the state that names them.

        ``new`` is read several times, so it should be stored already.
        """
        part = lambda rows: F.pmod(F.xxhash64(*KEYS[name]), F.lit(PARTS)).cast("int")
        touched = {r[0] for r in new.select(part(new)).distinct().collect()}
        if not touched:
            return state
        folders = dict(state["tables"].get(name, {}))
        paths = [f"{self.root}/{folders[str(k)]}" for k in touched if str(k) in folders]
        old = self.spark.read.parquet(*paths) if paths else new.limit(0)
        out = f"{name}/{uuid.uuid4().hex}"
        rows = merge(old, new)
        rows.withColumn("part", part(rows)).repartition("part").write.partitionBy("part").parquet(f"{self.root}/{out}")
        folders |= {str(k): f"{out}/part={k}" for k in touched}
        return state | {"tables": state["tables"] | {name: folders}}

    def drop(self, folder: str) -> None:
        """A folder that nothing reads any more."""
        self._fs.delete(self._path(folder), True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows of a table that only grows."""
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def appended(self, name: str, schema: str) -> DataFrame:
        here = f"{self.root}/{name}"
        there = self._fs.exists(self._path(here))
        return self.spark.read.schema(schema).parquet(here) if there else self.spark.createDataFrame([], schema)
