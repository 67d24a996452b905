"""Batch manifest and its event log, from an append-only table of attempted transitions; and records of ingestion runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: From pending to one of these; nothing leads on from them.
FINAL = ("committed", "failed", "dry_run")


class ManifestStateError(ValueError):
    """A transition that the batch's status does not allow, a batch that is recorded twice, or a run that is unknown."""


def refused(old: DataFrame, new: DataFrame) -> DataFrame:
    """batch_id and n of new batches whose id is there already, or comes n times in new."""
    ids = new.groupBy("batch_id").agg(F.count("*").alias("n"))
    there = old.select("batch_id").distinct().withColumn("_there", F.lit(True))
    return ids.join(there, "batch_id", "left").filter("n > 1 OR _there").select("batch_id", "n")


def recorded(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new batches; an id that is there already, or twice in new, is an error."""
    bad = refused(old, new).limit(1).collect()
    if bad:
        raise ManifestStateError(f"batch {bad[0]['batch_id']} is recorded already")
    return old.unionByName(new)


def attempts(events: DataFrame) -> DataFrame:
    """events(batch_id, to_status, event_id, at) with each one's turn in its batch, and whether it is valid.

    The first event of a batch creates it (pending).  The first later one to a final status is valid; all
    others are not.  One window on the batch decides.
    """
    own = Window.partitionBy("batch_id").orderBy("at", "event_id")
    rows = events.withColumn("turn", F.row_number().over(own))
    final = (F.col("turn") > 1) & F.col("to_status").isin(*FINAL)
    rows = rows.withColumn("finals", F.sum(final.cast("int")).over(own))
    return rows.withColumn("valid", (F.col("turn") == 1) | (final & (F.col("finals") == 1)))


def state(events: DataFrame) -> DataFrame:
    """Each batch's status, and when it was committed."""
    rows = attempts(events).filter("valid")
    last = F.max_by(F.when(F.col("turn") == 1, "pending").otherwise(F.col("to_status")), "turn")
    return rows.groupBy("batch_id").agg(last.alias("status"), F.max(F.when((F.col("turn") > 1) & (F.col("to_status") == "committed"), F.col("at"))).alias("committed_at"))


def invalid(events: DataFrame) -> DataFrame:
    return attempts(events).filter("NOT valid")


def log(events: DataFrame) -> DataFrame:
    """The valid events with the status that each led from."""
    return attempts(events).filter("valid").select("event_id", "batch_id", F.when(F.col("turn") > 1, "pending").alias("from_status"), F.when(F.col("turn") == 1, "pending").otherwise(F.col("to_status")).alias("to_status"))


def batch(batches: DataFrame, batch_id: str) -> DataFrame:
    """The batch of this id: one row, or none."""
    return batches.filter(F.col("batch_id") == batch_id)


def batches_for_run(batches: DataFrame, run: str, status: str = "", limit: int = 0) -> DataFrame:
    rows = batches.filter(F.col("run") == run)
    rows = rows.filter(F.col("status") == status) if status else rows
    rows = rows.orderBy("created_at", "batch_id")
    return rows.limit(limit) if limit > 0 else rows


def recorded_ingestions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ingestion runs, a row for each run: new rows replace old ones of their run whole; of new rows of one run the one that started last stays."""
    columns = [c for c in old.columns if c != "run"]
    rows = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return rows.groupBy("run").agg(F.max_by(F.struct(*columns), F.struct("_turn", "started_at")).alias("_row")).select("run", "_row.*").select(*old.columns)


def finished_ingestions(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs(run, started_at, finished_at, ...) with the time of ends(run, finished_at); an unknown run is an error."""
    unknown = ends.join(runs.select("run"), "run", "left_anti").limit(1).collect()
    if unknown:
        raise ManifestStateError(f"run {unknown[0]['run']} is unknown")
    last = ends.groupBy("run").agg(F.max("finished_at").alias("_end"))
    return runs.join(last, "run", "left").withColumn("finished_at", F.coalesce("_end", "finished_at")).select(*runs.columns)


def ingestion(runs: DataFrame, run: str) -> DataFrame:
    """The ingestion record of a run: one row, or none."""
    return runs.filter(F.col("run") == run)
