"""Reading state as an append-only log: folds give sessions, checkpoints and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("blocked", "in_progress", "queued", "reviewed", "skipped", "todo", "understood")


def checkpoints(log: DataFrame) -> DataFrame:
    """Latest state by (session, target): status of the last event, time of the first."""
    return log.groupBy("session_id", "target_kind", "target_id").agg(
        F.max_by("status", F.struct("at", "seq")).alias("status"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def progress(log: DataFrame) -> DataFrame:
    """Counts of each status by session."""
    return checkpoints(log).groupBy("session_id").agg(F.count("*").alias("n_targets"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])


def after_reimport(log: DataFrame, targets: DataFrame) -> DataFrame:
    """State after a paper came anew: skipped stays, the rest is blocked for review; targets that are gone drop out."""
    kept = checkpoints(log).join(targets, ["target_kind", "target_id"], "left_semi")
    return kept.withColumn("status", F.when(F.col("status") == "skipped", "skipped").otherwise("blocked"))


def queue(items: DataFrame) -> DataFrame:
    """items(queue_id, section, ord, target_kind, target_id) to positions: sections in order, the first place of a target wins."""
    first = items.groupBy("queue_id", "target_kind", "target_id").agg(F.min(F.struct("section", "ord")).alias("p"))
    place = F.row_number().over(Window.partitionBy("queue_id").orderBy("p", "target_kind", "target_id"))
    return first.select("queue_id", "target_kind", "target_id", "p.section", place.alias("position"))
