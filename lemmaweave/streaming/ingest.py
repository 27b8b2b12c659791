"""Structured Streaming: projects as they arrive, and a running fold of the checkpoint log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract
from ..sources.snapshots import Snapshots
from ..sources.store import latest


def ingest(projects: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extract each arriving project and replace its papers in documents, results and citations, in one commit a batch.

    The tables are read through Snapshots(spark, out).  A run that fails in between has committed nothing; a batch that
    is replayed after its commit is known by its label and changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = extract.documents(latest(batch)).persist()
        tables = {"documents": docs, "results": extract.results(docs), "citations": extract.citation_records(docs)}
        Snapshots(docs.sparkSession, out).commit(tables, docs, label=f"{checkpoint}#{number}")
        docs.unpersist()

    return projects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and kind; rows later than the watermark are dropped by the engine."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
