"""Projects that arrive as files are extracted once; a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmaweave.sources.snapshots import Snapshots
from lemmaweave.streaming import ingest

SCHEMA = "paper_id string, main string, files map<string,string>"


def test_ingest(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    text = "\\begin{lemma}\\label{l}x\\end{lemma}\\cite{k}"
    arrive = lambda i, t: spark.createDataFrame([(f"local:{i}", "m.tex", {"m.tex": t})], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arrive(1, text)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.ingest(stream, out, str(tmp_path / "state")).awaitTermination(120)
    arrive(2, text + text.replace("{l}", "{m}"))
    ingest.ingest(spark.readStream.schema(SCHEMA).parquet(source), out, str(tmp_path / "state")).awaitTermination(120)
    tables = Snapshots(spark, out)
    rows = tables.read("results", "paper_id string, local_id string").groupBy("paper_id").agg(F.count("*").alias("n")).collect()
    assert {r.paper_id: r.n for r in rows} == {"local:1": 1, "local:2": 2}
    assert tables.read("citations", "paper_id string").count() == 3 and tables.version() == 2


def test_activity(spark):
    log = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0), ("2024-01-02 00:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.value) for r in ingest.activity(log).collect()) == [(1, 4.0), (2, 3.0)]
