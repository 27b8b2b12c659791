"""From raw documents to sharded training data, in stages that each read what the one before has written.

Defined results: a null text has no words and goes in the first stage; rows without a doc_id take part in
everything, among copies after all others; an empty table gives an empty
table; columns beyond doc_id, text and source are carried and never read, whatever their names, but for
size, text_crc32, shard and slot, which the last stage sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaweave.llm import decontam, mixing, probminhash, quality_ledger, resharding
from lemmaweave.llm.common import read_table, shared_folder, stored
from lemmaweave.session import reach_workers

POLICY = "v1"
#: Every document that is left appears at least once, none more than twice.
MIX = mixing.Mix(repeats=2.0, budget=None)
LAYOUT = resharding.Layout()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    rows = quality_ledger.with_policy(quality_ledger.ledger(whole, keep=("_row",)), POLICY)
    return rows.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest doc_id."""
    reach_workers(spark)
    return probminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other values in it, go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat by epoch until the sources have their weights; none is lost."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    return mixing.mixed(whole, MIX, keep=("_row",)).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as read back from their shards, with size, text_crc32, slot and shard.  docs: a table in files."""
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return resharding.read_shards(resharding.rewrite(docs, folder, LAYOUT), docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]
#: Stages 2, 4 and 5 have no SQL form; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-{number}-{name}")
    return docs
