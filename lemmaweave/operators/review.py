"""What a reader goes through by hand: proofs behind a result, works to import, the next steps of a paper."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import extract, graph

#: What each status of a triage tells its reader (fixed names, own words).
HEADLINES = {
    "external_blocked": "Some cited works have no identifier; they must be named before they can be imported.",
    "proofs_missing": "Proofs are missing or in fragments; this is a map for review only.",
    "sparse": "Few local dependencies were found; the graph is not complete.",
    "usable": "Some local evidence can be used, within the limits of the extraction.",
    "manual": "The extracted evidence needs a review by hand.",
}
#: Length of a text in a review, and how many texts it names (fixed values).
TEXT, TEXTS = 160, 5


def headline(status: Column) -> Column:
    out = F.lit(HEADLINES["manual"])
    for name, said in HEADLINES.items():
        out = F.when(status == name, said).otherwise(out)
    return out


def theorem_summaries(docs: DataFrame) -> DataFrame:
    """Results without their content; refs in the order of their labels."""
    cols = ["global_id", "paper_id", "local_id", "kind", "normalized_kind", "title", "label", "source_file"]
    return extract.results(docs).select(*cols, F.array_sort(F.coalesce("refs", F.array().cast("array<string>"))).alias("refs"))


def first_proofs(docs: DataFrame) -> DataFrame:
    """paper_id, owner, proof: of several proofs of a result the one whose number is first as text."""
    rows = docs.select("paper_id", F.inline("proofs")).where("owner is not null")
    return rows.groupBy("paper_id", "owner").agg(F.min_by("number", F.col("number").cast("string")).alias("proof"))


def breadth(root: str, adjacency: dict[str, list[str]]) -> list[str]:
    """Nodes reached from a root, nearest first; the root is not among them."""
    seen, out, waiting = {root}, [], deque([root])
    while waiting:
        for node in sorted(adjacency.get(waiting.popleft(), [])):
            if node not in seen:
                seen.add(node)
                out.append(node)
                waiting.append(node)
    return out


def proofs_behind(docs: DataFrame) -> DataFrame:
    """paper_id, root, position, node, proof: the proofs on which a result's own proof rests, nearest first.

    Only the first proof of a result counts; a result without one ends its way and has no row.
    """
    own = first_proofs(docs)
    said = extract.proof_mentions(docs).where("resolution_status = 'resolved_unique'")
    edges = said.join(own, ["paper_id", "owner", "proof"], "left_semi").select("paper_id", F.col("owner").alias("src"), F.col("target").alias("dst")).distinct()

    def per_paper(rows: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict[str, list[str]] = {}
        for a, b in zip(rows["src"], rows["dst"], strict=True):
            adjacency.setdefault(a, []).append(b)
        out = [(rows["paper_id"].iloc[0], r, i, n) for r in adjacency for i, n in enumerate(breadth(r, adjacency))]
        return pd.DataFrame(out, columns=["paper_id", "root", "position", "node"])

    reached = edges.groupBy("paper_id").applyInPandas(per_paper, "paper_id string, root string, position bigint, node string")
    return reached.join(own.withColumnRenamed("owner", "node"), ["paper_id", "node"]).select("paper_id", "root", "position", "node", "proof")


def import_reviews(evidence: DataFrame) -> DataFrame:
    """group_key, local_result_ids, proof_ids, citation_keys, raw_texts, evidence_summary of works to import.

    evidence: group_key, kind, id, source, result_id, proof_id, citation_key, raw_text.  Empty values count as
    none, evidence without a group_key is left out.  Of the different texts, but for those of bibliography
    entries, the first five by kind, id and source are named.
    """
    rows = evidence.where("group_key is not null")
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.array_sort(F.collect_set(given(c)))
    sets = rows.groupBy("group_key").agg(listed("result_id").alias("local_result_ids"), listed("proof_id").alias("proof_ids"), listed("citation_key").alias("citation_keys"))
    texts = rows.where("not coalesce(kind = 'bibliography_entry', false)").select("group_key", F.struct("kind", "id", "source").alias("_at"), scalar.excerpt(given("raw_text"), TEXT).alias("_text")).where("_text is not null")
    texts = texts.groupBy("group_key", "_text").agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("_at", "_text"))
    texts = texts.withColumn("_n", place).where(F.col("_n") <= TEXTS).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("_n", "_text")))["_text"].alias("raw_texts"))
    out = sets.join(texts, "group_key", "left").withColumn("raw_texts", F.coalesce("raw_texts", F.array().cast("array<string>")))
    many = lambda c, word: F.concat(F.size(c).cast("string"), F.lit(f" {word}"), F.when(F.size(c) == 1, "").otherwise("s"))
    tail = lambda c, head, sep: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, sep)))
    # the wording of a review (fixed format)
    said = F.concat(F.lit("Needed by "), many("local_result_ids", "local result"), F.lit(" through "), many("proof_ids", "proof"))
    return out.withColumn("evidence_summary", F.concat_ws("; ", said, tail("citation_keys", "citation keys: ", ", "), tail("raw_texts", "cited result evidence: ", "; ")))


def next_steps(docs: DataFrame) -> DataFrame:
    """paper_id, position, kind, source, target: what to do first in a paper, then the citations to be named.

    First comes the review of a cycle, else a chain to read (target before source), else a review by hand.
    """
    edges = extract.dependency_edges(docs).where("src <> dst")
    cyclic = graph.on_cycles(edges).select("paper_id", F.lit(True).alias("_cyclic")).distinct()
    chain = edges.groupBy("paper_id").agg(F.min(F.struct("src", "ord", "dst")).alias("_c"))
    kind = F.when(F.col("_cyclic"), "review_dependency_cycle").when(F.col("_c").isNotNull(), "read_supported_chain").otherwise("manual_review")
    first = docs.select("paper_id").join(chain, "paper_id", "left").join(cyclic, "paper_id", "left").withColumn("kind", kind)
    shown = F.col("kind") == "read_supported_chain"
    first = first.select("paper_id", F.lit(0).cast("bigint").alias("position"), "kind", F.when(shown, F.col("_c.src")).alias("source"), F.when(shown, F.col("_c.dst")).alias("target"))
    open_keys = extract.citation_records(docs).where("arxiv_id is null").select("paper_id", "key").distinct()
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("key")).cast("bigint")
    blocked = open_keys.select("paper_id", place.alias("position"), F.lit("resolve_external_blocker").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("key").alias("target"))
    return first.unionByName(blocked)
