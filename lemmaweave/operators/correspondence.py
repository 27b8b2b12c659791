"""Proof entry through correspondences that an author declares, like ``Theorem 1 (= Theorem 4)``.

A declaration is a statement of the source, never a verified equality.  Each hop
is a join, at most HOPS of them; every outcome, also a failed one, stays a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

HOPS = 8
_KIND = "Theorem|Lemma|Proposition|Corollary|Claim"
_NUMBER = r"[A-Za-z]?\d+(?:\.\d+)*"
DECLARATION = rf"(?i)^(?:{_KIND})\s+{_NUMBER}\.?\s*\(\s*=\s*({_KIND})\s+({_NUMBER})\s*\)"


def declared(statement: Column) -> Column:
    """struct(kind, number) of the declared counterpart, else null."""
    flat = scalar.collapsed(statement)
    found = F.struct(F.lower(F.regexp_extract(flat, DECLARATION, 1)).alias("kind"), F.lower(F.regexp_extract(flat, DECLARATION, 2)).alias("number"))
    return F.when(flat.rlike(DECLARATION), found)


def links(statements: DataFrame) -> DataFrame:
    """paper_id, src, n (counterparts found), dst (the only one) for statements(paper_id, local_id, kind, visible_number, statement) with a declaration."""
    said = statements.select("paper_id", F.col("local_id").alias("src"), declared(F.col("statement")).alias("d")).where("d is not null")
    names = statements.where("visible_number is not null").select(F.col("paper_id").alias("p"), F.col("kind").alias("k"), F.lower("visible_number").alias("v"), "local_id")
    hit = said.join(names, (F.col("paper_id") == F.col("p")) & (F.col("d.kind") == F.col("k")) & (F.col("d.number") == F.col("v")), "left")
    return hit.groupBy("paper_id", "src").agg(F.count("local_id").alias("n"), F.min("local_id").alias("one")).select("paper_id", "src", "n", F.when(F.col("n") == 1, F.col("one")).alias("dst"))


def proof_entries(statements: DataFrame, proofs: DataFrame) -> DataFrame:
    """paper_id, local_id, status, proof_of, trail: where a reader of each statement finds a proof.

    proofs: paper_id, owner.  Statuses: direct, corresponding_proof, not_found,
    corresponding_proof_not_found, ambiguous_correspondence, missing_correspondence_target,
    correspondence_cycle, correspondence_hop_limit.
    """
    owned = proofs.where("owner is not null").select("paper_id", F.col("owner").alias("at"), F.lit(True).alias("has")).distinct()
    edge = links(statements).withColumnRenamed("src", "at")
    rows = statements.select("paper_id", "local_id", F.col("local_id").alias("at"), F.array().cast("array<string>").alias("trail"), F.lit(None).cast("string").alias("status"))
    for hop in range(HOPS + 1):
        open_ = F.col("status").isNull()
        rows = rows.join(owned, ["paper_id", "at"], "left").join(edge, ["paper_id", "at"], "left")
        moved = F.size("trail") > 0
        status = (
            F.when(F.array_contains("trail", F.col("at")), "correspondence_cycle")
            .when(F.col("has"), F.when(moved, "corresponding_proof").otherwise("direct"))
            .when(F.col("n").isNull(), F.when(moved, "corresponding_proof_not_found").otherwise("not_found"))
            .when(F.col("n") > 1, "ambiguous_correspondence").when(F.col("n") == 0, "missing_correspondence_target")
            .when(F.lit(hop == HOPS), "correspondence_hop_limit")
        )
        status = F.when(open_, status).otherwise(F.col("status"))
        go = status.isNull()
        rows = rows.select("paper_id", "local_id", F.when(go, F.col("dst")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("trail", F.col("at"))).otherwise(F.col("trail")).alias("trail"), status.alias("status"))
    proof_of = F.when(F.col("status").isin("direct", "corresponding_proof"), F.col("at"))
    return rows.select("paper_id", "local_id", "status", proof_of.alias("proof_of"), "trail")
