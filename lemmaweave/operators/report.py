"""Paper map, triage and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import extract, graph

#: Reasons for a main result and their weights (fixed values).
WEIGHTS = {"theorem": 3, "titled": 2, "early": 1, "has_proof": 1, "used": 1}


def main_results(docs: DataFrame, k: int = 5) -> DataFrame:
    """paper_id, rank, local_id, score, reasons: the best k results of each paper; ties go by position."""
    rows = extract.results(docs)
    early = F.row_number().over(Window.partitionBy("paper_id").orderBy("position")) <= 3
    proved = docs.select("paper_id", F.inline("proofs")).where("owner is not null").select("paper_id", F.col("owner").alias("local_id")).distinct().withColumn("_proof", F.lit(True))
    used = extract.dependency_edges(docs).select("paper_id", F.col("dst").alias("local_id")).distinct().withColumn("_used", F.lit(True))
    rows = rows.withColumn("_early", early).join(proved, ["paper_id", "local_id"], "left").join(used, ["paper_id", "local_id"], "left")
    hits = {"theorem": F.col("normalized_kind") == "theorem", "titled": F.col("title").isNotNull(), "early": F.col("_early"), "has_proof": F.col("_proof").isNotNull(), "used": F.col("_used").isNotNull()}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in hits.items()]))
    score = sum((F.when(c, WEIGHTS[n]).otherwise(0) for n, c in hits.items()), F.lit(0))
    rows = rows.select("paper_id", "local_id", "position", score.alias("score"), reasons.alias("reasons"))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "position", "local_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("position")


def triage(docs: DataFrame) -> DataFrame:
    """paper_id, counts and status, the most pressing first: external_blocked, proofs_missing, sparse, usable, manual."""
    per = lambda df, name, cond=None: df.groupBy("paper_id").agg((F.count("*") if cond is None else F.count_if(cond)).alias(name))
    out = docs.select("paper_id", "error")
    counts = {
        "n_results": per(extract.results(docs), "n_results"), "n_proofs": per(docs.select("paper_id", F.inline("proofs")), "n_proofs"),
        "n_edges": per(extract.dependency_edges(docs), "n_edges"),
        "n_blocked": per(extract.citation_records(docs), "n_blocked", F.col("arxiv_id").isNull()),
    }
    for df in counts.values():
        out = out.join(df, "paper_id", "left")
    out = out.fillna(0, list(counts))
    status = F.when(F.col("n_blocked") > 0, "external_blocked").when((F.col("n_results") > 0) & (F.col("n_proofs") == 0), "proofs_missing").when((F.col("n_results") >= 3) & (F.col("n_edges") <= 1), "sparse").when(F.col("n_results") > 0, "usable").otherwise("manual")
    return out.withColumn("status", status)


def escaped(text: str) -> str:
    for c in "\\`*_[]<>|":
        text = text.replace(c, "\\" + c)
    return " ".join(text.split())


def reading_report(docs: DataFrame, paper_id: str) -> str:
    """Markdown of one paper; unknowns are named, not left out."""
    one = docs.where(F.col("paper_id") == paper_id)
    head = one.select("title", "error").first()
    if head is None:
        raise KeyError(paper_id)
    lines = [f"# {escaped(head.title or paper_id)}", ""]
    if head.error:
        lines += [f"Not readable: {escaped(head.error)}", ""]
    lines += ["## Main results", ""] + [f"{r.rank}. {escaped(r.local_id)} (score {r.score}: {', '.join(r.reasons)})" for r in main_results(one).orderBy("rank").collect()]
    lines += ["", "## Reading orders", ""]
    for r in graph.reading_paths(extract.dependency_edges(one)).orderBy("root").collect():
        lines.append(f"- {escaped(r.root)}: {r.order_status}; " + " < ".join(map(escaped, r.bottom_up or r.top_down)))
    lines += ["", "## Unresolved", ""]
    lines += [f"- proof {r.proof}: {escaped(r.ref_label)} ({r.resolution_status})" for r in extract.proof_mentions(one).where("resolution_status <> 'resolved_unique'").orderBy("proof", "ord").collect()]
    lines += [f"- citation {escaped(r.key)} ({r.resolution_status})" for r in extract.citation_records(one).where("arxiv_id is null").orderBy("position", "key").collect()]
    return "\n".join(lines) + "\n"
