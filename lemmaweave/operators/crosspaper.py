"""Reading plans over several papers: where to start, what to read for context, what is missing.

plans: plan_id, paper_id, input (order given), status.  candidates: plan_id, paper_id, result_id, score,
position, focus (whether it matches what the reader asked for).  edges: plan_id, source, target, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Warnings, the most pressing first (fixed values).
WARNINGS = ("dependency_cycle", "focus_no_match", "no_cross_paper_edges", "no_main_candidate", "external_dependencies", "unresolved_references", "missing_proof", "sparse_evidence")


def starts(plans: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, paper_id, result_id, score, focus of the candidate to begin with.

    Order: matches the focus, its paper cites another of the plan, score, order given, place, id.
    """
    cites = edges.select("plan_id", F.col("source").alias("paper_id")).distinct().withColumn("_cites", F.lit(True))
    rows = candidates.join(plans.select("plan_id", "paper_id", "input"), ["plan_id", "paper_id"]).join(cites, ["plan_id", "paper_id"], "left")
    order = Window.partitionBy("plan_id").orderBy(F.desc(F.coalesce("focus", F.lit(False))), F.col("_cites").isNull(), F.desc("score"), "input", "position", "result_id")
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("plan_id", "paper_id", "result_id", "score", "focus")


def sequence(plans: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, position, paper_id, result_id, role, reason: every paper of a plan once, at its first place.

    start: the best candidate; context: cited papers in the order of the citations; continue or review: the
    rest in the order given, with or without a candidate of their own.
    """
    first = Window.partitionBy("plan_id", "paper_id").orderBy(F.desc("score"), "position", "result_id")
    own = candidates.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("plan_id", "paper_id", F.col("result_id").alias("_own"))
    row = lambda df, section, ord_, result, role, reason: df.select("plan_id", "paper_id", F.lit(section).alias("_section"), ord_.cast("long").alias("_ord"), result.cast("string").alias("result_id"), role.alias("role"), F.lit(reason).alias("reason"))
    none = F.lit(None)
    start = row(starts(plans, candidates, edges), 0, F.lit(0), F.col("result_id"), F.lit("start"), "selected_main_candidate")
    context = row(edges.select("plan_id", F.col("target").alias("paper_id"), "ord"), 1, F.col("ord"), none, F.lit("context"), "selected_paper_citation")
    rest = row(plans.join(own, ["plan_id", "paper_id"], "left"), 2, F.col("input"), F.col("_own"), F.when(F.col("_own").isNull(), "review").otherwise("continue"), "input_order")
    rows = start.unionByName(context).unionByName(rest)
    best = rows.groupBy("plan_id", "paper_id").agg(F.min(F.struct("_section", "_ord", "result_id", "role", "reason")).alias("x")).select("plan_id", "paper_id", "x.*")
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("_section", "_ord", "paper_id"))
    return best.withColumn("position", place).select("plan_id", "position", "paper_id", "result_id", "role", "reason")


def risks(plans: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, paper_id, kind (external_candidate or blocked), target.  imports: paper_id, target (a paper id, or null), group_key.

    What a plan already has and cites is no risk.
    """
    rows = plans.select("plan_id", "paper_id").join(imports, "paper_id")
    have = edges.select("plan_id", F.col("source").alias("paper_id"), "target")
    rows = rows.join(have, ["plan_id", "paper_id", "target"], "left_anti")
    return rows.select("plan_id", "paper_id", F.when(F.col("target").isNull(), "blocked").otherwise("external_candidate").alias("kind"), F.coalesce("target", "group_key").alias("target"))


def summary(plans: DataFrame, candidates: DataFrame, edges: DataFrame, risk: DataFrame) -> DataFrame:
    """One row per plan: counts, where to start, and how good the evidence is: usable if any paper is, else sparse, else limited."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    head = plans.groupBy("plan_id").agg(F.count("*").alias("n_papers"), F.when(any_("usable"), "usable").when(any_("sparse"), "sparse").otherwise("limited").alias("evidence_status"))
    count = lambda df, name, when=None: df.groupBy("plan_id").agg((F.count("*") if when is None else F.count_if(when)).alias(name))
    parts = {"n_candidates": count(candidates, "n_candidates"), "n_edges": count(edges, "n_edges"), "n_external": count(risk, "n_external", F.col("kind") == "external_candidate"), "n_blocked": count(risk, "n_blocked", F.col("kind") == "blocked")}
    for part in parts.values():
        head = head.join(part, "plan_id", "left")
    start = starts(plans, candidates, edges).select("plan_id", F.col("paper_id").alias("start_paper"), F.col("result_id").alias("start_result"))
    return head.fillna(0, list(parts)).join(start, "plan_id", "left")


def warnings(summaries: DataFrame, facts: DataFrame) -> DataFrame:
    """plan_id, warnings in their order.  facts: plan_id, focus_asked, focus_matched, n_cyclic, n_missing_proof."""
    rows = summaries.join(facts, "plan_id", "left").fillna(0, ["n_cyclic", "n_missing_proof"]).fillna(False, ["focus_asked", "focus_matched"])
    when = {
        "dependency_cycle": F.col("n_cyclic") > 0, "focus_no_match": F.col("focus_asked") & ~F.col("focus_matched"), "no_cross_paper_edges": F.col("n_edges") == 0,
        "no_main_candidate": F.col("n_candidates") == 0, "external_dependencies": F.col("n_external") > 0, "unresolved_references": F.col("n_blocked") > 0,
        "missing_proof": F.col("n_missing_proof") > 0, "sparse_evidence": F.col("evidence_status") != "usable",
    }
    return rows.select("plan_id", F.array_compact(F.array(*[F.when(when[w], F.lit(w)) for w in WARNINGS])).alias("warnings"))
