"""Reviews on a fixture with two proofs of a result, a cycle and open citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmaweave.operators import extract, review

CHAIN = r"""\newtheorem{thm}{Theorem}
\begin{thm}\label{c} z \end{thm}
\begin{proof} Clear. \end{proof}
\begin{thm}\label{b} y \ref{c} \ref{a} \end{thm}
\begin{proof} By \ref{c} and \ref{d}. \end{proof}
\begin{thm}\label{d} w \end{thm}
\begin{thm}\label{a} x \end{thm}
\begin{proof} By \ref{b} and \cite{none} and \cite{gone}. \end{proof}
"""
CYCLE = r"""\newtheorem{thm}{Theorem}
\begin{thm}\label{a} x \end{thm}
\begin{proof} By \ref{b}. \end{proof}
\begin{thm}\label{b} y \end{thm}
\begin{proof} By \ref{a}. \end{proof}
"""


def docs(spark):
    rows = [("local:p", "m.tex", {"m.tex": CHAIN}), ("local:q", "m.tex", {"m.tex": CYCLE}), ("local:e", "m.tex", {"m.tex": ""})]
    return extract.documents(spark.createDataFrame(rows, "paper_id string, main string, files map<string,string>"))


def test_proofs_behind_a_result(spark):
    d = docs(spark)
    got = sorted((r.paper_id, r.root, r.position, r.node) for r in review.proofs_behind(d).collect())
    # d has no proof, so it has no row; the root of a cycle is not behind itself
    assert got == [("local:p", "a", 0, "b"), ("local:p", "a", 1, "c"), ("local:p", "b", 0, "c"), ("local:q", "a", 0, "b"), ("local:q", "b", 0, "a")]
    two = d.withColumn("proofs", F.transform("proofs", lambda p: p.withField("number", F.when(p["owner"] == "a", 10).otherwise(9).cast("bigint")).withField("owner", F.lit("a"))))
    assert {r.paper_id: r.proof for r in review.first_proofs(two).collect()} == {"local:p": 10, "local:q": 10}
    assert review.proofs_behind(d.limit(0)).count() == 0


def test_summaries_and_steps(spark):
    d = docs(spark)
    refs = {(r.paper_id, r.local_id): r.refs for r in review.theorem_summaries(d).collect()}
    assert refs["local:p", "b"] == ["a", "c"] and refs["local:p", "c"] == []
    steps = sorted((r.paper_id, r.position, r.kind, r.source, r.target) for r in review.next_steps(d).collect())
    assert steps == [("local:e", 0, "manual_review", None, None), ("local:p", 0, "read_supported_chain", "a", "b"), ("local:p", 1, "resolve_external_blocker", None, "gone"), ("local:p", 2, "resolve_external_blocker", None, "none"), ("local:q", 0, "review_dependency_cycle", None, None)]
    said = spark.createDataFrame([("sparse",), ("other",), (None,)], "s string").select(review.headline(F.col("s"))).collect()
    assert [r[0] for r in said] == [review.HEADLINES[x] for x in ("sparse", "manual", "manual")]


def test_import_reviews(spark):
    rows = [("g", "cite", f"{i}", "s", "r1", f"p{i % 2}", "k" if i else "", f"t{i}  x") for i in range(7)]
    rows += [("g", "bibliography_entry", "0", "s", None, None, "[1]", "A work"), ("h", None, None, None, "r", None, None, " "), (None, "cite", "1", "s", "r", "p", "k", "t")]
    got = {r.group_key: r for r in review.import_reviews(spark.createDataFrame(rows, "group_key string, kind string, id string, source string, result_id string, proof_id string, citation_key string, raw_text string")).collect()}
    assert set(got) == {"g", "h"} and got["g"].raw_texts == [f"t{i} x" for i in range(5)]
    assert got["g"].evidence_summary == "Needed by 1 local result through 2 proofs; citation keys: [1], k; cited result evidence: t0 x; t1 x; t2 x; t3 x; t4 x"
    assert got["h"].proof_ids == [] and got["h"].evidence_summary.startswith("Needed by 1 local result through 0 proofs")
