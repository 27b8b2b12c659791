"""Spans, prose mentions, sessions, plans, searches and expansion control on fixtures with edges the tables lack."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lemmaweave.functions import prose, scalar
from lemmaweave.operators import crosspaper, expansion, extract, mentions, search, sessions, spans

MAIN = r"""\newtheorem{thm}{Theorem}
\newtheorem{lem}{Lemma}
\begin{lem}\label{a} x \end{lem}
\input{part}
\begin{proof} By Lemma 1, [Known, Theorem 2.1], [other], \cite[Lemma~3]{known} and Lemma 9; see $[known]$ and [known]. It remains to prove Lemma 1. \end{proof}
\begin{thebibliography}{9} \bibitem{Known} A. arXiv:2001.00001 \end{thebibliography}
"""
PART = "\\begin{thm}\\label{b} y\n\\input{deep} \\end{thm}\n"


def docs(spark):
    rows = [("local:p", "m.tex", {"m.tex": MAIN, "part.tex": PART, "deep.tex": "z \\ref{a}"}), ("arxiv:2001.00001", "m.tex", {"m.tex": ""}), ("local:bad", "m.tex", {"m.tex": "\\input{none}"})]
    return extract.documents(spark.createDataFrame(rows, "paper_id string, main string, files map<string,string>"))


def test_spans_cross_files_and_gaps_stay(spark):
    d = docs(spark)
    own, parts = spans.own_spans(d), spans.segments(d)
    got = {(r.evidence_id, r.ord): r for r in spans.fragments(own, parts).collect()}
    b = [got["local:p::b", i] for i in range(3)]
    assert [r.path for r in b] == ["part.tex", "deep.tex", "part.tex"] and {r.coverage for r in b} == {"complete"}
    text = {"part.tex": PART, "deep.tex": "z \\ref{a}"}
    assert "".join(text[r.path][r.file_start : r.file_end] for r in b).replace("\n", " ").startswith("\\begin{thm}\\label{b} y z \\ref{a}")
    holes = spans.fragments(own, parts.where("path <> 'deep.tex'")).where("evidence_id = 'local:p::b'").collect()
    assert {r.coverage for r in holes} == {"gap"} and len(holes) == 2
    assert {r.coverage for r in spans.fragments(own, parts.limit(0)).collect()} == {"gap"}
    way = spans.trail(d).where("kind = 'entry'").collect()
    assert [(r.evidence_id, r.via, r.path, r.coverage) for r in way] == [("local:p::entry:Known", ["local:p::entry:Known"], "m.tex", "complete")]
    assert MAIN[way[0].file_start : way[0].file_end].startswith("\\bibitem{Known}")


def test_prose(spark):
    assert [(x["kind"], x["number"]) for x in prose.named("By Theorems 1.2, A and 3 and Lemma  B2.1, not Lemmas of others, Corollaries 4 and 5.")] == [("theorem", "1.2"), ("theorem", "A"), ("theorem", "3"), ("lemma", "B2.1"), ("corollary", "4"), ("corollary", "5")]
    found = prose.citations("see [12] and [Ab, Lemma 3] and [x, y]", is_tex=False)
    assert [(x["key"], x["kind"], x["number"]) for x in found] == [("12", None, None), ("Ab", "lemma", "3")]
    assert [t for t in map(lambda r: "ab $x$ \\(y\\) \\[z\\] $$w$$ \\$5 $open"[r[0] : r[1]], prose.math_ranges("ab $x$ \\(y\\) \\[z\\] $$w$$ \\$5 $open"))] == ["$x$", "\\(y\\)", "\\[z\\]", "$$w$$"]


def test_mentions_of_a_proof(spark):
    d = docs(spark)
    cites = sorted((r.method, r.key, r.kind or "", r.resolution_status) for r in mentions.citation_mentions(d).collect())
    assert cites == [("bracket", "Known", "theorem", "resolved_unique"), ("bracket", "known", "", "resolved_unique"), ("command", "known", "lemma", "resolved_unique")]
    outside = {(r.kind, r.number): (r.resolution_status, r.target_paper_id) for r in mentions.external_mentions(d).collect()}
    assert outside == {("theorem", "2.1"): ("resolved_paper", "arxiv:2001.00001"), ("lemma", "3"): ("resolved_paper", "arxiv:2001.00001")}
    local = sorted((r.method, r.raw, r.resolution_status) for r in mentions.local_mentions(d).collect())
    assert local == [("number", "Lemma 9", "unresolved"), ("roadmap", "lemma 1", "resolved_unique")]
    kinds = {(r["class"], r.target) for r in mentions.classified(d).collect()}
    assert {("known_local", "a"), ("unresolved_local", "Lemma 9"), ("known_citation", "Known"), ("resolved_external", "arxiv:2001.00001"), ("inferred", "immediately_follows_result")} == kinds
    whole = {r.paper_id: r for r in mentions.completeness(d).collect()}
    assert whole["local:p"].self_containment == "low" and whole["local:p"].isolated == ["b"] and whole["arxiv:2001.00001"].self_containment == "high"
    reading = {r.root: r for r in mentions.compact(mentions.dependency_reading(d), 1).collect()}
    assert reading["b"].n_external == 2 and len(reading["b"].external) == 1 and reading["a"].proof_local is None


def test_sessions(spark):
    at = datetime(2024, 5, 1, 10)
    asked = spark.createDataFrame([("local:p", at), ("local:p", at), ("local:q", at)], "paper_id string, at timestamp")
    first = sessions.named(asked, spark.createDataFrame([], "session_id string"))
    ids = sorted(r.session_id for r in first.collect())
    assert ids == ["local-p-20240501T100000Z", "local-p-20240501T100000Z-2", "local-q-20240501T100000Z"]
    more = sessions.named(asked.limit(1), first.select("session_id")).collect()
    assert more[0].session_id == "local-p-20240501T100000Z-3"
    log = spark.createDataFrame([("s", "result", "r", "blocked", at, 1), ("s", "external_stop", "x", "queued", at, 2), ("s", "result", "gone", "skipped", at, 3)], "session_id string, target_kind string, target_id string, status string, at timestamp, seq bigint")
    notes = spark.createDataFrame([("s", "question" if i == 2 else "note", str(i), at, i) for i in range(7)], "session_id string, note_type string, text string, at timestamp, seq bigint")
    owners = spark.createDataFrame([("s", "local:p", "r2", at), ("t", "local:q", None, at)], "session_id string, paper_id string, target_id string, at timestamp")
    got = {r.session_id: r for r in sessions.summaries(owners, log, notes).collect()}
    assert got["s"].next_actions == ["review_blocked_targets", "continue_queued_targets", "review_target_result", "answer_or_retire_open_questions"]
    assert [x.text for x in got["s"].latest] == ["6", "5", "4", "3", "2"] and got["t"].next_actions == [] and got["t"].n_targets == 0
    assert [r.target_id for r in sessions.invalid_targets(log, spark.createDataFrame([("result", "r")], "target_kind string, target_id string")).collect()] == ["gone"]
    assert {r.session_id: (r.n_checkpoints, r.n_notes) for r in sessions.listed(owners, log, notes).collect()} == {"s": (3, 7), "t": (0, 0)}
    assert sessions.review_notes(log, owners.where("paper_id = 'local:p'"), at).collect()[0].seq == 2


def test_cross_paper_edges_cases(spark):
    plans = spark.createDataFrame([("x", "p", 0, "limited"), ("x", "q", 1, "sparse"), ("y", "p", 0, "limited")], "plan_id string, paper_id string, input int, status string")
    none = spark.createDataFrame([], "plan_id string, paper_id string, result_id string, score int, position int, focus boolean")
    edges = spark.createDataFrame([("x", "p", "q", 1)], "plan_id string, source string, target string, ord int")
    got = [(r.plan_id, r.position, r.paper_id, r.role) for r in crosspaper.sequence(plans, none, edges).orderBy("plan_id", "position").collect()]
    assert got == [("x", 1, "q", "context"), ("x", 2, "p", "review"), ("y", 1, "p", "review")]
    imports = spark.createDataFrame([("p", "q", "g"), ("p", None, "h")], "paper_id string, target string, group_key string")
    risk = crosspaper.risks(plans, imports, edges)
    assert sorted((r.plan_id, r.kind, r.target) for r in risk.collect()) == [("x", "blocked", "h"), ("y", "blocked", "h"), ("y", "external_candidate", "q")]
    head = crosspaper.summary(plans, none, edges, risk)
    assert {r.plan_id: (r.evidence_status, r.start_paper) for r in head.collect()} == {"x": ("sparse", None), "y": ("limited", None)}
    facts = spark.createDataFrame([("y", True, False, 1, 2)], "plan_id string, focus_asked boolean, focus_matched boolean, n_cyclic int, n_missing_proof int")
    said = {r.plan_id: r.warnings for r in crosspaper.warnings(head, facts).collect()}
    assert said["y"] == list(crosspaper.WARNINGS) and said["x"] == ["no_main_candidate", "unresolved_references", "sparse_evidence"]


def test_searches(spark):
    blocked = spark.createDataFrame([("b", 0, "citation", "k2", "[7]"), ("b", 1, "bibliography_entry", "k1", "[7] A. Smith and B. Jones. On the shape of drums. Journal, 1966."), ("b", 2, "citation", " ", "[7]"), ("c", 0, None, None, None)], "blocked_id string, ord int, kind string, citation_key string, raw_text string")
    hint = {r.blocked_id: r for r in search.hints(blocked).collect()}
    assert hint["b"].citation_keys == ["k1", "k2"] and hint["b"].citation_texts == ["[7]"] and hint["b"].year_hint == "1966"
    assert hint["b"].title_hint == "Smith and B" and hint["c"].title_hint is None and hint["c"].bibliography_text == ""
    fixed = search.hints(blocked).withColumn("title_hint", F.lit("On the shape of drums")).withColumn("author_hints", F.array(F.lit("Smith"), F.lit("Jones")))
    rows = [("b", 0, "x", "The shape of drum", ["Smith"], "1966", None, None, "http://u"), ("b", 0, "y", "Shape of drums", ["Jones", "Smith"], "1966", None, "2001.00001", None), ("b", 0, "z", "Other", None, None, None, None, None)]
    found = search.candidates(fixed, spark.createDataFrame(rows, "blocked_id string, ord int, provider string, title string, authors array<string>, year string, doi string, arxiv_id string, url string"))
    got = [(r.rank, r.title, r.score, r.confidence, r.evidence) for r in search.ranked(found).orderBy("rank").collect()]
    assert got == [(1, "Shape of drums", 8.8, "strong", ["title_exact_match", "author_overlap:2", "year_exact_match", "arxiv_present"]), (2, "The shape of drum", 4.4, "plausible", ["title_close_match", "author_overlap:1", "year_exact_match"]), (3, "Other", 0.0, "unavailable", [])]
    asked = spark.createDataFrame([("b", ["y", "x"], 10, "v2"), ("b", ["x"], 10, "v2")], "blocked_id string, providers array<string>, max_candidates int, resolver string")
    past = spark.createDataFrame([("old", "b", ["x", "y"], 10, "v2", 1), ("new", "b", ["x", "y", "x"], 10, "v2", 2)], "run_id string, blocked_id string, providers array<string>, max_candidates int, resolver string, at int")
    assert sorted(((len(r.providers), r.run_id) for r in search.reusable(asked, past).collect()), key=str) == [(1, None), (2, "new")]


def test_expansion_control(spark):
    refs = spark.createDataFrame([("r", "n", i) for i in range(30)], "run_id string, node string, ord int")
    none = spark.createDataFrame([], "run_id string, node string, cursor bigint")
    one = expansion.next_pages(refs, none)
    assert one.count() == 25 and {r.cursor for r in one.collect()} == {25}
    two = expansion.next_pages(refs, one.select("run_id", "node", "cursor").distinct())
    assert sorted(r.ord for r in two.collect()) == list(range(25, 30))
    stored = spark.createDataFrame([("r", 1, "a")], "run_id string, event_id int, what string")
    control = spark.createDataFrame([("r", 1, "b"), ("r", -1, "pause"), ("r", -1, "pause")], "run_id string, event_id int, what string")
    assert sorted((r.event_id, r.what) for r in expansion.merged_events(stored, control).collect()) == [(-1, "pause"), (1, "a")]
    roots = spark.createDataFrame([("r", "a")], "run_id string, node string")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "c"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d")], "run_id string, source string, target string")
    assert expansion.rendered(expansion.tree(roots, edges, 5)).split("\n") == ["- a", "  - b", "    - c (shared)", "  - c", "    - a (cycle)", "    - d"]
    work = spark.createDataFrame([("r", 1, "p", "edge", "2"), ("r", 1, "p", "discover", "9"), ("r", 0, "z", "edge", "1")], "run_id string, depth int, source string, kind string, item_id string")
    assert [r.item_id for r in expansion.work(work).orderBy("position").collect()] == ["1", "9", "2"]


def test_labels(spark):
    row = spark.createDataFrame([(None, "lemma", "2", "id"), (None, "lemma", None, "id"), ("L", "lemma", "2", "id")], "a string, b string, c string, d string")
    assert [r[0] for r in row.select(scalar.display_label(*map(F.col, "abcd"))).collect()] == ["lemma 2", "id", "L"]


def test_a_paper_that_comes_anew_keeps_nothing_old(spark, tmp_path):
    import pytest

    from lemmaweave.api import Workspace
    from lemmaweave.sources import store

    both = docs(spark).where("error is null").persist()
    path = str(tmp_path / "results")
    store.replace_papers(extract.results(both), path, both)
    assert spark.read.parquet(path).count() == 2
    bare = extract.documents(spark.createDataFrame([("local:p", "m.tex", {"m.tex": "nothing"})], "paper_id string, main string, files map<string,string>"))
    store.replace_papers(extract.results(bare), path, bare)
    assert spark.read.schema(extract.results(both).schema).parquet(path).count() == 0
    twice = spark.createDataFrame([("local:p", "m.tex", {"m.tex": "old"}, 1), ("local:p", "m.tex", {"m.tex": "new"}, 2)], "paper_id string, main string, files map<string,string>, seq int")
    assert [r.files["m.tex"] for r in store.latest(twice).collect()] == ["new"]
    space = Workspace(spark, str(tmp_path / "w"))
    both.select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / "json"))
    space.add_evidence(store.read_evidence(spark, str(tmp_path / "json"), extract.DOCUMENT))
    assert {r.paper_id: r.n_results for r in space.list_papers().collect()} == {"local:p": 2, "arxiv:2001.00001": 0}
    with pytest.raises(store.InvalidEvidence):
        space.add_evidence(both.withColumn("paper_id", F.lit("p")))
